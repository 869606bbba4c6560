"""Window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternflow.catalog import shared
from lanternflow.catalog.chain import CHAIN, MODEL, TOKENS
from lanternflow.catalog.registry import query, r6
from lanternflow.catalog.views import FLOWS, flows, supplier_flows
from lanternflow.operators import windows as W
from lanternflow.operators.scale import positions
from lanternflow.operators.tokens import tokenize
from lanternflow.schema import TIME_ORDER, WINDOW_FEATURES

FEATS = ", ".join(f"round({f}, 6) AS {f}" for f in WINDOW_FEATURES)


def _tokens(spark, sf):
    return tokenize(flows(spark, sf), shared.tokenizer(spark, sf))


@query("D1_sequences", f"""WITH {TOKENS}, s AS (SELECT *, row_number() OVER w - 1 AS pos,
 list(token_id) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_row_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS ctx
 FROM tok WINDOW w AS (PARTITION BY entity_id ORDER BY "timestamp", event_row_id))
SELECT event_row_id, array_to_string(ctx, ',') AS context, CAST(token_id AS INT) AS target, label, epoch_us("timestamp") AS at
FROM s WHERE pos >= 3""")
def sequences(spark, sf):
    s = W.sequences(_tokens(spark, sf), 3)
    return s.select("event_row_id", F.concat_ws(",", F.col("context").cast("array<string>")).alias("context"),
                    F.col("token_id").alias("target"), "label", F.unix_micros("timestamp").alias("at"))


@query("D1_sequences_step", f"""WITH {TOKENS}, s AS (SELECT *, row_number() OVER (PARTITION BY entity_id
 ORDER BY "timestamp", event_row_id) - 1 AS pos FROM tok)
SELECT event_row_id, pos FROM s WHERE pos >= 3 AND (pos - 3) % 4 = 0""")
def sequences_step(spark, sf):
    return W.sequences(_tokens(spark, sf), 3, 4).select("event_row_id", "pos")


@query("D2_window_features", f"WITH {CHAIN} SELECT event_row_id, {FEATS} FROM wst")
def window_features(spark, sf):
    rows = _tokens(spark, sf).filter(F.col("split") != "train")
    return W.window_features(rows, 3).select("event_row_id", *[r6(f).alias(f) for f in WINDOW_FEATURES])


@query("D2_window_features_per_split", f"WITH {CHAIN} SELECT event_row_id, split, {FEATS} FROM wds")
def window_features_per_split(spark, sf):
    rows = _tokens(spark, sf).filter(F.col("split") != "train")
    return W.window_features(rows, 3, keys=["split", "entity_id"]).select(
        "event_row_id", "split", *[r6(f).alias(f) for f in WINDOW_FEATURES])


def multiscale_sql(source: str, widths, order: str, key: str, rounded: bool = True) -> str:
    cols, frames, out = [], [], []
    r, d = ("round", ", 6") if rounded else ("", "")
    for n in widths:
        now, past = f"n{n}", f"p{n}"
        frames += [f"{now} AS (PARTITION BY entity_id ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)",
                   f"{past} AS (PARTITION BY entity_id ORDER BY {order} ROWS BETWEEN {2 * n - 1} PRECEDING AND {n} PRECEDING)"]
        cols += [f"count(*) OVER {now} AS k{n}, first(\"timestamp\") OVER {now} AS a{n}, list(event_type) OVER {now} AS e{n}, "
                 f"list(port) OVER {now} AS o{n}, list(dst_id) OVER {now} AS d{n}, list(dst_id) OVER {past} AS b{n}, "
                 f"avg(x) OVER {now} AS m{n}, stddev_pop(x) OVER {now} AS s{n}"]
        out += [f"{r}(k{n} / greatest((epoch_us(\"timestamp\") - epoch_us(a{n})) / 1e6, 1.0){d}) AS w{n}_rate",
                f"{r}(list_max(list_transform(list_distinct(e{n}), lambda v: len(list_filter(e{n}, lambda y: y = v)))) / k{n}{d}) AS w{n}_repetition",
                f"{r}(len(list_filter(list_distinct(d{n}), lambda v: NOT list_contains(coalesce(b{n}, []), v)))"
                f" / greatest(len(list_distinct(d{n})), 1){d}) AS w{n}_peer_novelty",
                f"CAST(len(list_distinct(o{n})) AS DOUBLE) AS w{n}_port_diversity",
                f"{r}(m{n}{d}) AS w{n}_bytes_mean", f"{r}(s{n}{d}) AS w{n}_bytes_std",
                f"CAST(len(list_distinct(d{n})) AS DOUBLE) AS w{n}_fanout"]
    return (f"WITH x AS (SELECT *, ln(1 + greatest(bytes, 0)) AS x, split_part(event_type, ':', -1) AS port FROM {source}), "
            f"f AS (SELECT *, {', '.join(cols)} FROM x WINDOW {', '.join(frames)}) SELECT {key}, {', '.join(out)} FROM f")


@query("D3_multiscale_features", f"WITH {FLOWS} SELECT * FROM (" + multiscale_sql(
    "flows", (8, 32, 128), '"timestamp", event_row_id', "event_row_id") + ")")
def multiscale(spark, sf):
    return W.multiscale_features(flows(spark, sf)).select(
        "event_row_id", *[r6(c).alias(c) for c in W.multiscale_names((8, 32, 128))])


SUPPLIER = """supplier_flows AS (SELECT l_orderkey * 8 + l_linenumber AS event_row_id, l_shipdate AS "timestamp",
 CAST(l_suppkey AS VARCHAR) AS entity_id, l_returnflag || ':' || l_linenumber AS event_type,
 CAST(l_partkey AS VARCHAR) AS dst_id, l_extendedprice AS bytes FROM lineitem)"""


@query("D3_multiscale_long_entities", f"WITH {SUPPLIER} SELECT * FROM (" + multiscale_sql(
    "supplier_flows", (8, 32, 128), '"timestamp", event_row_id, dst_id, bytes', 'entity_id, event_row_id, dst_id') + ")")
def multiscale_long(spark, sf):
    """Hundreds of rows per entity, many on the same day; the row id is made unique for ties."""
    rows = supplier_flows(spark, sf)
    # Two lines may share order and line number, so the tie key gets the part and price as well.
    rows = rows.withColumn("event_row_id", F.struct("event_row_id", "dst_id", "bytes"))
    out = W.multiscale_features(rows, (8, 32, 128))
    return out.select("entity_id", F.col("event_row_id.event_row_id").alias("event_row_id"), "dst_id",
                      *[r6(c).alias(c) for c in W.multiscale_names((8, 32, 128))])


@query("D4_last_token_accuracy", f"WITH {MODEL} SELECT round(avg(CAST(t1 = token_id AS DOUBLE)), 6) AS last_token_accuracy FROM wtr")
def last_token(spark, sf):
    return W.last_token_accuracy(shared.train_windows(spark, sf)).select(r6("last_token_accuracy").alias("last_token_accuracy"))


@query("D5_position_in_entity", f"""WITH {FLOWS} SELECT event_row_id, row_number() OVER (PARTITION BY entity_id
 ORDER BY "timestamp", event_row_id) - 1 AS pos FROM flows""")
def position(spark, sf):
    return positions(flows(spark, sf), ["entity_id"], TIME_ORDER).select("event_row_id", "pos")
