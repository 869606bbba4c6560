"""Feature-table operators and the isolation forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternflow.catalog import shared
from lanternflow.catalog.registry import query, r6
from lanternflow.catalog.views import FLOWS, flows, table
from lanternflow.catalog.windows import multiscale_sql
from lanternflow.functions import content
from lanternflow.operators import iforest, tabular
from lanternflow.operators.splits import content_hash_split
from lanternflow.operators.windows import multiscale_features, multiscale_names
from lanternflow.session import durable


@query("B19_clean_features", """SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS DOUBLE) AS n_chars, 0.0 AS missing,
 CAST(doc_id % 7 AS INT) AS kind FROM documents WHERE doc_id % 10 <> 0""")
def clean_features(spark, sf):
    raw = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "n/a").otherwise(F.col("n_chars").cast("string")).alias("n_chars"),
        (F.col("doc_id") % 7).cast("string").alias("kind"), (F.col("doc_id") % 10 != 0).cast("int").alias("ok"))
    return tabular.clean_features(raw, ["n_chars", "missing"], ["kind"]).drop("ok")


@query("I1_symbol_entropy", """SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p
 FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY ALL)) GROUP BY 1""")
def symbol_entropy(spark, sf):
    return content.symbol_entropy(table(spark, sf, "documents"), "doc_id", F.col("text")).select("doc_id", r6("entropy").alias("entropy"))


@query("I1_byte_entropy", """SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p
 FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS c FROM documents) GROUP BY ALL)) GROUP BY 1""")
def byte_entropy(spark, sf):
    blobs = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return blobs.select("doc_id", r6(content.byte_entropy(F.col("content"))).alias("entropy"))


@query("I2_content_digest", "SELECT doc_id, sha256(text) AS digest FROM documents")
def digest(spark, sf):
    return table(spark, sf, "documents").select("doc_id", content.sha256_hex(F.col("text")).alias("digest"))


_SPLIT = """s AS (SELECT *, CASE WHEN CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 1000 < 800 THEN 'train' ELSE 'val' END AS split FROM documents)"""


def _split(spark, sf):
    return content_hash_split(table(spark, sf, "documents"), F.sha2("text", 256), 0.2)


@query("I3_standardize", f"""WITH {_SPLIT}, f AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM s WHERE split = 'train')
SELECT doc_id, round((n_chars - m) / CASE WHEN d < 1e-8 THEN 1 ELSE d END, 6) AS n_chars, 0.0 AS flat FROM s CROSS JOIN f""")
def standardize(spark, sf):
    rows = _split(spark, sf).withColumn("flat", F.lit(3.0))
    fitted = tabular.fit_standardizer(rows.filter(F.col("split") == "train"), ["n_chars", "flat"])
    return tabular.standardize(rows, fitted).select("doc_id", r6("n_chars").alias("n_chars"), "flat")


@query("I4_category_ids", f"""WITH {_SPLIT}, v AS (SELECT source, row_number() OVER (ORDER BY source) AS id FROM (SELECT DISTINCT source FROM s
 WHERE split = 'train' AND lang <> 'de')) SELECT doc_id, CAST(coalesce(id, 0) AS INT) AS source_id FROM s LEFT JOIN v USING (source)""")
def category_ids(spark, sf):
    rows = _split(spark, sf)
    fitted = tabular.fit_categories(rows.filter((F.col("split") == "train") & (F.col("lang") != "de")), "source")
    return tabular.with_category_ids(rows, "source", fitted).select("doc_id", "source_id")


def _rated(spark, sf):
    """Labelled documents with a probability that is too sure of itself."""
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    p = 1.0 / (1.0 + F.exp(-(F.col("n_chars") - 800.0) / 120.0))
    return tabular.with_logit(l.join(d, "doc_id").select("doc_id", F.col("quality").alias("label"), p.alias("p")), "p")


@query("I5_temperature", """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, quality AS y, ln(p / (1 - p)) AS z FROM (SELECT doc_id, quality,
  least(greatest(1 / (1 + exp(-(n_chars - 800.0) / 120.0)), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p FROM labels JOIN documents USING (doc_id))),
 cut AS (SELECT 0 AS i, 1e-6::DOUBLE AS lo, 1048576.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN up THEN lo ELSE sqrt(lo * hi) END, CASE WHEN up THEN sqrt(lo * hi) ELSE hi END FROM
   (SELECT *, (SELECT sum((1 / (1 + exp(-sqrt(lo * hi) * z)) - y) * z) > 0 FROM d) AS up FROM cut WHERE i < 60)),
 t AS (SELECT 1 / sqrt(lo * hi) AS t FROM cut WHERE i = 60)
SELECT doc_id, y AS label, round(1 / (1 + exp(-z / t)), 6) AS p, round(t, 6) AS temperature FROM d CROSS JOIN t""")
def temperature(spark, sf):
    rated = durable(_rated(spark, sf))
    t = tabular.fit_temperature(rated, "logit", "label")
    return tabular.calibrated(rated, "logit", t).select("doc_id", "label", r6("p").alias("p"), r6(F.lit(t)).alias("temperature"))


@query("I6_evaluation_row", """WITH d AS (SELECT quality AS y, least(greatest(1 / (1 + exp(-(n_chars - 800.0) / 120.0)), 1e-6), 1 - 1e-6) AS p FROM labels JOIN documents USING (doc_id)),
 c AS (SELECT sum(y) OVER w AS tp, sum(1 - y) OVER w AS fp, sum(y) OVER () AS np, sum(1 - y) OVER () AS nn FROM d
  WINDOW w AS (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT any_value(np + nn) AS val_size, round(any_value(np / (np + nn)), 6) AS positive_rate, 2.0::DOUBLE AS temperature,
 round(coalesce(max(tp / np) FILTER (fp / nn <= 0.01), 0), 6) AS tpr_at_fpr_1pct,
 round(coalesce(max(tp / np) FILTER (fp / nn <= 0.001), 0), 6) AS tpr_at_fpr_0_1pct FROM c""")
def evaluation_row(spark, sf):
    rows = tabular.calibrated(_rated(spark, sf), "logit", 2.0)
    e = tabular.evaluation_row(rows, "p", "label", 2.0)
    return e.select("val_size", "temperature", *[r6(c).alias(c) for c in ("positive_rate", "tpr_at_fpr_1pct", "tpr_at_fpr_0_1pct")])


def forest_sql(fit: str, rows: str, names, seed: int, trees: int = iforest.TREES, sample: int = iforest.SAMPLE) -> str:
    """Common table expressions that end in ``forest(event_row_id, isolation_forest)``: grown on ``fit``, scored over ``rows``."""
    limit = (sample - 1).bit_length()
    number = lambda at: f"CAST('0x' || substr(h, {at}, 15) AS BIGINT)"
    x = "[" + ", ".join(names) + "]"
    spread = ", ".join(f"{{'i': {i}, 'lo': min({f}) OVER w, 'hi': max({f}) OVER w}}" for i, f in enumerate(names))
    rounded = ", ".join(f"round({f}, {iforest.PLACES}) AS {f}" for f in names)
    path = lambda n: (f"CASE WHEN {n} <= 1 THEN 0.0::DOUBLE WHEN {n} = 2 THEN 1.0::DOUBLE "  # noqa: E731
                      f"ELSE 2 * (ln({n} - 1) + {iforest.EULER_GAMMA}::DOUBLE) - 2 * ({n} - 1.0::DOUBLE) / {n} END")
    out = [f"""fplan AS (SELECT n, c, least(1.0::DOUBLE, {2.0 * trees * sample}::DOUBLE / (n * c)) * {iforest.UNIT}::DOUBLE AS lim FROM
  (SELECT n, greatest(1, ({2 * trees * sample - 1} + greatest(n, 1)) // greatest(n, 1)) AS c FROM (SELECT count(*) AS n FROM {fit}))),
fdraw AS (SELECT *, {number(1)} % {trees} AS tree_id, {number(16)} AS u FROM
  (SELECT *, sha256('{seed}:' || copy || ':' || event_row_id) AS h FROM (SELECT event_row_id, {rounded}, unnest(range(c)) AS copy FROM {fit} CROSS JOIN fplan))),
g0 AS MATERIALIZED (SELECT tree_id, 1 AS node, {', '.join(names)} FROM (SELECT * FROM fdraw CROSS JOIN fplan WHERE u < lim
  QUALIFY row_number() OVER (PARTITION BY tree_id, event_row_id ORDER BY u) = 1)
  QUALIFY row_number() OVER (PARTITION BY tree_id ORDER BY u, event_row_id) <= {sample})"""]
    for d in range(limit + 1):
        out.append(f"""a{d} AS (SELECT *, count(*) OVER w AS n, sha256('{seed}:' || tree_id || ':' || node) AS h,
  list_filter([{spread}], lambda c: c.hi > c.lo) AS ok FROM g{d} WINDOW w AS (PARTITION BY tree_id, node)),
p{d} AS MATERIALIZED (SELECT *, s.lo + {number(16)} / {float(iforest.UNIT)}::DOUBLE * (s.hi - s.lo) AS cut FROM
  (SELECT *, CASE WHEN len(ok) > 0 AND {d} < {limit} THEN ok[{number(1)} % len(ok) + 1] END AS s FROM a{d})),
g{d + 1} AS (SELECT * EXCLUDE (n, h, ok, s, cut, node), CASE WHEN s IS NULL THEN node ELSE 2 * node + CAST({x}[s.i + 1] > cut AS INT) END AS node FROM p{d})""")
    cells = " UNION ALL ".join(f"SELECT tree_id, node, coalesce(s.i, -1) AS feature, coalesce(cut, 0) AS cut, n FROM p{d}" for d in range(limit + 1))
    out.append(f"""nodes AS MATERIALIZED (SELECT tree_id, node, max(feature) AS feature, max(cut) AS cut, max(n) AS n FROM ({cells}) GROUP BY ALL),
leaves AS MATERIALIZED (SELECT tree_id, node, (floor(log2(node)) + {path('n')}) / greatest(any_value({path('n')}) FILTER (node = 1) OVER (PARTITION BY tree_id), 1e-12) AS depth,
  feature FROM nodes),
w0 AS (SELECT event_row_id, tree_id, 1 AS node, {x} AS x FROM (SELECT event_row_id, {rounded} FROM {rows}) CROSS JOIN (SELECT DISTINCT tree_id FROM nodes))""")
    for d in range(limit):
        out.append(f"""w{d + 1} AS (SELECT w.event_row_id, w.tree_id, CASE WHEN feature < 0 THEN w.node ELSE 2 * w.node + CAST(x[feature + 1] > cut AS INT) END AS node, x
  FROM w{d} w JOIN nodes USING (tree_id, node))""")
    out.append(f"""forest AS (SELECT event_row_id, power(2.0::DOUBLE, -avg(depth)) AS isolation_forest FROM w{limit} JOIN leaves USING (tree_id, node) GROUP BY 1)""")
    return ",\n".join(out)


_WIDTHS = (8, 32, 128)
_ORDER = '"timestamp", event_row_id'


@query("E11_isolation_forest", f"""WITH {FLOWS}, ftrain AS MATERIALIZED ({multiscale_sql("(SELECT * FROM flows WHERE split = 'train' AND label = 'BENIGN')", _WIDTHS,
       _ORDER, "event_row_id", rounded=False)}),
 frows AS MATERIALIZED ({multiscale_sql("(SELECT * FROM flows WHERE split <> 'train')", _WIDTHS, _ORDER, "event_row_id", rounded=False)}),
 {forest_sql("ftrain", "frows", multiscale_names(_WIDTHS), 42)}
SELECT event_row_id, round(isolation_forest, 6) AS isolation_forest FROM forest""")
def isolation_forest(spark, sf):
    """Forest on the training behaviour, scores for every later event."""
    names = multiscale_names(_WIDTHS)
    train = durable(multiscale_features(shared.benign_train(spark, sf), _WIDTHS).select("event_row_id", *names))
    forest = iforest.fit_forest(train, "event_row_id", names, 42)
    rows = multiscale_features(flows(spark, sf).filter(F.col("split") != "train"), _WIDTHS)
    return iforest.with_isolation_score(rows, forest, names).select("event_row_id", r6("isolation_forest").alias("isolation_forest"))
