"""Alert selection, suppression and packets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators.scale import HotKeys, global_rank, hot_keys, positions
from lanternflow.operators.timeblocks import walk_in_blocks
from lanternflow.schema import TIME_ORDER
from lanternflow.session import durable


def passes_allowlist(score: str, threshold: Column, allowlist: Sequence[str], margin: float,
                     destination: str = "dst_id") -> Column:
    """Destinations on the (top-k bounded) list need ``threshold + margin``."""
    if not allowlist:
        return F.lit(True)
    listed = F.coalesce(F.col(destination).isin(list(allowlist)), F.lit(False))
    return ~listed | (F.col(score) >= threshold + F.lit(margin))


def _first_after_gap(seconds: int):
    """Keep instants at least ``seconds`` after the last kept one.

    Rows arrive sorted by entity, segment and time; only the last kept instant is
    carried from batch to batch.
    """
    gap = seconds * 1_000_000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, last = None, 0
        for rows in batches:
            if rows.empty:
                continue
            at = rows["at"].to_numpy()
            entity, segment = rows["entity_id"].to_numpy(), rows["segment"].to_numpy()
            new = np.flatnonzero((entity[1:] != entity[:-1]) | (segment[1:] != segment[:-1])) + 1
            keep = []
            for lo, hi in zip(np.r_[0, new], np.r_[new, len(at)]):
                key = (entity[lo], segment[lo])
                i = lo if key != open_key else lo + np.searchsorted(at[lo:hi], last + gap)
                open_key = key
                while i < hi:
                    keep.append(i)
                    last = at[i]
                    i = lo + np.searchsorted(at[lo:hi], last + gap)
            yield rows.iloc[keep][["event_row_id"]]

    return run


def cooldown(candidates: DataFrame, seconds: int, limit: int | None = None) -> DataFrame:
    """Row ids that survive the per-entity cooldown.

    A time slot as long as the cooldown without any candidate resets it, so an entity's
    history falls apart into independent segments, each reduced to distinct instants. Segments of up
    to ``limit`` instants stream through one task in constant memory; longer ones are walked
    in blocks of about that size (see ``timeblocks``), with the same result.
    """
    if seconds <= 0:
        return candidates.select("event_row_id")
    at = F.unix_micros("timestamp")
    slot = F.floor(at / F.lit(seconds * 1_000_000))
    instants = candidates.groupBy("entity_id", at.alias("at"), slot.alias("slot")).agg(
        F.min("event_row_id").alias("event_row_id"))
    # Slots per entity are bounded by the time span, not by the number of rows.
    slots = instants.select("entity_id", "slot").distinct()
    w = Window.partitionBy("entity_id").orderBy("slot")
    quiet = slots.withColumn("gap", (F.col("slot") - F.lag("slot").over(w) > 1).cast("int"))
    segments = quiet.select("entity_id", "slot", F.coalesce(F.sum("gap").over(w), F.lit(0)).alias("segment"))
    placed = durable(instants.join(segments, ["entity_id", "slot"]).select("entity_id", "segment", "at", "event_row_id"))
    hot = hot_keys(placed, ["entity_id", "segment"], limit)
    short, long = hot.split(placed)
    ordered = short.repartition("entity_id", "segment").sortWithinPartitions("entity_id", "segment", "at")
    kept = ordered.mapInPandas(_first_after_gap(seconds), "event_row_id bigint")
    if long is None:
        return kept
    return kept.unionByName(walk_in_blocks(long, seconds, -(-hot.rows // hot.limit)))


def suppression_masks(scored: DataFrame, score: str, threshold: float, allowlist: Sequence[str] = (),
                      margin: float = 0.0, cooldown_seconds: int = 300,
                      destination: str = "dst_id") -> DataFrame:
    """Add ``raw`` and ``kept`` before any cap is applied.

    Only the candidates take part in the join; all other rows pass straight through.
    """
    t = F.lit(float(threshold))
    raw = F.coalesce(F.col(score) >= t, F.lit(False))
    flagged = scored.withColumns({"raw": raw, "_open": raw & passes_allowlist(score, t, allowlist, margin, destination)})
    candidates = flagged.filter("_open")
    survivors = cooldown(candidates, cooldown_seconds).withColumn("_kept", F.lit(True))
    decided = candidates.join(survivors, "event_row_id", "left").withColumn("kept", F.coalesce("_kept", F.lit(False)))
    others = flagged.filter(~F.col("_open")).withColumn("kept", F.lit(False))
    return decided.drop("_kept", "_open").unionByName(others.drop("_open"))


def suppression_report(masks: DataFrame) -> DataFrame:
    """Alert reduction, retained recall, recall loss and whether to switch suppression on."""
    benign = V.is_benign(F.col("label"))
    counts = masks.agg(
        F.count_if("raw").alias("raw_alerts"), F.count_if("kept").alias("post_suppression_alerts"),
        F.count_if(~benign).alias("attacks"), F.count_if(F.col("raw") & ~benign).alias("raw_hits"),
        F.count_if(F.col("kept") & ~benign).alias("kept_hits"), F.count_if(F.col("raw") & benign).alias("raw_false"),
        F.count_if(F.col("kept") & benign).alias("kept_false"))

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))

    loss = share("raw_hits", "attacks") - share("kept_hits", "attacks")
    quieter = (F.col("raw_false") == 0) | (F.col("kept_false") <= 0.8 * F.col("raw_false"))
    reduction = F.when(F.col("raw_alerts") > 0, 1 - F.col("post_suppression_alerts") / F.col("raw_alerts")).otherwise(0.0)
    return counts.select("raw_alerts", "post_suppression_alerts", reduction.alias("alert_reduction"),
                         share("kept_hits", "attacks").alias("retained_recall"), loss.alias("recall_loss"),
                         (quieter & (loss <= 0.01)).alias("enabled_by_default"))


def cap_per_entity(alerts: DataFrame, score: str, n: int) -> DataFrame:
    """Best n alerts of each entity; Spark limits each map task to n rows per entity first."""
    w = Window.partitionBy("entity_id").orderBy(F.desc(score), F.asc("event_row_id"))
    return alerts.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def select_alerts(scored: DataFrame, score: str, threshold: float, top_k: int | None = None,
                  max_per_entity: int | None = None, allowlist: Sequence[str] = (), margin: float = 1.5,
                  cooldown_seconds: int = 0, destination: str = "dst_id") -> DataFrame:
    """Threshold, allowlist, cooldown, per-entity cap, then the k highest scores."""
    t = F.lit(float(threshold))
    out = scored.filter((F.col(score) >= t) & passes_allowlist(score, t, allowlist, margin, destination))
    if cooldown_seconds > 0:
        out = out.join(cooldown(out, cooldown_seconds), "event_row_id", "left_semi")
    if max_per_entity is not None:
        out = cap_per_entity(out, score, max_per_entity)
    out = out.orderBy(F.desc(score), F.asc("event_row_id"))
    return out if top_k is None else out.limit(top_k)


def alert_packets(alerts: DataFrame, events: DataFrame, seq_len: int, hot: HotKeys | None = None) -> DataFrame:
    """Each alert's target event with up to seq_len events before it.

    ``alerts`` needs ``alert_index`` and ``event_row_id``. Alerts with unknown rows give
    nothing. Only entities with alerts are numbered, and each alert asks for its
    positions by value, so the join is an equality join.
    """
    wanted = alerts.select("alert_index", F.col("event_row_id").alias("_target"))
    hit = events.join(alerts.select("event_row_id"), "event_row_id", "left_semi").select("entity_id").distinct()
    placed = positions(events.join(hit, "entity_id", "left_semi"), ["entity_id"], TIME_ORDER, "pos", hot)
    spans = (placed.select(F.col("event_row_id").alias("_target"), "entity_id", F.col("pos").alias("_at"))
             .join(wanted, "_target")
             .select("alert_index", "entity_id", "_at",
                     F.explode(F.sequence(F.greatest(F.col("_at") - seq_len, F.lit(0)), "_at")).alias("pos")))
    return (placed.join(spans, ["entity_id", "pos"])
            .withColumn("is_target", F.col("pos") == F.col("_at")).drop("_at"))


def with_alert_index(alerts: DataFrame, score: str) -> DataFrame:
    """Number the alerts from the highest score down."""
    ranked = global_rank(alerts.withColumn("_down", -F.col(score)), ["_down", "event_row_id"], "alert_index")
    return ranked.withColumn("alert_index", F.col("alert_index").cast("int")).drop("_down")


def entity_timelines(scored: DataFrame, alerts: DataFrame, score: str, max_entities: int | None = None) -> DataFrame:
    """Score series of entities with two rows or more, with an alert flag.

    With ``max_entities`` only that many, alerting ones first.
    """
    key = ["entity_id", "timestamp", "token_str"]
    marks = alerts.select(*key).distinct().withColumn("_hit", F.lit(True))
    flagged = scored.join(marks, key, "left").withColumn("is_alert", F.coalesce("_hit", F.lit(False))).drop("_hit")
    chosen = (flagged.groupBy("entity_id").agg(F.max("is_alert").alias("_any"), F.count(F.lit(1)).alias("_n"))
              .filter(F.col("_n") >= 2))
    if max_entities is not None:
        chosen = chosen.orderBy(F.desc("_any"), F.asc("entity_id")).limit(max_entities)
    return (flagged.join(chosen.select("entity_id"), "entity_id", "left_semi")
            .select("entity_id", "timestamp", "event_row_id", score, "is_alert"))


def score_histogram(scored: DataFrame, score: str, bins: int = 60) -> DataFrame:
    """Equal-width histogram between min and max; the last bin includes the maximum."""
    low, high = scored.agg(F.min(score), F.max(score)).first()
    if low is None:
        return scored.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    if low == high:
        low, high = low - 0.5, high + 0.5
    slot = F.floor((F.col(score) - F.lit(low)) / F.lit(high - low) * bins)
    return (scored.filter(F.col(score).isNotNull())
            .groupBy(F.least(F.greatest(slot, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))
