"""Live views: statistics, timeline, entity profile, alert feed and predictions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators import nextevent as N
from lanternflow.operators import tokens as K
from lanternflow.plans.detection import Detector
from lanternflow.streaming.scoring import tally, use_rocksdb


def _each_batch(stream: DataFrame, mode: str, checkpoint: str, save) -> None:
    use_rocksdb(stream.sparkSession)
    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
         .foreachBatch(save).start())
    q.awaitTermination()


SNAPSHOT = "batch_id long, total_events long, anomalies long, active_entities long, anomaly_rate double"


def write_snapshots(scored: DataFrame, path: str, checkpoint: str) -> None:
    """One row of running totals for each micro-batch of a stream with ``entity_id, is_anomaly``.

    A batch adds its own counts to the newest snapshot before it and overwrites its own folder, so a replayed
    batch gives the same row. Which entities are new is known from keyed state. A batch reads one
    row, whatever came before.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        n = batch.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("events", "anomalies", "fresh")]).first()
        if not n[0]:
            return  # a batch without rows only moves the watermark
        before = read_snapshots(spark, path).filter(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).first()
        old = [before[c] if before else 0 for c in ("total_events", "anomalies", "active_entities")]
        now = [o + int(x) for o, x in zip(old, n[1:])]
        row = spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), *_with_trends(
            [F.lit(x).cast("long") for x in now], [F.lit(x).cast("long") for x in old]))
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")

    _each_batch(tally(scored), "update", checkpoint, save)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots that ``write_snapshots`` has made so far."""
    shape = SNAPSHOT + ", " + ", ".join(f"{c}_trend double" for c in TOTALS)
    try:
        return spark.read.schema(shape).option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
    except AnalysisException:  # none yet
        return spark.createDataFrame([], shape)


TOTALS = ("total_events", "anomalies", "active_entities")


def _with_trends(now: list[Column], before: list[Column]) -> list[Column]:
    """The totals with their anomaly rate and the percent trend against the batch before."""
    rate = F.round(F.coalesce(F.try_divide(now[1] * 100.0, now[0]), F.lit(0.0)), 2)
    return [*[n.alias(c) for n, c in zip(now, TOTALS)], rate.alias("anomaly_rate"),
            *[V.percent_trend(n.cast("double"), b.cast("double")).alias(f"{c}_trend") for n, b, c in zip(now, before, TOTALS)]]


def write_timeline(scored: DataFrame, path: str, checkpoint: str, watermark: str | None = None) -> None:
    """Keep the hourly timeline of a stream: every micro-batch writes the hours that it changed.

    The aggregation runs in update mode, so an hour is there from its first event on; the watermark (given here
    or set on the stream) only lets go of old hours in the state. A batch overwrites its own folder, so a replay changes nothing.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{path}/batch={batch_id:010d}")

    _each_batch(hourly_timeline(scored, watermark), "update", checkpoint, save)


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every hour."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    cells = ("events", "anomalies", "mean_nll")
    return rows.groupBy("hour").agg(F.max_by(F.struct(*cells), "batch_id").alias("s")).select("hour", *[F.col(f"s.{c}") for c in cells])


def stats_snapshots(counts: DataFrame) -> DataFrame:
    """Totals after each batch with the percent trend against the batch before.

    An entity becomes active in its first batch, so active entities are a running sum of
    first appearances. The windows run over one row per batch.
    """
    totals = counts.groupBy("batch_id").agg(F.sum("events").alias("e"), F.sum("anomalies").alias("a"))
    first = counts.groupBy("entity_id").agg(F.min("batch_id").alias("batch_id"))
    fresh = first.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("batch_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = totals.join(fresh, "batch_id", "left").select(
        "batch_id", F.sum("e").over(upto).alias("total_events"), F.sum("a").over(upto).alias("anomalies"),
        F.sum(F.coalesce("n", F.lit(0))).over(upto).alias("active_entities"))
    return run.select("batch_id", *_with_trends([F.col(c) for c in TOTALS], [F.coalesce(F.lag(c).over(order), F.lit(0)) for c in TOTALS]))


def hourly_timeline(scored: DataFrame, watermark: str | None = None) -> DataFrame:
    """Events, anomalies and mean NLL per hour; give a watermark for streams."""
    rows = scored.withWatermark("timestamp", watermark) if watermark else scored
    return rows.groupBy(F.window("timestamp", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_anomaly").alias("anomalies"),
        F.avg("nll").alias("mean_nll")).select(F.col("w.start").alias("hour"), "events", "anomalies", "mean_nll")


def last_hours(timeline: DataFrame, hours: int = 24) -> DataFrame:
    """The last N hours that end with the newest hour of the timeline."""
    newest = timeline.agg(F.max("hour")).first()[0]
    return timeline.filter(F.col("hour") > F.lit(newest) - F.make_dt_interval(F.lit(0), F.lit(hours)))


def entity_profile(events: DataFrame, d: Detector) -> DataFrame:
    """Event count, first and last sighting and the NLL baseline of each entity."""
    seen = events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("total_events"), F.min("timestamp").alias("first_seen"),
                                           F.max("timestamp").alias("last_seen"))
    return seen.join(d.profiles.select("entity_id", "mean_nll", "std_nll"), "entity_id", "left")


def recent_alerts(alerts: DataFrame, limit: int = 50, score: str = "score") -> DataFrame:
    """Newest alerts with a severity band. Reading never changes the feed."""
    return (alerts.orderBy(F.desc("timestamp"), F.desc("event_row_id")).limit(limit)
            .withColumn("severity", V.severity_band(F.col(score)))
            .withColumn("reason", F.format_string("Anomaly score: %.2f", F.col(score))))


def latest_context(events: DataFrame, d: Detector) -> DataFrame:
    """Last two tokens of every entity with at least seq_len events.

    Ranking keeps seq_len rows per entity already on the map side.
    """
    w = Window.partitionBy("entity_id").orderBy(F.desc("timestamp"), F.desc("event_row_id"))
    last = (K.tokenize(events, d.tokenizer).select("entity_id", "timestamp", "event_row_id", "token_id")
            .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= d.seq_len))
    return last.groupBy("entity_id").agg(
        F.max(F.when(F.col("r") == 1, F.col("token_id"))).alias("t1"),
        F.max(F.when(F.col("r") == 2, F.col("token_id"))).alias("t2"),
        F.max("timestamp").alias("timestamp"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= d.seq_len).drop("n")


def predict_next(events: DataFrame, d: Detector, k: int = 5) -> DataFrame:
    """The k likeliest next events per entity with probability and entropy."""
    live = latest_context(events, d)
    top = N.top_predictions(live, d.model, k)
    ent = N.prediction_entropy(live, d.model)
    names = K.vocabulary(d.tokenizer)
    return (live.join(top, N.CONTEXT).join(ent, N.CONTEXT).join(names, "token_id", "left")
            .select("entity_id", "timestamp", "rank", "token_id",
                    K.token_name(F.col("token_id"), F.col("token_str")).alias("event"), "p", "entropy"))
