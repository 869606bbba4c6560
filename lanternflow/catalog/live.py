"""Streams and live views."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.catalog import shared
from lanternflow.catalog.chain import CHAIN, _nll, _scored, _windows
from lanternflow.catalog.events import VOCAB, scratch
from lanternflow.catalog.registry import query, r6
from lanternflow.catalog.scores import ALL_P, ALLOW, COOL, recursive
from lanternflow.catalog.views import FLOWS, as_flows, flows, table
from lanternflow.session import durable
from lanternflow.streaming import ingest, live
from lanternflow.streaming import scoring as SC

C = f"WITH {CHAIN}"
# Fixed settings of the delivered streams: files, and the silence in seconds that ends a context.
PARTS, IDLE = 6, 48 * 3600
# The file of an event: a sixth of the time each, every 97th event one file late.
PART = f"""sent AS MATERIALIZED (SELECT *, least({PARTS - 1}, CAST(floor({PARTS} * (epoch_us("timestamp") - lo) / CAST(hi - lo + 1 AS DOUBLE)) AS INT)
  + CASE WHEN event_row_id % 97 = 0 THEN 1 ELSE 0 END) AS part FROM (SELECT *, min(epoch_us("timestamp")) OVER () AS lo, max(epoch_us("timestamp")) OVER () AS hi FROM {{}})),
 ontime AS (SELECT * FROM (SELECT *, max(epoch_us("timestamp")) OVER (PARTITION BY entity_id ORDER BY part RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sent)
  WHERE seen IS NULL OR epoch_us("timestamp") >= seen),
 calls AS MATERIALIZED (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_row_id) AS call FROM
  (SELECT *, coalesce(epoch_us("timestamp") - lag(epoch_us("timestamp")) OVER (PARTITION BY entity_id ORDER BY "timestamp", event_row_id) > {IDLE}000000, false) AS fresh FROM ontime))"""


def in_parts(rows: DataFrame) -> DataFrame:
    """Add ``part``: the file in which a row is delivered (``PART`` in SQL)."""
    at = F.unix_micros("timestamp")
    lo, hi = rows.agg(F.min(at), F.max(at)).first()
    part = F.floor(PARTS * (at - lo) / F.lit(float(hi - lo + 1))).cast("int") + (F.col("event_row_id") % 97 == 0).cast("int")
    return rows.withColumn("part", F.least(F.lit(PARTS - 1), part))


def deliver(rows: DataFrame, run) -> None:
    """Write ``rows`` file by file and stream them: ``run(stream)`` is called after half of the files and after the rest,
    so the second call starts from the first one's checkpoint. Each file is a micro-batch."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    placed = durable(in_parts(rows))
    for k in range(PARTS):
        placed.filter(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(path)
        if k in (PARTS // 2 - 1, PARTS - 1):
            run(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("timestamp", "4 days"))


def event_stream(spark, sf) -> DataFrame:
    events = table(spark, sf, "events")
    return as_flows(ingest.read_event_files(spark, sf, "events.parquet", events.schema))


def _drain(stream: DataFrame) -> DataFrame:
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    SC.run_available(stream, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def json_lines(spark, sf) -> DataFrame:
    """Flows as JSON lines; some lack the entity, some are cut off."""
    f = flows(spark, sf)
    row = F.to_json(F.struct("event_row_id", F.col("timestamp").cast("string").alias("timestamp"),
                             F.when(F.col("event_row_id") % 50 == 0, "").otherwise(F.col("entity_id")).alias("entity_id"),
                             "event_type", "dst_id", F.col("bytes").cast("string").alias("bytes"), "label"))
    return f.select(F.when(F.col("event_row_id") % 70 == 1, F.substring(row, 1, 20)).otherwise(row).alias("value"))


@query("A10_ingest_events", f"""WITH {FLOWS} SELECT event_row_id, entity_id, event_type, dst_id, round(bytes, 6) AS bytes, label,
 epoch_us("timestamp") AS at FROM flows WHERE event_row_id % 50 <> 0 AND event_row_id % 70 <> 1""")
def ingest_events(spark, sf):
    path = scratch(spark)
    json_lines(spark, sf).write.text(path)
    parsed = ingest.parse_events(ingest.read_lines(spark, path, 8))
    return _drain(ingest.accepted(parsed)).select("event_row_id", "entity_id", "event_type", "dst_id", r6("bytes").alias("bytes"),
                                                  "label", F.unix_micros("timestamp").alias("at"))


@query("A10_rejected_events", """SELECT CASE WHEN event_id % 70 = 1 THEN 'not a JSON event' ELSE 'entity_id is required' END AS reject_reason,
 count(*) AS n FROM events WHERE event_id % 50 = 0 OR event_id % 70 = 1 GROUP BY 1""")
def rejected_events(spark, sf):
    path = scratch(spark)
    json_lines(spark, sf).write.text(path)
    parsed = ingest.parse_events(ingest.read_lines(spark, path, 8))
    return _drain(ingest.rejected(parsed)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("n"))


@query("H1_stream_scores", f"""{C} SELECT event_row_id, round(nll, 6) AS nll, round(nll_z, 6) AS nll_z, round(score, 6) AS score,
 round(score_without_nll, 6) AS score_without_nll, top_contributing_feature FROM sst""")
def stream_scores(spark, sf):
    d = shared.detector(spark, sf)
    rows = event_stream(spark, sf).filter(F.col("split") != "train")
    out = _drain(SC.score_stream(rows, d, shared.ABLATIONS))
    return out.select("event_row_id", *[r6(c).alias(c) for c in ("nll", "nll_z", "score", "score_without_nll")],
                      "top_contributing_feature")


def _later(spark, sf) -> DataFrame:
    return flows(spark, sf).filter(F.col("split") != "train")


@query("H1_stream_scores_delivered", f"""{C}, {PART.format("tds")}, {_windows('wh', 'calls', 'entity_id, call')}, {_nll('nh', 'wh')}, {_scored('sh', 'nh')}
SELECT event_row_id, round(nll, 6) AS nll, round(nll_z, 6) AS nll_z, round(score, 6) AS score, round(score_without_nll, 6) AS score_without_nll,
 top_contributing_feature FROM sh""")
def stream_scores_delivered(spark, sf):
    """Six files, six micro-batches, a restart after three, late events, and contexts that end after two silent days."""
    d, path = shared.detector(spark, sf), scratch(spark)
    deliver(_later(spark, sf), lambda s: SC.run_available(
        SC.score_stream(s, d, shared.ABLATIONS, IDLE), f"{path}/out", f"{path}/checkpoint"))
    out = spark.read.parquet(f"{path}/out")
    return out.select("event_row_id", *[r6(c).alias(c) for c in ("nll", "nll_z", "score", "score_without_nll")],
                      "top_contributing_feature")


@query("H2_recent_events_delivered", f"""WITH {FLOWS}, {PART.format("(SELECT * FROM flows WHERE split <> 'train')")},
 l AS (SELECT *, row_number() OVER (PARTITION BY entity_id, call ORDER BY "timestamp" DESC, event_row_id DESC) AS r, max(call) OVER (PARTITION BY entity_id) AS newest FROM calls)
SELECT entity_id, CAST(count(*) AS INT) AS buffered, min(epoch_us("timestamp")) AS first_at, max(epoch_us("timestamp")) AS last_at
 FROM l WHERE call = newest AND r <= 20 GROUP BY 1""")
def recent_delivered(spark, sf):
    """The buffers of the delivered stream: an entity's last run of events, at most twenty."""
    path = scratch(spark)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/out/b={batch_id}")

    def run(stream: DataFrame) -> None:
        live._each_batch(SC.recent_events(stream, 20, IDLE), "update", f"{path}/checkpoint", save)

    deliver(_later(spark, sf), run)
    last = spark.read.parquet(f"{path}/out").groupBy("entity_id").agg(F.max_by(F.struct("buffered", "first_at", "last_at"), "batch_id").alias("s"))
    return last.select("entity_id", "s.buffered", "s.first_at", "s.last_at")


@query("H2_recent_events", f"""WITH {FLOWS}, l AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp" DESC, event_row_id DESC) AS r FROM flows)
SELECT entity_id, CAST(count(*) AS INT) AS buffered, min(epoch_us("timestamp")) AS first_at, max(epoch_us("timestamp")) AS last_at FROM l WHERE r <= 40 GROUP BY 1""")
def recent(spark, sf):
    """State emits in update mode, so the last row per entity counts; the sink is written per batch."""
    path = scratch(spark)
    SC.use_rocksdb(spark)
    stream = SC.recent_events(event_stream(spark, sf), 40)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/out/b={batch_id}")

    q = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/checkpoint")
         .trigger(availableNow=True).foreachBatch(save).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    last = out.groupBy("entity_id").agg(F.max_by(F.struct("buffered", "first_at", "last_at"), "batch_id").alias("s"))
    return last.select("entity_id", "s.buffered", "s.first_at", "s.last_at")


@query("H3_stats_snapshots", f"""{C}, c AS (SELECT strftime("timestamp", '%Y%m%d') AS batch_id, entity_id, count(*) AS e, count(*) FILTER (score >= t) AS a
  FROM sst CROSS JOIN thr GROUP BY ALL),
 tt AS (SELECT batch_id, sum(e) AS e, sum(a) AS a FROM c GROUP BY 1), ff AS (SELECT b AS batch_id, count(*) AS n FROM (SELECT entity_id, min(batch_id) AS b FROM c GROUP BY 1) GROUP BY 1),
 rr AS (SELECT batch_id, sum(e) OVER w AS total_events, sum(a) OVER w AS anomalies, sum(coalesce(n, 0)) OVER w AS active_entities FROM tt LEFT JOIN ff USING (batch_id) WINDOW w AS (ORDER BY batch_id)),
 pp AS (SELECT *, coalesce(lag(total_events) OVER (ORDER BY batch_id), 0) AS p1, coalesce(lag(anomalies) OVER (ORDER BY batch_id), 0) AS p2, coalesce(lag(active_entities) OVER (ORDER BY batch_id), 0) AS p3 FROM rr)
SELECT CAST(batch_id AS INT) AS batch_id, CAST(total_events AS BIGINT) AS total_events, CAST(anomalies AS BIGINT) AS anomalies, CAST(active_entities AS BIGINT) AS active_entities,
 round(anomalies * 100.0::DOUBLE / total_events, 2) AS anomaly_rate,
 CASE WHEN p1 = 0 THEN CASE WHEN total_events = 0 THEN 0.0 ELSE 100.0 END ELSE round((total_events - p1) / CAST(p1 AS DOUBLE) * 100, 1) END AS total_events_trend,
 CASE WHEN p2 = 0 THEN CASE WHEN anomalies = 0 THEN 0.0 ELSE 100.0 END ELSE round((anomalies - p2) / CAST(p2 AS DOUBLE) * 100, 1) END AS anomalies_trend,
 CASE WHEN p3 = 0 THEN CASE WHEN active_entities = 0 THEN 0.0 ELSE 100.0 END ELSE round((active_entities - p3) / CAST(p3 AS DOUBLE) * 100, 1) END AS active_entities_trend FROM pp""")
def stats(spark, sf):
    """One snapshot per day of the scored stream."""
    rows = shared.stream(spark, sf).withColumn("is_anomaly", F.col("score") >= shared.stream_threshold(spark, sf))
    counts = rows.groupBy(F.date_format("timestamp", "yyyyMMdd").cast("int").alias("batch_id"), "entity_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_anomaly").alias("anomalies"))
    return live.stats_snapshots(counts)


def _trend(c: str) -> str:
    return (f"CASE WHEN lag({c}, 1, 0) OVER o = 0 THEN CASE WHEN {c} = 0 THEN 0.0 ELSE 100.0 END "
            f"ELSE round(({c} - lag({c}) OVER o) / CAST(lag({c}) OVER o AS DOUBLE) * 100, 1) END AS {c}_trend")


@query("H3_stream_stats", f"""{C}, {PART.format("(SELECT sst.*, score >= t AS hit FROM sst CROSS JOIN thr)")},
 run AS (SELECT p.part, count(*) AS total_events, count(*) FILTER (hit) AS anomalies, count(DISTINCT entity_id) AS active_entities
  FROM (SELECT DISTINCT part FROM sent) p JOIN sent q ON q.part <= p.part GROUP BY 1)
SELECT row_number() OVER o AS snapshot, total_events, anomalies, active_entities, round(anomalies * 100.0::DOUBLE / total_events, 2) AS anomaly_rate,
 {_trend("total_events")}, {_trend("anomalies")}, {_trend("active_entities")} FROM run WINDOW o AS (ORDER BY part)""")
def stream_stats(spark, sf):
    """A snapshot for each of six micro-batches, with a restart after three."""
    path = scratch(spark)
    rows = shared.stream(spark, sf).withColumn("is_anomaly", F.col("score") >= shared.stream_threshold(spark, sf))
    deliver(rows.select("entity_id", "timestamp", "event_row_id", "is_anomaly"),
            lambda s: live.write_snapshots(s, f"{path}/snapshots", f"{path}/checkpoint"))
    snaps = live.read_snapshots(spark, f"{path}/snapshots")
    # Batches without rows have no snapshot; the others are numbered in their order.
    order = Window.partitionBy(F.lit(0)).orderBy("batch_id")
    return snaps.withColumn("snapshot", F.row_number().over(order).cast("long")).drop("batch_id")


@query("H4_hourly_timeline", f"""{C} SELECT epoch_us(date_trunc('hour', "timestamp")) AS hour, count(*) AS events,
 count(*) FILTER (score >= t) AS anomalies, round(avg(nll), 6) AS mean_nll FROM sst CROSS JOIN thr
 WHERE date_trunc('hour', "timestamp") > (SELECT date_trunc('hour', max("timestamp")) FROM sst) - INTERVAL 24 HOUR GROUP BY 1""")
def timeline(spark, sf):
    rows = shared.stream(spark, sf).withColumn("is_anomaly", F.col("score") >= shared.stream_threshold(spark, sf))
    t = live.last_hours(live.hourly_timeline(rows), 24)
    return t.select(F.unix_micros("hour").alias("hour"), "events", "anomalies", r6("mean_nll").alias("mean_nll"))


@query("H4_stream_timeline", f"""{C} SELECT epoch_us(date_trunc('hour', "timestamp")) AS hour, count(*) AS events,
 count(*) FILTER (score >= t) AS anomalies, round(avg(nll), 6) AS mean_nll FROM sst CROSS JOIN thr GROUP BY 1""")
def stream_timeline(spark, sf):
    """Every hour of the scored stream, kept up to date over six micro-batches and a restart; late events count."""
    path, t = scratch(spark), shared.stream_threshold(spark, sf)
    rows = shared.stream(spark, sf).select("event_row_id", "timestamp", "nll", (F.col("score") >= t).alias("is_anomaly"))
    deliver(rows, lambda s: live.write_timeline(s, f"{path}/hours", f"{path}/checkpoint"))
    return live.read_timeline(spark, f"{path}/hours").select(
        F.unix_micros("hour").alias("hour"), "events", "anomalies", r6("mean_nll").alias("mean_nll"))


@query("H5_entity_profile", f"""{C} SELECT entity_id, count(*) AS total_events, epoch_us(min("timestamp")) AS first_seen, epoch_us(max("timestamp")) AS last_seen,
 round(any_value(mean_nll), 6) AS mean_nll, round(any_value(std_nll), 6) AS std_nll FROM flows LEFT JOIN en USING (entity_id) GROUP BY 1""")
def profile(spark, sf):
    p = live.entity_profile(flows(spark, sf), shared.detector(spark, sf))
    return p.select("entity_id", "total_events", F.unix_micros("first_seen").alias("first_seen"),
                    F.unix_micros("last_seen").alias("last_seen"), r6("mean_nll").alias("mean_nll"), r6("std_nll").alias("std_nll"))


@query("H6_recent_alerts", f"""{C} SELECT event_row_id, entity_id, round(score, 6) AS score, CASE WHEN score > 5 THEN 'high' WHEN score > 3.5 THEN 'medium' ELSE 'low' END AS severity
 FROM sst CROSS JOIN thr WHERE score >= t / 3 ORDER BY "timestamp" DESC, event_row_id DESC LIMIT 50""")
def alerts_feed(spark, sf):
    al = shared.stream(spark, sf).filter(F.col("score") >= shared.stream_threshold(spark, sf) / 3)
    return live.recent_alerts(al).select("event_row_id", "entity_id", r6("score").alias("score"), "severity")


@query("H7_predict_next", f"""{C}, lr AS (SELECT entity_id, token_id, row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp" DESC, event_row_id DESC) AS r FROM tok),
 lc AS (SELECT entity_id, max(token_id) FILTER (r = 1) AS t1, max(token_id) FILTER (r = 2) AS t2 FROM lr WHERE r <= 3 GROUP BY 1 HAVING count(*) >= 3),
 {ALL_P.replace('SELECT DISTINCT t2, t1 FROM wst', 'SELECT DISTINCT t2, t1 FROM lc')},
 ents AS (SELECT t2, t1, -sum(p * ln(p + 1e-10)) AS entropy FROM allp GROUP BY ALL)
SELECT entity_id, CAST(rank AS INT) AS rank, CAST(token_id AS INT) AS token_id, round(p, 6) AS p, round(entropy, 6) AS entropy
 FROM lc JOIN ranked USING (t2, t1) JOIN ents USING (t2, t1) WHERE rank <= 5""")
def predict(spark, sf):
    p = live.predict_next(flows(spark, sf), shared.detector(spark, sf))
    return p.select("entity_id", "rank", "token_id", r6("p").alias("p"), r6("entropy").alias("entropy"))


def _walk_over(source: str) -> str:
    """Greedy walk over the open rows of ``source`` in order of arrival (part, then time)."""
    return f"""cand AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY part, "timestamp", event_row_id) AS i FROM {source} WHERE open),
 walk AS (SELECT event_row_id, entity_id, i, epoch_us("timestamp") AS last, true AS keep FROM cand WHERE i = 1 UNION ALL
  SELECT c.event_row_id, c.entity_id, c.i, CASE WHEN epoch_us(c."timestamp") - w.last >= {COOL}000000 THEN epoch_us(c."timestamp") ELSE w.last END,
   epoch_us(c."timestamp") - w.last >= {COOL}000000 FROM cand c JOIN walk w ON c.entity_id = w.entity_id AND c.i = w.i + 1)"""


@query("H8_stream_cooldown_delivered", f"""WITH RECURSIVE {CHAIN}, {PART.format("sst")},
 arrived AS MATERIALIZED (SELECT p.*, score >= t / 2 AND NOT (dst_id IN ('1', '2', '3') AND score < t / 2 + 1.5) AS open,
  dst_id IN ('1', '2', '3') AND score < t / 2 + 1.5 AS listed FROM sent p CROSS JOIN thr), {_walk_over("arrived")}
SELECT a.event_row_id, coalesce(w.keep, false) AS is_anomaly, a.listed OR coalesce((SELECT epoch_us(a."timestamp") - max(k.last) < {COOL}000000 FROM walk k JOIN arrived b
  ON k.keep AND b.event_row_id = k.event_row_id AND b.entity_id = a.entity_id AND (b.part, b."timestamp", b.event_row_id) < (a.part, a."timestamp", a.event_row_id)), false)
 AS suppressed FROM arrived a LEFT JOIN walk w USING (event_row_id)""")
def stream_cooldown_delivered(spark, sf):
    """Six micro-batches, a restart after three, late rows; the last alert of an entity goes when its cooldown has passed."""
    path = scratch(spark)
    d = shared.calibrated(spark, sf, allowlist=ALLOW, allowlist_margin=1.5, cooldown_seconds=COOL)
    d = replace(d, threshold=d.threshold / 2)
    deliver(shared.stream(spark, sf).select("entity_id", "timestamp", "event_row_id", "dst_id", "score"),
            lambda s: SC.run_available(SC.with_stream_cooldown(s, d, expire=True), f"{path}/out", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/out").select("event_row_id", "is_anomaly", "suppressed")


@query("H8_stream_cooldown", recursive("(t / 2)") + f""" SELECT s.event_row_id, coalesce(w.keep, false) AS is_anomaly,
 (s.dst_id IN ('1', '2', '3') AND s.score < t / 2 + 1.5) OR EXISTS (SELECT 1 FROM walk k WHERE k.keep AND k.entity_id = s.entity_id
   AND (k."timestamp", k.event_row_id) < (s."timestamp", s.event_row_id)
   AND epoch_us(s."timestamp") - epoch_us(k."timestamp") < {COOL}000000) AS suppressed
 FROM sst s CROSS JOIN thr LEFT JOIN walk w ON s.event_row_id = w.event_row_id""")
def stream_cooldown(spark, sf):
    """The scored table read as a stream, with the last alert of each entity in state."""
    path = scratch(spark)
    scored = shared.stream(spark, sf).select("entity_id", "timestamp", "event_row_id", "dst_id", "score")
    scored.write.parquet(path)
    d = shared.calibrated(spark, sf, allowlist=ALLOW, allowlist_margin=1.5, cooldown_seconds=COOL)
    d = replace(d, threshold=d.threshold / 2)
    rows = spark.readStream.schema(scored.schema).parquet(path)
    return _drain(SC.with_stream_cooldown(rows, d)).select("event_row_id", "is_anomaly", "suppressed")
