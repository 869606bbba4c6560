"""Baselines, next-event scores, thresholds and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternflow.catalog import shared
from lanternflow.catalog.chain import CHAIN, FEATURES, MODEL, threshold_of
from lanternflow.catalog.events import VOCAB
from lanternflow.catalog.registry import query, r6
from lanternflow.catalog.views import flows
from lanternflow.functions import scores as S, values as V
from lanternflow.operators import alerts as A
from lanternflow.operators import baselines as B
from lanternflow.operators import nextevent as N
from lanternflow.operators import thresholds as T

from lanternflow.plans import detection as D
from lanternflow.schema import SCORE_FEATURES

C = f"WITH {CHAIN}"


@query("E1_baselines", C + " " + " UNION ALL ".join(
    [f"SELECT entity_id, '{f}' AS feature, round(med_{f}, 6) AS median, round(scale_{f}, 6) AS scale FROM ebase" for f in FEATURES]
    + [f"SELECT NULL, '{f}', round(med_{f}, 6), round(scale_{f}, 6) FROM gbase" for f in FEATURES]))
def baselines(spark, sf):
    b = B.fit_baselines(shared.train_scores(spark, sf), SCORE_FEATURES, shared.MIN_WINDOWS)
    return B.baseline_table(b).select("entity_id", "feature", r6("median").alias("median"), r6("scale").alias("scale"))


ZS = ", ".join(f"round(z_{f}, 6) AS z_{f}" for f in FEATURES)


@query("E2_robust_z", f"{C} SELECT event_row_id, has_baseline, {ZS} FROM sst")
def robust_z(spark, sf):
    b = B.fit_baselines(shared.train_scores(spark, sf), SCORE_FEATURES, shared.MIN_WINDOWS)
    rows = shared.stream(spark, sf).select("event_row_id", "entity_id", *SCORE_FEATURES)
    return B.with_robust_z(rows, b).select("event_row_id", "has_baseline", *[r6(f"z_{f}").alias(f"z_{f}") for f in FEATURES])


@query("E3_combo_score", f"{C} SELECT event_row_id, round(score, 6) AS combo_score FROM sds")
def combo(spark, sf):
    z = shared.by_split(spark, sf)
    return B.with_combo_score(z, SCORE_FEATURES).select("event_row_id", r6("combo_score").alias("combo_score"))


@query("E4_top_feature", f"{C} SELECT top_contributing_feature, count(*) AS n FROM sst GROUP BY 1")
def top_feature(spark, sf):
    return (shared.stream(spark, sf).select(S.top_feature(SCORE_FEATURES).alias("top_contributing_feature"))
            .groupBy("top_contributing_feature").agg(F.count(F.lit(1)).alias("n")))


@query("E5_ablated_scores", f"{C} SELECT event_row_id, round(score_without_nll, 6) AS score_without_nll FROM sst")
def ablated(spark, sf):
    return B.with_combo_score(shared.stream(spark, sf), SCORE_FEATURES, ["nll"], "s").select(
        "event_row_id", r6("s").alias("score_without_nll"))


@query("E6_entity_nll_stats", f"{C} SELECT entity_id, round(mean_nll, 6) AS mean_nll, round(std_nll, 6) AS std_nll FROM en")
def entity_nll(spark, sf):
    s = N.fit_entity_nll(shared.train_scores(spark, sf)).entities
    return s.select("entity_id", r6("mean_nll").alias("mean_nll"), r6("std_nll").alias("std_nll"))


@query("E7_entity_nll_z", f"{C} SELECT event_row_id, round(nll_z, 6) AS nll_z FROM sst")
def nll_z(spark, sf):
    rows = shared.stream(spark, sf).drop("nll_z")
    return N.with_nll_z(rows, N.fit_entity_nll(shared.train_scores(spark, sf))).select("event_row_id", r6("nll_z").alias("nll_z"))


@query("E7_self_fitted_nll_z", f"""{C}, own AS (SELECT entity_id, avg(nll) AS m, stddev_samp(nll) AS s FROM nst GROUP BY 1)
SELECT event_row_id, round((nll - m) / CASE WHEN coalesce(s, 0) = 0 THEN 1e-6 ELSE s END, 4) AS nll_z FROM nst JOIN own USING (entity_id)""")
def self_nll_z(spark, sf):
    rows = N.with_self_fitted_nll_z(shared.stream(spark, sf).drop("nll_z"))
    return rows.select("event_row_id", F.round("nll_z", 4).alias("nll_z"))


@query("E8_next_event_nll", f"{C} SELECT event_row_id, round(nll, 6) AS nll FROM nst")
def next_event_nll(spark, sf):
    d = shared.detector(spark, sf)
    w = D.windows_of(flows(spark, sf).filter(F.col("split") != "train"), d.tokenizer, shared.SEQ_LEN)
    return N.with_nll(w, d.model).select("event_row_id", r6("nll").alias("nll"))


# Brute force over the whole vocabulary for every context that occurs. Doubles in the order of
# the Spark expression, so equal probabilities are equal on both sides and ranks compare by row.
ALL_P = f"""ctx AS (SELECT DISTINCT t2, t1 FROM wst), ids AS (SELECT unnest(range(v)) AS token_id FROM voc),
allp AS MATERIALIZED (SELECT ctx.t2, ctx.t1, ids.token_id,
   coalesce(0.5::DOUBLE * coalesce(tri.c, 0) / h2.c2, 0.0::DOUBLE) + coalesce(0.3::DOUBLE * coalesce(pr.c1y, 0) / h1.c1, 0.0::DOUBLE)
   + (0.2::DOUBLE + CASE WHEN h2.c2 IS NULL THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN h1.c1 IS NULL THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)
     * ((coalesce(u.cy, 0) + 0.1::DOUBLE) / (tot.n + 0.1::DOUBLE * voc.v)) AS p, coalesce(u.cy, 0) AS cy
 FROM ctx CROSS JOIN ids CROSS JOIN tot CROSS JOIN voc
 LEFT JOIN tri ON ctx.t2 = tri.t2 AND ctx.t1 = tri.t1 AND ids.token_id = tri.token_id
 LEFT JOIN h2 ON ctx.t2 = h2.t2 AND ctx.t1 = h2.t1 LEFT JOIN h1 ON ctx.t1 = h1.t1
 LEFT JOIN pr ON ctx.t1 = pr.t1 AND ids.token_id = pr.token_id LEFT JOIN u ON ids.token_id = u.token_id),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t2, t1 ORDER BY p DESC, token_id) AS rank FROM allp)"""


@query("E9_top_predictions", f"""{C}, {ALL_P} SELECT CAST(t2 AS INT) AS t2, CAST(t1 AS INT) AS t1, CAST(rank AS INT) AS rank,
 CAST(token_id AS INT) AS token_id, round(p, 6) AS p FROM ranked WHERE rank <= 5""")
def top_predictions(spark, sf):
    top = N.top_predictions(shared.stream(spark, sf), shared.detector(spark, sf).model)
    return top.select("t2", "t1", "rank", "token_id", r6("p").alias("p"))


@query("E9_prediction_entropy", f"""{C}, {ALL_P} SELECT CAST(t2 AS INT) AS t2, CAST(t1 AS INT) AS t1,
 round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM allp GROUP BY t2, t1""")
def entropy(spark, sf):
    e = N.prediction_entropy(shared.stream(spark, sf), shared.detector(spark, sf).model)
    return e.select("t2", "t1", r6("entropy").alias("entropy"))


@query("E10_next_event_evaluation", f"""{C}, {ALL_P} SELECT round(avg(CAST(r.rank = 1 AS DOUBLE)), 6) AS accuracy,
 round(avg(CAST(r.rank <= 5 AS DOUBLE)), 6) AS top_k_accuracy, round(avg(CAST(n.t1 = n.token_id AS DOUBLE)), 6) AS last_token_accuracy,
 round(avg(nll), 6) AS mean_nll, round(exp(avg(nll)), 6) AS perplexity, round(quantile_cont(nll, 0.95::DOUBLE), 6) AS p95_nll,
 count(*) AS n_sequences FROM nst n JOIN ranked r ON n.t2 = r.t2 AND n.t1 = r.t1 AND n.token_id = r.token_id""")
def evaluation(spark, sf):
    e = N.evaluate_next_event(shared.stream(spark, sf), shared.detector(spark, sf).model)
    return e.select(*[r6(c).alias(c) for c in e.columns if c != "n_sequences"], "n_sequences")


REASON = """CASE WHEN nll_z > 6 THEN 'extreme deviation for entity' WHEN nll_z > 4 THEN 'unexpected event sequence'
 WHEN nll_z > 3 THEN 'rare but plausible behavior' ELSE 'normal variation' END"""


@query("E12_reason_and_severity", f"""{C} SELECT event_row_id, {REASON} AS reason,
 CASE WHEN score > 5 THEN 'high' WHEN score > 3.5 THEN 'medium' ELSE 'low' END AS severity FROM sst""")
def bands(spark, sf):
    return shared.stream(spark, sf).select("event_row_id", V.reason_band(F.col("nll_z")).alias("reason"),
                                           V.severity_band(F.col("score")).alias("severity"))


@query("E13_described_scores", f"""{C}, {VOCAB}, {ALL_P}, named AS (SELECT t2, t1,
  string_agg(coalesce(token_str, CASE token_id WHEN 0 THEN 'PAD' ELSE 'UNK' END), ', ' ORDER BY rank) AS predicted_events,
  string_agg(printf('%.3f', p), ', ' ORDER BY rank) AS predicted_probs
  FROM ranked LEFT JOIN vocabulary USING (token_id) WHERE rank <= 5 GROUP BY t2, t1)
SELECT event_row_id, coalesce(v.token_str, 'UNK') AS true_next_event,
 CASE WHEN token_id = 1 THEN '' WHEN di IS NULL THEN 'OTHER' ELSE dst_id END AS dst_parsed, {REASON} AS reason,
 top_contributing_feature || ' deviates from entity baseline' AS combo_reason, predicted_events, predicted_probs
 FROM sst LEFT JOIN vocabulary v USING (token_id) LEFT JOIN named USING (t2, t1)""")
def described(spark, sf):
    d = shared.detector(spark, sf)
    out = D.describe_scores(shared.stream(spark, sf), d)
    return out.select("event_row_id", "true_next_event", "dst_parsed", "reason", "combo_reason", "predicted_events", "predicted_probs")


@query("E14_score_stream", f"""{C} SELECT event_row_id, entity_id, round(nll, 6) AS nll, round(nll_z, 6) AS nll_z,
 round(score, 6) AS score, round(score_without_nll, 6) AS score_without_nll, top_contributing_feature,
 score >= t AS is_anomaly, false AS suppressed FROM sst CROSS JOIN thr""")
def score_stream(spark, sf):
    """The full pipeline over the stream, scored afresh with the fitted detector."""
    d = shared.calibrated(spark, sf)
    events = flows(spark, sf).filter(F.col("split") != "train")
    out = D.apply_policy(D.score_events(events, d, shared.ABLATIONS), d)
    return out.select("event_row_id", "entity_id", *[r6(c).alias(c) for c in ("nll", "nll_z", "score", "score_without_nll")],
                      "top_contributing_feature", "is_anomaly", "suppressed")


ALLOW = ["1", "2", "3"]
COOL = 3 * 86400
# The kept alerts of an entity, one recursion step per candidate in time order.
_COOL = f"""cand AS (SELECT event_row_id, entity_id, "timestamp", score, label, split, row_number() OVER (PARTITION BY entity_id
  ORDER BY "timestamp", event_row_id) AS i FROM sst CROSS JOIN thr WHERE score >= {{t}}
  AND (dst_id NOT IN ('1', '2', '3') OR score >= {{t}} + 1.5)),
walk AS (SELECT c.*, "timestamp" AS last, true AS keep FROM cand c WHERE i = 1
  UNION ALL SELECT c.*, CASE WHEN epoch_us(c."timestamp") - epoch_us(w.last) >= {COOL}000000 THEN c."timestamp" ELSE w.last END,
   epoch_us(c."timestamp") - epoch_us(w.last) >= {COOL}000000 FROM cand c JOIN walk w ON c.entity_id = w.entity_id AND c.i = w.i + 1)"""


def recursive(t: str) -> str:
    return "WITH RECURSIVE " + CHAIN + ", " + _COOL.replace("{t}", t)


@query("E14_score_stream_with_cooldown", recursive("(t / 2)") + f""" SELECT s.event_row_id,
 coalesce(w.keep, false) AS is_anomaly,
 (s.dst_id IN ('1', '2', '3') AND s.score < t / 2 + 1.5) OR EXISTS (SELECT 1 FROM walk k WHERE k.keep AND k.entity_id = s.entity_id
   AND (k."timestamp", k.event_row_id) < (s."timestamp", s.event_row_id)
   AND epoch_us(s."timestamp") - epoch_us(k."timestamp") < {COOL}000000) AS suppressed
 FROM sst s CROSS JOIN thr LEFT JOIN walk w ON s.event_row_id = w.event_row_id""")
def score_stream_cooldown(spark, sf):
    from dataclasses import replace
    d = shared.calibrated(spark, sf, allowlist=ALLOW, allowlist_margin=1.5, cooldown_seconds=COOL)
    d = replace(d, threshold=d.threshold / 2)
    return D.apply_policy(shared.stream(spark, sf), d).select("event_row_id", "is_anomaly", "suppressed")


@query("E15_nll_histogram", f"""{C}, lim AS (SELECT min(nll) AS a, max(nll) AS b FROM nst)
SELECT CAST(least(floor((nll - a) / (b - a) * 60), 59) AS INT) AS bin, count(*) AS n FROM nst CROSS JOIN lim GROUP BY 1""")
def histogram(spark, sf):
    return A.score_histogram(shared.stream(spark, sf), "nll", 60)


@query("E16_entity_timelines", f"""{C}, al AS (SELECT DISTINCT entity_id, "timestamp", token_str FROM sst CROSS JOIN thr WHERE score >= t),
 fl AS (SELECT s.*, al.entity_id IS NOT NULL AS is_alert FROM sst s LEFT JOIN al ON s.entity_id = al.entity_id
  AND s."timestamp" = al."timestamp" AND s.token_str = al.token_str),
 pick AS (SELECT entity_id, count(*) AS n FROM fl GROUP BY 1)
SELECT entity_id, event_row_id, round(score, 6) AS score, is_alert FROM fl WHERE entity_id IN (SELECT entity_id FROM pick WHERE n >= 2)""")
def timelines(spark, sf):
    s = shared.stream(spark, sf)
    al = s.filter(F.col("score") >= shared.stream_threshold(spark, sf))
    return A.entity_timelines(s, al, "score").select("entity_id", "event_row_id", r6("score").alias("score"), "is_alert")


@query("F1_threshold", f"""{C} SELECT split, 'score' AS variant, count(*) AS n, round({threshold_of('sst', 'score', "split = 'dev' AND label = 'BENIGN'")}, 6) AS threshold
 FROM sst WHERE split = 'dev' AND label = 'BENIGN' GROUP BY 1""")
def threshold(spark, sf):
    rows = shared.stream(spark, sf).filter((F.col("split") == "dev") & V.is_benign(F.col("label")))
    return T.calibrate(rows, ["score"], 0.01, ["split"]).select("split", "variant", "n", r6("threshold").alias("threshold"))


@query("F1_threshold_per_supplier", """SELECT l_suppkey, count(*) AS n, round(min(l_extendedprice) FILTER (k >= ceil((n - 1) * 0.99::DOUBLE)), 6) AS threshold
 FROM (SELECT l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) - 1 AS k,
 count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) GROUP BY 1""")
def threshold_per_supplier(spark, sf):
    from lanternflow.catalog.views import table
    return T.calibrate(table(spark, sf, "lineitem"), ["l_extendedprice"], 0.01, ["l_suppkey"]).select(
        "l_suppkey", "n", r6("threshold").alias("threshold"))


@query("F2_operating_thresholds", f"""{C} SELECT 'score' AS variant, round(t, 6) AS threshold FROM thr
 UNION ALL SELECT 'nll_z', round({threshold_of('sst', 'nll_z', "split = 'dev' AND label = 'BENIGN'")}, 6)
 UNION ALL SELECT 'score_without_nll', 2.5""")
def operating(spark, sf):
    rows = shared.stream(spark, sf).filter((F.col("split") == "dev") & V.is_benign(F.col("label")))
    found = T.operating_thresholds(rows, ["score", "nll_z", "score_without_nll"], 0.01, overrides={"score_without_nll": 2.5})
    return spark.createDataFrame(list(found.items()), "variant string, threshold double").select(
        "variant", r6("threshold").alias("threshold"))


@query("F3a_above_threshold", f"{C} SELECT event_row_id, round(score, 6) AS score FROM sst CROSS JOIN thr WHERE score >= t")
def above(spark, sf):
    return A.select_alerts(shared.stream(spark, sf), "score", shared.stream_threshold(spark, sf)).select(
        "event_row_id", r6("score").alias("score"))


@query("F3b_allowlist", f"""{C} SELECT event_row_id FROM sst CROSS JOIN thr WHERE score >= t / 2
 AND (dst_id NOT IN ('1', '2', '3') OR score >= t / 2 + 1.5)""")
def allowlisted(spark, sf):
    return A.select_alerts(shared.stream(spark, sf), "score", shared.stream_threshold(spark, sf) / 2,
                           allowlist=ALLOW, margin=1.5).select("event_row_id")


@query("F3c_cooldown", recursive("(t / 2)") + " SELECT event_row_id FROM walk WHERE keep")
def cooldown(spark, sf):
    return A.select_alerts(shared.stream(spark, sf), "score", shared.stream_threshold(spark, sf) / 2,
                           allowlist=ALLOW, margin=1.5, cooldown_seconds=COOL).select("event_row_id")


@query("F3c_cooldown_long_entities", """WITH RECURSIVE inst AS (SELECT DISTINCT l_suppkey AS e, epoch_us(l_shipdate) // 1000000 AS sec FROM lineitem),
 cand AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY sec) AS i FROM inst),
 walk AS (SELECT e, sec, i, sec AS last, true AS keep FROM cand WHERE i = 1 UNION ALL
  SELECT c.e, c.sec, c.i, CASE WHEN c.sec - w.last >= 864000 THEN c.sec ELSE w.last END, c.sec - w.last >= 864000
  FROM cand c JOIN walk w ON c.e = w.e AND c.i = w.i + 1)
SELECT CAST(e AS VARCHAR) AS entity_id, sec FROM walk WHERE keep""")
def cooldown_long(spark, sf):
    """Ten days of cooldown over every line item; only distinct instants matter."""
    from lanternflow.catalog.views import supplier_flows
    rows = supplier_flows(spark, sf).withColumn("event_row_id", F.xxhash64("entity_id", "timestamp"))
    kept = A.cooldown(rows, 864000).distinct()
    return rows.join(kept, "event_row_id", "left_semi").select(
        "entity_id", F.unix_seconds("timestamp").alias("sec")).distinct()


@query("F3c_cooldown_flood", """WITH RECURSIVE inst AS (SELECT DISTINCT epoch_us(ts) AS us FROM events),
 walk AS (SELECT min(us) AS us FROM inst UNION ALL
  SELECT (SELECT min(i.us) FROM inst i WHERE i.us >= walk.us + 7200000000) FROM walk WHERE walk.us IS NOT NULL)
SELECT us FROM walk WHERE us IS NOT NULL""")
def cooldown_flood(spark, sf):
    """All events as one entity without a quiet slot, two hours of cooldown, walked in some forty blocks."""
    rows = flows(spark, sf).withColumn("entity_id", F.lit("all"))
    kept = A.cooldown(rows, 7200, limit=max(1, rows.count() // 40))
    return rows.join(kept, "event_row_id", "left_semi").select(F.unix_micros("timestamp").alias("us"))


@query("F3d_cap_per_entity", f"""{C} SELECT event_row_id FROM (SELECT event_row_id, row_number() OVER (PARTITION BY entity_id
 ORDER BY score DESC, event_row_id) AS r FROM sst CROSS JOIN thr WHERE score >= t / 3) WHERE r <= 2""")
def capped(spark, sf):
    return A.select_alerts(shared.stream(spark, sf), "score", shared.stream_threshold(spark, sf) / 3,
                           max_per_entity=2).select("event_row_id")


@query("F3e_top_k", f"{C} SELECT event_row_id, round(score, 6) AS score FROM sst CROSS JOIN thr WHERE score >= t / 2 ORDER BY score DESC, event_row_id LIMIT 20")
def top_k(spark, sf):
    return A.select_alerts(shared.stream(spark, sf), "score", shared.stream_threshold(spark, sf) / 2, top_k=20).select(
        "event_row_id", r6("score").alias("score"))


@query("F4_suppression_masks", recursive("(t / 2)") + """ SELECT s.event_row_id, s.score >= t / 2 AS raw, coalesce(w.keep, false) AS kept
 FROM sst s CROSS JOIN thr LEFT JOIN walk w ON s.event_row_id = w.event_row_id""")
def masks(spark, sf):
    return _masks(spark, sf).select("event_row_id", "raw", "kept")


def _masks(spark, sf):
    return A.suppression_masks(shared.stream(spark, sf), "score", shared.stream_threshold(spark, sf) / 2, ALLOW, 1.5, COOL)


@query("F5_suppression_report", recursive("(t / 2)") + """, m AS (SELECT s.label <> 'BENIGN' AS attack, s.score >= t / 2 AS raw,
  coalesce(w.keep, false) AS kept FROM sst s CROSS JOIN thr LEFT JOIN walk w ON s.event_row_id = w.event_row_id),
 c AS (SELECT count(*) FILTER (raw) AS r, count(*) FILTER (kept) AS k, count(*) FILTER (attack) AS p, count(*) FILTER (raw AND attack) AS rp,
  count(*) FILTER (kept AND attack) AS kp, count(*) FILTER (raw AND NOT attack) AS rb, count(*) FILTER (kept AND NOT attack) AS kb FROM m)
SELECT r AS raw_alerts, k AS post_suppression_alerts, round(1 - k / r, 6) AS alert_reduction, round(kp / p, 6) AS retained_recall,
 round(rp / p - kp / p, 6) AS recall_loss, (rb = 0 OR kb <= 0.8 * rb) AND rp / p - kp / p <= 0.01 AS enabled_by_default FROM c""")
def suppression_report(spark, sf):
    r = A.suppression_report(_masks(spark, sf))
    return r.select("raw_alerts", "post_suppression_alerts", *[r6(c).alias(c) for c in (
        "alert_reduction", "retained_recall", "recall_loss")], "enabled_by_default")


def day_thresholds_sql(columns) -> str:
    one = []
    for c in columns:
        one.append(f"SELECT day, '{c}' AS variant, benign, {c} AS v FROM daily")
    return f"""daily AS (SELECT *, strftime("timestamp", '%Y-%m-%d') AS day, label = 'BENIGN' AS benign FROM sst),
days AS (SELECT day, lag(day) OVER (ORDER BY day) AS prev_day FROM (SELECT DISTINCT day FROM daily)),
vals AS ({' UNION ALL '.join(one)}),
tb AS (SELECT day, variant, min(v) FILTER (k >= ceil((n - 1) * 0.99::DOUBLE)) AS threshold FROM (SELECT *, row_number() OVER w - 1 AS k,
  count(*) OVER (PARTITION BY day, variant) AS n FROM vals WHERE benign WINDOW w AS (PARTITION BY day, variant ORDER BY v)) GROUP BY ALL),
ta AS (SELECT day, variant, min(v) FILTER (k >= ceil((n - 1) * 0.99::DOUBLE)) AS threshold FROM (SELECT *, row_number() OVER w - 1 AS k,
  count(*) OVER (PARTITION BY day, variant) AS n FROM vals WINDOW w AS (PARTITION BY day, variant ORDER BY v)) GROUP BY ALL),
lim AS (SELECT d.day, d.prev_day, 'frozen' AS policy, variant, threshold FROM days d CROSS JOIN tb
   WHERE tb.day = '2024-01-21' AND d.day > '2024-01-21'
 UNION ALL SELECT d.day, d.prev_day, 'prev_day_benign', variant, threshold FROM days d JOIN tb ON tb.day = d.prev_day
 UNION ALL SELECT d.day, d.prev_day, 'prev_day_unlabeled', variant, threshold FROM days d JOIN ta ON ta.day = d.prev_day)"""


DEV_DAY = "2024-01-21"


@query("F6_day_thresholds", f"""{C}, {day_thresholds_sql(['score', 'score_without_nll'])}
SELECT day, prev_day, policy, variant, round(threshold, 6) AS threshold FROM lim""")
def day_thresholds(spark, sf):
    t = T.day_thresholds(shared.stream(spark, sf), ["score", "score_without_nll"], DEV_DAY, 0.01)
    return t.select("day", "prev_day", "policy", "variant", r6("threshold").alias("threshold"))


@query("A6_alert_packets", f"""{C}, al AS (SELECT event_row_id, row_number() OVER (ORDER BY score DESC, event_row_id) - 1 AS alert_index
  FROM sst CROSS JOIN thr WHERE score >= t / 2 ORDER BY score DESC, event_row_id LIMIT 20),
 pos AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY "timestamp", event_row_id) - 1 AS pos FROM flows),
 hit AS (SELECT alert_index, entity_id, pos FROM al JOIN pos USING (event_row_id))
SELECT CAST(h.alert_index AS INT) AS alert_index, p.event_row_id, p.entity_id, p.pos, p.pos = h.pos AS is_target FROM hit h
 JOIN pos p ON p.entity_id = h.entity_id AND p.pos BETWEEN h.pos - 3 AND h.pos""")
def packets(spark, sf):
    from lanternflow.catalog.events import scratch
    from lanternflow.sources import sinks
    al = A.with_alert_index(A.select_alerts(shared.stream(spark, sf), "score", shared.stream_threshold(spark, sf) / 2, top_k=20),
                            "score")
    al = D.durable(al.select("alert_index", "event_row_id", "entity_id", "timestamp", "score"))
    path = scratch(spark)
    sinks.write_packets(al, A.alert_packets(al, flows(spark, sf), shared.SEQ_LEN), path)
    return spark.read.parquet(f"{path}/packets").select("alert_index", "event_row_id", "entity_id", "pos", "is_target")
