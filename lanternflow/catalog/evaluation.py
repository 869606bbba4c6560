"""Metrics and studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanternflow.catalog import shared
from lanternflow.catalog.chain import CHAIN, threshold_of
from lanternflow.catalog.events import scratch
from lanternflow.catalog.registry import query, r6
from lanternflow.catalog.scores import DEV_DAY, day_thresholds_sql
from lanternflow.catalog.tabular import forest_sql
from lanternflow.catalog.views import DOCS, attack_days, flows
from lanternflow.catalog.windows import multiscale_sql
from lanternflow.operators import baselines as B
from lanternflow.operators import iforest
from lanternflow.operators import metrics as M
from lanternflow.operators.tokens import tokenize
from lanternflow.operators.windows import multiscale_features, multiscale_names
from lanternflow.plans import studies
from lanternflow.plans.detection import durable
from lanternflow.sources import files, sinks

C = f"WITH {CHAIN}"
D = f"WITH {DOCS}"
POINT = ["recall", "precision", "f1", "fpr", "benign_alerts_per_10000"]


def point_sql(source: str, by: str = "", hit: str = "score >= t", digits: int = 6) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {keys}tp, fp, tn, fn, round(coalesce(recall, 0), {digits}) AS recall, round(coalesce("precision", 0), {digits}) AS "precision",
 round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0), {digits}) AS f1, round(coalesce(fpr, 0), {digits}) AS fpr,
 round(coalesce(10000 * fpr, 0), {digits}) AS benign_alerts_per_10000 FROM (SELECT *, tp / nullif(tp + fn, 0) AS recall,
 coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", fp / nullif(fp + tn, 0) AS fpr FROM (SELECT {keys}
 count(*) FILTER (label <> 'BENIGN' AND {hit}) AS tp, count(*) FILTER (label = 'BENIGN' AND {hit}) AS fp,
 count(*) FILTER (label = 'BENIGN' AND NOT {hit}) AS tn, count(*) FILTER (label <> 'BENIGN' AND NOT {hit}) AS fn FROM {source}{group}))"""


def pairs_sql(source: str, column: str = "score") -> str:
    """ROC-AUC by comparing all attack and benign rows, per family; average precision and TPR by rank."""
    return f"""r AS (SELECT label, {column} AS s FROM {source}),
fams AS (SELECT DISTINCT label AS family FROM r WHERE label <> 'BENIGN'),
pop AS MATERIALIZED (SELECT family, label = family AS y, s FROM r JOIN fams ON r.label = family OR r.label = 'BENIGN'),
cum AS (SELECT family, s, sum(CAST(y AS INT)) OVER w AS tp, sum(CAST(NOT y AS INT)) OVER w AS fp, y,
   sum(CAST(y AS INT)) OVER (PARTITION BY family) AS p, sum(CAST(NOT y AS INT)) OVER (PARTITION BY family) AS n FROM pop
   WINDOW w AS (PARTITION BY family ORDER BY s DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
rank AS (SELECT family, sum(CASE WHEN y THEN tp / (tp + fp) END) / any_value(p) AS pr_auc,
   coalesce(max(tp) FILTER (fp / n <= 0.01), 0) / any_value(p) AS tpr_at_fpr FROM cum GROUP BY 1),
auc AS (SELECT a.family, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS roc_auc
   FROM pop a JOIN pop b ON a.family = b.family AND a.y AND NOT b.y GROUP BY 1)"""


def _docs(spark, sf):
    return attack_days(spark, sf)


@query("G1_operating_point", D + ", d AS (SELECT *, 500.0 AS t FROM docs) " + point_sql("d"))
def operating_point(spark, sf):
    p = M.operating_point(_docs(spark, sf), "score", 500.0)
    return p.select("tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in POINT])


@query("G1_operating_point_of_test", C + ", d AS (SELECT * FROM sst CROSS JOIN thr WHERE split = 'test') " + point_sql("d"))
def operating_point_test(spark, sf):
    rows = shared.stream(spark, sf).filter(F.col("split") == "test")
    p = M.operating_point(rows, "score", shared.stream_threshold(spark, sf))
    return p.select("tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in POINT])


_ALL = """d AS (SELECT CASE WHEN label = 'BENIGN' THEN label ELSE 'attack' END AS label, score FROM docs)"""


@query("G2_roc_auc", f"{D}, {_ALL}, {pairs_sql('d')} SELECT round(roc_auc, 6) AS roc_auc FROM auc")
def roc_auc(spark, sf):
    return M.diagnostics(_docs(spark, sf), "score").select(r6("roc_auc").alias("roc_auc"))


@query("G3_pr_auc", f"{D}, {_ALL}, {pairs_sql('d')} SELECT round(pr_auc, 6) AS pr_auc FROM rank")
def pr_auc(spark, sf):
    return M.diagnostics(_docs(spark, sf), "score").select(r6("pr_auc").alias("pr_auc"))


@query("G4_tpr_at_fpr", f"{D}, {_ALL}, {pairs_sql('d')} SELECT round(tpr_at_fpr, 6) AS tpr_at_fpr FROM rank")
def tpr_at_fpr(spark, sf):
    return M.diagnostics(_docs(spark, sf), "score").select(r6("tpr_at_fpr").alias("tpr_at_fpr"))


@query("G5_family_metrics", f"""{C}, d AS (SELECT label, score FROM sst WHERE split = 'test'), {pairs_sql('d')}
SELECT family, sample_count, miss AS false_negative_count, round(1 - miss / sample_count, 6) AS recall,
 (SELECT count(*) FROM d WHERE label = 'BENIGN') AS n_benign, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc
FROM (SELECT label AS family, count(*) AS sample_count, count(*) FILTER (NOT score >= t) AS miss FROM d CROSS JOIN thr
 WHERE label <> 'BENIGN' GROUP BY 1) JOIN rank USING (family) JOIN auc USING (family)""")
def family_metrics(spark, sf):
    rows = shared.stream(spark, sf).filter(F.col("split") == "test")
    f = M.family_metrics(rows, "score", shared.stream_threshold(spark, sf))
    return f.select("family", "sample_count", "false_negative_count", "n_benign",
                    *[r6(c).alias(c) for c in ("recall", "roc_auc", "pr_auc")])


@query("G6_detection_summary", f"""{D}, {_ALL}, {pairs_sql('d')}, q AS (SELECT *, 500.0 AS t FROM docs), p AS ({point_sql('q')})
SELECT tp, fp, tn, fn, recall, "precision", f1, fpr, tp + fn AS n_positive, tp + fp + tn + fn AS n_total,
 round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(tpr_at_fpr, 6) AS tpr_at_fpr, CAST(NULL AS VARCHAR) AS note
FROM p CROSS JOIN rank CROSS JOIN auc""")
def detection_summary(spark, sf):
    s = M.detection_summary(durable(_docs(spark, sf)), "score", 500.0)
    return s.select("tp", "fp", "tn", "fn", "n_positive", "n_total", "note",
                    *[r6(c).alias(c) for c in ("recall", "precision", "f1", "fpr", "roc_auc", "pr_auc", "tpr_at_fpr")])


@query("G7_macro_recall", f"""{C} SELECT round(avg(r), 6) AS macro_recall FROM (SELECT avg(CAST(score >= t AS DOUBLE)) AS r
 FROM sst CROSS JOIN thr WHERE split = 'test' AND label <> 'BENIGN' GROUP BY label)""")
def macro(spark, sf):
    rows = shared.stream(spark, sf).filter(F.col("split") == "test")
    t = shared.stream_threshold(spark, sf)
    return M.macro_recall(M.family_recall(rows, F.col("score") >= t)).select(r6("macro_recall").alias("macro_recall"))


CANDIDATES = ["score", "score_without_nll", "nll_z"]


def _by_variant(columns, source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS variant, label, split, {c} AS v FROM {source}" for c in columns)


_SCREEN = f"""lng AS MATERIALIZED ({_by_variant(CANDIDATES, "sst")}),
lim AS (SELECT variant, min(v) FILTER (k >= ceil((n - 1) * 0.99::DOUBLE)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY v) - 1 AS k,
  count(*) OVER (PARTITION BY variant) AS n FROM lng WHERE split = 'dev' AND label = 'BENIGN') GROUP BY 1)"""
_RATES = """SELECT variant, any_value(t) AS threshold, count(*) FILTER (label <> 'BENIGN' AND v >= t) AS tp,
 count(*) FILTER (label = 'BENIGN' AND v >= t) AS fp, count(*) FILTER (label = 'BENIGN') AS nb, count(*) FILTER (label <> 'BENIGN') AS np"""


@query("G8_screen_candidates", f"""{C}, {_SCREEN}, dev AS (SELECT * FROM lng JOIN lim USING (variant) WHERE split = 'dev'),
 pts AS ({_RATES} FROM dev GROUP BY 1),
 mac AS (SELECT variant, avg(r) AS macro_recall FROM (SELECT variant, label, avg(CAST(v >= t AS DOUBLE)) AS r FROM dev WHERE label <> 'BENIGN' GROUP BY ALL) GROUP BY 1),
 rated AS (SELECT variant, threshold, macro_recall, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", fp / nb AS fpr,
  fp / nb <= 0.01 + 1.0 / nb + 1e-12 AS eligible FROM pts JOIN mac USING (variant))
SELECT variant, round(threshold, 6) AS threshold, round(macro_recall, 6) AS macro_recall, round("precision", 6) AS "precision",
 round(fpr, 6) AS fpr, eligible, CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible
 ORDER BY macro_recall DESC, "precision" DESC, CASE variant WHEN 'score' THEN 7 END NULLS LAST, variant) END AS rank FROM rated""")
def screen(spark, sf):
    dev = shared.stream(spark, sf).filter(F.col("split") == "dev")
    s = studies.screen_candidates(dev, CANDIDATES, 0.01, {"score": 7.0})
    return s.select("variant", *[r6(c).alias(c) for c in ("threshold", "macro_recall", "precision", "fpr")], "eligible", "rank")


@query("G9_improvement_gate", f"""{C}, {_SCREEN}, dev AS (SELECT * FROM lng JOIN lim USING (variant) WHERE split = 'dev'),
 fp AS (SELECT variant, avg(CAST(v >= t AS DOUBLE)) AS fpr FROM dev WHERE label = 'BENIGN' GROUP BY 1),
 mac AS (SELECT variant, avg(r) AS m FROM (SELECT variant, label, avg(CAST(v >= t AS DOUBLE)) AS r FROM dev WHERE label <> 'BENIGN' GROUP BY ALL) GROUP BY 1),
 q AS (SELECT * FROM fp JOIN mac USING (variant))
SELECT b.m - a.m >= 0.02 AND b.fpr - a.fpr <= 0.01 AS improves FROM q a, q b WHERE a.variant = 'nll_z' AND b.variant = 'score'""")
def gate(spark, sf):
    dev = shared.stream(spark, sf).filter(F.col("split") == "dev")
    s = durable(studies.screen_candidates(dev, CANDIDATES, 0.01))
    return M.improvement_gate(s.filter(F.col("variant") == "nll_z"), s.filter(F.col("variant") == "score"))


def _multi_timescale_sql(forest: bool = False) -> str:
    names = multiscale_names((8, 32, 128))
    order = '"timestamp", event_row_id'
    fit = multiscale_sql("tr", (8, 32, 128), order, "event_row_id, entity_id", rounded=False)
    dev = multiscale_sql("(SELECT * FROM flows WHERE split = 'dev')", (8, 32, 128), order, "event_row_id, entity_id", rounded=False)
    gmed = ", ".join(f"median({f}) AS med_{f}, greatest(0.25 * stddev_pop({f}), 1e-3) AS floor_{f}" for f in names)
    gall = ", ".join(f"any_value(g.med_{f}) AS med_{f}, greatest(1.4826 * median(abs(n.{f} - g.med_{f})), any_value(g.floor_{f})) AS scale_{f}"
                     for f in names)
    emed = ", ".join(f"median({f}) AS med_{f}" for f in names)
    eall = ", ".join(f"any_value(m.med_{f}) AS med_{f}, greatest(1.4826 * median(abs(n.{f} - m.med_{f})), any_value(g.floor_{f})) AS scale_{f}"
                     for f in names)
    z = " + ".join(f"abs(least(greatest((d.{f} - coalesce(e.med_{f}, g.med_{f})) / greatest(coalesce(e.scale_{f}, g.scale_{f}), 1e-6), -50), 50))"
                   for f in names)
    return f"""{C}, mtr AS MATERIALIZED ({fit}), mdev AS MATERIALIZED ({dev}), mg AS (SELECT {gmed} FROM mtr),
mga AS MATERIALIZED (SELECT {gall} FROM mtr n CROSS JOIN mg g), me AS (SELECT entity_id, {emed} FROM mtr GROUP BY 1 HAVING count(*) >= 30),
mea AS MATERIALIZED (SELECT n.entity_id, {eall} FROM mtr n JOIN me m USING (entity_id) CROSS JOIN mg g GROUP BY 1){', ' + forest_sql("mtr", "mdev", names, 42) if forest else ''}
SELECT d.event_row_id, s.label, round(s.nll_z, 6) AS next_event_nll, round(s.score, 6) AS equal_weight_combined, round(({z}) / {len(names)}.0, 6) AS multi_timescale{", round(i.isolation_forest, 6) AS isolation_forest" if forest else ""}
FROM mdev d JOIN sst s ON s.event_row_id = d.event_row_id{" JOIN forest i ON i.event_row_id = d.event_row_id" if forest else ""}
 CROSS JOIN mga g LEFT JOIN mea e ON e.entity_id = d.entity_id"""


@query("G10_candidate_scores", _multi_timescale_sql(forest=True))
def candidate_scores(spark, sf):
    """Four candidates on the development rows."""
    dev = flows(spark, sf).filter(F.col("split") == "dev")
    scored = shared.stream(spark, sf).filter(F.col("split") == "dev")
    return studies.candidate_scores(shared.benign_train(spark, sf), dev, scored, 42).select("event_row_id", "label", *[
        r6(c).alias(c) for c in ("next_event_nll", "equal_weight_combined", "multi_timescale", "isolation_forest")])


@query("G10_candidate_join", _multi_timescale_sql())
def candidate_join(spark, sf):
    """The candidates that SQL can express, joined on the row id."""
    names = multiscale_names((8, 32, 128))
    train = durable(multiscale_features(shared.benign_train(spark, sf), (8, 32, 128)).select("entity_id", "event_row_id", *names))
    dev = multiscale_features(flows(spark, sf).filter(F.col("split") == "dev"), (8, 32, 128)).select("entity_id", "event_row_id", *names)
    z = B.with_combo_score(B.with_robust_z(dev, B.fit_baselines(train, names)), names, name="multi_timescale")
    scored = shared.stream(spark, sf).select("event_row_id", "label", "nll_z", "score")
    return scored.join(z.select("event_row_id", "multi_timescale"), "event_row_id").select(
        "event_row_id", "label", r6("nll_z").alias("next_event_nll"), r6("score").alias("equal_weight_combined"),
        r6("multi_timescale").alias("multi_timescale"))


_ABL = f"""{C}, {_SCREEN}, tst AS (SELECT variant, label, v AS score, t FROM lng JOIN lim USING (variant) WHERE split = 'test'),
 mac AS (SELECT variant, avg(r) AS macro_recall FROM (SELECT variant, label, avg(CAST(score >= t AS DOUBLE)) AS r FROM tst WHERE label <> 'BENIGN' GROUP BY ALL) GROUP BY 1)
SELECT p.*, round(macro_recall, 6) AS macro_recall FROM ({point_sql('tst', 'variant')}) p JOIN mac USING (variant)"""


@query("G11_ablation_study", _ABL)
def ablation(spark, sf):
    s = shared.stream(spark, sf)
    out = studies.ablation_study(s.filter(F.col("split") == "dev"), s.filter(F.col("split") == "test"), CANDIDATES, 0.01)
    return out.select("variant", "tp", "fp", "tn", "fn", *[r6(c).alias(c) for c in [*POINT, "macro_recall"]])


def drift_sql(columns) -> str:
    values = " UNION ALL ".join(f"SELECT day, '{c}' AS variant, label, {c} AS v FROM daily" for c in columns)
    return f"""{day_thresholds_sql(columns)}, lng AS ({values}),
 pts AS (SELECT variant, policy, day, prev_day, label, v, threshold AS t FROM lng JOIN lim USING (day, variant)),
 cells AS (SELECT variant, policy, day, prev_day, count(*) FILTER (label <> 'BENIGN' AND v >= t) AS tp, count(*) FILTER (label = 'BENIGN' AND v >= t) AS fp,
   count(*) FILTER (label = 'BENIGN') AS nb, count(*) FILTER (label <> 'BENIGN') AS np FROM pts GROUP BY ALL),
 mac AS (SELECT variant, policy, day, avg(r) AS macro_recall FROM (SELECT variant, policy, day, label, avg(CAST(v >= t AS DOUBLE)) AS r
   FROM pts WHERE label <> 'BENIGN' GROUP BY ALL) GROUP BY ALL),
 daily_points AS (SELECT c.*, fp / nullif(nb, 0) AS fpr, coalesce(tp / nullif(np, 0), 0) AS recall, macro_recall FROM cells c LEFT JOIN mac USING (variant, policy, day))"""


_DRIFT = f"{C}, {drift_sql(['score', 'score_without_nll'])}"


@query("G12_drift_study", f"""{_DRIFT} SELECT variant, policy, day, prev_day, tp, fp, round(coalesce(fpr, 0), 6) AS fpr, round(recall, 6) AS recall,
 round(macro_recall, 6) AS macro_recall, policy <> 'prev_day_unlabeled' AS labels_used FROM daily_points""")
def drift(spark, sf):
    p = studies.drift_study(shared.stream(spark, sf), ["score", "score_without_nll"], DEV_DAY, 0.01)
    return p.select("variant", "policy", "day", "prev_day", "tp", "fp", r6("fpr").alias("fpr"), r6("recall").alias("recall"),
                    r6("macro_recall").alias("macro_recall"), "labels_used")


@query("G12_drift_rollup", f"""{_DRIFT} SELECT variant, policy, round(max(coalesce(fpr, 0)), 6) AS max_daily_fpr, round(avg(coalesce(fpr, 0)), 6) AS mean_daily_fpr,
 count(*) FILTER (coalesce(fpr, 0) <= 0.02) AS days_within_2x_target, round(avg(recall), 6) AS mean_daily_recall,
 round(avg(macro_recall), 6) AS mean_daily_macro_recall FROM daily_points GROUP BY ALL""")
def drift_rollup(spark, sf):
    p = studies.drift_study(shared.stream(spark, sf), ["score", "score_without_nll"], DEV_DAY, 0.01)
    r = studies.drift_rollup(p, 0.01)
    return r.select("variant", "policy", "days_within_2x_target", *[r6(c).alias(c) for c in (
        "max_daily_fpr", "mean_daily_fpr", "mean_daily_recall", "mean_daily_macro_recall")])


def _marked(spark, sf):
    return studies.mark_false_positives(shared.stream(spark, sf), shared.detector(spark, sf).known_entities, DEV_DAY, 0.05)


FP = f"""{C}, m AS MATERIALIZED (SELECT strftime("timestamp", '%Y-%m-%d') AS day, hour("timestamp") AS hour, entity_id, dst_id,
  top_contributing_feature, has_baseline AS known, score >= {threshold_of('sst', 'score', "label = 'BENIGN' AND strftime(\"timestamp\", '%Y-%m-%d') = '2024-01-21'").replace('0.99::DOUBLE', '0.95::DOUBLE')} AS alert
  FROM sst WHERE label = 'BENIGN' AND strftime("timestamp", '%Y-%m-%d') <> '2024-01-21'),
 e AS (SELECT day, entity_id, count(*) AS benign_rows, count(*) FILTER (alert) AS fp, any_value(known) AS has_baseline FROM m GROUP BY ALL),
 er AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY fp DESC, entity_id) AS rank FROM e)"""


@query("G13a_fp_by_entity", f"""{FP} SELECT day, entity_id, CAST(rank AS INT) AS rank, benign_rows, fp AS false_positives, has_baseline,
 round(fp / benign_rows, 6) AS entity_fpr FROM er WHERE rank <= 10""")
def fp_entities(spark, sf):
    t = studies.fp_top_entities(_marked(spark, sf))
    return t.select("day", "entity_id", "rank", "benign_rows", "false_positives", "has_baseline", r6("entity_fpr").alias("entity_fpr"))


@query("G13b_fp_concentration", f"""{FP} SELECT day, CAST(sum(benign_rows) AS BIGINT) AS benign_rows, CAST(sum(fp) AS BIGINT) AS false_positives,
 round(sum(fp) / sum(benign_rows), 6) AS fpr, count(*) AS benign_entities, count(*) FILTER (fp > 0) AS entities_with_false_positives,
 round(coalesce(sum(fp) FILTER (rank = 1) / nullif(sum(fp), 0), 0), 6) AS fp_share_top_1,
 round(coalesce(sum(fp) FILTER (rank <= 5) / nullif(sum(fp), 0), 0), 6) AS fp_share_top_5,
 round(coalesce(coalesce(sum(fp) FILTER (rank > 5), 0) / nullif(sum(benign_rows) FILTER (rank > 5), 0), 0), 6) AS fpr_without_top_5 FROM er GROUP BY day""")
def fp_concentration(spark, sf):
    t = studies.fp_concentration(_marked(spark, sf))
    return t.select("day", "benign_rows", "false_positives", "benign_entities", "entities_with_false_positives",
                    *[r6(c).alias(c) for c in ("fpr", "fp_share_top_1", "fp_share_top_5", "fpr_without_top_5")])


@query("G13c_fp_cold_start", f"""{FP} SELECT day, round(avg(CAST(NOT known AS DOUBLE)), 6) AS benign_row_share,
 round(coalesce(count(*) FILTER (alert AND NOT known) / nullif(count(*) FILTER (alert), 0), 0), 6) AS fp_share,
 round(coalesce(count(*) FILTER (alert AND known) / nullif(count(*) FILTER (known), 0), 0), 6) AS fpr_with_baseline,
 round(coalesce(count(*) FILTER (alert AND NOT known) / nullif(count(*) FILTER (NOT known), 0), 0), 6) AS fpr_cold_start FROM m GROUP BY day""")
def fp_cold(spark, sf):
    t = studies.fp_cold_start(_marked(spark, sf))
    return t.select("day", *[r6(c).alias(c) for c in t.columns if c != "day"])


@query("G13d_fp_top_peers", f"""{FP}, p AS (SELECT day, dst_id AS peer, count(*) AS n, count(*) FILTER (alert) AS fp FROM m GROUP BY ALL),
 day_total AS (SELECT day, sum(n) AS an, sum(fp) AS afp FROM p GROUP BY 1)
SELECT day, CAST(rank AS INT) AS rank, peer, fp AS false_positives, round(fp / afp, 6) AS fp_share, round((afp - fp) / (an - n), 6) AS fpr_without_peer
 FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY fp DESC, peer) AS rank FROM p WHERE fp > 0) JOIN day_total USING (day) WHERE rank <= 10""")
def fp_peers(spark, sf):
    t = studies.fp_top_peers(_marked(spark, sf))
    return t.select("day", "rank", "peer", "false_positives", r6("fp_share").alias("fp_share"),
                    r6("fpr_without_peer").alias("fpr_without_peer"))


@query("G13e_fp_by_feature", f"""{FP}, g AS (SELECT day, top_contributing_feature, count(*) AS fp FROM m WHERE alert GROUP BY ALL)
SELECT *, round(fp / sum(fp) OVER (PARTITION BY day), 6) AS fp_share FROM g""")
def fp_feature(spark, sf):
    t = studies.fp_by_feature(_marked(spark, sf))
    return t.select("day", "top_contributing_feature", "fp", r6("fp_share").alias("fp_share"))


@query("G13e_fp_by_hour", f"""{FP} SELECT day, CAST(hour AS INT) AS hour, count(*) AS benign_rows, count(*) FILTER (alert) AS fp,
 round(avg(CAST(alert AS DOUBLE)), 6) AS fpr FROM m GROUP BY ALL""")
def fp_hour(spark, sf):
    t = studies.fp_by_hour(_marked(spark, sf))
    return t.select("day", "hour", "benign_rows", "fp", r6("fpr").alias("fpr"))


@query("G14_transfer_study", f"""{C}, q AS (SELECT label, score, t FROM sst CROSS JOIN thr), p AS ({point_sql('q')}),
 d AS (SELECT CASE WHEN label = 'BENIGN' THEN label ELSE 'attack' END AS label, score FROM sst), {pairs_sql('d')}
SELECT tp, fp, recall, fpr, round(roc_auc, 6) AS roc_auc, round(tpr_at_fpr, 6) AS tpr_at_fpr,
 (SELECT round(avg(CAST(token_id = 1 AS DOUBLE)), 6) FROM tok WHERE split <> 'train') AS token_unk_rate,
 (SELECT round(avg(r), 6) FROM (SELECT avg(CAST(score >= t AS DOUBLE)) AS r FROM q WHERE label <> 'BENIGN' GROUP BY label)) AS macro_recall
FROM p CROSS JOIN rank CROSS JOIN auc""")
def transfer(spark, sf):
    d = shared.calibrated(spark, sf)
    tokens = tokenize(flows(spark, sf).filter(F.col("split") != "train"), d.tokenizer)
    t = studies.transfer_study(tokens, shared.stream(spark, sf), d)
    return t.select("tp", "fp", *[r6(c).alias(c) for c in ("recall", "fpr", "roc_auc", "tpr_at_fpr", "token_unk_rate", "macro_recall")])


def _fold_runs(spark, sf):
    """Metrics of three folds of the labelled documents, written and read back as run artifacts."""
    rows = _docs(spark, sf).withColumns({"fold": F.pmod("doc_id", F.lit(3)), "value": F.col("score"), "threshold": F.lit(500.0)})
    rows = durable(rows)
    points = M.operating_point(rows, "score", 500.0, ["fold"])
    fams = M.family_recall(rows, F.col("score") >= 500.0, ["fold"]).groupBy("fold").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("family", F.struct(F.col("sample_count"), F.col("recall")))))).alias("families"))
    runs = points.join(fams, "fold").select(
        (F.col("fold") + 42).alias("seed"), F.struct("recall", "precision", "f1", F.col("fpr").alias("observed_test_fpr"),
        F.col("benign_alerts_per_10000").alias("benign_alerts_per_10000_events")).alias("point"), "families")
    # Seed 42 uses the nested shape, the others the flat one.
    nested = F.col("seed") == 42
    shaped = runs.select(
        F.when(nested, F.struct("seed")).alias("run_manifest"), F.when(~nested, F.col("seed")).alias("seed"),
        F.when(nested, F.struct(F.col("point").alias("frozen_operating_point"))).alias("detection"),
        F.when(~nested, F.col("point")).alias("frozen_operating_point"),
        F.when(nested, F.col("families")).alias("detection_by_label"), F.when(~nested, F.col("families")).alias("per_attack"))
    path = scratch(spark)
    shaped.repartition(3, F.coalesce("seed", F.lit(42))).write.option("maxRecordsPerFile", 1).json(path)
    return files.read_runs(spark, path, "docs")


_FOLDS = f"""{D}, d AS (SELECT doc_id % 3 + 42 AS seed, label, score, 500.0 AS t FROM docs), p AS ({point_sql('d', 'seed', digits=12)}),
 fam AS (SELECT seed, label AS family, count(*) AS sample_count, avg(CAST(score >= t AS DOUBLE)) AS recall FROM d WHERE label <> 'BENIGN' GROUP BY ALL)"""


@query("A8_read_runs", f"""{_FOLDS} SELECT seed, round(recall, 6) AS recall, round("precision", 6) AS "precision", round(f1, 6) AS f1, round(fpr, 6) AS fpr, round(macro, 6) AS macro_recall FROM p
 JOIN (SELECT seed, avg(recall) AS macro FROM fam GROUP BY 1) USING (seed)""")
def read_runs(spark, sf):
    return _fold_runs(spark, sf).select("seed", *[r6(c).alias(c) for c in ("recall", "precision", "f1", "fpr", "macro_recall")])


@query("G15_seed_aggregate", f"""{_FOLDS}, w AS (SELECT p.*, macro AS macro_recall FROM p JOIN (SELECT seed, avg(recall) AS macro FROM fam GROUP BY 1) USING (seed)),
 l AS (UNPIVOT (SELECT CAST(recall AS DOUBLE) AS recall, CAST("precision" AS DOUBLE) AS "precision", CAST(f1 AS DOUBLE) AS f1, CAST(fpr AS DOUBLE) AS fpr,
  CAST(benign_alerts_per_10000 AS DOUBLE) AS benign_alerts_per_10000, CAST(macro_recall AS DOUBLE) AS macro_recall FROM w)
  ON COLUMNS(*) INTO NAME metric VALUE v)
SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n_runs FROM l GROUP BY 1""")
def seed_aggregate(spark, sf):
    a = studies.seed_aggregate(_fold_runs(spark, sf))
    return a.select("metric", r6("mean").alias("mean"), r6("std").alias("std"), "n_runs")


@query("G16_family_aggregate", f"""{_FOLDS} SELECT family, round(avg(recall), 6) AS mean, round(stddev_pop(recall), 6) AS std, count(*) AS n_runs,
 arg_min(sample_count, seed) AS sample_count FROM fam GROUP BY 1""")
def family_aggregate(spark, sf):
    a = studies.family_aggregate(files.run_families(_fold_runs(spark, sf)))
    return a.select("family", r6("mean").alias("mean"), r6("std").alias("std"), "n_runs", "sample_count")


_FOREST = multiscale_names((8, 32, 128))
_RUNS = [f"forest_{seed}" for seed in studies.SEEDS]


def _seeded_sql() -> str:
    """The scored stream with one forest score per seed; each forest is a query of its own."""
    order = '"timestamp", event_row_id'
    features = lambda source: multiscale_sql(source, (8, 32, 128), order, "event_row_id", rounded=False)
    forests = ", ".join(f"{run} AS MATERIALIZED (WITH {forest_sql('ftrain', 'frows', _FOREST, seed)} "
                        f"SELECT event_row_id, round(isolation_forest, 6) AS {run} FROM forest)" for run, seed in zip(_RUNS, studies.SEEDS))
    joins = " ".join(f"JOIN {run} USING (event_row_id)" for run in _RUNS)
    return f"""{C}, ftrain AS MATERIALIZED ({features("tr")}),
 frows AS MATERIALIZED ({features("(SELECT * FROM flows WHERE split <> 'train')")}), {forests},
 seeded AS MATERIALIZED (SELECT * FROM sst {joins})"""


def _seeded(spark, sf):
    """The scored stream with the scores of three forests, each grown from a seed of its own, to six places."""
    def build():
        fit = durable(multiscale_features(shared.benign_train(spark, sf), (8, 32, 128)).select("event_row_id", *_FOREST))
        rows = multiscale_features(flows(spark, sf).filter(F.col("split") != "train"), (8, 32, 128)).select("event_row_id", *_FOREST)
        for run, seed in zip(_RUNS, studies.SEEDS):
            rows = iforest.with_isolation_score(rows, durable(iforest.fit_forest(fit, "event_row_id", _FOREST, seed)), _FOREST, run)
        rows = rows.select("event_row_id", *[F.round(run, 6).alias(run) for run in _RUNS])
        return durable(shared.stream(spark, sf).join(rows, "event_row_id"))
    return shared.once(spark, sf, "seeded", build)


def _studied(spark, artifacts):
    """Artifacts written one file each and read back."""
    path = scratch(spark)
    sinks.write_studies(artifacts, path)
    return files.read_studies(spark, path)


def _drift_points(spark, sf):
    p = studies.drift_study(_seeded(spark, sf), _RUNS, DEV_DAY, 0.01)
    p = durable(p.withColumns({"seed": F.substring_index("variant", "_", -1).cast("long"), "variant": F.lit("isolation_forest")}))
    return durable(studies.drift_points(_studied(spark, studies.drift_artifacts(p, 0.01)), "isolation_forest"))


_SEEDS = f"""{_seeded_sql()}, {drift_sql(_RUNS).replace("FROM sst)", "FROM seeded)")},
 sp AS (SELECT variant AS seed, policy, day, coalesce(fpr, 0) AS fpr, recall, macro_recall FROM daily_points)"""


@query("G17_drift_over_seeds_daily", f"""{_SEEDS} SELECT policy, policy <> 'prev_day_unlabeled' AS labels_used, day, round(avg(fpr), 6) AS mean,
 round(stddev_pop(fpr), 6) AS std, count(*) AS n_runs FROM sp GROUP BY ALL""")
def drift_seeds_daily(spark, sf):
    daily, _ = studies.drift_over_seeds(_drift_points(spark, sf))
    return daily.select("policy", "labels_used", "day", r6("mean").alias("mean"), r6("std").alias("std"), "n_runs")


@query("G17_drift_over_seeds_rollup", f"""{_SEEDS}, ps AS (SELECT policy, seed, max(fpr) AS max_daily_fpr, avg(recall) AS mean_daily_recall,
  avg(macro_recall) AS mean_daily_macro_recall FROM sp GROUP BY ALL)
SELECT policy, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n_runs FROM
 (UNPIVOT ps ON max_daily_fpr, mean_daily_recall, mean_daily_macro_recall INTO NAME metric VALUE v) GROUP BY ALL""")
def drift_seeds_rollup(spark, sf):
    _, roll = studies.drift_over_seeds(_drift_points(spark, sf))
    return roll.select("policy", "metric", r6("mean").alias("mean"), r6("std").alias("std"), "n_runs")


_RIVALS = ["score", "score_without_nll"]
_SEED_LONG = f"""{_seeded_sql()}, cols AS ({_by_variant([*_RIVALS, *_RUNS], "seeded")}),
lng AS MATERIALIZED (SELECT s.seed, CASE WHEN variant LIKE 'forest%' THEN 'isolation_forest' ELSE variant END AS variant, label, split, v
  FROM cols JOIN (SELECT unnest({studies.SEEDS}) AS seed) s ON variant NOT LIKE 'forest%' OR variant = 'forest_' || s.seed),
lim AS (SELECT seed, variant, min(v) FILTER (k >= ceil((n - 1) * 0.99::DOUBLE)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY seed, variant ORDER BY v) - 1 AS k,
  count(*) OVER (PARTITION BY seed, variant) AS n FROM lng WHERE split = 'dev' AND label = 'BENIGN') GROUP BY ALL)"""


def _run_of(spark, sf, seed, split):
    return _seeded(spark, sf).filter(F.col("split") == split).withColumnRenamed(f"forest_{seed}", "isolation_forest")


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("G17_selection_over_seeds", f"""{_SEED_LONG}, dev AS (SELECT * FROM lng JOIN lim USING (seed, variant) WHERE split = 'dev'),
 pts AS (SELECT seed, variant, any_value(t) AS threshold, count(*) FILTER (label <> 'BENIGN' AND v >= t) AS tp,
  count(*) FILTER (label = 'BENIGN' AND v >= t) AS fp, count(*) FILTER (label = 'BENIGN') AS nb FROM dev GROUP BY ALL),
 mac AS (SELECT seed, variant, avg(r) AS macro_recall FROM (SELECT seed, variant, label, avg(CAST(v >= t AS DOUBLE)) AS r FROM dev WHERE label <> 'BENIGN' GROUP BY ALL) GROUP BY ALL),
 rated AS (SELECT seed, variant, threshold, macro_recall, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", fp / nb AS fpr,
  fp / nb <= 0.01 + 1.0 / nb + 1e-12 AS eligible FROM pts JOIN mac USING (seed, variant)),
 won AS (SELECT seed, variant AS winner, threshold AS winner_threshold FROM rated WHERE eligible
  QUALIFY row_number() OVER (PARTITION BY seed ORDER BY macro_recall DESC, "precision" DESC, variant) = 1)
SELECT CAST(seed AS BIGINT) AS seed, winner, round(winner_threshold, 6) AS winner_threshold, variant, round(macro_recall, 6) AS macro_recall,
 round("precision", 6) AS "precision", round(fpr, 6) AS fpr FROM rated JOIN won USING (seed)""")
def selection_seeds(spark, sf):
    """Candidate selection of three seeds, written as artifacts, read back and flattened."""
    screened = _union([studies.screen_candidates(_run_of(spark, sf, s, "dev"), [*_RIVALS, "isolation_forest"], 0.01)
                       .withColumn("seed", F.lit(s).cast("long")) for s in studies.SEEDS])
    out = studies.selection_summary(_studied(spark, studies.selection_artifacts(screened)))
    return out.select("seed", "winner", "variant", *[r6(c).alias(c) for c in ("winner_threshold", "macro_recall", "precision", "fpr")])


@query("G17_ablation_over_seeds", f"""{_SEED_LONG}, tst AS (SELECT seed, variant, label, v AS score, t FROM lng JOIN lim USING (seed, variant) WHERE split = 'test'),
 mac AS (SELECT seed, variant, avg(r) AS macro_recall FROM (SELECT seed, variant, label, avg(CAST(score >= t AS DOUBLE)) AS r FROM tst WHERE label <> 'BENIGN' GROUP BY ALL) GROUP BY ALL),
 w AS (SELECT variant, CAST(recall AS DOUBLE) AS recall, CAST("precision" AS DOUBLE) AS "precision", CAST(f1 AS DOUBLE) AS f1, CAST(fpr AS DOUBLE) AS fpr, macro_recall
  FROM ({point_sql('tst', 'seed, variant', digits=12)}) JOIN mac USING (seed, variant))
SELECT variant, metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) AS n_runs FROM
 (UNPIVOT w ON recall, "precision", f1, fpr, macro_recall INTO NAME metric VALUE v) GROUP BY ALL""")
def ablation_seeds(spark, sf):
    """Ablation of three seeds, written as artifacts, read back and averaged."""
    points = _union([studies.ablation_study(_run_of(spark, sf, s, "dev"), _run_of(spark, sf, s, "test"), [*_RIVALS, "isolation_forest"], 0.01)
                     .withColumn("seed", F.lit(s).cast("long")) for s in studies.SEEDS])
    summary = studies.ablation_summary(_studied(spark, studies.ablation_artifacts(points)))
    out = studies.variants_over_seeds(summary, ["recall", "precision", "f1", "fpr", "macro_recall"])
    return out.select("variant", "metric", r6("mean").alias("mean"), r6("std").alias("std"), "n_runs")
