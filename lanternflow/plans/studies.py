"""Evaluation studies over scored streams: ablation, drift, false positives, selection, transfer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators import baselines as B
from lanternflow.operators import iforest
from lanternflow.operators import metrics as M
from lanternflow.operators import thresholds as T
from lanternflow.operators.tokens import unknown_token_rate
from lanternflow.operators.windows import multiscale_features, multiscale_names
from lanternflow.plans.detection import Detector
from lanternflow.session import durable

SEEDS = [42, 43, 44]
POINT_KEYS = ["recall", "precision", "f1", "fpr", "benign_alerts_per_10000"]


def long_scores(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per score variant."""
    return rows.select(*keep, *columns).unpivot(list(keep), list(columns), "variant", "value")


def _with_thresholds(long: DataFrame, thresholds: DataFrame, on: Sequence[str]) -> DataFrame:
    # Thresholds: one row per variant (and day, policy), a handful of rows.
    return long.join(F.broadcast(thresholds), list(on))


def points_with_macro(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Operating point and macro family recall per group of (value, threshold) rows.

    Both come from one aggregation by group and family, so the long rows are shuffled
    once, already combined.
    """
    benign, hit = V.is_benign(F.col("label")), F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False))
    family = F.when(benign, F.lit(None).cast("string")).otherwise(F.coalesce("label", F.lit("")))
    cells = long.groupBy(*by, "threshold", family.alias("family")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    attack = F.col("family").isNotNull()

    def total(flag: Column, c: Column) -> Column:
        return F.coalesce(F.sum(F.when(flag, c)), F.lit(0))

    counts = cells.groupBy(*by, "threshold").agg(
        total(attack, F.col("hits")).alias("tp"), total(~attack, F.col("hits")).alias("fp"),
        total(~attack, F.col("n") - F.col("hits")).alias("tn"),
        total(attack, F.col("n") - F.col("hits")).alias("fn"),
        F.avg(F.when(attack, F.col("hits") / F.col("n"))).alias("macro_recall"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = counts.select("*", M.ratio(tp, tp + fn).alias("recall"), M.ratio(tp, tp + fp).alias("precision"),
                          M.ratio(fp, fp + tn).alias("fpr"))
    return rated.select("*", M.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
                        .alias("f1"), (F.col("fpr") * 10000).alias("benign_alerts_per_10000"))


def ablation_study(dev: DataFrame, test: DataFrame, variants: Sequence[str], target_fpr: float) -> DataFrame:
    """Each variant's threshold comes from benign development rows and is applied to the test rows."""
    found = T.calibrate(dev.filter(V.is_benign(F.col("label"))), variants, target_fpr)
    long = _with_thresholds(long_scores(test, variants, ["label"]), found.select("variant", "threshold"), ["variant"])
    return points_with_macro(long, ["variant"])


def drift_study(scored: DataFrame, variants: Sequence[str], dev_day: str, target_fpr: float) -> DataFrame:
    """Daily operating points of every threshold policy; the stream must start on ``dev_day``."""
    first = scored.agg(F.min(V.day_of(F.col("timestamp")))).first()[0]
    if first != dev_day:
        raise ValueError(f"the first day of the data is {first}, not {dev_day}")
    limits = durable(T.day_thresholds(scored, variants, dev_day, target_fpr))
    rows = scored.withColumn("day", V.day_of(F.col("timestamp"))).filter(F.col("day") > dev_day)
    long = long_scores(rows, variants, ["day", "label"])
    points = points_with_macro(_with_thresholds(long, limits, ["day", "variant"]), ["variant", "policy", "day", "prev_day"])
    return points.withColumn("labels_used", F.col("policy") != "prev_day_unlabeled")


def drift_rollup(points: DataFrame, target_fpr: float) -> DataFrame:
    return points.groupBy("variant", "policy").agg(
        F.max("fpr").alias("max_daily_fpr"), F.avg("fpr").alias("mean_daily_fpr"),
        F.count_if(F.col("fpr") <= 2 * target_fpr).alias("days_within_2x_target"),
        F.avg("recall").alias("mean_daily_recall"), F.avg("macro_recall").alias("mean_daily_macro_recall"))


def mark_false_positives(scored: DataFrame, known: DataFrame, dev_day: str, target_fpr: float,
                         score: str = "score") -> DataFrame:
    """Benign rows after the development day with day, hour, alert and known columns."""
    rows = scored.withColumns({"day": V.day_of(F.col("timestamp")), "hour": F.hour("timestamp")})
    dev = rows.filter((F.col("day") == dev_day) & V.is_benign(F.col("label")))
    t = T.operating_thresholds(dev, [score], target_fpr, {score: float("inf")})[score]
    marks = known.select("entity_id").distinct().withColumn("known", F.lit(True))
    benign = rows.filter((F.col("day") != dev_day) & V.is_benign(F.col("label")))
    return (benign.join(marks, "entity_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))
            .withColumn("alert", F.col(score) >= F.lit(t))
            .select("day", "hour", "entity_id", "dst_id", "top_contributing_feature", "known", "alert"))


def fp_by_entity(marked: DataFrame) -> DataFrame:
    return marked.groupBy("day", "entity_id").agg(
        F.count(F.lit(1)).alias("benign_rows"), F.count_if("alert").alias("false_positives"),
        F.first("known").alias("has_baseline"))


def fp_top_entities(marked: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("day").orderBy(F.desc("false_positives"), F.asc("entity_id"))
    return (fp_by_entity(marked).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .withColumn("entity_fpr", M.ratio(F.col("false_positives"), F.col("benign_rows"))))


def fp_concentration(marked: DataFrame) -> DataFrame:
    """FP share of the top 1 and top 5 entities per day, and the FPR without the top 5."""
    per = fp_by_entity(marked)
    top = fp_top_entities(marked, 5).groupBy("day").agg(
        F.sum(F.when(F.col("rank") == 1, F.col("false_positives"))).alias("fp1"),
        F.sum("false_positives").alias("fp5"), F.sum("benign_rows").alias("rows5"))
    days = per.groupBy("day").agg(
        F.sum("benign_rows").alias("benign_rows"), F.sum("false_positives").alias("false_positives"),
        F.count(F.lit(1)).alias("benign_entities"),
        F.count_if(F.col("false_positives") > 0).alias("entities_with_false_positives"))
    fp, rows = F.col("false_positives"), F.col("benign_rows")
    return days.join(top, "day").select(
        "day", "benign_rows", "false_positives", M.ratio(fp, rows).alias("fpr"), "benign_entities",
        "entities_with_false_positives", M.ratio(F.col("fp1"), fp).alias("fp_share_top_1"),
        M.ratio(F.col("fp5"), fp).alias("fp_share_top_5"),
        M.ratio(fp - F.col("fp5"), rows - F.col("rows5")).alias("fpr_without_top_5"))


def fp_cold_start(marked: DataFrame) -> DataFrame:
    known, alert = F.col("known"), F.col("alert")
    c = marked.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~known).alias("cold"), F.count_if(alert).alias("fp"),
        F.count_if(alert & ~known).alias("cold_fp"))
    return c.select("day", M.ratio(F.col("cold"), F.col("n")).alias("benign_row_share"),
                    M.ratio(F.col("cold_fp"), F.col("fp")).alias("fp_share"),
                    M.ratio(F.col("fp") - F.col("cold_fp"), F.col("n") - F.col("cold")).alias("fpr_with_baseline"),
                    M.ratio(F.col("cold_fp"), F.col("cold")).alias("fpr_cold_start"))


def fp_top_peers(marked: DataFrame, n: int = 10) -> DataFrame:
    """Peers behind most false positives per day, with the FPR that remains without each."""
    per = marked.groupBy("day", F.coalesce("dst_id", F.lit("")).alias("peer")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("alert").alias("false_positives"))
    totals = per.groupBy("day").agg(F.sum("rows").alias("all_rows"), F.sum("false_positives").alias("all_fp"))
    w = Window.partitionBy("day").orderBy(F.desc("false_positives"), F.asc("peer"))
    top = (per.filter(F.col("false_positives") > 0).withColumn("rank", F.row_number().over(w))
           .filter(F.col("rank") <= n))
    return top.join(totals, "day").select(
        "day", "rank", "peer", "false_positives", M.ratio(F.col("false_positives"), F.col("all_fp")).alias("fp_share"),
        M.ratio(F.col("all_fp") - F.col("false_positives"), F.col("all_rows") - F.col("rows")).alias("fpr_without_peer"))


def fp_by_feature(marked: DataFrame) -> DataFrame:
    per = marked.filter("alert").groupBy("day", "top_contributing_feature").agg(F.count(F.lit(1)).alias("fp"))
    total = F.sum("fp").over(Window.partitionBy("day"))
    return per.select("day", "top_contributing_feature", "fp", (F.col("fp") / total).alias("fp_share"))


def fp_by_hour(marked: DataFrame) -> DataFrame:
    return marked.groupBy("day", "hour").agg(
        F.count(F.lit(1)).alias("benign_rows"), F.count_if("alert").alias("fp"),
        (F.count_if("alert") / F.count(F.lit(1))).alias("fpr"))


def screen_candidates(validation: DataFrame, columns: Sequence[str], target_fpr: float = 0.01,
                      latency_p95_ms: dict[str, float] | None = None) -> DataFrame:
    """All candidates with threshold, rates, eligibility and rank (1 = winner; null if not eligible)."""
    found = T.calibrate(validation.filter(V.is_benign(F.col("label"))), columns, target_fpr)
    long = _with_thresholds(long_scores(validation, columns, ["label"]),
                            found.select("variant", "threshold"), ["variant"])
    points = points_with_macro(long, ["variant"])
    latency = F.lit(None).cast("double")
    for name, ms in (latency_p95_ms or {}).items():
        latency = F.when(F.col("variant") == name, F.lit(float(ms))).otherwise(latency)
    slack = F.coalesce(F.try_divide(F.lit(1.0), F.col("fp") + F.col("tn")), F.lit(0.0))
    rated = points.select("variant", "threshold", F.coalesce("macro_recall", F.lit(0.0)).alias("macro_recall"),
                          "precision", "fpr", latency.alias("p95_latency_ms"),
                          (F.col("fpr") <= F.lit(target_fpr) + slack + F.lit(1e-12)).alias("eligible"))
    w = Window.partitionBy("eligible").orderBy(F.desc("macro_recall"), F.desc("precision"),
                                               F.asc_nulls_last("p95_latency_ms"), F.asc("variant"))
    return rated.withColumn("rank", F.when(F.col("eligible"), F.row_number().over(w)))


def select_candidate(validation: DataFrame, columns: Sequence[str], target_fpr: float = 0.01,
                     latency_p95_ms: dict[str, float] | None = None) -> DataFrame:
    """The winning candidate; an error when none meets the FPR constraint."""
    winner = durable(screen_candidates(validation, columns, target_fpr, latency_p95_ms).filter(F.col("rank") == 1))
    if winner.first() is None:
        raise RuntimeError("every candidate raises too many false alarms on the validation rows")
    return winner


def candidate_scores(train: DataFrame, dev: DataFrame, scored: DataFrame, seed: int,
                     widths: Sequence[int] = (8, 32, 128), trees: int = iforest.TREES) -> DataFrame:
    """Scored events joined on the row id with the multi-timescale and forest scores."""
    names = multiscale_names(widths)
    fit_rows = durable(multiscale_features(train, widths).select("entity_id", "event_row_id", *names))
    base = B.fit_baselines(fit_rows, names)
    forest = iforest.fit_forest(fit_rows, "event_row_id", names, seed, trees)
    rows = multiscale_features(dev, widths).select("entity_id", "event_row_id", *names)
    z = B.with_combo_score(B.with_robust_z(rows, base), names, name="multi_timescale")
    other = iforest.with_isolation_score(z, forest, names).select(
        "event_row_id", "multi_timescale", "isolation_forest")
    return scored.join(other, "event_row_id", "inner").withColumns(
        {"next_event_nll": F.col("nll_z"), "equal_weight_combined": F.col("score")})


def transfer_study(tokens: DataFrame, scored: DataFrame, d: Detector) -> DataFrame:
    """Frozen threshold on foreign events: unknown-token rate, operating point, ranking metrics."""
    rate = unknown_token_rate(tokens).first()[0]
    scored = durable(scored.select("label", "score"))
    summary = M.detection_summary(scored, "score", d.threshold)
    macro = M.macro_recall(M.family_recall(scored, F.col("score") >= F.lit(float(d.threshold)))).first()
    return summary.select("*", F.lit(rate or 0.0).alias("token_unk_rate"),
                          F.lit(macro["macro_recall"] if macro and macro["macro_recall"] is not None else 0.0)
                          .alias("macro_recall"))


def seed_aggregate(runs: DataFrame, require_seeds: Sequence[int] | None = SEEDS) -> DataFrame:
    """Mean and population deviation per dataset and metric; numeric seeds must match exactly."""
    if require_seeds is not None:
        odd = (runs.filter(F.col("seed").isNotNull()).groupBy("dataset")
               .agg(F.array_sort(F.collect_set("seed")).alias("seeds"))
               .filter(F.col("seeds") != F.array(*[F.lit(int(s)).cast("bigint") for s in sorted(require_seeds)])))
        bad = odd.first()
        if bad:
            raise ValueError(f"runs of {bad['dataset']} have the seeds {bad['seeds']}, wanted {list(require_seeds)}")
    keys = [k for k in [*POINT_KEYS, "macro_recall", "p95_latency_ms"] if k in runs.columns]
    long = runs.select("dataset", *[F.col(k).cast("double") for k in keys]).unpivot(
        ["dataset"], keys, "metric", "value").filter(F.col("value").isNotNull())
    return long.groupBy("dataset", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                                 F.count("value").alias("n_runs"))


def family_aggregate(families: DataFrame) -> DataFrame:
    """Per family: mean and deviation of the recall over the runs where it occurs."""
    return families.groupBy("dataset", "family").agg(
        F.avg("recall").alias("mean"), F.stddev_pop("recall").alias("std"), F.count(F.lit(1)).alias("n_runs"),
        F.min_by("sample_count", "seed").alias("sample_count"))


def drift_artifacts(points: DataFrame, target_fpr: float) -> DataFrame:
    """Drift points of several seeds as artifacts, one row per ``seed``: score variant, policy and day nested."""
    day = F.struct(F.col("fpr").alias("observed_test_fpr"), "recall", F.col("macro_recall").alias("macro_attack_family_recall"),
                   F.struct(F.col("labels_used").alias("labels_used_for_threshold")).alias("calibration_population"))
    policy = points.groupBy("seed", "variant", "policy").agg(
        F.max("fpr").alias("max_daily_fpr"), F.map_from_entries(F.collect_list(F.struct("day", day))).alias("days"))
    variant = policy.groupBy("seed", "variant").agg(
        F.map_from_entries(F.collect_list(F.struct("policy", F.struct("max_daily_fpr", "days")))).alias("policies"))
    scores = variant.groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("variant", "policies"))).alias("scores"))
    days = points.groupBy("seed").agg(F.array_sort(F.collect_set("day")).alias("test_days"))
    return scores.join(days, "seed").select(F.col("seed").alias("bundle_seed"), F.lit(float(target_fpr)).alias("target_fpr"),
                                            "test_days", "scores")


def selection_artifacts(screened: DataFrame) -> DataFrame:
    """Screened candidates of several seeds as artifacts, one row per ``seed``."""
    return screened.groupBy(F.col("seed").alias("bundle_seed")).agg(
        F.max(F.when(F.col("rank") == 1, F.struct("variant", "threshold"))).alias("winner"),
        F.array_sort(F.collect_list(F.struct("variant", "threshold", F.col("macro_recall").alias("macro_attack_family_recall"),
                                             "precision", "fpr", "p95_latency_ms"))).alias("candidates"))


def ablation_artifacts(points: DataFrame) -> DataFrame:
    """Operating points of ablation variants of several seeds as artifacts, one row per ``seed``."""
    point = F.struct("recall", "precision", "f1", F.col("fpr").alias("observed_test_fpr"),
                     F.col("benign_alerts_per_10000").alias("benign_alerts_per_10000_events"))
    value = F.struct(point.alias("frozen_operating_point"), F.col("macro_recall").alias("macro_attack_family_recall"))
    return points.groupBy(F.col("seed").alias("bundle_seed")).agg(
        F.map_from_entries(F.collect_list(F.struct("variant", value))).alias("variants"))


def drift_points(artifacts: DataFrame, score: str) -> DataFrame:
    """One row per artifact, policy and test day of one score."""
    runs = artifacts.filter(F.col("scores").isNotNull()).select(
        "artifact", F.col("bundle_seed").alias("seed"), "target_fpr", "test_days", F.explode(F.col("scores")[score]).alias("policy", "_p"))
    return runs.select("*", F.explode("_p.days").alias("day", "_d")).select(
        "artifact", "seed", "target_fpr", "test_days", "policy", F.col("_p.max_daily_fpr").alias("max_daily_fpr"), "day",
        F.col("_d.observed_test_fpr").alias("fpr"), F.col("_d.recall").alias("recall"),
        F.col("_d.macro_attack_family_recall").alias("macro_recall"),
        F.col("_d.calibration_population.labels_used_for_threshold").alias("labels_used"))


def _over_seeds(long: DataFrame, *by: str) -> DataFrame:
    return long.filter(F.col("value").isNotNull()).groupBy(*by).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("n_runs"))


def drift_over_seeds(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily FPR and per-policy rollups across the artifacts of ``drift_points``.

    They must agree on the test days, the target FPR and on which policies use labels. A metric that is
    null in an artifact is averaged over the others.
    """
    for column in ("test_days", "target_fpr"):
        if points.select(column).distinct().count() > 1:
            raise ValueError(f"drift runs disagree on {column}")
    mixed = points.groupBy("policy").agg(F.count_distinct("labels_used").alias("n")).filter("n > 1").first()
    if mixed:
        raise ValueError(f"drift runs disagree on the use of labels by {mixed['policy']}")
    daily = _over_seeds(points.select("policy", "labels_used", "day", F.col("fpr").alias("value")), "policy", "labels_used", "day")
    per_run = points.groupBy("policy", "artifact").agg(
        F.max("max_daily_fpr").alias("max_daily_fpr"), F.avg("recall").alias("mean_daily_recall"),
        F.avg("macro_recall").alias("mean_daily_macro_recall"))
    names = ["max_daily_fpr", "mean_daily_recall", "mean_daily_macro_recall"]
    return daily, _over_seeds(per_run.unpivot(["policy"], names, "metric", "value"), "policy", "metric")


def _required(c: Column, what: str) -> Column:
    return F.when(c.isNull(), F.raise_error(F.lit(f"study artifact has no {what}"))).otherwise(c)


def selection_summary(artifacts: DataFrame) -> DataFrame:
    """One row per selection artifact and candidate, with the winner and its threshold; a missing winner is an error."""
    rows = artifacts.filter(F.col("candidates").isNotNull()).select(
        "artifact", F.col("bundle_seed").alias("seed"), _required(F.col("winner.variant"), "winner").alias("winner"),
        F.col("winner.threshold").alias("winner_threshold"), F.explode("candidates").alias("_c"))
    return rows.select("artifact", "seed", "winner", "winner_threshold", F.col("_c.variant").alias("variant"),
                       F.col("_c.macro_attack_family_recall").alias("macro_recall"),
                       F.col("_c.precision").alias("precision"), F.col("_c.fpr").alias("fpr"))


def ablation_summary(artifacts: DataFrame) -> DataFrame:
    """One row per ablation artifact and variant; a variant without an operating point is an error."""
    rows = artifacts.filter(F.col("variants").isNotNull()).select(
        "artifact", F.col("bundle_seed").alias("seed"), F.explode("variants").alias("variant", "_v"))
    point = F.col("_v.frozen_operating_point")
    return rows.select("artifact", "seed", "variant", _required(point["recall"], "frozen_operating_point").alias("recall"),
                       point["precision"].alias("precision"), point["f1"].alias("f1"), point["observed_test_fpr"].alias("fpr"),
                       F.col("_v.macro_attack_family_recall").alias("macro_recall"))


def variants_over_seeds(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each variant's metrics over the artifacts of a summary."""
    return _over_seeds(summary.unpivot(["variant"], list(metrics), "metric", "value"), "variant", "metric")


def dataset_profile(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Rows in, out and dropped, distinct entities and event types."""
    rows_in = raw.count()
    return clean.agg(F.count(F.lit(1)).alias("rows_out"), F.count_distinct("entity_id").alias("entities"),
                     F.count_distinct("event_type").alias("event_types")).select(
        F.lit(rows_in).alias("rows_in"), "rows_out", (F.lit(rows_in) - F.col("rows_out")).alias("dropped"),
        "entities", "event_types")


def top_labels(events: DataFrame, n: int = 15) -> DataFrame:
    return events.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("label")).limit(n)
