"""Detection metrics at frozen thresholds and ranking metrics with exact ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators.scale import CHUNK, range_chunks

ALL = "*"


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion(rows: DataFrame, alert: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, recall, precision, F1, FPR and benign alerts per 10,000."""
    benign = V.is_benign(F.col("label"))
    counts = rows.groupBy(*by).agg(
        F.count_if(alert & ~benign).alias("tp"), F.count_if(alert & benign).alias("fp"),
        F.count_if(~alert & benign).alias("tn"), F.count_if(~alert & ~benign).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = counts.select("*", ratio(tp, tp + fn).alias("recall"), ratio(tp, tp + fp).alias("precision"),
                          ratio(fp, fp + tn).alias("fpr"))
    return rated.select("*", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
                        .alias("f1"), (F.col("fpr") * 10000).alias("benign_alerts_per_10000"))


def operating_point(rows: DataFrame, score: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return confusion(rows, F.coalesce(F.col(score) >= t, F.lit(False)), by)


def _ranking(rows: DataFrame, score: str, by: Sequence[str], families: bool) -> DataFrame:
    """One row per group, family and distinct score with the counts at or above it.

    Rows are first reduced to counts per distinct score. Benign counts are accumulated
    once and shared by all families, so nothing is replicated. The running sums go over
    range chunks of the score, so a group of any size is spread over many tasks.
    """
    benign = V.is_benign(F.col("label"))
    family = F.when(benign, F.lit(None).cast("string")).otherwise(
        F.coalesce("label", F.lit("")) if families else F.lit(ALL))
    counted = (rows.filter(F.col(score).isNotNull())
               .groupBy(*by, F.col(score).alias("_score"), family.alias("family"))
               .agg(F.count(F.lit(1)).alias("n")))
    chunked = range_chunks(counted.withColumn("_down", -F.col("_score")), [*by, "_down"])

    def offsets(keys: Sequence[str], source: DataFrame, name: str) -> DataFrame:
        totals = source.groupBy(*keys, CHUNK).agg(F.sum("n").alias("n"))
        before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(*keys, CHUNK, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(name))

    attacks, normal = chunked.filter(F.col("family").isNotNull()), chunked.filter(F.col("family").isNull())
    # A chunk without benign rows still needs the benign total above it.
    zeros = chunked.select(*by, CHUNK).distinct().withColumn("n", F.lit(0).cast("long"))
    fp_before = offsets(by, normal.select(*by, CHUNK, "n").unionByName(zeros), "_fp0")
    tp_before = offsets([*by, "family"], attacks, "_tp0")
    inside = (Window.partitionBy(*by, CHUNK).orderBy("_down")
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    same = Window.partitionBy(*by, CHUNK, "_down")
    own = (Window.partitionBy(*by, CHUNK, "family").orderBy("_down")
           .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    is_fp = F.when(F.col("family").isNull(), F.col("n")).otherwise(0)
    summed = chunked.select("*", F.sum(is_fp).over(inside).alias("_fp"), F.sum(is_fp).over(same).alias("fp_here"),
                            F.sum("n").over(own).alias("_tp"))
    return (summed.filter(F.col("family").isNotNull())
            .join(fp_before, [*by, CHUNK]).join(tp_before, [*by, "family", CHUNK])
            .select(*by, "family", "n", "fp_here", (F.col("_fp") + F.col("_fp0")).alias("fp"),
                    (F.col("_tp") + F.col("_tp0")).alias("tp")))


def ranking_metrics(rows: DataFrame, score: str, by: Sequence[str] = (), families: bool = False,
                    target_fpr: float = 0.01) -> DataFrame:
    """ROC-AUC, average precision and the best TPR with FPR <= target, per group (and family).

    Every attack family is compared with all benign rows of its group. Values are null
    when a class is missing.
    """
    keys = [*by, "family"]
    benign = rows.filter(F.col(score).isNotNull()).groupBy(*by).agg(
        F.count_if(V.is_benign(F.col("label"))).alias("n_benign"))
    ranked = _ranking(rows, score, by, families)
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("n_attack"))
    both = totals.join(benign, list(by)) if by else totals.withColumn("n_benign", F.lit(benign.first()[0]))
    return _finish(ranked.join(both, keys), keys, target_fpr)


def _finish(joined: DataFrame, keys: Sequence[str], target_fpr: float) -> DataFrame:
    pos, neg = F.col("n_attack"), F.col("n_benign")
    wins = neg - F.col("fp") + F.col("fp_here") / 2
    out = joined.groupBy(*keys, "n_attack", "n_benign").agg(
        F.sum(F.col("n") * wins).alias("_u"),
        F.sum(F.col("n") * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_ap"),
        F.coalesce(F.max(F.when(F.col("fp") / neg <= target_fpr, F.col("tp"))), F.lit(0)).alias("_top"))
    some = neg > 0
    return out.select(*keys, "n_attack", "n_benign",
                      F.when(some, F.col("_u") / pos / neg).alias("roc_auc"),
                      F.when(some, F.col("_ap") / pos).alias("pr_auc"),
                      F.when(some, F.col("_top") / pos).alias("tpr_at_fpr"))


def diagnostics(rows: DataFrame, score: str, by: Sequence[str] = (), target_fpr: float = 0.01) -> DataFrame:
    """Ranking metrics of all attacks together."""
    return ranking_metrics(rows, score, by, False, target_fpr).drop("family")


def family_recall(rows: DataFrame, alert: Column, by: Sequence[str] = ()) -> DataFrame:
    attacks = rows.filter(~V.is_benign(F.col("label")))
    return attacks.groupBy(*by, F.coalesce("label", F.lit("")).alias("family")).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(~alert).alias("false_negative_count"),
        (1 - F.count_if(~alert) / F.count(F.lit(1))).alias("recall"))


def family_metrics(rows: DataFrame, score: str, threshold: float | Column, by: Sequence[str] = (),
                   target_fpr: float = 0.01) -> DataFrame:
    """Counts, misses, recall, ROC-AUC and average precision of each family vs all benign rows."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.coalesce(F.col(score) >= t, F.lit(False))
    keys = [*by, "family"]
    ranks = ranking_metrics(rows, score, by, True, target_fpr).select(*keys, "n_benign", "roc_auc", "pr_auc")
    return family_recall(rows, hit, by).join(ranks, keys, "left")


def macro_recall(families: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of the family recalls."""
    return families.groupBy(*by).agg(F.avg("recall").alias("macro_recall"))


def detection_summary(rows: DataFrame, score: str, threshold: float) -> DataFrame:
    """One row with the operating point and ranking metrics; a note marks single-class data."""
    point = operating_point(rows, score, threshold)
    ranks = diagnostics(rows, score).first()
    both = ranks is not None and ranks["roc_auc"] is not None
    cells = {c: F.lit(ranks[c] if both else None).cast("double") for c in ("roc_auc", "pr_auc", "tpr_at_fpr")}
    total = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    return point.select("*", (F.col("tp") + F.col("fn")).alias("n_positive"), total.alias("n_total"),
                        *[c.alias(n) for n, c in cells.items()],
                        F.lit(None if both else "single-class data").cast("string").alias("note"))


def improvement_gate(current: DataFrame, candidate: DataFrame) -> DataFrame:
    """+0.02 macro recall, at most +0.01 FPR and 1.10x latency; unmeasured latency is unbounded."""
    unbounded = F.lit(float("inf"))

    def side(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.lit(1).alias("_one"), F.col("macro_recall").alias(p + "recall"),
                         F.col("fpr").alias(p + "fpr"), F.coalesce("p95_latency_ms", unbounded).alias(p + "latency"))

    both = side(current, "a_").join(side(candidate, "b_"), "_one")
    return both.select(((F.col("b_recall") - F.col("a_recall") >= 0.02) & (F.col("b_fpr") - F.col("a_fpr") <= 0.01)
                        & (F.col("b_latency") <= F.col("a_latency") * 1.10)).alias("improves"))
