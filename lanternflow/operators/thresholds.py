"""Operating thresholds from benign scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators.scale import exact_quantile

# Thresholds used when there is nothing to calibrate on.
FALLBACKS = {"combo_score": 2.0, "nll_z": 3.0}
POLICIES = ["frozen", "prev_day_benign", "prev_day_unlabeled"]


def calibrate(scores: DataFrame, columns: Sequence[str], target_fpr: float,
              by: Sequence[str] = ()) -> DataFrame:
    """Quantile 1 - fpr, upper neighbour, over finite scores: ``by..., variant, n, threshold``."""
    def finite(c: str):
        x = F.col(c).cast("double")
        return F.when(F.abs(x) < F.lit(float("inf")), x).alias(c)

    picked = exact_quantile(scores.select(*by, *[finite(c) for c in columns]), columns,
                            1.0 - float(target_fpr), "higher", by)
    return picked.select(*by, F.col("feature").alias("variant"), "n", F.col("quantile").alias("threshold"))


def operating_thresholds(scores: DataFrame, columns: Sequence[str], target_fpr: float,
                         fallbacks: dict[str, float] | None = None,
                         overrides: dict[str, float] | None = None) -> dict[str, float]:
    """One threshold per score column: an override, else the calibrated value, else a fallback."""
    found = {r["variant"]: r["threshold"] for r in calibrate(scores, columns, target_fpr).collect()}
    fallbacks = FALLBACKS if fallbacks is None else fallbacks
    return {c: (overrides or {}).get(c, found[c] if found.get(c) is not None else fallbacks.get(c))
            for c in columns}


def day_thresholds(scored: DataFrame, columns: Sequence[str], dev_day: str, target_fpr: float) -> DataFrame:
    """Thresholds for every test day and policy, from earlier days that have data.

    ``day, prev_day, policy, variant, threshold``. Days are few, so their table is small.
    """
    rows = scored.select(V.day_of(F.col("timestamp")).alias("day"), V.is_benign(F.col("label")).alias("benign"),
                         *columns)
    days = rows.select("day").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("day")
    pairs = days.select("day", F.lag("day").over(order).alias("prev_day")).filter(
        F.col("prev_day").isNotNull() & (F.col("day") > dev_day))
    benign = calibrate(rows.filter("benign"), columns, target_fpr, ["day"])
    every = calibrate(rows, columns, target_fpr, ["day"])

    def from_day(table: DataFrame, policy: str) -> DataFrame:
        t = table.select(F.col("day").alias("prev_day"), "variant", "threshold")
        return pairs.join(t, "prev_day").select("day", "prev_day", F.lit(policy).alias("policy"), "variant", "threshold")

    variants = F.explode(F.array(*[F.lit(c) for c in columns])).alias("variant")
    dev = benign.filter(F.col("day") == dev_day).select("variant", "threshold")
    frozen = pairs.select("day", "prev_day", variants).join(dev, "variant").select(
        "day", "prev_day", F.lit("frozen").alias("policy"), "variant", "threshold")
    return (frozen.unionByName(from_day(benign, "prev_day_benign"))
            .unionByName(from_day(every, "prev_day_unlabeled")))
