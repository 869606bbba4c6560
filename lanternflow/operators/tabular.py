"""Standardisation, category ids and temperature calibration for feature tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators.metrics import diagnostics
from lanternflow.operators.scale import global_rank
from lanternflow.session import durable


def clean_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Keep rows with ok = 1, add missing columns, turn unparsable values into zero."""
    out = df.filter(V.to_number(F.col("ok")) == 1) if "ok" in df.columns else df
    rest = [c for c in out.columns if c not in {*numeric, *categorical}]

    def value(c: str):
        return F.coalesce(V.to_number(F.col(c)), F.lit(0.0)) if c in out.columns else F.lit(0.0)

    return out.select(*rest, *[value(c).alias(c) for c in numeric],
                      *[value(c).cast("int").alias(c) for c in categorical])


def fit_standardizer(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a flat column gets deviation 1."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, 1.0 if (row[f"s_{c}"] or 0.0) < 1e-8 else row[f"s_{c}"]) for c in columns}


def standardize(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()})


def fit_categories(train: DataFrame, column: str) -> DataFrame:
    """Sorted distinct training values numbered from 1; 0 is left for unseen values."""
    values = train.select(column).filter(F.col(column).isNotNull()).distinct()
    ranked = global_rank(values, [column], f"{column}_id")
    return ranked.withColumn(f"{column}_id", (F.col(f"{column}_id") + 1).cast("int"))


def with_category_ids(df: DataFrame, column: str, fitted: DataFrame) -> DataFrame:
    return df.join(fitted, column, "left").withColumn(f"{column}_id", F.coalesce(f"{column}_id", F.lit(0)))


# Bounds of 1/T, and how many passes a fit may take.
LEAST_SLOPE, MOST_SLOPE, PASSES = 1e-6, 2.0 ** 20, 200


def fit_temperature(rows: DataFrame, logit: str, label: str) -> float:
    """T that minimises the log loss of sigmoid(logit / T), found by Newton steps on 1/T.

    The loss is convex in 1/T; its first two derivatives are sums, so each step is one aggregate over ``rows``,
    which should be a stored table. The sign of the slope keeps a bracket around the minimum, and a
    step that would leave it halves the bracket instead. Labels that zero separates end where no loss is left in
    double precision, labels that no slope fits at the least 1/T. Rows with a null logit or label don't count.
    """
    z, y = F.col(logit).cast("double"), F.col(label).cast("double")
    known = rows.select(z.alias("z"), y.alias("y")).filter("z IS NOT NULL AND y IS NOT NULL")

    def slope_at(b: float) -> tuple[float, float]:
        # 1 / (1 + exp(-x)) without overflow
        x = F.col("z") * F.lit(b)
        e = F.exp(-F.abs(x))
        p = F.when(x >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))
        first, second = known.agg(F.sum((p - F.col("y")) * F.col("z")), F.sum(p * (1.0 - p) * F.col("z") * F.col("z"))).first()
        return first or 0.0, second or 0.0

    low, high, at = None, None, 1.0
    for _ in range(PASSES):
        first, second = slope_at(at)
        if first == 0 or (first > 0 and at <= LEAST_SLOPE) or (first < 0 and at >= MOST_SLOPE):
            break
        low, high = (low, at) if first > 0 else (at, high)
        if low is None or high is None:
            at = max(LEAST_SLOPE, at / 4) if first > 0 else min(MOST_SLOPE, at * 4)
            continue
        step = at - first / second if second > 0 else math.inf
        following = step if low < step < high else math.sqrt(low * high)
        if abs(following - at) <= 1e-12 * at:
            break
        at = following
    return 1.0 / at


def with_logit(df: DataFrame, p: str, name: str = "logit") -> DataFrame:
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1.0 - 1e-6))
    return df.withColumn(name, F.ln(clipped / (1.0 - clipped)))


def calibrated(df: DataFrame, logit: str, temperature: float, name: str = "p") -> DataFrame:
    return df.withColumn(name, 1.0 / (1.0 + F.exp(-(F.col(logit) / F.lit(temperature)))))


def evaluation_row(rows: DataFrame, p: str, label: str, temperature: float) -> DataFrame:
    """Size, positive rate, temperature and TPR at 1% and 0.1% FPR, at distinct scores only."""
    named = rows.select(F.col(p).alias("score"), F.when(F.col(label) == 1, "positive").otherwise("benign").alias("label"))
    named = durable(named)
    found = {}
    for name, fpr in (("tpr_at_fpr_1pct", 0.01), ("tpr_at_fpr_0_1pct", 0.001)):
        r = diagnostics(named, "score", target_fpr=fpr).first()
        found[name] = r["tpr_at_fpr"] if r else None
    return named.agg(F.count(F.lit(1)).alias("val_size"),
                     F.avg((F.col("label") == "positive").cast("double")).alias("positive_rate")).select(
        "*", F.lit(float(temperature)).alias("temperature"),
        *[F.lit(v).cast("double").alias(n) for n, v in found.items()])
