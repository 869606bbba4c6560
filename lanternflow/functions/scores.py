"""Expressions over window arrays and robust z columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Z_CLIP = 50.0


def distinct_count(items: Column) -> Column:
    return F.size(F.array_distinct(items)).cast("double")


def top_share(items: Column) -> Column:
    """Share of the most common element of a short array (one sliding window)."""
    most = F.array_max(F.transform(
        F.array_distinct(items), lambda v: F.size(F.filter(items, lambda x: x == v))))
    return most / F.size(items)


def array_mean(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x) / F.size(items)


def array_std(items: Column) -> Column:
    """Population standard deviation of a short array."""
    mean = array_mean(items)
    return F.sqrt(F.aggregate(items, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(items))


def robust_z(x: Column, median: Column, scale: Column, clip: float = Z_CLIP) -> Column:
    z = (x - median) / F.greatest(scale, F.lit(1e-6))
    return F.least(F.greatest(z, F.lit(-clip)), F.lit(clip))


def mean_abs(zs: Sequence[Column]) -> Column:
    total = F.abs(zs[0])
    for z in zs[1:]:
        total = total + F.abs(z)
    return total / F.lit(float(len(zs)))


def top_feature(names: Sequence[str], prefix: str = "z_") -> Column:
    """Name of the feature with the largest |z|; the first one wins a tie.

    Sizes are compared to nine places, so features whose z-scores are equal on paper tie
    whatever the rounding of their sums.
    """
    ranked = F.array_max(F.array(*[
        F.struct(F.round(F.abs(F.col(prefix + n)), 9).alias("size"), F.lit(-i).alias("order"), F.lit(n).alias("name"))
        for i, n in enumerate(names)]))
    return ranked["name"]


def kept_features(features: Sequence[str], dropped: Sequence[str]) -> list[str]:
    """Features left after an ablation; unknown or all-dropping sets are rejected."""
    unknown = sorted(set(dropped) - set(features))
    if unknown:
        raise ValueError(f"ablation drops unknown features {unknown}")
    kept = [f for f in features if f not in set(dropped)]
    if not kept:
        raise ValueError("ablation drops every feature")
    return kept
