"""Label-blind splits. Each returns the input with a ``split`` column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.operators.scale import before_key, key_at_rank


def day_split(df: DataFrame, train_day: str, dev_day: str, test_days: Sequence[str],
              check: bool = True) -> DataFrame:
    """Whole calendar days; other days are dropped, an empty part is an error."""
    day = V.day_of(F.col("timestamp"))
    split = (F.when(day == train_day, "train").when(day == dev_day, "dev")
             .when(day.isin(list(test_days)), "test"))
    out = df.withColumn("split", split).filter(F.col("split").isNotNull())
    if check and out.select("split").distinct().count() < 3:
        raise ValueError("every part of the day split needs events")
    return out


def _check_fractions(train: float, val: float) -> None:
    if not 0 < train < 1 or not 0 <= val < 1 or train + val >= 1:
        raise ValueError("fractions must satisfy 0 < train and train + val < 1")


def _by_cuts(df: DataFrame, order: Sequence[str], cuts: dict[str, int], last: str, rows: int) -> DataFrame:
    """Name rows by global rank. Only the keys at the cuts are searched, so the rows
    themselves are neither sorted nor shuffled."""
    split: Column = F.lit(last)
    for name, rank in reversed(list(cuts.items())):
        split = F.when(before_key(order, key_at_rank(df, order, rank, rows)), name).otherwise(split)
    return df.withColumn("split", split)


def chronological_split(df: DataFrame, train: float, val: float, tie: str | Sequence[str] = "event_row_id") -> DataFrame:
    """First ``int(n*train)`` rows in time, then up to ``int(n*(train+val))``, then the rest; ``tie`` settles equal times."""
    _check_fractions(train, val)
    n = df.count()
    timed = df.withColumn("_at", F.unix_micros("timestamp"))
    ties = [tie] if isinstance(tie, str) else list(tie)
    return _by_cuts(timed, ["_at", *ties], {"train": int(n * train), "val": int(n * (train + val))},
                    "test", n).drop("_at")


def early_stop_cut(df: DataFrame, fraction: float = 0.9, tie: str = "event_row_id") -> DataFrame:
    """Earliest share for training, the rest for early stopping."""
    n = df.count()
    timed = df.withColumn("_at", F.unix_micros("timestamp"))
    return _by_cuts(timed, ["_at", tie], {"train": int(n * fraction)}, "early", n).drop("_at")


def _seeded_rank(key: str, seed: int) -> Column:
    """Sixty bits of the SHA-256 of ``seed:key``, which any engine can compute; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 15), 16, 10).cast("long")


def entity_holdout(df: DataFrame, train: float, val: float, seed: int) -> DataFrame:
    """Disjoint entities per part, in the order of a seeded hash.

    Parts hold ``max(1, int(n*f))`` entities. The rows are labelled by comparing their
    hash with two cut values, without a join.
    """
    hashed = df.withColumn("_h", _seeded_rank("entity_id", seed))
    entities = hashed.select("_h", "entity_id").distinct()
    n = entities.count()
    a = max(1, int(n * train))
    order = ["_h", "entity_id"]
    cut_a, cut_b = (key_at_rank(entities, order, r, n) for r in (a, a + max(1, int(n * val))))
    split = F.when(before_key(order, cut_a), "train").when(before_key(order, cut_b), "val").otherwise("test")
    return hashed.withColumn("split", split).drop("_h")


def entity_then_time(df: DataFrame, train: float, val: float, seed: int,
                     shares: dict[str, float] | None = None, tie: str = "event_row_id") -> DataFrame:
    """Entity holdout, then only the earliest share of every part is kept."""
    shares = shares or {"train": 0.85, "val": 0.5, "test": 0.5}
    parts = entity_holdout(df, train, val, seed).withColumn("_at", F.unix_micros("timestamp"))
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    keep = F.lit(False)
    for name, share in shares.items():
        part = parts.filter(F.col("split") == name)
        key = key_at_rank(part, ["_at", tie], int(counts.get(name, 0) * share), counts.get(name, 0))
        keep = keep | ((F.col("split") == name) & before_key(["_at", tie], key))
    return parts.filter(keep).drop("_at")


def content_hash_split(df: DataFrame, digest: Column, val_fraction: float) -> DataFrame:
    """Stable split by content digest."""
    cut = int((1.0 - val_fraction) * 1000)
    return df.withColumn("split", F.when(V.hash_bucket(digest) < cut, "train").otherwise("val"))


def seeded_random_split(df: DataFrame, key: str, val_fraction: float, seed: int) -> DataFrame:
    """Random split of exact size that does not depend on the partitioning."""
    hashed = df.withColumn("_h", _seeded_rank(key, seed))
    n = df.count()
    return _by_cuts(hashed, ["_h", key], {"train": int(n * (1.0 - val_fraction))}, "val", n).drop("_h")
