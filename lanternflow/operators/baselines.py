"""Robust per-entity baselines, z-scores and the combined score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.functions import scores as S
from lanternflow.operators.scale import HotKeys, exact_quantile, few, global_quantiles, hot_keys

# Fixed values of the robust scale.
MAD_TO_STD, STD_SHARE, SCALE_FLOOR = 1.4826, 0.25, 1e-3


@dataclass(frozen=True)
class Baselines:
    """Entity table (``entity_id, med_<f>, scale_<f>``) plus the global fallback."""

    features: list[str]
    entities: DataFrame
    medians: dict[str, float]
    scales: dict[str, float]


def _wide(long: DataFrame, by: str, features: Sequence[str], prefix: str) -> DataFrame:
    return long.groupBy(by).agg(
        *[F.max(F.when(F.col("feature") == f, F.col("quantile"))).alias(prefix + f) for f in features])


def _entity_medians(rows: DataFrame, features: Sequence[str], min_n: int) -> DataFrame:
    """Median and MAD per entity with a single shuffle: the group-by reuses the
    partitioning of the partition-only window."""
    per_entity = Window.partitionBy("entity_id")
    centred = rows.select("entity_id", *features,
                          *[F.median(f).over(per_entity).alias(f"med_{f}") for f in features])
    return (centred.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(f"med_{f}").alias(f"med_{f}") for f in features],
        *[F.median(F.abs(F.col(f) - F.col(f"med_{f}"))).alias(f"mad_{f}") for f in features])
        .filter(F.col("_n") >= min_n).drop("_n"))


def _hot_medians(rows: DataFrame, features: Sequence[str], most: int) -> DataFrame:
    """The same for entities too large for one task: bracketed exact quantiles."""
    med = _wide(exact_quantile(rows, features, 0.5, by=["entity_id"]), "entity_id", features, "med_")
    off = rows.join(few(med, most), "entity_id").select(
        "entity_id", *[F.abs(F.col(f) - F.col(f"med_{f}")).alias(f) for f in features])
    mad = _wide(exact_quantile(off, features, 0.5, by=["entity_id"]), "entity_id", features, "mad_")
    return med.join(few(mad, most), "entity_id")


def fit_baselines(windows: DataFrame, features: Sequence[str], min_n: int = 30,
                  hot: HotKeys | None = None) -> Baselines:
    """Median and floored MAD scale, global and per entity with at least ``min_n`` windows.

    ``windows`` is read several times; pass a durable table.
    """
    features = list(features)
    rows = windows.select("entity_id", *features)
    spread = rows.agg(*[F.stddev_pop(f).alias(f) for f in features], F.count(F.lit(1)).alias("_n")).first()
    if not spread["_n"]:
        raise ValueError("no training windows to fit baselines on")
    medians = {f: v[0] for f, v in global_quantiles(rows, features, [0.5], spread["_n"]).items()}
    off = rows.select(*[F.abs(F.col(f) - F.lit(medians[f])).alias(f) for f in features])
    mads = {f: v[0] for f, v in global_quantiles(off, features, [0.5], spread["_n"]).items()}
    floors = {f: max(STD_SHARE * (spread[f] or 0.0), SCALE_FLOOR) for f in features}
    scales = {f: max(mads[f] * MAD_TO_STD, floors[f]) for f in features}

    hot = hot or hot_keys(rows, ["entity_id"])
    cold, hot_rows = hot.split(rows)
    found = _entity_medians(cold, features, min_n)
    if hot_rows is not None:
        found = found.unionByName(_hot_medians(hot_rows, features, hot.most))
    entities = found.select("entity_id", *[F.col(f"med_{f}") for f in features], *[
        F.greatest(F.col(f"mad_{f}") * MAD_TO_STD, F.lit(floors[f])).alias(f"scale_{f}") for f in features])
    return Baselines(features, entities, medians, scales)


def baseline_table(b: Baselines) -> DataFrame:
    """Long form ``entity_id, feature, median, scale``; the global rows have no entity."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"med_{f}").alias("median"),
                               F.col(f"scale_{f}").alias("scale")) for f in b.features])
    own = b.entities.select("entity_id", F.explode(cells).alias("c")).select("entity_id", "c.*")
    shared = b.entities.sparkSession.createDataFrame(
        [(None, f, b.medians[f], b.scales[f]) for f in b.features],
        "entity_id string, feature string, median double, scale double")
    return own.unionByName(shared)


def with_robust_z(windows: DataFrame, b: Baselines, clip: float = S.Z_CLIP) -> DataFrame:
    """Add ``z_<feature>`` and ``has_baseline``; entities without a baseline use the global one.

    The entity table grows with the data, so the join strategy is left to adaptive
    execution, which also splits a hot entity.
    """
    known = b.entities.withColumn("_known", F.lit(True))
    joined = windows.join(known, "entity_id", "left")
    return joined.select(
        *[F.col(c) for c in windows.columns], F.coalesce("_known", F.lit(False)).alias("has_baseline"),
        *[S.robust_z(F.col(f), F.coalesce(F.col(f"med_{f}"), F.lit(b.medians[f])),
                     F.coalesce(F.col(f"scale_{f}"), F.lit(b.scales[f])), clip).alias(f"z_{f}")
          for f in b.features])


def with_combo_score(z: DataFrame, features: Sequence[str], dropped: Sequence[str] = (),
                     name: str = "combo_score") -> DataFrame:
    """Mean |z| over the features that are left after dropping some."""
    kept = S.kept_features(features, dropped)
    return z.withColumn(name, S.mean_abs([F.col(f"z_{f}") for f in kept]))
