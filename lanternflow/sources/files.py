"""Readers for flow files, headerless parts, run artifacts and folders of binaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternflow.operators.adapters import adapt
from lanternflow.operators.scale import global_rank
from lanternflow.schema import EVENT_COLUMNS

# Columns of the UNSW full release, and a UTF-8 byte order mark read as Latin-1.
UNSW_COLUMN_COUNT = 49
LATIN1_BOM = "^ï»¿"
# A quote inside quoted text is doubled (RFC 4180).
CSV = {"quote": '"', "escape": '"'}


def read_table(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Parquet by extension, anything else as CSV text with a header; casts come later.

    ``multi_line`` allows line breaks inside quotes; such files are read whole by one task each.
    """
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.options(**CSV).option("header", True).option("multiLine", multi_line).csv(path)


def number_rows(events: DataFrame, name: str = "event_row_id") -> DataFrame:
    """Dense ids in (entity, time) order; the other columns settle ties."""
    rest = [c for c in events.columns if c not in ("entity_id", "timestamp", name)]
    return global_rank(events, ["entity_id", "timestamp", *rest], name)


def load_events(spark: SparkSession, path: str, fmt: str = "auto", **options) -> DataFrame:
    """Read, adapt to the event schema and number the rows."""
    return number_rows(adapt(read_table(spark, path), fmt, **options).select(*EVENT_COLUMNS))


def feature_names(spark: SparkSession, path: str, expected: int = UNSW_COLUMN_COUNT) -> list[str]:
    """Column names from the feature description file, in file order of its number column."""
    rows = spark.read.options(**CSV).option("header", True).option("encoding", "ISO-8859-1").csv(path)
    rows = rows.toDF(*[_clean_name(c) for c in rows.columns])
    # One row per column of the data files.
    found = [r["Name"].strip() for r in rows.orderBy(F.col(f"`{rows.columns[0]}`").cast("int")).select("Name").collect()]
    if len(found) != expected:
        raise ValueError(f"expected {expected} feature names, got {len(found)}")
    return found


def _clean_name(name: str) -> str:
    return name.replace("ï»¿", "").strip()


def assemble_parts(spark: SparkSession, paths: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Union of headerless CSV parts under the given names, without byte order marks."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.schema(schema).options(**CSV).option("encoding", "ISO-8859-1").csv(list(paths))
    first = names[0]
    return rows.withColumn(first, F.regexp_replace(F.col(f"`{first}`"), LATIN1_BOM, ""))


_POINT = "recall double, precision double, f1 double, observed_test_fpr double, benign_alerts_per_10000_events double"
_FAMILY = "map<string, struct<sample_count: bigint, recall: double>>"
_RUN = (f"run_manifest struct<seed: bigint>, seed bigint, detection struct<frozen_operating_point: "
        f"struct<{_POINT.replace(' double', ': double')}>>, frozen_operating_point struct<{_POINT.replace(' double', ': double')}>, "
        f"detection_by_label {_FAMILY}, per_attack {_FAMILY}, "
        f"inference_benchmark struct<batch_one_ms: struct<p95: double>>")


def read_runs(spark: SparkSession, paths: str | Sequence[str], dataset: str) -> DataFrame:
    """Run artifacts in either accepted shape, one row per file with a family map."""
    raw = spark.read.schema(_RUN).option("multiLine", True).json(paths)
    point = F.coalesce("frozen_operating_point", "detection.frozen_operating_point")
    families = F.coalesce("detection_by_label", "per_attack")
    recalls = F.transform(F.map_values(families), lambda v: v["recall"])
    macro = F.aggregate(recalls, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(recalls), F.lit(0))
    out = raw.select(
        F.lit(dataset).alias("dataset"), F.coalesce("run_manifest.seed", "seed").alias("seed"),
        point["recall"].alias("recall"), point["precision"].alias("precision"), point["f1"].alias("f1"),
        point["observed_test_fpr"].alias("fpr"),
        point["benign_alerts_per_10000_events"].alias("benign_alerts_per_10000"),
        F.when(F.size(recalls) > 0, macro).alias("macro_recall"),
        F.col("inference_benchmark.batch_one_ms.p95").alias("p95_latency_ms"), families.alias("families"))
    return out.withColumn("recall", F.when(F.col("recall").isNull(), F.raise_error(
        F.lit("run artifact has no frozen_operating_point"))).otherwise(F.col("recall")))


def run_families(runs: DataFrame) -> DataFrame:
    """One row per run and attack family."""
    return runs.select("dataset", "seed", F.explode("families").alias("family", "v")).select(
        "dataset", "seed", "family", "v.sample_count", "v.recall")


_STUDY = ("bundle_seed bigint, target_fpr double, test_days array<string>, "
          "scores map<string, map<string, struct<max_daily_fpr: double, days: map<string, struct<observed_test_fpr: double, "
          "recall: double, macro_attack_family_recall: double, calibration_population: struct<labels_used_for_threshold: boolean>>>>>>, "
          "winner struct<variant: string, threshold: double>, "
          "candidates array<struct<variant: string, macro_attack_family_recall: double, precision: double, fpr: double>>, "
          f"variants map<string, struct<frozen_operating_point: struct<{_POINT.replace(' double', ': double')}>, macro_attack_family_recall: double>>")


def read_studies(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Artifacts of drift, selection and ablation studies as one table, one row per file; what a kind lacks is null."""
    raw = spark.read.schema(_STUDY).option("multiLine", True).json(paths)
    return raw.select(F.col("_metadata.file_path").alias("artifact"), "*")


def read_binaries(spark: SparkSession, folders: dict[str, int]) -> DataFrame:
    """Files below labelled folders: ``path, length, content, label``."""
    out = None
    for folder, label in folders.items():
        part = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
                .select("path", "length", "content", F.lit(label).alias("label")))
        out = part if out is None else out.unionByName(part)
    return out
