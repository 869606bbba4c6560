"""Event ingest from line-oriented JSON streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.functions import values as V
from lanternflow.schema import EVENT_COLUMNS

_RAW = ("event_row_id bigint, timestamp string, entity_id string, event_type string, dst_id string, "
        "bytes string, label string, _corrupt_record string")


def read_lines(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Stream of text lines from a folder; a Kafka value column works the same way."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Parse one JSON event per line and name the reason for rejected ones.

    Rejected: not JSON, no entity, or no usable timestamp. The line itself is kept.
    """
    parsed = lines.withColumn("e", F.from_json(F.col(value).cast("string"), _RAW))
    ts = V.parse_utc(F.col("e.timestamp"))
    reason = (F.when(F.col("e").isNull() | F.col("e._corrupt_record").isNotNull(), "not a JSON event")
              .when(F.trim(F.coalesce("e.entity_id", F.lit(""))) == "", "entity_id is required")
              .when(ts.isNull(), "timestamp is not readable"))
    return parsed.select(
        F.col("e.event_row_id").alias("event_row_id"), ts.alias("timestamp"), F.col("e.entity_id").alias("entity_id"),
        F.coalesce("e.event_type", F.lit("UNK")).alias("event_type"), F.coalesce("e.dst_id", F.lit("")).alias("dst_id"),
        F.coalesce(V.to_number(F.col("e.bytes")), F.lit(0.0)).alias("bytes"),
        F.coalesce("e.label", F.lit("")).alias("label"), reason.alias("reject_reason"),
        F.col(value).cast("string").alias("line"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).select("event_row_id", *EVENT_COLUMNS)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull()).select("line", "reject_reason")


def read_event_files(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Stream over Parquet event files that match a name pattern."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", pattern).parquet(folder))
