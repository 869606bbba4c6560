"""Writers for clean events, scores, alerts and alert packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.functions.values import iso_utc


def clean_rows(events: DataFrame) -> DataFrame:
    """Event columns with ISO-8601 UTC text timestamps."""
    return events.withColumn("timestamp", iso_utc(F.col("timestamp")))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def write_clean_events(events: DataFrame, path: str, fmt: str = "csv") -> None:
    write_table(clean_rows(events), path, fmt)


def packet_manifest(alerts: DataFrame, packets: DataFrame) -> DataFrame:
    """One row per exported alert."""
    targets = packets.filter("is_target").select("alert_index", F.lit(True).alias("_found"))
    return (alerts.join(targets, "alert_index")
            .withColumn("packet_path", F.concat(F.lit("alert_index="), F.col("alert_index").cast("string")))
            .drop("_found"))


def write_packets(alerts: DataFrame, packets: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Packets in one folder per alert plus the manifest."""
    write_table(packets, f"{path}/packets", fmt, ["alert_index"])
    write_table(packet_manifest(alerts, packets), f"{path}/manifest", fmt)


def write_studies(artifacts: DataFrame, path: str) -> None:
    """One JSON file per artifact row."""
    artifacts.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)
