"""Views over the given tables that play the role of event logs, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_END, DEV_END = "2024-01-21", "2024-01-26"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_flows(table(spark, sf_dir, "events"))


def as_flows(events: DataFrame) -> DataFrame:
    """Events seen as labelled flows; works on tables and on streams."""
    e = events.withColumn("k", F.get_json_object("props", "$.k"))
    k = F.col("k")
    kind, value = F.col("event_type"), F.col("value")
    label = (F.when((kind == "error") & (value > 60), "DoS")
             .when((kind == "signup") & (k.cast("int") < 3), "PortScan")
             .when((kind == "view") & (value < 0.5), "Bot").otherwise("BENIGN"))
    ts = F.col("ts").cast("timestamp")
    split = (F.when(ts < F.lit(TRAIN_END).cast("timestamp"), "train")
             .when(ts < F.lit(DEV_END).cast("timestamp"), "dev").otherwise("test"))
    return e.select(F.col("event_id").alias("event_row_id"), ts.alias("timestamp"),
                    F.col("user_id").cast("string").alias("entity_id"), kind.alias("event_type"),
                    k.alias("dst_id"), (value * 100).alias("bytes"), label.alias("label"), split.alias("split"))


FLOWS = f"""flows AS MATERIALIZED (
  SELECT event_id AS event_row_id, ts AS "timestamp", CAST(user_id AS VARCHAR) AS entity_id, event_type,
         json_extract_string(props, '$.k') AS dst_id, value * 100 AS bytes,
         CASE WHEN event_type = 'error' AND value > 60 THEN 'DoS'
              WHEN event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS INT) < 3 THEN 'PortScan'
              WHEN event_type = 'view' AND value < 0.5 THEN 'Bot' ELSE 'BENIGN' END AS label,
         CASE WHEN ts < TIMESTAMP '{TRAIN_END}' THEN 'train' WHEN ts < TIMESTAMP '{DEV_END}' THEN 'dev'
              ELSE 'test' END AS split
  FROM events)"""


def supplier_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long entities with many equal timestamps, from lineitem.

    The row id packs the remaining sort key, so it is unique inside an entity and day.
    """
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_row_id"),
        F.col("l_shipdate").cast("timestamp").alias("timestamp"), F.col("l_suppkey").cast("string").alias("entity_id"),
        F.concat(F.col("l_returnflag"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("event_type"),
        F.col("l_partkey").cast("string").alias("dst_id"), F.col("l_extendedprice").alias("bytes"))


def attack_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as score rows: the text length is the score."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return l.join(d, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality")
        .otherwise("BENIGN").alias("label"), F.col("n_chars").cast("double").alias("score"))


DOCS = """docs AS MATERIALIZED (
  SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' ELSE 'BENIGN' END AS label,
         CAST(n_chars AS DOUBLE) AS score
  FROM labels JOIN documents USING (doc_id))"""
