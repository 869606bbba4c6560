"""Sources, adapters, scalar cleaning, splits and tokens."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.catalog import shared
from lanternflow.catalog.chain import CHAIN, TOKENS
from lanternflow.catalog.registry import micros, query, r6
from lanternflow.catalog.views import DOCS, FLOWS, flows, table
from lanternflow.functions import content, values as V
from lanternflow.operators import adapters, splits, tokens
from lanternflow.plans import studies
from lanternflow.session import shared_folder
from lanternflow.sources import bundle, digests, files, sinks


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/catalog/{uuid.uuid4().hex}"


WITH = f"WITH {FLOWS}"
EPOCH = "epoch_us(\"timestamp\")"


@query("A1_read_table", "SELECT event_id, user_id, event_type, round(value, 6) AS value, props FROM events")
def read_table(spark, sf):
    return files.read_table(spark, f"{sf}/events.parquet").select(
        "event_id", "user_id", "event_type", r6("value").alias("value"), "props")


def raw_clean(spark, sf) -> DataFrame:
    """Flows as a clean-format text table with padded names and text values."""
    return flows(spark, sf).select(
        F.col("timestamp").cast("string").alias(" timestamp"), F.col("entity_id"), F.col("event_type").alias("event_type "),
        F.col("dst_id"), F.col("bytes").cast("string").alias(" bytes"), F.col("label").alias("Label"))


@query("A2_load_events", f"""{WITH} SELECT row_number() OVER (ORDER BY entity_id, "timestamp") - 1 AS event_row_id,
 entity_id, {EPOCH} AS at, event_type, dst_id, round(bytes, 6) AS bytes, label FROM flows""")
def load_events(spark, sf):
    path = scratch(spark)
    sinks.write_table(raw_clean(spark, sf), path, "csv")
    return files.load_events(spark, path).select(
        "event_row_id", "entity_id", micros().alias("at"), "event_type", "dst_id", r6("bytes").alias("bytes"), "label")


@query("A3_assemble_parts", """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
 event_type, props FROM events""")
def assemble_parts(spark, sf):
    names = ["event_id", "user_id", "event_type", "props"]
    path = scratch(spark)
    events = table(spark, sf, "events").select(*names)
    quarter = F.pmod(F.col("user_id"), F.lit(4))
    # Four headerless parts; the first lines carry a byte order mark.
    marked = events.withColumn("event_id", F.concat(
        F.when(F.col("event_id") % 1000 == 0, "﻿").otherwise(""), F.col("event_id").cast("string")))
    marked.withColumn("part", quarter).write.partitionBy("part").option("escape", '"').csv(f"{path}/parts")
    listing = spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "`No.` int, ` Name` string")
    sinks.write_table(listing.coalesce(1), f"{path}/names", "csv")
    found = files.feature_names(spark, f"{path}/names", len(names))
    return files.assemble_parts(spark, [f"{path}/parts/part={i}" for i in range(4)], found)


@query("A1_read_csv", """SELECT CAST(doc_id AS VARCHAR) AS doc_id, replace(text, chr(10), ' "q", ') AS text, source FROM documents""")
def read_csv(spark, sf):
    """Texts with quotes and commas, written as CSV and read back."""
    path = scratch(spark)
    docs = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(' "q", ')).alias("text"), "source")
    sinks.write_table(docs, path, "csv")
    return files.read_table(spark, path)


@query("A4_write_clean_events", f"""{WITH} SELECT event_row_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ') AS "timestamp",
 entity_id, event_type, dst_id, round(bytes, 6) AS bytes, label FROM flows""")
def write_clean_events(spark, sf):
    path = scratch(spark)
    sinks.write_clean_events(flows(spark, sf), path)
    return files.read_table(spark, path).select(F.col("event_row_id").cast("bigint").alias("event_row_id"), "timestamp",
                                                "entity_id", "event_type", "dst_id", r6(F.col("bytes").cast("double")).alias("bytes"), "label")


@query("A5_write_scores", f"""WITH {CHAIN} SELECT event_row_id, round(score, 6) AS score, label, split FROM sst""")
def write_scores(spark, sf):
    path = scratch(spark)
    sinks.write_table(shared.stream(spark, sf), path, partition_by=["split"])
    return spark.read.parquet(path).select("event_row_id", r6("score").alias("score"), "label", "split")


@query("A7_bundle_round_trip", f"""WITH {CHAIN} SELECT en.entity_id, round(mean_nll, 6) AS mean_nll, round(std_nll, 6) AS std_nll,
 round(med_nll, 6) AS med_nll, round(scale_bytes_mean, 6) AS scale_bytes_mean FROM en LEFT JOIN ebase USING (entity_id)""")
def bundle_round_trip(spark, sf):
    path = bundle.save_detector(shared.calibrated(spark, sf), scratch(spark), {"seed": "42"})
    d = bundle.load_detector(spark, path)
    return d.profiles.select("entity_id", *[r6(c).alias(c) for c in ("mean_nll", "std_nll", "med_nll", "scale_bytes_mean")])


@query("A9_split_manifest", f"""{WITH} SELECT split, sum(n) AS "rows", min(a) AS first_at, max(b) AS last_at,
 string_agg(label || '=' || n, ',' ORDER BY label) AS label_counts FROM (SELECT split, label, count(*) AS n,
 min({EPOCH}) AS a, max({EPOCH}) AS b FROM flows GROUP BY ALL) GROUP BY split""")
def split_manifest(spark, sf):
    m = digests.split_manifest(flows(spark, sf))
    counts = F.concat_ws(",", F.transform(F.array_sort(F.map_entries("label_counts")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))))
    return m.select("split", "rows", F.unix_micros("start").alias("first_at"), F.unix_micros("end").alias("last_at"),
                    counts.alias("label_counts"))


def _exact_sql(x: str) -> str:
    """A finite double as its whole mantissa, ``p`` and its exponent."""
    scaled = lambda e: f"(abs({x}) * pow(2.0::DOUBLE, -({e})))"
    guess = f"CAST(floor(log2(abs({x}))) AS BIGINT)"
    e = f"({guess} + CASE WHEN {scaled(guess)} >= 2 THEN 1 WHEN {scaled(guess)} < 1 THEN -1 ELSE 0 END)"
    return (f"CASE WHEN {x} = 0 THEN '0' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(CAST({scaled(e)} * 4503599627370496::DOUBLE "
            f"AS BIGINT) AS VARCHAR) || 'p' || CAST({e} AS VARCHAR) END")


FLOW_TEXTS = {"bytes": _exact_sql("bytes"), "timestamp": f"CAST({EPOCH} AS VARCHAR)"}
FLOW_NAMES = sorted(["event_row_id", "timestamp", "entity_id", "event_type", "dst_id", "bytes", "label", "split"])
_CELLS = " || ".join(f"coalesce(strlen({t}) || ':' || {t}, '-')" for t in (
    FLOW_TEXTS.get(c, f'CAST("{c}" AS VARCHAR)') for c in FLOW_NAMES))


@query("A9_run_manifest", f"""{WITH}, h AS (SELECT sha256({_CELLS}) AS h FROM flows),
 s AS (SELECT sha256('{",".join(FLOW_NAMES)}|' || sum(CAST('0x' || substr(h, 1, 14) AS BIGINT)) || '|' || sum(CAST('0x' || substr(h, 15, 14) AS BIGINT))
  || '|' || count(*)) AS source_digest FROM h)
SELECT 'flows' AS dataset, 42 AS seed, source_digest, 'seq_len={shared.SEQ_LEN}' AS config, split, count(*) AS "rows", min({EPOCH}) AS first_at,
 max({EPOCH}) AS last_at FROM flows CROSS JOIN s GROUP BY ALL""")
def run_manifest(spark, sf):
    m = digests.run_manifest(flows(spark, sf), "flows", 42, {"seq_len": shared.SEQ_LEN})
    config = F.concat_ws(",", F.transform(F.map_entries("config"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return m.select("dataset", "seed", "source_digest", config.alias("config"), "split", "rows",
                    F.unix_micros("start").alias("first_at"), F.unix_micros("end").alias("last_at"))


LEAF, CHILDREN = 1000, 5  # small, so that the trees of these files have several levels


def _tree_sql() -> str:
    """Levels of the hash trees; a level with one node for every file repeats it."""
    levels = []
    for k in range(12):
        before, name = f"l{k}", f"l{k + 1}"
        levels.append(f"{name} AS (SELECT day, length, CAST(ceil(nodes / {CHILDREN}) AS BIGINT) AS nodes, node // {CHILDREN} AS node, CASE WHEN nodes > 1 "
                      f"THEN sha256(string_agg(digest, '' ORDER BY node)) ELSE min(digest) END AS digest FROM {before} GROUP BY day, length, nodes, node // {CHILDREN})")
    return ", ".join(levels)


@query("A9_file_digests", f"""WITH f AS (SELECT strftime(ts, '%Y-%m-%d') AS day, string_agg(event_id || ' ' || user_id || ' ' || event_type || chr(10), ''
  ORDER BY event_id) AS t FROM events GROUP BY 1),
 l0 AS (SELECT day, strlen(t) AS length, CAST(ceil(strlen(t) / {LEAF}) AS BIGINT) AS nodes, i AS node, sha256(substr(t, i * {LEAF} + 1, {LEAF})) AS digest
  FROM f, LATERAL (SELECT unnest(range(0, CAST(ceil(strlen(t) / {LEAF}) AS BIGINT))) AS i)), {_tree_sql()}
SELECT day, length, digest AS sha256 FROM l12""")
def file_digests(spark, sf):
    """The events of each day as a text file, hashed by ranges and levels."""
    path = scratch(spark)
    line = F.concat_ws(" ", "event_id", "user_id", "event_type")
    events = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", line.alias("value"))
    (events.repartition("day").sortWithinPartitions("day", "event_id").select("day", "value")
     .write.partitionBy("day").text(path))
    found = digests.file_digests(spark, path, LEAF, CHILDREN)
    return found.select(F.regexp_extract("path", "day=([^/]+)/", 1).alias("day"), "length", "sha256")


@query("A11_read_binaries", """SELECT source, CAST(source = (SELECT min(source) FROM documents) AS INT) AS label, count(DISTINCT doc_id % 4) AS files,
 sum(strlen(text)) AS total_bytes FROM documents GROUP BY source""")
def read_binaries(spark, sf):
    """Several text files per document source, below a folder for each label, read back as binaries."""
    path = scratch(spark)
    docs = table(spark, sf, "documents")
    first = docs.agg(F.min("source")).first()[0]
    placed = docs.select((F.col("source") == first).cast("int").alias("label"), "source", F.pmod("doc_id", F.lit(4)).alias("part"), "text")
    (placed.repartition("label", "source", "part").sortWithinPartitions("label", "source", "part")
     .write.partitionBy("label", "source", "part").option("lineSep", "\u0001").text(path))
    rows = files.read_binaries(spark, {f"{path}/label={n}": n for n in (0, 1)})
    size = F.octet_length(F.regexp_replace(F.col("content").cast("string"), "\u0001", ""))
    return rows.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "label").agg(
        F.count_distinct("path").alias("files"), F.sum(size.cast("bigint")).alias("total_bytes"))


@query("B1_adapt_clean", f"""{WITH} SELECT entity_id, {EPOCH} AS at, event_type, dst_id, round(bytes, 6) AS bytes, label FROM flows""")
def adapt_clean(spark, sf):
    return adapters.adapt(raw_clean(spark, sf)).select(
        "entity_id", micros().alias("at"), "event_type", "dst_id", r6("bytes").alias("bytes"), "label")


PORT = "(event_row_id * 37 % 66000 - 100)"


def raw_flows(spark, sf) -> DataFrame:
    """Flows in the CICIDS layout: padded names and day-first text times."""
    f = flows(spark, sf)
    proto = F.when(F.col("event_type") == "view", "6").when(F.col("event_type") == "click", " tcp ").when(
        F.col("event_type") == "error", "17").otherwise("1")
    text = F.when(F.col("event_row_id") % 2 == 0, F.date_format("timestamp", "dd/MM/yyyy HH:mm:ss")).otherwise(
        F.date_format("timestamp", "d/M/yyyy H:mm"))
    port = F.when(F.col("event_row_id") % 11 == 0, "-").otherwise(
        (F.col("event_row_id") * 37 % 66000 - 100).cast("string"))
    clock = F.col("event_row_id") % 3 == 0
    return f.select(
        "event_row_id",
        text.alias(" Timestamp"), F.concat(F.lit("10.0.0."), "dst_id").alias(" Source IP"),
        F.concat(F.lit("192.168."), "entity_id").alias(" Destination IP"), port.alias(" Destination Port"),
        proto.alias(" Protocol"), F.concat(F.lit(" "), "label").alias(" Label"),
        F.when(clock, "oops").otherwise(F.col("bytes").cast("string")).alias("Total Length of Fwd Packets"),
        F.lit("2").alias(" Total Length of Bwd Packets"))


def _raw_sql(entity: str, peer: str) -> str:
    return f"""{WITH}, f AS (SELECT *, {PORT} AS port FROM flows)
SELECT event_row_id, {entity} AS entity_id, {peer} AS dst_id,
 epoch_us(date_trunc(CASE WHEN event_row_id % 2 = 0 THEN 'second' ELSE 'minute' END, "timestamp")
  + CASE WHEN hour("timestamp") BETWEEN 1 AND 7 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END) AS at,
 CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN 'P0_WELL_KNOWN' ELSE
   CASE WHEN event_type = 'error' THEN 'UDP' ELSE 'TCP' END || CASE WHEN event_row_id % 11 = 0 THEN '_REGISTERED'
   WHEN port BETWEEN 0 AND 1023 THEN '_WELL_KNOWN' WHEN port <= 49151 THEN '_REGISTERED' ELSE '_EPHEMERAL' END END AS event_type,
 CASE WHEN event_row_id % 3 = 0 THEN 0.0 ELSE round(bytes + 2, 6) END AS bytes, label FROM f"""


@query("B2_adapt_cicids", _raw_sql("'192.168.' || entity_id", "'10.0.0.' || dst_id"))
def adapt_cicids(spark, sf):
    return adapters.adapt(raw_flows(spark, sf), "cicids").select(
        "event_row_id", "entity_id", "dst_id", micros().alias("at"), "event_type", r6("bytes").alias("bytes"), "label")


@query("B2_adapt_cicids_source_side", _raw_sql("'10.0.0.' || dst_id", "'192.168.' || entity_id"))
def adapt_cicids_source(spark, sf):
    return adapters.adapt(raw_flows(spark, sf), "cicids", entity_side="src").select(
        "event_row_id", "entity_id", "dst_id", micros().alias("at"), "event_type", r6("bytes").alias("bytes"), "label")


def raw_unsw(spark, sf) -> DataFrame:
    f = flows(spark, sf)
    family = F.when(F.col("label") == "BENIGN", "Normal").when(F.col("label") == "Bot", " Backdoors ").otherwise(F.col("label"))
    return f.select(
        "event_row_id", F.unix_seconds("timestamp").cast("string").alias("Stime"), F.col("entity_id").alias("dstip"),
        F.col("dst_id").alias("srcip"), F.when(F.col("event_type") == "view", " TCP").otherwise("udp").alias("proto"),
        F.when(F.col("event_row_id") % 13 == 0, "0x000b").otherwise((F.col("event_row_id") * 37 % 66000).cast("string"))
        .alias("dsport"),
        F.when(F.col("event_row_id") % 17 == 0, "bad").otherwise((F.col("bytes") - 500).cast("string")).alias("sbytes"),
        F.lit("1").alias("dbytes"), family.alias("attack_cat"),
        F.when(F.col("label") == "BENIGN", "0").otherwise("1").alias("label"))


def _unsw_sql(kind: str) -> str:
    return f"""{WITH}, f AS (SELECT *, CASE WHEN event_row_id % 13 = 0 THEN NULL ELSE event_row_id * 37 % 66000 END AS port,
 CASE WHEN event_type = 'view' THEN 'tcp' ELSE 'udp' END AS proto FROM flows WHERE event_row_id % 17 <> 0)
SELECT event_row_id, entity_id, dst_id, epoch_us(date_trunc('second', "timestamp")) AS at, {kind} AS event_type,
 round(greatest(bytes - 500 + 1, 0), 6) AS bytes, CASE WHEN label = 'Bot' THEN 'Backdoor' ELSE label END AS label FROM f"""


@query("B3_adapt_unsw", _unsw_sql("proto || ':' || coalesce(CAST(port AS VARCHAR), '0x000b')"))
def adapt_unsw(spark, sf):
    return adapters.adapt(raw_unsw(spark, sf)).select(
        "event_row_id", "entity_id", "dst_id", micros().alias("at"), "event_type", r6("bytes").alias("bytes"), "label")


@query("B3_adapt_unsw_port_class", _unsw_sql("""upper(proto) || CASE WHEN port IS NULL THEN '_REGISTERED'
 WHEN port BETWEEN 0 AND 1023 THEN '_WELL_KNOWN' WHEN port <= 49151 THEN '_REGISTERED' ELSE '_EPHEMERAL' END"""))
def adapt_unsw_port_class(spark, sf):
    return adapters.adapt(raw_unsw(spark, sf), event_types="cicids").select(
        "event_row_id", "entity_id", "dst_id", micros().alias("at"), "event_type", r6("bytes").alias("bytes"), "label")


@query("B4_column_aliases", "SELECT event_id AS \"Timestamp\", user_id AS \"Source IP\", event_type AS \"Protocol\" FROM events")
def column_aliases(spark, sf):
    raw = table(spark, sf, "events").select(F.col("event_id").alias("timestamp"), F.col("user_id").alias("source_ip"),
                                            F.col("event_type").alias("protocol"))
    return raw.select(*[F.col(adapters.resolve_column(raw.columns, c)).alias(c)
                        for c in ("Timestamp", "Source IP", "Protocol")])


@query("B5_port_class", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 CASE WHEN l_linenumber IN (6, 17) THEN 'TCP' WHEN l_linenumber = 5 THEN 'UDP' END AS base,
 CASE WHEN l_linenumber NOT IN (5, 6) THEN 'P0_WELL_KNOWN' ELSE CASE WHEN l_linenumber = 6 THEN 'TCP' ELSE 'UDP' END ||
  CASE WHEN l_orderkey * 3 - 50 BETWEEN 0 AND 1023 THEN '_WELL_KNOWN' WHEN l_orderkey * 3 - 50 <= 49151 THEN '_REGISTERED'
  ELSE '_EPHEMERAL' END END AS event_type FROM lineitem""")
def port_class(spark, sf):
    li = table(spark, sf, "lineitem")
    proto = F.when(F.col("l_linenumber") == 5, " udp ").otherwise(F.col("l_linenumber").cast("string"))
    base = F.when(F.col("l_linenumber").isin(6, 17), "TCP").when(F.col("l_linenumber") == 5, "UDP")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", base.alias("base"),
                     V.port_class(proto, F.col("l_orderkey") * 3 - 50).alias("event_type"))


@query("B6_day_first_time", f"""{WITH} SELECT event_row_id, epoch_us(date_trunc('second', "timestamp")
 + CASE WHEN hour("timestamp") BETWEEN 1 AND 7 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END) AS at FROM flows""")
def day_first_time(spark, sf):
    f = flows(spark, sf)
    text = F.when(F.col("event_row_id") % 2 == 0, F.date_format("timestamp", "d/M/yyyy H:mm:ss")).otherwise(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    return f.select("event_row_id", F.unix_micros(V.parse_day_first(text)).alias("at"))


@query("B7_flow_bytes", f"""{WITH} SELECT event_row_id, round(CASE WHEN event_row_id % 5 = 0 THEN 0 ELSE bytes + 3 END, 6) AS total,
 round(CASE WHEN event_row_id % 5 = 0 THEN 0 ELSE bytes + 3 END, 6) AS from_subflow, 0.0 AS without FROM flows""")
def flow_bytes(spark, sf):
    f = flows(spark, sf)
    text = F.when(F.col("event_row_id") % 5 == 0, "x").otherwise(F.col("bytes").cast("string"))
    full = f.select("event_row_id", text.alias("Total Length of Fwd Packets"), F.lit("3").alias("total_length_of_bwd_packets"),
                    text.alias("Subflow Fwd Bytes"), F.lit(3).alias("subflow_bwd_bytes"))
    sub = ["event_row_id", "Subflow Fwd Bytes", "subflow_bwd_bytes"]
    return full.select("event_row_id", r6(adapters.flow_bytes(full.columns)).alias("total"),
                       r6(adapters.flow_bytes(sub)).alias("from_subflow"), adapters.flow_bytes([]).alias("without"))


@query("B8_normalize_label", f"""{WITH} SELECT event_row_id, CASE WHEN event_row_id % 7 = 0 THEN 'BENIGN'
 WHEN label = 'Bot' THEN 'Backdoor' WHEN event_row_id % 4 = 0 THEN 'BENIGN' ELSE label END AS label FROM flows""")
def normalize_label(spark, sf):
    f = flows(spark, sf)
    text = F.when(F.col("label") == "Bot", " Backdoors").when(F.col("event_row_id") % 4 == 0, " NORMAL ").otherwise(F.col("label"))
    return f.select("event_row_id", V.normalize_label(
        text, F.when(F.col("event_row_id") % 7 == 0, "0").otherwise("1")).alias("label"))


@query("B9_is_benign", f"""{WITH} SELECT event_row_id, coalesce(lower(trim(CASE event_row_id % 6 WHEN 0 THEN NULL
 WHEN 1 THEN ' None ' WHEN 2 THEN 'nan' WHEN 3 THEN '0' ELSE label END)), '')
 IN ('', '0', 'benign', 'normal', 'none', 'nan') AS benign FROM flows""")
def is_benign(spark, sf):
    m = F.col("event_row_id") % 6
    text = F.when(m == 1, " None ").when(m == 2, "nan").when(m == 3, "0").when(m > 3, F.col("label"))
    return flows(spark, sf).select("event_row_id", V.is_benign(text).alias("benign"))


@query("B10_drop_malformed", f"{WITH} SELECT event_row_id FROM flows WHERE event_row_id % 9 <> 0")
def drop_malformed(spark, sf):
    f = flows(spark, sf).withColumn("timestamp", F.when(F.col("event_row_id") % 9 == 0, "soon").otherwise(
        F.col("timestamp").cast("string")))
    return adapters.adapt_clean(f).select("event_row_id")


@query("B11_keep_entities", f"""{WITH} SELECT event_row_id, entity_id FROM flows WHERE entity_id IN
 (SELECT entity_id FROM flows GROUP BY 1 HAVING count(*) >= 70)""")
def keep_entities(spark, sf):
    return adapters.keep_entities(flows(spark, sf), 70).select("event_row_id", "entity_id")


@query("B12_keep_label", f"{WITH} SELECT event_row_id FROM flows WHERE split = 'train' AND label = 'BENIGN'")
def keep_label(spark, sf):
    return adapters.keep_label(flows(spark, sf).filter(F.col("split") == "train"), "BENIGN").select("event_row_id")


@query("B13_day_split", f"""{WITH} SELECT event_row_id, CASE strftime("timestamp", '%Y-%m-%d') WHEN '2024-01-03' THEN 'train'
 WHEN '2024-01-04' THEN 'dev' ELSE 'test' END AS split FROM flows
 WHERE strftime("timestamp", '%Y-%m-%d') BETWEEN '2024-01-03' AND '2024-01-07'""")
def day_split(spark, sf):
    return splits.day_split(flows(spark, sf).drop("split"), "2024-01-03", "2024-01-04",
                            ["2024-01-05", "2024-01-06", "2024-01-07"]).select("event_row_id", "split")


def _rank_sql(source: str, order: str, cuts: str, key: str) -> str:
    return (f"SELECT {key}, CASE {cuts} END AS split FROM (SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS k, "
            f"count(*) OVER () AS n FROM {source})")


@query("B14_chronological_split", f"{WITH} " + _rank_sql(
    "flows", '"timestamp", event_row_id',
    "WHEN k < CAST(floor(n * 0.7::DOUBLE) AS INT) THEN 'train' WHEN k < CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS INT) THEN 'val' ELSE 'test'",
    "event_row_id"))
def chronological_split(spark, sf):
    return splits.chronological_split(flows(spark, sf).drop("split"), 0.7, 0.15).select("event_row_id", "split")


TIED = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("B14_chronological_split_ties", _rank_sql(
    "lineitem", f"l_shipdate, {', '.join(TIED)}",
    "WHEN k < CAST(floor(n * 0.6::DOUBLE) AS INT) THEN 'train' WHEN k < CAST(floor(n * (0.6::DOUBLE + 0.2::DOUBLE)) AS INT) THEN 'val' ELSE 'test'",
    ", ".join(TIED)))
def chronological_split_ties(spark, sf):
    """Many events share a day, so the cut falls inside a tie and the row key decides."""
    li = table(spark, sf, "lineitem").withColumn("timestamp", F.col("l_shipdate").cast("timestamp"))
    out = splits.chronological_split(li, 0.6, 0.2, TIED)
    return out.select(*TIED, "split")


# Entities in the order of 60 bits of the SHA-256 of "42:entity"; the first 70% and the next 15% of them.
HELD = """ents AS (SELECT entity_id, row_number() OVER (ORDER BY CAST('0x' || substr(sha256('42:' || entity_id), 1, 15) AS BIGINT), entity_id) - 1 AS k,
  count(*) OVER () AS n FROM (SELECT DISTINCT entity_id FROM flows)),
held AS (SELECT entity_id, CASE WHEN k < greatest(1, floor(n * 0.7::DOUBLE)) THEN 'train'
  WHEN k < greatest(1, floor(n * 0.7::DOUBLE)) + greatest(1, floor(n * 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS part FROM ents)"""


@query("B15_entity_holdout", f"{WITH}, {HELD} SELECT event_row_id, entity_id, part AS split FROM flows JOIN held USING (entity_id)")
def entity_holdout(spark, sf):
    return splits.entity_holdout(flows(spark, sf).drop("split"), 0.7, 0.15, 42).select("event_row_id", "entity_id", "split")


@query("B16_entity_then_time", f"""{WITH}, {HELD}, placed AS (SELECT event_row_id, part, count(*) OVER (PARTITION BY part) AS m,
  row_number() OVER (PARTITION BY part ORDER BY "timestamp", event_row_id) - 1 AS i FROM flows JOIN held USING (entity_id))
SELECT event_row_id, part AS split FROM placed WHERE i < floor(m * CASE part WHEN 'train' THEN 0.85::DOUBLE ELSE 0.5::DOUBLE END)""")
def entity_then_time(spark, sf):
    return splits.entity_then_time(flows(spark, sf).drop("split"), 0.7, 0.15, 42).select("event_row_id", "split")


@query("B17_early_stop_cut", f"{WITH} " + _rank_sql(
    "(SELECT * FROM flows WHERE split = 'train')", '"timestamp", event_row_id',
    "WHEN k < CAST(floor(n * 0.9::DOUBLE) AS INT) THEN 'train' ELSE 'early'", "event_row_id"))
def early_stop_cut(spark, sf):
    return splits.early_stop_cut(flows(spark, sf).filter(F.col("split") == "train")).select("event_row_id", "split")


@query("B18_content_hash_split", """SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) % 1000 < 800
 THEN 'train' ELSE 'val' END AS split FROM documents""")
def content_hash_split(spark, sf):
    return splits.content_hash_split(table(spark, sf, "documents"), F.sha2("text", 256), 0.2).select("doc_id", "split")


@query("B20_seeded_random_split", """SELECT doc_id, CASE WHEN k < floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM (
 SELECT doc_id, count(*) OVER () AS n, row_number() OVER (ORDER BY CAST('0x' || substr(sha256('42:' || doc_id), 1, 15) AS BIGINT), doc_id) - 1 AS k
 FROM documents)""")
def seeded_random_split(spark, sf):
    return splits.seeded_random_split(table(spark, sf, "documents"), "doc_id", 0.2, 42).select("doc_id", "split")


TOK = f"WITH {TOKENS}"


@query("C1_top_destinations", f"{TOK} SELECT dst_id, count(*) AS n FROM tr GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_destinations(spark, sf):
    return tokens.top_destinations(shared.benign_train(spark, sf), shared.TOP_N).select("dst_id", "n")


@query("C2_destination_bucket", f"{TOK} SELECT event_row_id, dst_bucket FROM tok")
def destination_bucket(spark, sf):
    return tokens.tokenize(flows(spark, sf), shared.tokenizer(spark, sf)).select("event_row_id", "dst_bucket")


@query("C3_byte_edges", f"{TOK} SELECT CAST(unnest(range(len(e))) AS INT) AS i, round(unnest(e), 6) AS edge FROM edges")
def byte_edges(spark, sf):
    edges = tokens.byte_edges(shared.benign_train(spark, sf), shared.BINS)
    return spark.createDataFrame(list(enumerate(edges)), "i int, edge double").select("i", r6("edge").alias("edge"))


@query("C4_byte_bin", f"{TOK} SELECT event_row_id, CAST(byte_bin AS INT) AS byte_bin FROM tok")
def byte_bin(spark, sf):
    return tokens.tokenize(flows(spark, sf), shared.tokenizer(spark, sf)).select("event_row_id", "byte_bin")


@query("C5_token_string", f"{TOK} SELECT event_row_id, token_str FROM tok")
def token_string(spark, sf):
    return tokens.tokenize(flows(spark, sf), shared.tokenizer(spark, sf)).select("event_row_id", "token_str")


VOCAB = """vocabulary AS (SELECT CAST(2 + (ei * 6 + d.di) * nb + b.bi AS INT) AS token_id,
 event_type || '|DST=' || d.dst || '|BYTES_Q' || b.bi AS token_str FROM kinds
 CROSS JOIN (SELECT dst_id AS dst, di FROM tops UNION ALL SELECT 'OTHER', 5) d
 CROSS JOIN (SELECT len(e) - 1 AS nb, unnest(range(len(e) - 1)) AS bi FROM edges) b)"""


@query("C6_vocabulary", f"{TOK}, {VOCAB} SELECT token_id, token_str FROM vocabulary")
def vocabulary(spark, sf):
    return tokens.vocabulary(shared.tokenizer(spark, sf))


@query("C7_token_ids", f"""{TOK}, {VOCAB} SELECT event_row_id, CAST(token_id AS INT) AS token_id,
 coalesce(v.token_str, 'UNK') AS name FROM tok LEFT JOIN vocabulary v USING (token_id)""")
def token_ids(spark, sf):
    tok = shared.tokenizer(spark, sf)
    names = tokens.vocabulary(tok).withColumnRenamed("token_str", "_name")
    t = tokens.tokenize(flows(spark, sf), tok).join(names, "token_id", "left")
    return t.select("event_row_id", "token_id", tokens.token_name(F.col("token_id"), F.col("_name")).alias("name"))


@query("C8_destination_of_token", f"""{TOK} SELECT event_row_id, CASE WHEN di IS NULL THEN 'OTHER' ELSE dst_id END AS dst_parsed FROM tok""")
def destination_of_token(spark, sf):
    t = tokens.tokenize(flows(spark, sf), shared.tokenizer(spark, sf))
    return t.select("event_row_id", tokens.destination_of(F.col("token_str")).alias("dst_parsed"))


@query("C9_allowlist", f"{TOK} SELECT dst_id FROM (SELECT dst_id FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)")
def allowlist(spark, sf):
    return tokens.top_destinations(shared.benign_train(spark, sf), 3).select("dst_id")


@query("C10_unknown_rate", f"{TOK} SELECT round(avg(CASE WHEN token_id = 1 THEN 1.0 ELSE 0.0 END), 6) AS unk_rate FROM tok")
def unknown_rate(spark, sf):
    return tokens.unknown_token_rate(tokens.tokenize(flows(spark, sf), shared.tokenizer(spark, sf))).select(
        r6("unk_rate").alias("unk_rate"))


@query("G18_dataset_profile", f"""{WITH} SELECT count(*) AS rows_in, count(*) FILTER (event_row_id % 9 <> 0) AS rows_out,
 count(*) FILTER (event_row_id % 9 = 0) AS dropped, count(DISTINCT entity_id) FILTER (event_row_id % 9 <> 0) AS entities,
 count(DISTINCT event_type) FILTER (event_row_id % 9 <> 0) AS event_types FROM flows""")
def dataset_profile(spark, sf):
    raw = flows(spark, sf).withColumn("timestamp", F.when(F.col("event_row_id") % 9 == 0, "soon").otherwise(
        F.col("timestamp").cast("string")))
    return studies.dataset_profile(raw, adapters.adapt_clean(raw))


@query("G18_top_labels", f"{WITH} SELECT label, count(*) AS n FROM flows GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def top_labels(spark, sf):
    return studies.top_labels(flows(spark, sf))
