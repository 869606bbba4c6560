"""Digests and manifests of tables and files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = 8 << 20  # bytes of a file under one leaf of its hash tree
FAN = 1024       # children of a node
PIECE = 1 << 20  # bytes read at once


def _exact_text(x: Column) -> Column:
    """A double as ``<whole number>p<exponent>``: its 53-bit mantissa and the power of two of its leading bit.

    Scaling by powers of two is exact, so every engine gets the same text, whatever its logarithm rounds to. Both
    zeros are ``0``.
    """
    def scaled(e: Column) -> Column:  # in two steps, as 2**1074 is no double
        half = F.floor(-e / 2)
        return F.abs(x) * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -e - half)

    guess = F.floor(F.log2(F.abs(x))).cast("long")
    m = scaled(guess)
    e = guess + F.when(m >= 2, 1).when(m < 1, -1).otherwise(0)
    whole = (scaled(e) * F.lit(2.0 ** 52)).cast("long")
    return (F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, "0")
            .otherwise(F.concat(F.when(x < 0, "-").otherwise(""), whole.cast("string"), F.lit("p"), e.cast("string"))))


def _text(x: Column, kind: T.DataType) -> Column:
    """A value without a fraction as text that doesn't depend on the engine: times are microseconds since 1970 in
    UTC, nested values JSON. A null is null."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(x).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(x))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(x.alias("v")))
    return x.cast("string")


def row_texts(df: DataFrame) -> DataFrame:
    """Every row as one ``text``: each value, in the order of the column names, behind its number of bytes and a
    colon; ``-`` for a null. Numbers with a fraction are exact."""
    kinds = {name: df.schema[name].dataType for name in sorted(df.columns)}
    reals = [name for name, kind in kinds.items() if isinstance(kind, (T.FloatType, T.DoubleType))]
    # One expression for all of them, however many there are.
    exact = F.transform(F.array(*[F.col(f"`{name}`").cast("double") for name in reals]).cast("array<double>"), _exact_text)
    values = df.select(F.struct(*[F.col(f"`{name}`") for name in kinds]).alias("row"), exact.alias("exact"))
    cells = []
    for name, kind in kinds.items():
        text = F.get("exact", F.lit(reals.index(name))) if name in reals else _text(F.col("row").getField(name), kind)
        cells.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return values.select(F.concat(*cells).alias("text"))


def table_digest(df: DataFrame) -> str:
    """Digest that ignores row order: the sums of two halves of each row's sha-256, plus the count.

    Only three numbers leave the executors.
    """
    rows = row_texts(df).select(F.sha2("text", 256).alias("row"))

    def half(start: int):
        return F.coalesce(F.sum(F.conv(F.substring("row", start, 14), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")

    a, b, n = rows.agg(half(1), half(15), F.count(F.lit(1))).first()
    return hashlib.sha256(f"{','.join(sorted(df.columns))}|{a}|{b}|{n}".encode()).hexdigest()


def _leaf_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for path, start, size in zip(*[batch.column(c).to_pylist() for c in ("path", "start", "size")]):
            system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with system.open_input_file(name) as f:
                f.seek(start)
                while size > 0:
                    data = f.read(min(size, PIECE))
                    if not data:
                        raise OSError(f"{path} ended before its listed length")
                    digest.update(data)
                    size -= len(data)
            out.append(digest.hexdigest())
        yield pa.record_batch([batch.column("path"), batch.column("length"), batch.column("node"), pa.array(out, pa.string())],
                              ["path", "length", "node", "digest"])


def file_digests(spark: SparkSession, path: str, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """``path, sha256, length`` of each file below a path, by a hash tree.

    A leaf is the sha-256 of ``size`` bytes of the file; a node is that of the hex digests of up to ``fan`` children
    written one after another. Ranges are read in parallel, so a file of any length is never one row or one task. Empty
    files have no row, since Spark's file source doesn't list them. Executors read the ranges by the listed URI.
    """
    if size < 1 or fan < 2:
        raise ValueError("a range needs a byte and a node two children")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    longest = listed.agg(F.max("length")).first()[0] or 0
    last = F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0))
    ranges = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("node"))
    ranges = ranges.select("*", (F.col("node") * size).alias("start")).select(
        "*", F.least(F.lit(size).cast("long"), F.col("length") - F.col("start")).alias("size"))
    level = ranges.repartition("path", "node").mapInArrow(_leaf_digests, "path string, length long, node long, digest string")
    level = level.withColumn("nodes", last + 1)
    nodes = max(1, -(-longest // size))
    while nodes > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"])
        parents = level.groupBy("path", "length", "nodes", F.floor(F.col("node") / fan).alias("node")).agg(children.alias("c"))
        # A file that has come down to its root stays as it is.
        digest = F.when(F.col("nodes") > 1, F.sha2(F.array_join("c", ""), 256)).otherwise(F.get("c", F.lit(0)))
        level = parents.select("path", "length", F.ceil(F.col("nodes") / fan).alias("nodes"), "node", digest.alias("digest"))
        nodes = -(-nodes // fan)
    return level.select("path", F.col("digest").alias("sha256"), "length")


def split_manifest(events: DataFrame) -> DataFrame:
    """Rows, first and last timestamp and label counts of each split, in one shuffle."""
    cells = events.groupBy("split", F.coalesce("label", F.lit("")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return cells.groupBy("split").agg(
        F.sum("n").alias("rows"), F.min("a").alias("start"), F.max("b").alias("end"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))


def run_manifest(events: DataFrame, dataset: str, seed: int, config: dict[str, str]) -> DataFrame:
    """Split manifest with the run's settings and the digest of its source rows."""
    digest = table_digest(events)
    settings = F.create_map(*[F.lit(str(x)) for kv in sorted(config.items()) for x in kv])
    return split_manifest(events).select(
        F.lit(dataset).alias("dataset"), F.lit(seed).alias("seed"), F.lit(digest).alias("source_digest"),
        settings.alias("config"), "*")
