"""SimHash document fingerprints and a Hamming search by permuted block tables.

A term is a run of three words (padded at both ends of the text). Its 128-bit hash votes on
each bit of the fingerprint with the weight of its number of occurrences; the signs of the
votes are the fingerprint. The likeness of two fingerprints is the share of equal bits.

The search cuts fingerprints into blocks. Two fingerprints within the radius agree on at least
``key_blocks`` of ``radius + key_blocks`` blocks, so there is one table for every choice of that
many blocks, with the chosen blocks moved to the front as its key. Equal keys are candidates, and
a pair counts in the first table that it shares. Fingerprints are folded before, so copies
cost one row.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.common import Memo, durable, range_bucket

BITS = 128
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_OFFSETS = (np.arange(BITS // 8) * 256)[None, :]


def _mix(x: np.ndarray, m: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(m)
    return x ^ (x >> np.uint64(29))


class Fingerprinter:
    """Fingerprints of texts; remembers the hashes of a bounded number of words."""

    def __init__(self):
        self.hashes = Memo(lambda w: xxhash.xxh3_64_intdigest(w))

    def __call__(self, text: str | None) -> bytes:
        words = text.lower().split() if text else []
        if not words:
            return bytes(BITS // 8)
        h = np.empty(len(words) + 4, np.uint64)
        h[:2], h[-2:] = 1, 2
        h[2:-2] = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        terms = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
        votes = np.zeros(BITS, np.int64)
        for i in range(0, len(terms), 65_536):  # bounded memory for long texts
            t = terms[i:i + 65_536]
            both = np.stack([_mix(t, 0xD6E8FEB86659FD93), _mix(t, 0xA0761D6478BD642F)], axis=1)
            # How often each byte value occurs at each place; every value knows its bits.
            counts = np.bincount((both.view(np.uint8).reshape(-1, BITS // 8) + _OFFSETS).ravel(), minlength=BITS // 8 * 256)
            votes += (counts.reshape(-1, 256) @ _BYTE_BITS).ravel()
        return np.packbits(2 * votes > len(terms)).tobytes()


def likeness(x: bytes, y: bytes) -> float:
    return 1 - (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (hex) of every row; null, empty and wordless texts have all bits zero."""
    def run(batches):
        make = Fingerprinter()
        for batch in batches:
            yield pa.record_batch([batch.column("doc_id"), pa.array([make(t.as_py()).hex() for t in batch.column("text")], pa.string())],
                                  ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third of the code points (rounded down) replaced by the first
    as many, or all, of the next document in descending doc_id; after the last comes the first.
    Result: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. A null text counts as empty; a null doc_id as the smallest. Rows that share a
    doc_id follow each other by text. A lone document is its own next.

    The table is dealt once, by ranges of doc_id. The largest document of a range also goes to
    the range above, so a task sees each neighbour while rows stream by in order.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = base.agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 20 * parts)).first()[0]
    bounds = sorted(set(cuts or []))
    bucket = range_bucket(F.col("doc_id"), bounds)
    tops = {r["b"]: r["top"] for r in base.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    # For each non-empty range: the range that needs its top document (the one above; the first needs the last).
    above = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    needs = durable(spark.createDataFrame([(b, tops[b], above[b]) for b in order], "b int, top long, above int").coalesce(1))
    placed = (base.withColumn("b", bucket).join(F.broadcast(needs), "b")
              .withColumn("to", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(
                  F.struct(F.col("b").alias("b"), F.lit(True).alias("own")), F.struct(F.col("above").alias("b"), F.lit(False).alias("own"))))
                  .otherwise(F.array(F.struct(F.col("b").alias("b"), F.lit(True).alias("own"))))))
              .select("to.b", "to.own", "doc_id", "text"))

    def run(batches):
        make = Fingerprinter()
        at, text, mark = None, "", b""
        for batch in batches:
            out = []
            for b, own, doc_id, t in zip(*[batch.column(c) for c in ("b", "own", "doc_id", "text")]):
                b, t = b.as_py(), t.as_py()
                if own.as_py() and at == b:
                    cut = len(t) // 3
                    edited = t[:len(t) - cut] + text[:cut]
                    mine, other = make(t), make(edited)
                    out.append((doc_id.as_py(), len(t), hashlib.sha256(edited.encode()).hexdigest(), mine.hex(), other.hex(),
                                likeness(mine, other), likeness(mine, mark)))
                else:
                    mine = make(t)
                at, text, mark = b, t, mine
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(),
                                                                        pa.float64(), pa.float64()))],
                                  ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return placed.repartition(parts, "b").sortWithinPartitions("b", "own", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _words64(c: str) -> list[Column]:
    """The fingerprint's 128 bits as four integers of 32."""
    return [F.conv(F.substring(c, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def block_tables(radius: int, key_blocks: int = 1) -> list[list[tuple[int, int]]]:
    """For each table the (start, length) of its key's blocks, in hex digits."""
    n = radius + key_blocks
    if n > BITS // 4:
        raise ValueError("at most 32 blocks")
    edges = [round(i * (BITS // 4) / n) for i in range(n + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in c] for c in combinations(range(n), key_blocks)]


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = 3, key_blocks: int = 1) -> DataFrame:
    """``query, near, distance``: fingerprints of ``index`` within ``radius`` bits of those of ``queries``.

    Both have a column ``fingerprint``; nulls are ignored and repeated values folded. All
    matches are found. The expected number of chance candidates of a query falls with longer
    keys: raise ``key_blocks`` with the table (more tables, each with a longer key).
    """
    tables = block_tables(radius, key_blocks)

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.concat(*[F.substring(name, s + 1, n) for s, n in t]) for t in tables])
        folded = df.filter("fingerprint IS NOT NULL").select(F.col("fingerprint").alias(name)).distinct()
        return folded.select(name, F.posexplode(keys).alias("_t", "_k"))

    pairs = keyed(queries, "query").join(keyed(index, "near"), ["_t", "_k"])
    same = [F.lit(True) if not t else None for t in tables]
    for i, t in enumerate(tables):
        for s, n in t:
            eq = F.substring("query", s + 1, n) == F.substring("near", s + 1, n)
            same[i] = eq if same[i] is None else same[i] & eq
    first = F.coalesce(*[F.when(e, F.lit(i)) for i, e in enumerate(same)])
    distance = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_words64("query"), _words64("near"))), F.lit(0))
    return (pairs.withColumn("distance", distance).filter(F.col("distance") <= radius)
            .filter(first == F.col("_t")).select("query", "near", "distance"))
