"""Helpers that several training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternflow.session import durable

__all__ = ["Memo", "Recent", "arrow_groups", "bounded_batches", "boxed", "connected_components", "durable", "gathered", "give_back", "piece_groups", "range_bucket", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let batches for Python end at about ``most`` bytes as well as at a number of rows, unless the session has a limit
    of its own. Ten thousand rows of whole texts take tens of megabytes, once in the JVM and once more in its worker."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def boxed(df: DataFrame, *replaced: str) -> DataFrame:
    """All columns but the ``replaced`` ones inside one column ``_row``, so that no name inside an operator clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in replaced]).alias("_row"))


class Memo(dict):
    """``make(key)`` remembered, for at most ``limit`` keys; then it starts afresh."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Recent:
    """Results of costly look-ups for the lately used keys, bounded by bytes.

    ``size(key, value)`` estimates a result's bytes; at most about twice ``most`` bytes are held, and a result
    of more than a thousandth of ``most`` is not kept.
    """

    def __init__(self, make_many: Callable[[list], Iterable], size: Callable, most: int = 24 << 20):
        self.make_many, self.size, self.most = make_many, size, most
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def fetch(self, keys: list) -> list:
        """The results of ``keys`` in order; unknown ones are made together."""
        out, missing, young, old = [], [], self.young, self.old
        for i, k in enumerate(keys):
            if (v := young.get(k)) is None:
                if (v := old.get(k)) is None:
                    missing.append(i)
                else:
                    young[k] = v
                    self.held += 512  # about what a small result takes
            out.append(v)
        for i, v in zip(missing, self.make_many([keys[i] for i in missing])):
            out[i] = v
            self._keep(keys[i], v)
        if self.held > self.most:
            self.old, self.young, self.held = young, {}, 0
        return out

    def _keep(self, key, value) -> None:
        n = self.size(key, value)
        if n * 1000 <= self.most:
            self.young[key] = value
            self.held += n


def give_back() -> None:
    """Return freed memory to the system: a Python worker that goes on to other stages else keeps its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


# Latin letters without combining marks, and no controls: lower-cased alike by Arrow and by the library.
_PLAIN_TEXT = r"\A[\t\n\r\x20-;=-~\x{a1}-\x{12f}\x{131}-\x{17e}]*\z"
_STOP_AFTER_SIGN = r"[^0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17e}\s][.,]"
_SEPARATORS = r"[\x1c-\x1f]"


def piece_groups(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Texts (a null is empty) as pieces cut at white space, so that no word of a tokenizer reaches across.

    Groups of texts of about ``most`` bytes: the distinct pieces, the number of each piece in order, and
    where each text begins among them. In plain texts case is folded, and stops and commas before white space are
    cut off too, where they are signs by themselves: this leaves far fewer different pieces.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy())
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        group = texts.slice(start, stop - start)
        start = stop
        plain = pc.and_not(pc.match_substring_regex(group, _PLAIN_TEXT), pc.match_substring_regex(group, _STOP_AFTER_SIGN))
        folded = pc.utf8_lower(group)
        for sign in (". ", ", ", ".\n"):
            folded = pc.replace_substring(folded, sign, " " + sign)
        group = pc.if_else(plain, folded, group)
        if pc.any(pc.match_substring_regex(group, _SEPARATORS)).as_py():  # white space for Arrow, not for the tokenizer
            cut = pc.split_pattern_regex(group, "[\t\n\x0b\x0c\r ]+")
        else:
            cut = pc.utf8_split_whitespace(group)
        coded = cut.flatten().dictionary_encode()
        yield coded.dictionary.to_pylist(), coded.indices.to_numpy(), cut.offsets.to_numpy().astype(np.int64)


def gathered(entries: list[bytes], at: np.ndarray, offsets: np.ndarray) -> tuple[memoryview, list[int]]:
    """``entries`` in the order ``at`` as one buffer, and where each text (see ``piece_groups``) begins in it."""
    taken = pa.array(entries, pa.large_binary()).take(pa.array(at))
    _, places, data = taken.buffers()
    begin = np.frombuffer(places, np.int64)[taken.offset:taken.offset + len(taken) + 1]
    return memoryview(data) if data is not None else memoryview(b""), begin[offsets].tolist()


def arrow_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by ``keys``, one after another.

    Only the group at hand is held, across the borders of record batches.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        marks = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        if start < len(marks):
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def range_bucket(value: Column, bounds: list) -> Column:
    """Number of ``bounds`` (ascending) that are at most ``value``; a null is in bucket 0.

    A balanced tree of comparisons, so a row costs the logarithm of their number.
    """
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value >= F.lit(bounds[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(bounds))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest reachable node) for all nodes of ``edges(a, b)``.

    Alternates large-star and small-star steps: every round moves the neighbours of a node
    to the smallest node it sees, so paths shrink fast and hubs are only aggregated
    (map-side combined) and joined. Each round is written, which ends its lineage; nothing
    but one checksum per round comes to the driver. Raises if it doesn't settle.
    """
    now = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*").filter("a <> b").distinct())
        now = durable(small)
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
