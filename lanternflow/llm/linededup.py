"""Removal of passages that repeat across documents, by content-defined chunks of lines.

Lines are hashed; a chunk ends where the rolling hash over the last two line hashes is smaller
than at the lines before and after, so the same run of lines is cut the same way wherever it
stands, and two ends are never neighbours: chunks hold three lines on average. A line of ``long_line`` words or more is a
passage by itself and always a chunk of its own.

A run that is shared by two documents need not hold a whole chunk. So from every line the
shortest run of lines that reaches ``long_line`` words is taken too, once down and once up. Any
shared run of that many words is covered by such runs inside it: of a line in it, either the
rest down to its end or up to its start is long enough, or the run that begins at its start
reaches over the line.

Chunks of several lines, long lines and these runs are compared over all documents; the first
occurrence (by doc_id, then place) stays and later ones are removed.

A chunk hash is 128 bits wide. Before anything is removed, the bytes of all chunks with one
hash are compared: their smallest and largest text, combined map-side, must be the same.
Hashes for which they are not are settled by grouping on the texts themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.common import boxed, durable

_M = (1 << 64) - 1


def line_chunks(text: str, long_line: int = 50) -> list[tuple[int, int, bool]]:
    """(first line, end line, is a long line) of every chunk; together they cover all lines."""
    lines = text.split("\n")
    chunks: list[tuple[int, int, bool]] = []
    run: list[int] = []     # rolling hashes of the lines since the last long one
    start = before = 0

    def cut(end: int) -> None:
        nonlocal start
        first, n = start, len(run)
        for i in range(1, n - 1):
            if run[i] < run[i - 1] and run[i] <= run[i + 1]:
                chunks.append((start, first + i + 1, False))
                start = first + i + 1
        if start < end:
            chunks.append((start, end, False))
        run.clear()

    for i, line in enumerate(lines):
        if line.count(" ") >= long_line - 1 and len(line.split()) >= long_line:
            cut(i)
            chunks.append((i, i + 1, True))
            start, before = i + 1, 0
        else:
            h = xxhash.xxh3_64_intdigest(line)
            run.append((h * 0x9E3779B97F4A7C15 + before * 0xC2B2AE3D27D4EB4F & _M) >> 20)
            before = h
    cut(len(lines))
    return chunks


def passage_spans(words: list[int], reach: int) -> set[tuple[int, int]]:
    """(first line, end line) of the shortest runs of lines with ``reach`` words, from every line down and up.

    ``words`` are the counts of the lines. Runs neither begin nor end with a line without words.
    """
    spans = set()
    end = total = 0
    for a, n in enumerate(words):
        while total < reach and end < len(words):
            total += words[end]
            end += 1
        if total >= reach and n:
            spans.add((a, end))
        total -= n
    start = total = 0
    for b, n in enumerate(words):
        total += n
        while total - words[start] >= reach:
            total -= words[start]
            start += 1
        if total >= reach and n:
            spans.add((start, b + 1))
    return spans


def _repeatable(text: str, long_line: int, min_words: int) -> Iterator[tuple[int, bytes, str, tuple[int, int]]]:
    """(index, hash, text, lines) of the chunks and runs that may be removed, in order of their lines."""
    lines = text.split("\n")
    words = [len(line.split()) for line in lines]
    spans = {(a, b) for a, b, long in line_chunks(text, long_line) if (b - a > 1 or long) and sum(words[a:b]) >= min_words}
    for k, (a, b) in enumerate(sorted(spans | passage_spans(words, max(long_line, min_words)))):
        chunk = "\n".join(lines[a:b])
        yield k, xxhash.xxh3_128_digest(chunk), chunk, (a, b)


def _chunk_rows(base: DataFrame, long_line: int, min_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, at, hashes = [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                for k, h, *_ in _repeatable(text.as_py() or "", long_line, min_words):
                    ids.append(doc_id.as_py())
                    at.append(k)
                    hashes.append(h)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "k", "h"])

    return base.mapInArrow(run, "doc_id long, k int, h binary")


def _chunk_texts(listed: DataFrame, long_line: int, min_words: int) -> DataFrame:
    """``h, chunk, doc_id, k`` of the listed chunks, from ``listed(doc_id, text, list<k, h>)``."""
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, marks in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")]):
                wanted = {(m["k"], bytes(m["h"])) for m in marks}
                out += [(h, chunk, doc_id, k) for k, h, chunk, _ in _repeatable(text or "", long_line, min_words) if (k, h) in wanted]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int64(), pa.int32()))],
                                  ["h", "chunk", "doc_id", "k"])

    return listed.mapInArrow(run, "h binary, chunk string, doc_id long, k int")


def _edit(long_line: int, min_words: int):
    @F.pandas_udf("struct<text:string,lines:int>")
    def edit(texts: pd.Series, marks: pd.Series) -> pd.DataFrame:
        out = []
        for text, drop in zip(texts, marks):
            if text is None or drop is None:
                out.append((None, None))
                continue
            gone = {(m["k"], bytes(m["h"])) for m in drop}
            hashes = {h for _, h in gone}
            lines, dropped = text.split("\n"), set()
            firsts: dict[str, tuple[int, int]] = {}     # lines of the first occurrence, if it is in this text
            for k, h, chunk, (a, b) in _repeatable(text, long_line, min_words):
                if (k, h) in gone:
                    c, d = firsts.get(chunk, (0, 0))
                    dropped.update(i for i in range(a, b) if not c <= i < d)
                elif h in hashes:
                    firsts.setdefault(chunk, (a, b))
            if dropped and not any(x.strip() for i, x in enumerate(lines) if i not in dropped):
                dropped.update(range(len(lines)))
            out.append(("\n".join(x for i, x in enumerate(lines) if i not in dropped), len(dropped)))
        return pd.DataFrame(out, columns=["text", "lines"])

    return edit.asNondeterministic()  # else a filter on its result is pushed below and edits again


def dedup_lines(docs: DataFrame, long_line: int = 50, min_words: int = 10) -> DataFrame:
    """``docs(doc_id, text, ...)`` with repeated chunks taken out of ``text``, and ``lines_removed``.

    The first occurrence of a chunk, in the smallest doc_id (null before all) and there the
    first, stays; a later one that overlaps it loses only its other lines. Runs of lines with
    ``long_line`` words or more are all found; shorter ones are if they make whole chunks of at
    least ``min_words`` words. A text is null only if it was; one of which only lines without
    words would be left is empty. Rows that repeat a doc_id and a text are the
    same occurrence, so neither loses to the other. All other columns stay; a column
    ``lines_removed`` is replaced. An empty table gives none.
    """
    base = docs.select("doc_id", "text")
    chunks = durable(_chunk_rows(base, long_line, min_words))
    place = F.struct("doc_id", "k")
    repeated = durable(chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
                       .filter("n > 1").select("h", "first"))
    members = durable(chunks.join(repeated, "h").select("doc_id", "k", "h", "first"))

    # Byte comparison of the chunks of each hash. Joins on doc_id use one plan at every size.
    def lists(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("k", "h")).alias("marks")).hint("merge")

    same_id: Column = F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = _chunk_texts(base.join(lists(members), same_id).select("doc_id", "text", "marks"), long_line, min_words)
    differing = durable(texts.groupBy("h").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi")).filter("lo <> hi").select("h"))
    later = members.filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "k", "h")
    if differing.count():
        own = durable(texts.join(differing, "h", "left_semi"))
        firsts = own.groupBy("h", "chunk").agg(F.min(place).alias("first"))
        later = (later.join(differing, "h", "left_anti").select("doc_id", "k", "h")
                 .unionByName(own.join(firsts, ["h", "chunk"]).filter(~place.eqNullSafe(F.col("first"))).select("doc_id", "k", "h")))
    drop = durable(lists(later)).hint("merge")
    joined = boxed(docs, "lines_removed").join(drop, F.col("_row.doc_id").eqNullSafe(F.col("_id")), "left")
    edited = joined.withColumn("_e", _edit(long_line, min_words)(F.when(F.col("marks").isNotNull(), F.col("_row.text")), F.col("marks")))
    own = [F.col(f"_row.`{c}`").alias(c) if c != "text" else F.coalesce("_e.text", "_row.text").alias(c)
           for c in docs.columns if c != "lines_removed"]
    return edited.select(*own, F.coalesce("_e.lines", F.lit(0)).alias("lines_removed"))
