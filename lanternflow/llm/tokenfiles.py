"""Token ids as length-delimited binary records with masked checksums and an offset index.

A record is: payload length (8 bytes, little endian), masked checksum of those 8 bytes (4),
payload, masked checksum of the payload (4). The checksum is CRC-32, rotated right by 15
bits plus a constant, so that checksums of data which hold checksums stay useful. The payload is
the document's ids as little-endian unsigned integers of 2 bytes if the vocabulary allows, else 4.

Shards are ranges of doc_id in ascending order, one task each, written under a task's own name and
moved into place when complete: a task that runs again, or twice, leaves one whole file of the
same content. The offset index is a separate Parquet table (doc_id, shard, offset, length, n_ids),
so records can be read in any order and by any number of readers.
"""

from __future__ import annotations

import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternflow.llm.common import Recent, durable, gathered, piece_groups
from lanternflow.llm.lexicon import bpe_file
from lanternflow.session import shared_folder

MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(record: bytes) -> bytes:
    """Payload of one record; raises ValueError if a length or checksum is wrong."""
    head = record[:8]
    (size,) = struct.unpack("<Q", head)
    if struct.unpack("<I", record[8:12])[0] != masked(head) or len(record) != size + 16:
        raise ValueError("damaged record length")
    payload = record[12:12 + size]
    if struct.unpack("<I", record[12 + size:])[0] != masked(payload):
        raise ValueError("damaged record payload")
    return payload


class _Encoder:
    """Ids of texts as packed integers, by the tokenizers library.

    Ids of a text are those of its words, as its tokenizer cuts them. New words go to
    the library's model; lately used pieces are looked up.
    """

    def __init__(self, path: str, width: int):
        self.file, self.code = bpe_file(path), "H" if width == 2 else "I"
        self.runs = Recent(self._encode_runs, lambda k, v: 250 + 2 * len(k) + len(v))

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.code, ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _encode_runs(self, runs: list[str]) -> Iterator[bytes]:
        tokenize, letters = self.file.library.model.tokenize, self.file.letters
        for r in runs:
            ids: list[int] = []
            for w in self.file.split(r):
                ids += [w] if isinstance(w, int) else [t.id for t in tokenize(
                    w.decode() if w.isalpha() else "".join([letters[b] for b in w]))]
            yield self._pack(ids)

    def many(self, texts: pa.Array) -> Iterator[memoryview]:
        for pieces, at, offsets in piece_groups(texts):
            data, begin = gathered(self.runs.fetch(pieces), at, offsets)
            for start, end in zip(begin, begin[1:]):
                yield data[start:end]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, shards: int | None = None,
                      folder: str | None = None) -> tuple[str, DataFrame]:
    """Encode ``docs(doc_id, text)``, append ``end_id``, write shards; (folder, offset index).

    A null text counts as empty: its record holds the end id alone. Rows go in ascending doc_id
    (null first); rows that share one follow each other by text. ``folder`` is a local path or a URI
    that pyarrow can open on every executor; by default a new one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/records/{uuid.uuid4().hex}"
    shards = shards or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = 2 if vocabulary <= 1 << 16 else 4

    def run(batches):
        task = TaskContext.get()
        shard = f"shard-{task.partitionId():07d}.rec"
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        part = f"{root}/.{shard}.{task.taskAttemptId()}"
        encoder, end, at = _Encoder(tokenizer, width), np.array([end_id], f"<u{width}").tobytes(), 0
        with files.open_output_stream(part) as out:
            for batch in batches:
                offsets, lengths, counts = [], [], []
                for ids in encoder.many(batch.column("text")):
                    record = frame(b"".join((ids, end)))
                    out.write(record)
                    offsets.append(at)
                    lengths.append(len(record))
                    counts.append((len(record) - 16) // width)
                    at += len(record)
                n = len(offsets)
                yield pa.record_batch([batch.column("doc_id"), pa.array([shard] * n, pa.string()), pa.array(offsets, pa.int64()),
                                       pa.array(lengths, pa.int64()), pa.array(counts, pa.int64())],
                                      ["doc_id", "shard", "offset", "length", "n_ids"])
        files.move(part, f"{root}/{shard}")

    index = (docs.select("doc_id", "text").repartitionByRange(shards, "doc_id", F.xxhash64("text"))
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
             .mapInArrow(run, "doc_id long, shard string, offset long, length long, n_ids long"))
    return folder, durable(index)


def read_token_files(folder: str, index: DataFrame, vocabulary: int, block: int = 32 << 20) -> DataFrame:
    """``doc_id, shard, offset, ids`` (packed little-endian unsigned 32-bit) of the indexed records.

    Every checksum is verified. Index rows are dealt by blocks of a shard, so any subset or order
    of the index reads only what it names; a task opens a file once for a run of records.
    """
    width = 2 if vocabulary <= 1 << 16 else 4

    def run(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        name, stream = None, None
        for batch in batches:
            ids, doc_ids = [], batch.column("doc_id")
            for shard, offset, length in zip(*[batch.column(c).to_pylist() for c in ("shard", "offset", "length")]):
                if shard != name:
                    if stream is not None:
                        stream.close()
                    name, stream = shard, files.open_input_file(f"{root}/{shard}")
                payload = unframe(stream.read_at(length, offset))
                ids.append(np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes())
            yield pa.record_batch([doc_ids, batch.column("shard"), batch.column("offset"), pa.array(ids, pa.binary())],
                                  ["doc_id", "shard", "offset", "ids"])
        if stream is not None:
            stream.close()

    return (index.select("doc_id", "shard", "offset", "length").withColumn("_b", F.floor(F.col("offset") / block))
            .repartition("shard", "_b").sortWithinPartitions("shard", "offset")
            .mapInArrow(run, "doc_id long, shard string, offset long, ids binary"))


def token_positions(records: DataFrame, n: str = "n_tokens") -> DataFrame:
    """Add ``start``: the ids of all records before, over shards in order and offsets within.

    The running sum over shards has one row a shard; rows are summed within their shard.
    """
    inside = Window.partitionBy("shard").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = records.groupBy("shard").agg(F.sum(n).alias("_t")).select(
        F.col("shard").alias("_s"), F.coalesce(F.sum("_t").over(over), F.lit(0)).alias("_base"))
    return (records.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
            .join(base, F.col("shard") == F.col("_s")).withColumn("start", F.col("_base") + F.col("_in")).drop("_s", "_base", "_in"))


def _summary():
    @F.pandas_udf("struct<n:long,crc:long>")
    def summary(ids):
        import pandas as pd
        return pd.DataFrame({"n": [len(x) // 4 for x in ids], "crc": [zlib.crc32(x) for x in ids]})
    return summary


def token_file_digest(docs: DataFrame, tokenizer: str, end_id: int = 1, vocabulary: int = 49_408) -> DataFrame:
    """Write the files, read them back: ``doc_id, start, n_tokens, ids_crc32`` of every record."""
    folder, index = write_token_files(docs, tokenizer, end_id, vocabulary)
    read = read_token_files(folder, index, vocabulary).withColumn("s", _summary()(F.col("ids")))
    rows = durable(read.select("doc_id", "shard", "offset", F.col("s.n").alias("n_tokens"), F.col("s.crc").alias("ids_crc32")))
    return token_positions(rows).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset")
