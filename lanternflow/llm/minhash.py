"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Every document's set of word shingles is hashed, reduced to minima, and only the low eight
   bits of each minimum are kept and packed: one byte a minimum.
2. Equal word sequences form one class, represented by its smallest doc_id, so copies never
   meet each other again.
3. Bands of consecutive signature bytes are the join keys. Band keys with a single class are
   dropped. Keys with many classes are cut into blocks of at most ``BLOCK`` classes, and blocks
   meet in pairs: a task holds two blocks, never a whole key.
4. In a block pair the equal bytes of two signatures give the similarity, corrected for chance
   collisions of low bits. A pair counts in the first band it shares, so in one place only.
   The classes of pairs that may reach the limit go on.
5. Their full sets are fetched and compared exactly. A block pair returns the links that join
   its classes, less those that are already implied by others of the same pair.
6. Links become components by large-star and small-star rounds.

The number of bands follows from the limit: a pair at the limit is missed by all bands with a
probability of at most ``MISS``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.common import Memo, arrow_groups, connected_components, durable

MISS = 1e-5
BLOCK = 256
SLACK = 4.0        # standard deviations of the estimate that a candidate may lack
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                        0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def band_shape(percent: int) -> tuple[int, int]:
    """(bands, rows a band) for a limit on the similarity."""
    t = min(percent, 99) / 100
    rows = max(1, round(math.log(0.35) / math.log(t)))
    return math.ceil(math.log(MISS) / math.log1p(-t ** rows)), rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_bytes(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text with A-Z lower-cased (bytes methods do just that)."""
    return text.lower().split() if text else []


def shingle_set(words: list[bytes], n: int, hashes: Memo) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    ends = len(h) - size + 1
    x = np.full(ends, np.uint64(size))
    for i in range(size):
        x = _mix(x + h[i:i + ends] * MULTIPLIERS[i % len(MULTIPLIERS)])
    return np.unique(x)


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20_011))
    return (rng.integers(0, 2 ** 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, k, dtype=np.uint64))


def low_bits(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    """The packed low eight bits of the minimum under each permutation."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (a[:, None] * shingles[None, i:i + 2048] + b[:, None]).min(axis=1), out=least)
    return _mix(least).astype(np.uint8).tobytes()


def _hash_memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def signatures(docs: DataFrame, percent: int, n: int = 5) -> DataFrame:
    """``doc_id, key, n_shingles, sig`` of every row; key and sig are null without words."""
    bands, rows = band_shape(percent)

    def run(batches):
        hashes, (a, b) = _hash_memo(), _permutations(bands * rows)
        for batch in batches:
            out = []
            for text in batch.column("text"):
                words = word_bytes(text.as_py())
                s = shingle_set(words, n, hashes)
                out.append((xxhash.xxh3_128_digest(b" ".join(words)) if words else None, len(s), low_bits(s, a, b) if words else None))
            keys, sizes, sigs = zip(*out) if out else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()),
                                   pa.array(sigs, pa.binary())], ["doc_id", "key", "n_shingles", "sig"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, key binary, n_shingles long, sig binary")


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity of every row of ``x`` to every row of ``y`` (packed signatures), corrected for collisions."""
    same = np.zeros((len(x), len(y)), np.int32)
    for i in range(0, len(x), 64):
        same[i:i + 64] = np.count_nonzero(x[i:i + 64, None, :] == y[None, :, :], axis=2)
    chance = 1 / 256
    return (same / x.shape[1] - chance) / (1 - chance)


def _candidates(percent: int):
    bands, rows = band_shape(percent)
    t = percent / 100
    floor = t - SLACK * math.sqrt(t * (1 - t) / (bands * rows))

    def run(batches):
        keep: list[pa.Table] = []
        held = 0
        for group in arrow_groups(batches, ["band", "bkey", "i", "j"]):
            m = group.num_rows
            if m < 2:
                continue
            s = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(m, -1)
            i, j, own = group.column("i")[0].as_py(), group.column("j")[0].as_py(), np.array(group.column("own").to_pylist())
            left, right = (np.arange(m), np.arange(m)) if i == j else (np.flatnonzero(own == i), np.flatnonzero(own == j))
            if not len(left) or not len(right):
                continue
            p, q = np.nonzero(estimate(s[left], s[right]) >= floor)
            p, q = left[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            wanted = np.zeros(m, bool)
            for k in range(0, len(p), 4096):
                first = (s[p[k:k + 4096]] == s[q[k:k + 4096]]).reshape(-1, bands, rows).all(axis=2).argmax(axis=1)
                here = first == group.column("band")[0].as_py()
                wanted[p[k:k + 4096][here]] = wanted[q[k:k + 4096][here]] = True
            if wanted.any():
                keep.append(group.select(["band", "bkey", "i", "j", "rep", "key"]).filter(pa.array(wanted)))
                held += int(wanted.sum())
            if held >= 20_000:
                yield from pa.concat_tables(keep).combine_chunks().to_batches()
                keep, held = [], 0
        if keep:
            yield from pa.concat_tables(keep).combine_chunks().to_batches()

    return run


def exact_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs (p, q) with 100 * intersection >= percent * union that connect the sets; implied ones are left out."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    inter = np.zeros((m, m), np.int64)
    if m == 2:
        inter[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        at = np.repeat(np.arange(m), sizes)
        values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        use = count[column] > 1
        at, column = at[use], shared[column[use]]
        order = np.argsort(column, kind="stable")
        at, column = at[order], column[order]
        for lo in range(0, int(shared[-1]) + 1 if len(values) else 0, 4096):
            x, y = np.searchsorted(column, (lo, lo + 4096))
            block = np.zeros((m, 4096), np.float32)
            block[at[x:y], column[x:y] - lo] = 1
            inter += (block @ block.T).astype(np.int64)
    p, q = np.nonzero(np.triu(100 * inter >= percent * (sizes[:, None] + sizes[None, :] - inter), 1))
    root = list(range(m))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    out = []
    for u, v in zip(p.tolist(), q.tolist()):
        if (a := find(u)) != (b := find(v)):
            root[max(a, b)] = min(a, b)
            out.append((u, v))
    return out


def _links(percent: int):
    def run(batches):
        a, b = [], []
        for group in arrow_groups(batches, ["band", "bkey", "i", "j"]):
            if group.num_rows < 2:
                continue
            reps = group.column("rep").to_pylist()
            for u, v in exact_links([np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()], percent):
                a.append(reps[u])
                b.append(reps[v])
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, n: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    Documents are linked if 100 * intersection >= percent * union of their sets of ``n``-word
    shingles; ``component_id`` is the smallest doc_id that links reach. Texts that are null or
    without words have an empty set and are linked with nothing. A text of fewer than ``n`` words
    has its whole word sequence as its one shingle. ``kept`` marks the row with
    doc_id = component_id; rows that repeat a doc_id share its fate. A row without doc_id is kept
    only if nothing else has its text, and then has no component_id. An empty table gives none.
    """
    bands, rows = band_shape(percent)
    sigs = durable(signatures(docs, percent, n))
    reps = sigs.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep")).filter("rep IS NOT NULL")
    reps = durable(reps)
    classes = durable(sigs.join(reps, (sigs["key"] == reps["key"]) & (sigs["doc_id"] == reps["rep"]), "left_semi")
                      .select("key", F.col("doc_id").alias("rep"), "sig").dropDuplicates(["rep", "key"]))
    banded = classes.select("rep", "key", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.substring("sig", i * rows + 1, F.lit(rows)))).alias("band", "bkey"))
    shared = durable(banded.groupBy("band", "bkey").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = (banded.join(shared, ["band", "bkey"]).join(classes.select("rep", "key", "sig"), ["rep", "key"])
               .withColumn("own", F.pmod(F.xxhash64("key"), blocks).cast("int"))
               .withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
               .withColumn("i", F.least("own", "_o")).withColumn("j", F.greatest("own", "_o")).drop("_o", "m"))
    group = ["band", "bkey", "i", "j"]
    shape = "band int, bkey binary, i int, j int, rep long, key binary"
    wanted = durable(members.repartition(*group).sortWithinPartitions(*group)
                     .mapInArrow(_candidates(percent), shape))

    # Full sets, only of classes that have a candidate.
    # The same plan at every size: texts are dealt by doc_id against a hash table of the wanted ids.
    ids = wanted.select("rep", "key").distinct().hint("shuffle_hash")
    sets = _sets(docs.select("doc_id", F.col("text").cast("binary").alias("text"))
                 .join(ids, F.col("doc_id") == F.col("rep")).select("rep", "key", "text"), n).dropDuplicates(["rep", "key"])
    links = (wanted.join(sets, ["rep", "key"]).repartition(*group).sortWithinPartitions(*group)
             .mapInArrow(_links(percent), "a long, b long"))
    parts = connected_components(links)
    label = reps.join(parts, F.col("rep") == F.col("node"), "left").select(
        F.col("key").alias("_key"), F.coalesce("component", "rep").alias("_c"))
    return (sigs.join(label, F.col("key") == F.col("_key"), "left")
            .select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def _sets(texts: DataFrame, n: int) -> DataFrame:
    def run(batches):
        hashes = _hash_memo()
        for batch in batches:
            reps, keys, sets = [], [], []
            for rep, key, text in zip(*[batch.column(c) for c in ("rep", "key", "text")]):
                words = word_bytes(text.as_py())
                if xxhash.xxh3_128_digest(b" ".join(words)) == key.as_py():  # a repeated doc_id may have other texts
                    reps.append(rep.as_py())
                    keys.append(key.as_py())
                    sets.append(shingle_set(words, n, hashes).tobytes())
            yield pa.record_batch([pa.array(reps, pa.int64()), pa.array(keys, pa.binary()), pa.array(sets, pa.binary())],
                                  ["rep", "key", "shingles"])

    return texts.mapInArrow(run, "rep long, key binary, shingles binary")
