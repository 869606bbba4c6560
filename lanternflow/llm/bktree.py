"""Near duplicates by 64-bit SimHash, linked through BK-trees.

A term is a run of three words, counted as often as it occurs; its XXH64 votes on each bit, and a bit of the
fingerprint is 1 if it is set in over half of the hashes. Documents link if their fingerprints differ in
at most ``radius`` bits.

Fingerprints are folded first, so copies are one entry. Two fingerprints within the radius agree on one
of ``radius + 1`` blocks of bits, so each fingerprint goes to one shard for each block and its value. A shard
is a BK-tree: a child hangs under its parent by their Hamming distance, and a search at distance d from a node
follows only the edges from d - radius to d + radius. A task builds the trees of many shards together, level
by level, and every member searches the tree of its own shard.

A shard of more than ``SHARD`` members is cut again, by blocks of the bits that it doesn't fix yet. Once
so few bits are left free that no more distinct fingerprints than ``SHARD`` are possible, no shard can be too
large. So a task holds bounded trees whatever the fingerprints are, and no link is lost.

Trees of all documents can't be broadcast, since their size grows with the documents; a shard's tree and all the
fingerprints that must search it meet in one task instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternflow.llm.common import connected_components, durable

BITS = 64
SEED = 42
SHARD = 8192      # members of a tree; 2^13, so shards with 13 free bits need no cut
QUERIES = 512     # members that search together


# Fingerprints ----------------------------------------------------------------------------

def term_hashes(text: bytes | None, n: int = 3) -> np.ndarray:
    """XXH64 of every run of ``n`` words (A-Z lower-cased, joined by a space); fewer words are one run."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist())),
                       np.uint64, len(words) - n + 1)


def votes_of(hashes: np.ndarray) -> int:
    """The fingerprint of the hashes: bits set in over half of them."""
    set_in = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):  # bounded memory for long texts
        part = hashes[i:i + 65_536].astype(">u8").view(np.uint8).reshape(-1, BITS // 8)
        set_in += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_in > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """``doc_id, fp`` (64 bits as a signed long) of every row; null and wordless texts have all bits zero."""
    def run(batches):
        for batch in batches:
            out = np.fromiter((votes_of(term_hashes(t.as_py(), n)) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


# Trees -----------------------------------------------------------------------------------

class Forest:
    """BK-trees of the distinct ``values`` of each shard; ``shard`` numbers are ascending."""

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        self.values = values
        m = len(values)
        first = np.r_[True, shard[1:] != shard[:-1]] if m else np.empty(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if m else np.empty(0, np.int64)
        parent, edge = np.full(m, -1), np.zeros(m, np.int64)
        item = np.flatnonzero(~first)
        at = self.root[item]
        while len(item):  # every turn, all members that aren't placed go down by one edge
            d = np.bitwise_count(values[item] ^ values[at]).astype(np.int64)
            _, lead, place = np.unique(at * (BITS + 1) + d, return_index=True, return_inverse=True)
            child = item[lead][place]
            parent[item[lead]], edge[item[lead]] = at[lead], d[lead]
            below = child != item
            item, at = item[below], child[below]
        inner = np.flatnonzero(parent >= 0)
        key = parent[inner] * (BITS + 1) + edge[inner]
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], inner[order]

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) pairs within ``radius`` in the query's own shard, member < query."""
        q, at = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.values[q] ^ self.values[at]).astype(np.int64)
            hit = (d <= radius) & (at < q)
            if hit.any():
                yield q[hit], at[hit]
            lo = np.searchsorted(self.key, at * (BITS + 1) + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, at * (BITS + 1) + np.minimum(d + radius, BITS), side="right")
            n = hi - lo
            q = np.repeat(q, n)
            at = self.child[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]


def spanning_links(values: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of positions that join all members within ``radius`` of each other; implied ones are left out."""
    forest, root = Forest(values, shard), np.arange(len(values))
    a, b = [], []

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for start in range(0, len(values), QUERIES):
        for q, m in forest.near(np.arange(start, min(start + QUERIES, len(values))), radius):
            x, y = root[q], root[m]
            while (x != root[x]).any() or (y != root[y]).any():
                x, y = root[x], root[y]
            apart = x != y
            if not apart.any():
                continue
            for u, v in np.unique(np.stack([x[apart], y[apart]], axis=1), axis=0).tolist():
                if (s := find(u)) != (t := find(v)):
                    root[max(s, t)] = min(s, t)
                    a.append(u)
                    b.append(v)
    return np.array(a, np.int64), np.array(b, np.int64)


# Shards ----------------------------------------------------------------------------------

def cut_blocks(free: list[tuple[int, int]], parts: int) -> list[list[tuple[int, int]]]:
    """``parts`` lists of bit ranges (start, length) that share out the ``free`` ranges as evenly as can be."""
    bits = [p for s, n in free for p in range(s, s + n)]
    out = []
    for i in range(parts):
        mine = bits[i * len(bits) // parts:(i + 1) * len(bits) // parts]
        ranges: list[tuple[int, int]] = []
        for p in mine:
            if ranges and sum(ranges[-1]) == p:
                ranges[-1] = (ranges[-1][0], ranges[-1][1] + 1)
            else:
                ranges.append((p, 1))
        out.append(ranges)
    return out


def _mask(ranges: list[tuple[int, int]]) -> int:
    m = 0
    for s, n in ranges:
        m |= ((1 << n) - 1) << s
    return m - (1 << BITS) if m >> (BITS - 1) else m


def _levels(radius: int, shard: int) -> list[list[tuple[int, list]]]:
    """For each level the tables as (number, ranges of fixed bits); a table of the next level refines one of this.

    The last level leaves so few bits free that a shard can't have more than ``shard`` members; there are at most
    16,384 tables, so from a radius of four on the last shards may be larger.
    """
    levels, tables = [], [(0, [], [(0, BITS)])]
    while max(sum(n for _, n in free) for _, _, free in tables) >= shard.bit_length() and len(tables) * (radius + 1) <= 16_384:
        following = []
        for number, fixed, free in tables:
            blocks = cut_blocks(free, radius + 1)
            for i, own in enumerate(blocks):
                rest = [r for j, other in enumerate(blocks) for r in other if j != i]
                following.append((number * (radius + 1) + i, fixed + own, sorted(rest)))
        tables = following
        levels.append([(number, fixed) for number, fixed, _ in tables])
    return levels


def _key(tables: list[tuple[int, list]], number: Column) -> Column:
    masks = F.split(F.lit(",".join(str(_mask(fixed)) for _, fixed in tables)), ",")  # folded to one constant
    return F.col("fp").bitwiseAND(F.element_at(masks, number.cast("int") + 1).cast("long"))


def _search(radius: int, rows: int = 65_536):
    def links(shards, values, reps):
        a, b = spanning_links(values, shards, radius)
        return pa.record_batch([pa.array(reps[a], pa.int64()), pa.array(reps[b], pa.int64())], ["a", "b"])

    def run(batches):
        """Whole shards of a sorted partition, many small ones at a time."""
        held, last = [], None
        count = 0
        for batch in batches:
            t, key, fp, rep = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("t", "key", "fp", "rep")]
            if not len(fp):
                continue
            new = np.r_[last != (t[0], key[0]), (t[1:] != t[:-1]) | (key[1:] != key[:-1])]
            last = (t[-1], key[-1])
            held.append((new, fp, rep))
            count += len(fp)
            if count >= rows:
                new, fp, rep = [np.concatenate(x) for x in zip(*held)]
                whole = np.flatnonzero(new)[-1]  # the last shard may go on
                if whole:
                    yield links(np.cumsum(new[:whole]), fp[:whole].view(np.uint64), rep[:whole])
                held, count = [(new[whole:], fp[whole:], rep[whole:])], len(fp) - whole
        if held:
            new, fp, rep = [np.concatenate(x) for x in zip(*held)]
            yield links(np.cumsum(new), fp.view(np.uint64), rep)

    return run


def near_links(prints: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """``a, b``: links between the ``rep`` of distinct ``fp`` of ``prints(fp, rep)`` within ``radius`` bits.

    Links that follow from others of the same shard are left out, so components are those of all links.
    """
    levels = _levels(radius, shard)
    found = None
    going = prints.select("fp", "rep", F.lit(0).cast("long").alias("_up"))
    for depth, tables in enumerate(levels):
        keyed = (going.withColumn("t", F.explode(F.sequence(F.col("_up") * (radius + 1), F.col("_up") * (radius + 1) + radius)))
                 .withColumn("key", _key(tables, F.col("t"))).select("t", "key", "fp", "rep"))
        if depth < len(levels) - 1:
            large = durable(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > shard).select("t", "key"))
            some = not large.isEmpty()
        else:
            some = False
        here = keyed.join(large, ["t", "key"], "left_anti") if some else keyed
        links = (here.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
                 .mapInArrow(_search(radius), "a long, b long"))
        found = links if found is None else found.unionByName(links)
        if not some:
            break
        going = durable(keyed.join(large, ["t", "key"], "left_semi").select("fp", "rep", F.col("t").alias("_up")))
    return found


def near_components(docs: DataFrame, radius: int = 3, n: int = 3, shard: int = SHARD) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs(doc_id, text, ...)``.

    ``fingerprint`` has 16 lower-case hex digits; ``component_id`` is the smallest doc_id that is reached by
    fingerprints of at most ``radius`` differing bits. Null, empty and wordless texts have the fingerprint
    zero and link like any other. Repeated rows and copies share a component. A null doc_id is linked too, but
    names no component: one whose rows all lack a doc_id has a null component_id. An empty table gives no row;
    other columns are not read.
    """
    prints = durable(fingerprints(docs, n))
    folded = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = folded.select("fp", F.col("fp").alias("rep"))
    parts = connected_components(near_links(nodes, radius, shard))
    named = folded.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("_c"))
    least = named.groupBy("_c").agg(F.min("least").alias("component_id"))
    of = named.join(least, "_c").select(F.col("fp").alias("_fp"), "component_id")
    return prints.join(of, F.col("fp") == F.col("_fp")).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
