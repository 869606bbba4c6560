"""64-bit SimHash and BK-tree links against all pairs."""

import random

import brute_new as brute
import numpy as np
import pytest
from lanternflow.llm import bktree as B
from pyspark.sql import functions as F

SHAPE = "doc_id long, text string"


def cluster(rng, n, spread):
    """Values that grow from each other by up to ``spread`` flipped bits."""
    out = [rng.getrandbits(64)]
    while len(out) < n:
        v = rng.choice(out)
        for b in rng.sample(range(64), rng.randint(1, spread)):
            v ^= 1 << b
        out.append(v)
    return out


def labels(values, links):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_tree_search_finds_every_pair(radius):
    rng = random.Random(radius)
    groups = [sorted(set(cluster(rng, n, 5))) for n in (1, 2, 300, 40)]
    values = np.array([v for g in groups for v in g], np.uint64)
    shard = np.repeat(np.arange(4), [len(g) for g in groups])
    forest = B.Forest(values, shard)
    found = {(int(q), int(m)) for qs, ms in forest.near(np.arange(len(values)), radius) for q, m in zip(qs, ms)}
    want = {(q, m) for q in range(len(values)) for m in range(q) if shard[q] == shard[m]
            and int(values[q] ^ values[m]).bit_count() <= radius}
    assert found == want


@pytest.mark.parametrize("shard", [2, 16, 8192])
def test_links_join_what_all_pairs_join(spark, shard):
    rng = random.Random(8)
    values = [v for i in range(12) for v in cluster(rng, 40, 4)] + [0, 1, (1 << 64) - 1]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    unsigned = lambda v: v & ((1 << 64) - 1)
    df = spark.createDataFrame([(v, v) for v in values], "fp long, rep long")
    links = [tuple(r) for r in B.near_links(df, 3, shard).collect()]
    want = brute.hamming_components([unsigned(v) for v in values])
    got = labels(values, links)
    same = lambda f: {frozenset(unsigned(v) for v in values if f(v) == c) for c in {f(v) for v in values}}
    assert same(got.__getitem__) == same(lambda v: want[unsigned(v)])


def test_shards_are_bounded():
    for radius in (0, 1, 2, 3):
        last = B._levels(radius, B.SHARD)[-1]
        assert [t for t, _ in last] == list(range(len(last)))
        assert all(64 - sum(n for _, n in fixed) <= 13 for _, fixed in last)


def test_documents_equal_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(900_001, None), (900_002, ""), (900_003, " \n"), (900_004, "one"), (900_005, "ONE"), (900_006, "One two"), (900_006, "a b c D"),
             (900_007, "Ünï " * 150_000), (-5, "A b C d"), (-5, "a b c d")]
    df = spark.createDataFrame(rows, SHAPE).withColumn("fp", F.lit("x")).withColumn("fingerprint", F.lit("x")).withColumn("rep", F.lit(1))
    prints = [(d, brute.simhash64(t)) for d, t in rows]
    parts = brute.hamming_components([p for _, p in prints])
    least = {}
    for d, p in prints:
        least[parts[p]] = min(d, least.get(parts[p], d))
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in B.near_components(df).collect())
    assert got == sorted((d, f"{p:016x}", least[parts[p]]) for d, p in prints)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "quite another text here")], SHAPE)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in B.near_components(df).collect() if r["doc_id"] or r["component_id"] == 7)
    assert got == [(0, 7), (7, 7)]
    assert B.near_components(spark.createDataFrame([], SHAPE)).collect() == []
