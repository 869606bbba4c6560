"""Hard negatives by zone maps against scoring everything."""

import math
import random

import brute_new as brute
import numpy as np
import pytest
from lanternflow.llm import negatives as N
from lanternflow.llm import queries
from pyspark.sql import functions as F

SHAPE = "vec_id long, label long, v array<long>"


def found(df):
    return sorted((tuple(r[c] for c in N.RESULT) for r in df.collect()), key=lambda t: [2 ** 63 if x is None else x for x in t])


def rows_of(seed, n, dims, labels=4, width=60):
    rng = random.Random(seed)
    centres = [[rng.randint(-width, width) for _ in range(dims)] for _ in range(labels + 2)]
    return [(i, rng.randrange(labels), [c + rng.randint(-20, 20) for c in rng.choice(centres)]) for i in range(n)]


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2), (2, 4)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        keys = N.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("dims,block", [(3, 8), (16, 32), (1, 4)])
def test_equals_scoring_everything(spark, dims, block):
    rows = rows_of(dims, 400, dims)
    rows += [(1000 + i, 1, rows[0][2]) for i in range(60)]      # a hot vector, ties by id
    rows += [(50, 2, rows[50][2]), (50, rows[50][1], rows[50][2])]  # a repeated id and a repeated row
    df = spark.createDataFrame(rows, SHAPE).withColumn("key", F.lit("x")).withColumn("_a", F.lit(1))
    got = found(N.hard_negatives(df, F.col("vec_id") % 10 == 0, block=block))
    assert got == brute.mined(rows, lambda i: i % 10 == 0) and got


def test_bounds_hold_every_score_and_skip_blocks(spark):
    rows = sorted(rows_of(5, 3000, 4, labels=3), key=lambda r: r[0])
    df = spark.createDataFrame(rows, SHAPE)
    store = N.Store(N.write_blocks(df, 4, 3, 64), 4)
    z = next(iter(store.zones()))
    v = np.array([r[2] for r in rows[:50]])
    search = N.Search(store, np.arange(50), np.array([r[1] for r in rows[:50]]), v, 5, 3, 50, 95)
    low, high, same = search.bounds(z)
    for b, place in enumerate(z.place):
        _, labels, block = store.block(place)
        score = N.products(v, block)
        assert (score >= low[:, [b]]).all() and (score <= high[:, [b]]).all()
        assert (same[:, b] == np.isin(search.labels, labels)).all()
    store.read_blocks = 0
    one = N.Search(store, *[x[:1] for x in (search.ids, search.labels, v)], 5, 3, 50, 95)
    one.positives()
    assert store.read_blocks < 30  # of about 48


def test_nulls_odd_components_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    given = [(0, 1, [0.5, 0.25]), (7, 1, [0.5, -0.25]), (1, 1, [0.5, None]), (2, 1, [nan, 0.1]), (3, None, [0.1, 0.1]), (4, 1, None),
             (5, 2, [inf, 0.1]), (50, 2, [0.4, 0.2]), (None, 2, [0.3, 0.2]), (8, 1, [0.45]), (9, 1, []), (100, 2, [0.0, 0.0])]
    df = spark.createDataFrame(given, "vec_id long, label int, embedding array<float>")
    rows = [(r["vec_id"], r["label"], r["v"]) for r in N.quantised(df).collect()]
    assert sorted((r[0] is None, r[0]) for r in rows if r[0] is not None) == [(False, i) for i in (0, 7, 8, 9, 50, 100)] and len(rows) == 7
    assert dict((r[0], r[2]) for r in rows)[7] == [math.floor(256 * 0.5), -64]
    last = 2 ** 63 - 1
    want = [tuple(None if x == last else x for x in r) for r in brute.mined([(last if i is None else i, c, v) for i, c, v in rows], lambda i: i % 50 == 0)]
    assert found(N.hard_negatives(N.quantised(df), F.col("vec_id") % 50 == 0)) == want


def test_empty_table_and_large_components(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert found(N.hard_negatives(empty, F.col("vec_id") % 50 == 0)) == []
    rows = [(i, i % 2, [(1 << 30) + i * 7919, -(1 << 29) + i]) for i in range(40)]
    got = found(N.hard_negatives(spark.createDataFrame(rows, SHAPE), F.col("vec_id") % 20 == 0, most=100))
    assert got == brute.mined(rows, lambda i: i % 20 == 0, most=100) and got


def test_query_equals_scoring_the_given_table(spark, sf):
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        e = r["embedding"]
        if r["label"] is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        rows.append((r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], [math.floor(256 * float(x)) for x in e]))
    assert found(queries.op13_hard_negatives(spark, sf)) == brute.mined(rows, lambda i: i % 50 == 0)
