import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternflow.operators import baselines as B
from lanternflow.operators import scale
from lanternflow.operators.windows import multiscale_features, multiscale_names, sequences, window_features


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of all rows, many equal timestamps."""
    rng = np.random.default_rng(1)
    n = 900
    rows = [("hot" if i % 3 == 0 else f"k{i % 17}", int(rng.integers(0, 200)), i, ["a:1", "b:2", "c:2"][i % 3 - i % 2],
             f"d{int(rng.integers(0, 9))}", float(rng.integers(0, 1000)), int(rng.integers(1, 6))) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, s int, event_row_id bigint, event_type string, dst_id string, bytes double, token_id int")
    return scale.durable(df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s"))


def test_hot_keys_lists_only_large_keys(skewed):
    hot = scale.hot_keys(skewed, ["entity_id"], 100)
    assert [r[0] for r in hot.table.collect()] == ["hot"] and hot.rows == 300 and hot.total == 900
    assert scale.hot_keys(skewed, ["entity_id"], 1000).table is None


@pytest.mark.parametrize("limit", [40, 90])
def test_split_windows_equal_plain_windows(skewed, limit):
    hot = scale.hot_keys(skewed, ["entity_id"], limit)
    assert hot.table is not None
    cool = scale.hot_keys(skewed, ["entity_id"], 10_000)
    names = multiscale_names((3, 8))

    def rows(df, cols):
        return [tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                for r in df.select("event_row_id", *cols).orderBy("event_row_id").collect()]

    assert rows(multiscale_features(skewed, (3, 8), hot=hot), names) == rows(multiscale_features(skewed, (3, 8), hot=cool), names)
    tokens = skewed.withColumns({"label": F.lit("x"), "token_str": F.lit("t")})
    feats = ["tok_uniq", "tok_top_share", "dst_uniq", "dst_top_share", "bytes_mean", "bytes_std", "repeat_last", "t1", "t2", "pos"]
    assert rows(window_features(tokens, 4, 2, hot=hot), feats) == rows(window_features(tokens, 4, 2, hot=cool), feats)
    assert rows(sequences(tokens, 5, hot=hot), ["context", "pos"]) == rows(sequences(tokens, 5, hot=cool), ["context", "pos"])


def test_positions_are_dense_for_hot_keys(skewed):
    got = scale.positions(skewed, ["entity_id"], ["timestamp", "event_row_id"], hot=scale.hot_keys(skewed, ["entity_id"], 50))
    order = [r.event_row_id for r in got.filter("entity_id = 'hot'").orderBy("pos").collect()]
    want = [r.event_row_id for r in skewed.filter("entity_id = 'hot'").orderBy("timestamp", "event_row_id").collect()]
    assert order == want


def test_global_rank_matches_sort(skewed):
    got = [r.event_row_id for r in scale.global_rank(skewed, ["timestamp", "event_row_id"], "k", 5).orderBy("k").collect()]
    assert got == [r.event_row_id for r in skewed.orderBy("timestamp", "event_row_id").collect()]


@pytest.mark.parametrize("prob", [0.0, 0.25, 0.5, 0.99, 1.0])
@pytest.mark.parametrize("method", ["linear", "higher"])
def test_bracketed_quantiles_are_exact(spark, prob, method):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=4000), rng.integers(0, 5, size=4000).astype(float)
    df = scale.durable(spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double"))
    for limit in (50, 10_000):
        got = {r.feature: r.quantile for r in scale.exact_quantile(df, ["a", "b"], prob, method, limit=limit).collect()}
        assert got["a"] == pytest.approx(np.quantile(a, prob, method=method), abs=1e-12)
        assert got["b"] == pytest.approx(np.quantile(b, prob, method=method), abs=1e-12)


def test_bracketed_quantiles_per_group(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k, n in (("x", 3000), ("y", 40), ("z", 1)) for v in rng.exponential(size=n)]
    df = scale.durable(spark.createDataFrame(rows, "k string, v double"))
    got = {r.k: r.quantile for r in scale.exact_quantile(df, ["v"], 0.9, by=["k"], limit=100).collect()}
    for k in "xyz":
        assert got[k] == pytest.approx(np.quantile([v for g, v in rows if g == k], 0.9), abs=1e-12)


def test_key_at_rank_settles_ties(spark, skewed):
    order = ["s", "event_row_id"]
    df = scale.durable(skewed.select(F.unix_seconds("timestamp").alias("s"), "event_row_id"))
    want = sorted((r.s, r.event_row_id) for r in df.collect())
    for rank in (0, 17, 450, 899):
        key = scale.key_at_rank(df, order, rank)
        assert key == want[rank]
        assert df.filter(scale.before_key(order, key)).count() == rank
    assert scale.key_at_rank(df, order, 900) is None


def test_rank_without_a_chunk_count(skewed):
    got = [r.event_row_id for r in scale.global_rank(skewed, ["timestamp", "event_row_id"], "k").orderBy("k").collect()]
    assert got == [r.event_row_id for r in skewed.orderBy("timestamp", "event_row_id").collect()]


def test_quantiles_have_the_same_bits_at_every_limit(spark):
    """The direct aggregate and the bracketed search of large groups agree exactly, per column and per group."""
    rng = np.random.default_rng(11)
    rows = [("xyz"[i % 3], float(a), float(b)) for i, (a, b) in enumerate(zip(rng.normal(size=1001), rng.exponential(size=1001) / 3))]
    df = scale.durable(spark.createDataFrame(rows, "entity_id string, a double, b double"))
    probs = [0.0, 0.1, 0.25, 0.37, 0.5, 0.731, 0.99, 1.0]
    found, fitted = [], []
    try:
        for limit in ("10", "1000000"):
            spark.conf.set("spark.lanternflow.maxGroupRows", limit)
            found.append(scale.global_quantiles(df, ["a", "b"], probs))
            base = B.fit_baselines(df, ["a", "b"])
            fitted.append((base.medians, base.scales, sorted(tuple(r) for r in base.entities.collect())))
    finally:
        spark.conf.unset("spark.lanternflow.maxGroupRows")
    assert found[0] == found[1] and fitted[0] == fitted[1]
    for p in probs:
        per = {r.entity_id: r.quantile for r in scale.exact_quantile(df, ["a"], p, by=["entity_id"], limit=10).collect()}
        assert per == {r.entity_id: r.q for r in df.groupBy("entity_id").agg(F.percentile("a", p).alias("q")).collect()}


def test_all_quantiles_of_large_columns_share_their_passes(spark, monkeypatch):
    """One stored copy and one search, however many probabilities; exact over ties, nulls and NaN."""
    rng = np.random.default_rng(2)
    a = [None, float("nan"), *rng.normal(size=3000).tolist()]
    rows = [(x, float(i % 3), 7.0 if i else 1.0) for i, x in enumerate(a)]
    df = scale.durable(spark.createDataFrame(rows, "a double, b double, c double"))
    probs, stored, passes = [i / 8 for i in range(9)], [], []
    keep, large = scale.durable, scale._large_ranks
    monkeypatch.setattr(scale, "durable", lambda x: stored.append(1) or keep(x))
    monkeypatch.setattr(scale, "_large_ranks", lambda *args: passes.append(1) or large(*args))
    monkeypatch.setattr(scale, "max_group_rows", lambda spark: 20)
    got = scale.global_quantiles(df, ["a", "b", "c"], probs)
    assert (len(stored), len(passes)) == (1, 1)
    want = df.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in probs])).alias(c) for c in "abc"]).first()
    assert {c: str(v) for c, v in got.items()} == {c: str(want[c]) for c in "abc"}
