import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternflow.operators import splits, tokens


def events(spark, n=20, label=lambda i: "BENIGN"):
    rows = [(i, f"e{i % 3}", 1_600_000_000 + i * 60, label(i), f"d{i % 4}", float(i), "tcp:80") for i in range(n)]
    df = spark.createDataFrame(rows, "event_row_id bigint, entity_id string, s bigint, label string, dst_id string, bytes double, event_type string")
    return df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")


def test_chronological_split_counts_order_and_blindness(spark):
    a = splits.chronological_split(events(spark, 10), 0.7, 0.15)
    counts = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert counts == {"train": 7, "val": 1, "test": 2}
    b = splits.chronological_split(events(spark, 10, lambda i: "DoS" if i > 4 else "BENIGN"), 0.7, 0.15)
    pick = lambda df: sorted((r.event_row_id, r.split) for r in df.collect())
    assert pick(a) == pick(b)
    with pytest.raises(ValueError):
        splits.chronological_split(events(spark), 0.8, 0.3)


def test_day_split(spark):
    days = ["2017-07-03 23:59:59", "2017-07-04 00:00:00", "2017-07-05 00:00:00", "2017-07-07 23:59:59", "2017-07-09 00:00:00"]
    df = spark.createDataFrame([(d,) for d in days], "t string").select(F.col("t").cast("timestamp").alias("timestamp"))
    out = splits.day_split(df, "2017-07-03", "2017-07-04", ["2017-07-05", "2017-07-06", "2017-07-07"])
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 1, "dev": 1, "test": 2}
    with pytest.raises(ValueError):
        splits.day_split(df.limit(1), "2017-07-03", "2017-07-04", ["2017-07-05"])


def test_entity_holdout_is_disjoint_and_sized(spark):
    rows = spark.range(200).select(F.col("id").alias("event_row_id"), F.concat(F.lit("e"), (F.col("id") % 20).cast("string")).alias("entity_id"),
                                   F.timestamp_seconds("id").alias("timestamp"))
    out = splits.entity_holdout(rows, 0.7, 0.15, 1).select("entity_id", "split").distinct().collect()
    sizes = {s: sum(r.split == s for r in out) for s in ("train", "val", "test")}
    assert sizes == {"train": 14, "val": 3, "test": 3} and len({r.entity_id for r in out}) == 20
    kept = splits.entity_then_time(rows, 0.7, 0.15, 1)
    assert {r.split: r["count"] for r in kept.groupBy("split").count().collect()} == {"train": 119, "val": 15, "test": 15}


def test_random_split_ignores_partitioning(spark):
    df = spark.range(100)
    a = splits.seeded_random_split(df, "id", 0.2, 7)
    b = splits.seeded_random_split(df.repartition(7), "id", 0.2, 7)
    assert a.filter("split = 'train'").count() == 80
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_byte_bins_match_searchsorted(spark):
    df = events(spark, 50)
    edges = tokens.byte_edges(df, 4)
    logs = np.log1p(np.arange(50.0))
    assert edges == pytest.approx(np.unique(np.quantile(logs, np.linspace(0, 1, 5))))
    tok = tokens.fit_tokenizer(df, 2, 4)
    got = {r.event_row_id: r.byte_bin for r in tokens.tokenize(df, tok).collect()}
    want = np.clip(np.searchsorted(edges, logs, side="right") - 1, 0, len(edges) - 2)
    assert [got[i] for i in range(50)] == want.tolist()


def test_flat_bytes_get_one_bin(spark):
    assert tokens.byte_edges(events(spark).withColumn("bytes", F.lit(0.0)), 4) == [0.0, 1e-6]


def test_token_ids_follow_the_grid(spark):
    df = events(spark, 40)
    tok = tokens.fit_tokenizer(df, 2, 3)
    assert tok.destinations == ["d0", "d1"] and tok.size == 1 * 3 * 3 + 2
    grid = {r.token_str: r.token_id for r in tokens.vocabulary(tok).collect()}
    assert sorted(grid.values()) == list(range(2, tok.size))
    for r in tokens.tokenize(df, tok).collect():
        assert grid[r.token_str] == r.token_id
    odd = tokens.tokenize(df.withColumn("event_type", F.lit("new")), tok)
    assert {r.token_id for r in odd.collect()} == {1}
    assert tokens.unknown_token_rate(odd).first()[0] == 1.0


def test_destination_of_token(spark):
    df = spark.createDataFrame([("tcp|DST=x|BYTES_Q0",), ("UNK",)], "t string")
    assert [r[0] for r in df.select(tokens.destination_of(F.col("t"))).collect()] == ["x", ""]


def test_default_event_types_make_the_standard_grid(spark):
    tok = tokens.fit_tokenizer(events(spark), 1, 1, tokens.DEFAULT_EVENT_TYPES)
    assert tok.kinds == 7


def test_event_types_are_numbered_in_order(spark):
    df = events(spark, 40).withColumn("event_type", F.concat(F.lit("t"), (F.col("event_row_id") % 7).cast("string")))
    tok = tokens.fit_tokenizer(df, 2, 3)
    assert [(r.event_type, r.ei) for r in tok.event_types.orderBy("ei").collect()] == [(f"t{i}", i) for i in range(7)]
    grid = {r.token_str: r.token_id for r in tokens.vocabulary(tok).collect()}
    assert len(grid) == tok.size - 2
    assert all(grid[r.token_str] == r.token_id for r in tokens.tokenize(df, tok).collect())


def test_null_event_type_is_unknown(spark):
    df = events(spark, 12).withColumn("event_type", F.when(F.col("event_row_id") % 4 != 0, F.col("event_type")))
    tok = tokens.fit_tokenizer(df, 2, 2)
    assert tok.kinds == 1
    assert {r.event_row_id for r in tokens.tokenize(df, tok).filter(F.col("token_id") == tokens.UNK_ID).collect()} == {0, 4, 8}
