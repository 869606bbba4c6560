"""Keyed state of streams: expiry, late rows, replays."""

import os
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lanternflow.catalog import shared
from lanternflow.catalog.views import flows
from lanternflow.plans import detection as D
from lanternflow.streaming import live
from lanternflow.streaming import scoring as SC


def test_runs_of_a_batch():
    rng = random.Random(3)
    for _ in range(200):
        last = rng.choice([None, 0])
        at = np.cumsum([rng.randint(0, 4) for _ in range(rng.randint(1, 12))]) * 1_000_000
        idle = rng.choice([None, 1, 2, 3])
        want, before, own = [], last, -1 if last is not None else None
        for t in at:
            broken = before is None or (idle is not None and t - before > idle * 1_000_000)
            own = 0 if broken else own + 1 if own >= 0 else -1
            want.append(own)
            before = t
        assert SC._sessions(at, last, idle).tolist() == want


def _files(rows, path, parts):
    for part in parts:
        rows.filter(part).coalesce(1).write.mode("append").parquet(path)


def _open(spark, rows, path):
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path).withWatermark("timestamp", "0 seconds")


def test_state_of_silent_entities_is_gone(spark, sf, tmp_path):
    """Entities are cut off at different days; only the state of those within the idle time is left."""
    d = shared.detector(spark, sf)
    rows = flows(spark, sf).filter("split <> 'train'").filter("CAST(entity_id AS INT) % 3 > 0 OR timestamp < '2024-01-23'")
    src, check = str(tmp_path / "in"), str(tmp_path / "c")
    _files(rows, src, ["timestamp < '2024-01-23'", "timestamp >= '2024-01-23' AND timestamp < '2024-01-26'", "timestamp >= '2024-01-26'"])
    idle = 2 * 86400
    SC.run_available(SC.stream_windows(_open(spark, rows, src), d, idle), str(tmp_path / "out"), check)
    left = spark.read.format("statestore").option("path", check).option("stateVarName", "recent").load()
    kept = {r.entity for r in left.select(F.col("key.entity_id").alias("entity")).collect()}
    last = rows.groupBy("entity_id").agg(F.max("timestamp").alias("t"))
    newest = last.agg(F.max("t")).first()[0]
    want = {r.entity_id for r in last.filter(F.col("t") >= F.lit(newest) - F.expr("INTERVAL 2 DAYS")).collect()}
    assert kept == want and len(want) < last.count()


def test_cooldown_state_goes_when_it_is_over(spark, tmp_path):
    rows = spark.createDataFrame([(e, 5000 + 100 * i, i, "d", 9.0) for i, e in enumerate("aabbbcd")], "entity_id string, s long, event_row_id long, dst_id string, score double")
    rows = rows.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    src, check = str(tmp_path / "in"), str(tmp_path / "c")
    _files(rows, src, ["event_row_id < 3", "event_row_id >= 3"])
    d = D.Detector(None, None, None, 0.0, 1.0, {}, {}, 3, threshold=1.0, cooldown_seconds=150)
    SC.run_available(SC.with_stream_cooldown(_open(spark, rows, src), d, expire=True), str(tmp_path / "out"), check)
    got = {r.event_row_id: (r.is_anomaly, r.suppressed) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: (True, False), 1: (False, True), 2: (True, False), 3: (False, True), 4: (True, False), 5: (True, False), 6: (True, False)}
    left = spark.read.format("statestore").option("path", check).option("stateVarName", "last").load()
    assert {r.e for r in left.select(F.col("key.entity_id").alias("e")).collect()} == {"c", "d"}


def test_late_rows_stay_out_of_contexts(spark, sf, tmp_path):
    d = shared.detector(spark, sf)
    rows = flows(spark, sf).filter("split <> 'train'")
    late = "event_row_id % 10 = 0 AND timestamp < '2024-01-25'"
    src = str(tmp_path / "in")
    _files(rows, src, [f"timestamp < '2024-01-25' AND NOT ({late})", f"timestamp >= '2024-01-25' OR ({late})"])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    SC.run_available(SC.stream_windows(stream, d), str(tmp_path / "out"), str(tmp_path / "c"))
    seen = (rows.filter(f"timestamp < '2024-01-25' AND NOT ({late})").groupBy(F.col("entity_id").alias("e")).agg(F.max("timestamp").alias("m")))
    on_time = (rows.join(seen, F.col("entity_id") == F.col("e"), "left")
               .filter(f"NOT ({late}) OR m IS NULL OR timestamp >= m").select(*rows.columns))
    want = D.windows_of(on_time, d.tokenizer, d.seq_len)
    pick = lambda df: sorted((r.event_row_id, r.t1, r.t2, round(r.bytes_mean, 9)) for r in df.select("event_row_id", "t1", "t2", "bytes_mean").collect())
    got = pick(spark.read.parquet(str(tmp_path / "out")))
    assert got == pick(want) and len(got) < D.windows_of(rows, d.tokenizer, d.seq_len).count()


@pytest.mark.parametrize("what", ["snapshots", "hours"])
def test_a_replayed_batch_changes_nothing(spark, tmp_path, what):
    """The last commit is taken back, so the last batch runs twice."""
    rows = spark.createDataFrame([(f"e{i % 7}", 600 * i, i % 5 == 0, float(i)) for i in range(60)],
                                 "entity_id string, s long, is_anomaly boolean, nll double")
    rows = rows.withColumn("timestamp", F.timestamp_seconds("s")).withColumn("k", F.floor(F.col("s") / 12_000)).drop("s")
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "c"))
    _files(rows, src, [f"k = {i}" for i in range(3)])
    write, read = (live.write_snapshots, live.read_snapshots) if what == "snapshots" else (live.write_timeline, live.read_timeline)
    once = lambda: write(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src), out, check)
    once()
    first = sorted(tuple(r) for r in read(spark, out).collect())
    commits = sorted((int(f) for f in os.listdir(f"{check}/commits") if f.isdigit()), reverse=True)
    for name in (str(commits[0]), f".{commits[0]}.crc"):
        os.rename(f"{check}/commits/{name}", str(tmp_path / f"taken{name}"))
    once()
    assert sorted(tuple(r) for r in read(spark, out).collect()) == first
    if what == "snapshots":
        assert [r[1:4] for r in first] == [(20, 4, 7), (40, 8, 7), (60, 12, 7)]
    else:
        assert sum(r[1] for r in first) == 60 and sum(r[2] for r in first) == 12


def test_state_is_read_once_per_entity_and_batch():
    class Value:
        held, calls = None, 0

        def exists(self):
            self.calls += 1
            return self.held is not None

        def get(self):
            self.calls += 1
            return self.held

        def update(self, value):
            self.held, self.calls = value, self.calls + 1

    for processor in (SC.ContextWindows(1, 60), SC.Cooldown(60, True), SC.RecentEvents(3, 60)):
        value = Value()
        processor.init(SimpleNamespace(getValueState=lambda name, shape: value, registerTimer=lambda at: None))
        for at in (1, 100_000_000):
            value.calls = 0
            row = Row(entity_id="a", at=at, event_row_id=at, timestamp=None, token_id=2, dst_id="d", x=1.0, candidate=True, listed=False)
            list(processor.handleInputRows(("a",), iter([row]), None))
            assert value.calls == 2 and value.held is not None
