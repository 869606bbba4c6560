from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternflow.catalog import shared
from lanternflow.catalog.views import flows
from lanternflow.operators import iforest, tabular
from lanternflow.plans import detection as D
from lanternflow.session import durable
from lanternflow.sources import bundle, digests, files, sinks
from lanternflow.streaming import ingest, live
from lanternflow.streaming import scoring as SC


@pytest.fixture(scope="module")
def detector(spark, sf):
    return replace(shared.calibrated(spark, sf, allowlist=["1", "2"], allowlist_margin=0.5, cooldown_seconds=86400),
                   threshold=shared.stream_threshold(spark, sf) / 2)


def later(spark, sf):
    return flows(spark, sf).filter("split <> 'train'")


def test_batches_of_a_stream_score_like_one_table(spark, sf, detector, tmp_path):
    """Many small files, each its own micro-batch, against the batch plan; then the cooldown."""
    days = later(spark, sf).withColumn("d", F.date_format("timestamp", "yyyyMMdd"))
    order = [r.d for r in days.select("d").distinct().orderBy("d").collect()]
    src = str(tmp_path / "events")
    for i, d in enumerate(order):
        days.filter(F.col("d") == d).drop("d").coalesce(1).write.mode("append").parquet(src)
    schema = days.drop("d").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(src)
    SC.run_available(SC.score_stream(stream, detector, shared.ABLATIONS), str(tmp_path / "scored"), str(tmp_path / "c1"))
    got = spark.read.parquet(str(tmp_path / "scored"))
    want = durable(D.score_events(later(spark, sf), detector, shared.ABLATIONS))
    cols = ["nll", "nll_z", "score", "score_without_nll"]
    a = {r.event_row_id: [r[c] for c in cols] + [r.top_contributing_feature] for r in got.collect()}
    b = {r.event_row_id: [r[c] for c in cols] + [r.top_contributing_feature] for r in want.collect()}
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][:-1] == pytest.approx(b[k][:-1], abs=1e-9) and a[k][-1] == b[k][-1]

    scored = want.select("entity_id", "timestamp", "event_row_id", "dst_id", "score")
    scored.repartitionByRange(4, "timestamp").sortWithinPartitions("timestamp").write.parquet(str(tmp_path / "table"))
    flags = spark.readStream.schema(scored.schema).parquet(str(tmp_path / "table"))
    SC.run_available(SC.with_stream_cooldown(flags, detector), str(tmp_path / "alerts"), str(tmp_path / "c2"))
    pick = lambda df: sorted((r.event_row_id, r.is_anomaly, r.suppressed) for r in df.select("event_row_id", "is_anomaly", "suppressed").collect())
    assert pick(spark.read.parquet(str(tmp_path / "alerts"))) == pick(D.apply_policy(want, detector))


def test_state_survives_a_restart(spark, sf, tmp_path):
    """The second run starts from the checkpoint and still knows the first run's context."""
    rows = later(spark, sf)
    src, d = str(tmp_path / "in"), shared.detector(spark, sf)
    for part in ("dev", "test"):
        rows.filter(F.col("split") == part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        SC.run_available(SC.stream_windows(stream, d), str(tmp_path / "out"), str(tmp_path / "c"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == D.windows_of(rows, d.tokenizer, d.seq_len).count()


def test_ingest_keeps_bad_lines(spark, tmp_path):
    lines = ['{"entity_id": "e", "timestamp": "2020-01-01T00:00:00Z", "bytes": "7"}', '{"timestamp": "2020-01-01"}', "{oops",
             '{"entity_id": "e", "timestamp": "later"}']
    p = ingest.parse_events(spark.createDataFrame([(x,) for x in lines], "value string"))
    ok = ingest.accepted(p).collect()
    assert len(ok) == 1 and (ok[0].event_type, ok[0].bytes) == ("UNK", 7.0)
    assert {r.reject_reason for r in ingest.rejected(p).collect()} == {"entity_id is required", "not a JSON event", "timestamp is not readable"}


def test_policy_threshold_and_windows_modes(spark, sf, detector):
    crossing = D.windows_of(later(spark, sf), detector.tokenizer, 3).count()
    restarting = D.windows_of(later(spark, sf), detector.tokenizer, 3, keys=("split", "entity_id")).count()
    assert crossing > restarting


def test_hot_entities_do_not_change_scores(spark, sf, detector):
    plain = D.score_events(later(spark, sf), detector)
    spark.conf.set("spark.lanternflow.maxGroupRows", "20")
    try:
        split = durable(D.score_events(later(spark, sf), detector))
    finally:
        spark.conf.unset("spark.lanternflow.maxGroupRows")
    pick = lambda df: sorted((r.event_row_id, round(r.score, 9)) for r in df.select("event_row_id", "score").collect())
    assert pick(plain) == pick(split)


def test_test_labels_never_move_the_alerts(spark, sf):
    base = flows(spark, sf)
    blind = base.withColumn("label", F.when(F.col("split") == "test", "BENIGN").otherwise(F.col("label")))
    ids = lambda df: [r.event_row_id for r in D.top_alerts(df).collect()]
    assert ids(base) == ids(blind)


def test_bundle_detects_changes(spark, detector, tmp_path):
    path = bundle.save_detector(detector, str(tmp_path / "b"))
    loaded = bundle.load_detector(spark, path)
    assert loaded.threshold == detector.threshold and loaded.tokenizer.size == detector.tokenizer.size
    text = spark.read.text(f"{path}/config").first()[0]
    spark.createDataFrame([(text.replace('"seq_len": 3', '"seq_len": 4'),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    with pytest.raises(bundle.BundleError, match="payload"):
        bundle.load_detector(spark, path)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    extra = durable(spark.read.parquet(f"{path}/triples").withColumn("c", F.col("c") + 1))
    extra.write.mode("overwrite").parquet(f"{path}/triples")
    with pytest.raises(bundle.BundleError, match="triples"):
        bundle.load_detector(spark, path)


def test_table_digest_ignores_order_only(spark):
    df = spark.range(50).withColumn("v", F.col("id") * 2)
    assert digests.table_digest(df) == digests.table_digest(df.repartition(5).orderBy(F.desc("id")))
    assert digests.table_digest(df) != digests.table_digest(df.withColumn("v", F.col("v") + (F.col("id") == 3).cast("int")))
    assert digests.table_digest(df) != digests.table_digest(df.union(df.limit(1)))


def test_parts_names_and_byte_order_marks(spark, tmp_path):
    names = str(tmp_path / "names.csv")
    (tmp_path / "names.csv").write_text("No.,Name\n1,srcip\n2,proto\n", encoding="latin-1")
    (tmp_path / "p1.csv").write_bytes(b"\xef\xbb\xbf1.1.1.1,tcp\n")
    (tmp_path / "p2.csv").write_bytes(b"2.2.2.2,udp\n")
    assert files.feature_names(spark, names, 2) == ["srcip", "proto"]
    with pytest.raises(ValueError, match="expected 49"):
        files.feature_names(spark, names)
    got = files.assemble_parts(spark, [str(tmp_path / "p1.csv"), str(tmp_path / "p2.csv")], ["srcip", "proto"])
    assert sorted(map(tuple, got.collect())) == [("1.1.1.1", "tcp"), ("2.2.2.2", "udp")]


def test_clean_events_round_trip(spark, sf, tmp_path):
    ev = flows(spark, sf)
    sinks.write_clean_events(ev, str(tmp_path / "clean"))
    back = files.load_events(spark, str(tmp_path / "clean"))
    assert back.count() == ev.count()
    ids = [r.event_row_id for r in back.orderBy("entity_id", "timestamp", "event_row_id").collect()]
    assert ids == list(range(len(ids)))


def test_run_without_a_point_is_rejected(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"seed": 42}')
    with pytest.raises(Exception, match="frozen_operating_point"):
        files.read_runs(spark, str(tmp_path / "r.json"), "d").collect()


def test_forest_ranks_outliers_first_and_is_repeatable(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(600, 2)), [[9.0, 9.0], [-8.0, 7.0]]])
    df = durable(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id bigint, a double, b double"))
    runs = []
    for rows in (df, df.repartition(7)):
        forest = durable(iforest.fit_forest(rows, "id", ["a", "b"], 42, trees=60))
        roots = forest.filter("node = 1").collect()
        assert len(roots) == 60 and all(200 < r.n <= 256 for r in roots)
        inner = {(r.tree_id, r.node): r for r in forest.collect()}
        for (t, v), r in inner.items():
            if r.feature >= 0:
                assert inner[t, 2 * v].n + inner[t, 2 * v + 1].n == r.n
        runs.append({r.id: r.isolation_forest for r in iforest.with_isolation_score(df, forest, ["a", "b"]).collect()})
    assert runs[0] == pytest.approx(runs[1])
    assert sorted(runs[0], key=runs[0].get)[-2:] in ([600, 601], [601, 600])
    assert all(0 < v < 1 for v in runs[0].values())


def test_temperature_recovers_overconfidence(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=4000) * 2
    y = rng.random(4000) < 1 / (1 + np.exp(-z))
    df = durable(spark.createDataFrame([(float(3 * a), int(b)) for a, b in zip(z, y)], "logit double, label int"))
    t = tabular.fit_temperature(df, "logit", "label")
    assert t == pytest.approx(3.0, rel=0.1)
    slope = lambda b: float(((1 / (1 + np.exp(-3 * z * b)) - y) * 3 * z).sum())
    assert slope(1 / t * (1 + 1e-9)) > 0 > slope(1 / t * (1 - 1e-9))
    sure = spark.createDataFrame([(1.0, 1), (-1.0, 0), (None, 1), (2.0, None)], "logit double, label int")
    assert tabular.fit_temperature(sure, "logit", "label") <= 1 / 36
    wrong = spark.createDataFrame([(1.0, 0), (-1.0, 1)], "logit double, label int")
    assert tabular.fit_temperature(wrong, "logit", "label") == pytest.approx(1e6)


def test_snapshots_trend_from_zero(spark):
    rows = [(0, "a", 10, 0), (1, "a", 5, 1), (1, "b", 5, 0)]
    snaps = live.stats_snapshots(spark.createDataFrame(rows, "batch_id int, entity_id string, events bigint, anomalies bigint")).orderBy("batch_id").collect()
    assert [(r.total_events, r.active_entities, r.anomalies) for r in snaps] == [(10, 1, 0), (20, 2, 1)]
    assert (snaps[0].total_events_trend, snaps[0].anomalies_trend, snaps[1].total_events_trend, snaps[1].anomalies_trend) == (100.0, 0.0, 100.0, 100.0)


def test_fitting_needs_data(spark, sf):
    base = flows(spark, sf)
    with pytest.raises(ValueError, match="no training events"):
        D.fit_detector(base.limit(0), 3, 5, 4)
    with pytest.raises(ValueError, match="no training windows"):
        D.fit_detector(base.filter("event_row_id < 3"), 16, 5, 4)
    with pytest.raises(ValueError, match="two context"):
        D.fit_detector(base, 1, 5, 4)
