import numpy as np
import pytest
from pyspark.sql import functions as F

from lanternflow.operators import alerts as A
from lanternflow.operators import timeblocks as TB
from lanternflow.operators import metrics as M
from lanternflow.operators import thresholds as T
from lanternflow.plans import studies
from lanternflow.session import durable


def scored_flows(spark, n, seed):
    """Plain rows (entity, time, destination, score, label, id) and the same as a table; scores tie often."""
    rng = np.random.default_rng(seed)
    rows = [(f"cam{rng.integers(4)}", int(40 * i + rng.integers(30)), str(rng.choice(["ntp", "proxy", "nas"])),
             float(rng.integers(0, 13)) / 2, str(rng.choice(["BENIGN", "Worms"], p=[0.7, 0.3])), i) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id string, t bigint, dst_id string, score double, label string, event_row_id bigint")
    return rows, durable(df.withColumn("timestamp", F.timestamp_seconds("t")))


def open_rows(rows, threshold, listed=(), margin=0.0):
    return [r for r in rows if r[3] >= threshold + (margin if r[2] in listed else 0)]


def walk(rows, gap):
    """Ids of the rows that a greedy walk keeps: the first of an entity, then those ``gap`` seconds after the last kept."""
    kept, last = set(), {}
    for e, t, *_, i in sorted(rows, key=lambda r: (r[1], r[5])):
        if e not in last or t - last[e] >= gap:
            kept.add(i)
            last[e] = t
    return kept


def test_threshold_rules(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=20_000)
    df = durable(spark.createDataFrame([(float(x),) for x in v], "s double"))
    t = T.calibrate(df, ["s"], 0.01).first().threshold
    assert t == np.quantile(v, 0.99, method="higher") and abs((v >= t).mean() - 0.01) < 0.001
    odd = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,), (3.0,), (float("inf"),), (None,)], "s double")
    assert T.calibrate(odd, ["s"], 0.0).first().threshold == 3.0
    assert T.operating_thresholds(odd.limit(0), ["s"], 0.01, {"s": 2.0}) == {"s": 2.0}
    assert T.operating_thresholds(odd, ["s"], 0.01, {}, {"s": 9.0}) == {"s": 9.0}


@pytest.mark.parametrize("top, each, listed", [(None, None, []), (9, None, []), (None, 3, ["ntp"]), (7, 2, ["ntp", "nas"])])
def test_selected_alerts_follow_the_definition(spark, top, each, listed):
    rows, df = scored_flows(spark, 80, 31)
    best = sorted(open_rows(rows, 2.5, listed, 1.25), key=lambda r: (-r[3], r[5]))
    taken = [r for i, r in enumerate(best) if each is None or sum(q[0] == r[0] for q in best[:i]) < each]
    got = A.select_alerts(df, "score", 2.5, top, each, listed, 1.25).collect()
    assert [r.event_row_id for r in got] == [r[5] for r in taken[:top]]


@pytest.mark.parametrize("seed, gap", [(41, 200), (42, 900)])
def test_suppression_masks_and_report(spark, seed, gap):
    rows, df = scored_flows(spark, 120, seed)
    masks = durable(A.suppression_masks(df, "score", 3.0, ["nas"], 1.0, gap))
    raw, kept = {r[5] for r in open_rows(rows, 3.0)}, walk(open_rows(rows, 3.0, ["nas"], 1.0), gap)
    got = masks.collect()
    assert len(got) == len(rows) and kept < raw
    assert {r.event_row_id for r in got if r.raw} == raw and {r.event_row_id for r in got if r.kept} == kept
    worms = {r[5] for r in rows if r[4] == "Worms"}
    rep = A.suppression_report(masks).first()
    loss = (len(raw & worms) - len(kept & worms)) / len(worms)
    assert (rep.raw_alerts, rep.post_suppression_alerts) == (len(raw), len(kept))
    assert rep.alert_reduction == pytest.approx(1 - len(kept) / len(raw)) and rep.recall_loss == pytest.approx(loss)
    assert rep.enabled_by_default is (len(kept - worms) <= 0.8 * len(raw - worms) and loss <= 0.01)


@pytest.mark.parametrize("gap", [1, 5, 17])
def test_cooldown_equals_greedy_walk(spark, gap):
    rng = np.random.default_rng(gap)
    rows = [(f"e{int(rng.integers(0, 4))}", int(t), i) for i, t in enumerate(np.cumsum(rng.choice([0, 1, 2, 3, 40], 500)))]
    df = spark.createDataFrame(rows, "entity_id string, t bigint, event_row_id bigint").withColumn("timestamp", F.timestamp_seconds("t"))
    want, last = set(), {}
    for e, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if e not in last or t - last[e] >= gap:
            want.add(i)
            last[e] = t
    assert {r.event_row_id for r in A.cooldown(df.repartition(6), gap).collect()} == want


def greedy(times, gap):
    """Positions kept of ascending times."""
    out, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last >= gap:
            out.append(i)
            last = t
    return out


@pytest.mark.parametrize("gap,steps", [(300, [1]), (40, [1, 1, 1, 2, 39]), (7, [1, 2, 3, 11]), (5000, [1, 3])])
def test_block_functions_compose_to_the_walk(gap, steps):
    rng = np.random.default_rng(gap)
    at = np.cumsum(rng.choice(steps, 3000))
    blocks = np.split(at, np.sort(rng.choice(np.arange(1, 3000), 60, replace=False)))
    entry = TB.START
    for b in blocks:
        entry = int(TB.apply_function(*TB.block_function(b, gap), np.array([entry]), gap)[0])
    assert entry == at[greedy(at, gap)[-1]]


@pytest.mark.parametrize("gap,steps", [(300, [1]), (40, [1, 1, 1, 2, 39]), (5000, [1, 3])])
def test_one_flood_over_many_tasks(spark, gap, steps, monkeypatch):
    """Uninterrupted sequences of 3,000 instants in blocks of at most about 20, composed in several rounds."""
    monkeypatch.setattr(TB, "FAN", 4)
    rng = np.random.default_rng(len(steps))
    rows = [(e, int(t), 10_000 * k + i) for k, e in enumerate(["a", "b"])
            for i, t in enumerate(np.cumsum(rng.choice(steps, 3000 if e == "a" else 50)))]
    df = spark.createDataFrame(rows, "entity_id string, t bigint, event_row_id bigint").withColumn("timestamp", F.timestamp_seconds("t"))
    want = {10_000 * k + i for k, e in enumerate(["a", "b"]) for i in greedy([r[1] for r in rows if r[0] == e], gap)}
    assert {r.event_row_id for r in A.cooldown(df, gap, limit=20).collect()} == want
    assert {r.event_row_id for r in A.cooldown(df, gap).collect()} == want


def labelled(spark, rows):
    return durable(spark.createDataFrame(rows, "label string, score double"))


@pytest.mark.parametrize("cut", [-1.0, 2.5, 3.0, 99.0])
def test_operating_point_counts(spark, cut):
    rows, df = scored_flows(spark, 90, 51)
    tp, fp, fn, tn = (sum((r[4] != "BENIGN") == bad and (r[3] >= cut) == alert for r in rows)
                      for alert, bad in ((True, True), (True, False), (False, True), (False, False)))
    p = M.operating_point(df, "score", cut).first()
    assert (p.tp, p.fp, p.fn, p.tn) == (tp, fp, fn, tn)
    assert p.precision == (tp / (tp + fp) if tp + fp else 0.0) and p.fpr == fp / (fp + tn)
    assert p.benign_alerts_per_10000 == pytest.approx(1e4 * fp / (fp + tn))
    assert p.f1 == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0.0)


def brute(y, s):
    pos, neg = s[y], s[~y]
    auc = np.mean((pos[:, None] > neg).astype(float) + 0.5 * (pos[:, None] == neg))
    ap, tpr = 0.0, 0.0
    for t in np.unique(pos):
        tp, fp = (pos >= t).sum(), (neg >= t).sum()
        ap += (pos == t).sum() / len(pos) * tp / (tp + fp)
        tpr = max(tpr, tp / len(pos)) if fp / len(neg) <= 0.01 else tpr
    return auc, ap, tpr


def test_ranking_metrics_with_ties_and_families(spark):
    rng = np.random.default_rng(9)
    label = rng.choice(["BENIGN", "normal", "A", "B"], 1500, p=[0.6, 0.2, 0.15, 0.05])
    score = np.round(rng.normal(size=1500) + (label == "A") * 1.5 + (label == "B"), 1)
    df = labelled(spark, [(str(a), float(b)) for a, b in zip(label, score)])
    benign = np.isin(label, ["BENIGN", "normal"])
    d = M.diagnostics(df, "score").first()
    assert (d.roc_auc, d.pr_auc, d.tpr_at_fpr) == pytest.approx(brute(~benign, score))
    fams = {r.family: r for r in M.family_metrics(df, "score", 1.0).collect()}
    for f in "AB":
        keep = benign | (label == f)
        auc, ap, _ = brute(label[keep] == f, score[keep])
        assert (fams[f].roc_auc, fams[f].pr_auc) == pytest.approx((auc, ap))
        assert fams[f].recall == pytest.approx((score[label == f] >= 1.0).mean())
        assert fams[f].sample_count == (label == f).sum() and fams[f].n_benign == benign.sum()


@pytest.mark.parametrize("keep", ["BENIGN", "Worms"])
def test_one_class_alone_has_no_ranking(spark, keep):
    rows, df = scored_flows(spark, 70, 61)
    own = [r for r in rows if r[4] == keep]
    alerts = sum(r[3] >= 2.0 for r in own)
    s = M.detection_summary(df.filter(F.col("label") == keep), "score", 2.0).first()
    assert (s.roc_auc, s.pr_auc, s.tpr_at_fpr) == (None, None, None) and s.note
    assert (s.n_total, s.n_positive, s.fp + s.tp) == (len(own), len(own) if keep == "Worms" else 0, alerts)


def test_separated_classes_rank_perfectly(spark):
    rows, df = scored_flows(spark, 70, 62)
    apart = df.withColumn("score", F.col("score") + F.when(F.col("label") == "Worms", 50.0).otherwise(0.0))
    f = M.family_metrics(apart, "score", 51.0).first()
    worms = [r[3] for r in rows if r[4] == "Worms"]
    assert (f.family, f.sample_count, f.roc_auc) == ("Worms", len(worms), 1.0)
    assert f.false_negative_count == sum(v < 1.0 for v in worms) and f.recall == pytest.approx(np.mean(np.array(worms) >= 1.0))


def plain_quantile(values, fpr):
    return float(np.quantile(values, 1 - fpr, method="higher"))


def test_winning_candidate_follows_the_definition(spark):
    rng = np.random.default_rng(71)
    label = np.array(["BENIGN"] * 140 + ["Worms"] * 25 + ["Generic"] * 9)
    cols = {"wide": rng.normal(size=174) + (label == "Worms") * 4, "fair": rng.normal(size=174) + (label != "BENIGN") * 3,
            "dull": rng.normal(size=174), "flat": np.ones(174)}
    df = durable(spark.createDataFrame([(str(a), *map(float, v)) for a, *v in zip(label, *cols.values())],
                                       "label string, " + ", ".join(f"{c} double" for c in cols)))
    benign, want = label == "BENIGN", {}
    for c, v in cols.items():
        t = plain_quantile(v[benign], 0.05)
        want[c] = (t, (v[benign] >= t).mean(), np.mean([(v[label == f] >= t).mean() for f in ("Worms", "Generic")]))
    got = {r.variant: r for r in studies.screen_candidates(df, list(cols), 0.05).collect()}
    for c, (t, fpr, macro) in want.items():
        assert (got[c].threshold, got[c].fpr, got[c].macro_recall) == pytest.approx((t, fpr, macro))
        assert got[c].eligible is bool(fpr <= 0.05 + 1 / 140 + 1e-12)
    best = max((c for c in cols if got[c].eligible), key=lambda c: want[c][2])
    assert studies.select_candidate(df, list(cols), 0.05).first().variant == best
    twins = df.select("label", "fair", F.col("fair").alias("also"))
    for fast in ("fair", "also"):
        assert studies.select_candidate(twins, ["fair", "also"], 0.05, {"fair": 8.0, "also": 8.0, fast: 3.0}).first().variant == fast
    with pytest.raises(RuntimeError, match="every candidate"):
        studies.select_candidate(df, ["flat"], 0.05)


def test_gate_on_a_grid(spark):
    schema = "macro_recall double, fpr double, p95_latency_ms double"
    base = (0.25, 0.125, 40.0)
    for gain in (0.0, 0.015, 0.03):
        for more in (-0.05, 0.005, 0.02):
            for slower in (None, 0.5, 1.05, 1.5):
                new = (base[0] + gain, base[1] + more, slower and base[2] * slower)
                got = M.improvement_gate(spark.createDataFrame([base], schema), spark.createDataFrame([new], schema)).first().improves
                assert got is (gain > 0.02 and more < 0.01 and slower is not None and slower < 1.1), new


def weeks(spark, seed=81):
    """Hourly rows of four days; scores rise from day to day, a fifth of the later rows is an attack."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(4):
        for i in range(120):
            bad = bool(d and rng.random() < 0.2)
            rows.append((f"2021-03-{11 + d}", i % 24, f"cam{rng.integers(6 + d)}", str(rng.choice(["ntp", "nas"])),
                         float(np.round(rng.gamma(2.0, 1.0 + d / 2) + 3 * bad, 1)), "Worms" if bad else "BENIGN", str(rng.choice(["rate", "size"]))))
    df = spark.createDataFrame(rows, "d string, h int, entity_id string, dst_id string, score double, label string, top_contributing_feature string")
    return rows, durable(df.withColumn("timestamp", F.expr("cast(d as timestamp) + make_interval(0, 0, 0, 0, h)")).drop("d", "h"))


def test_daily_thresholds_of_all_policies(spark):
    rows, df = weeks(spark)
    days = sorted({r[0] for r in rows})
    got = {(r.policy, r.day): r for r in studies.drift_study(df, ["score"], days[0], 0.1).collect()}
    assert set(got) == {(p, d) for p in T.POLICIES for d in days[1:]}
    of = lambda day, benign: [r[4] for r in rows if r[0] == day and (r[5] == "BENIGN" or not benign)]
    for before, day in zip(days, days[1:]):
        for policy, source in (("frozen", of(days[0], True)), ("prev_day_benign", of(before, True)), ("prev_day_unlabeled", of(before, False))):
            r, t = got[policy, day], plain_quantile(source, 0.1)
            assert r.threshold == t and r.labels_used is (policy != "prev_day_unlabeled")
            assert r.fpr == pytest.approx(np.mean([v >= t for v in of(day, True)]))
    with pytest.raises(ValueError, match="first day"):
        studies.drift_study(df, ["score"], days[1], 0.1)


def test_false_positive_tables_by_counting(spark):
    rows, df = weeks(spark, 82)
    known = {f"cam{i}" for i in range(6)}
    dev = min(r[0] for r in rows)
    t = plain_quantile([r[4] for r in rows if r[0] == dev], 0.1)
    m = durable(studies.mark_false_positives(df, spark.createDataFrame([(k,) for k in known], "entity_id string"), dev, 0.1))
    benign = [r for r in rows if r[0] > dev and r[5] == "BENIGN"]
    tables = {name: f(m).collect() for name, f in (("all", studies.fp_concentration), ("top", studies.fp_top_entities), ("cold", studies.fp_cold_start),
                                                   ("peer", studies.fp_top_peers), ("feature", studies.fp_by_feature), ("hour", studies.fp_by_hour))}
    for day in sorted({r[0] for r in benign}):
        at = {name: [r for r in found if r.day == day] for name, found in tables.items()}
        own = [r for r in benign if r[0] == day]
        bad = [r for r in own if r[4] >= t]
        assert (at["all"][0].benign_rows, at["all"][0].false_positives) == (len(own), len(bad))
        per = {e: sum(r[2] == e for r in bad) for e in {r[2] for r in own}}
        ranked = sorted(per, key=lambda e: (-per[e], e))
        assert [r.entity_id for r in sorted(at["top"], key=lambda r: r.rank)] == ranked[:10]
        assert all(r.has_baseline is (r.entity_id in known) for r in at["top"])
        assert at["all"][0].fp_share_top_1 == pytest.approx(per[ranked[0]] / len(bad))
        rest = [r for r in own if r[2] not in ranked[:5]]
        assert at["all"][0].fpr_without_top_5 == pytest.approx(np.mean([r[4] >= t for r in rest]) if rest else 0.0)
        assert at["cold"][0].fp_share == pytest.approx(sum(r[2] not in known for r in bad) / len(bad))
        assert {r.peer: r.false_positives for r in at["peer"]} == {p: n for p in ("ntp", "nas") if (n := sum(r[3] == p for r in bad))}
        assert {r.top_contributing_feature: r.fp for r in at["feature"]} == {k: n for k in ("rate", "size") if (n := sum(r[6] == k for r in bad))}
        assert {r.hour: (r.benign_rows, r.fp) for r in at["hour"]} == {
            h: (sum(r[1] == h for r in own), sum(r[1] == h for r in bad)) for h in {r[1] for r in own}}


def test_packets_skip_unknown_rows(spark):
    ev = spark.createDataFrame([("a", i, i) for i in range(5)] + [("b", 0, 9)], "entity_id string, s int, event_row_id bigint").withColumn("timestamp", F.timestamp_seconds("s"))
    al = spark.createDataFrame([(0, 3), (1, 9), (2, 77)], "alert_index int, event_row_id bigint")
    got = A.alert_packets(al, ev, 2).orderBy("alert_index", "pos").collect()
    assert [(r.alert_index, r.event_row_id, r.is_target) for r in got] == [(0, 1, False), (0, 2, False), (0, 3, True), (1, 9, True)]


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 0.5, 1, 2, 2]], "s double")
    got = {r.bin: r.n for r in A.score_histogram(df, "s", 4).collect()}
    want, _ = np.histogram([0, 0.5, 1, 2, 2], bins=4)
    assert [got.get(i, 0) for i in range(4)] == want.tolist()


def test_seed_aggregate_checks_seeds(spark):
    schema = "dataset string, seed bigint, recall double, precision double, f1 double, fpr double, benign_alerts_per_10000 double"
    runs = spark.createDataFrame([("d", s, r, 0.5, 0.5, 0.1, 1.0) for s, r in ((42, 0.8), (43, 0.9), (44, 1.0))], schema)
    got = {r.metric: (r["mean"], r["std"]) for r in studies.seed_aggregate(runs).collect()}
    assert got["recall"] == pytest.approx((0.9, np.std([0.8, 0.9, 1.0])))
    with pytest.raises(ValueError, match="seeds"):
        studies.seed_aggregate(runs.filter("seed < 44"))
