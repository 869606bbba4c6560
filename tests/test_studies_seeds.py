"""Study artifacts of several seeds: read, checked for agreement, flattened and averaged."""

import json

import numpy as np
import pytest

from lanternflow.plans import studies
from lanternflow.sources import files, sinks

DAYS = {"d1": (0.01, 0.5, 0.4), "d2": (0.03, 0.7, None)}


def drift(seed, shift=0.0, target=0.01, days=("d1", "d2"), labels=True):
    cells = {d: {"observed_test_fpr": DAYS[d][0] + shift, "recall": DAYS[d][1], "macro_attack_family_recall": DAYS[d][2],
                 "calibration_population": {"labels_used_for_threshold": labels}} for d in days}
    entry = {"max_daily_fpr": max(c["observed_test_fpr"] for c in cells.values()), "days": cells}
    return {"bundle_seed": seed, "target_fpr": target, "test_days": list(days), "scores": {"combined": {"frozen": entry}}, "note": [1]}


def stored(spark, folder, *artifacts):
    for i, a in enumerate(artifacts):
        (folder / f"a{i}.json").write_text(json.dumps(a, indent=1))
    return files.read_studies(spark, str(folder))


def test_drift_is_averaged_over_artifacts(spark, tmp_path):
    read = stored(spark, tmp_path, drift(42), drift(43, 0.02), drift(44, 0.04))
    daily, roll = studies.drift_over_seeds(studies.drift_points(read, "combined"))
    got = {r.day: (r.labels_used, r["mean"], r["std"], r.n_runs) for r in daily.collect()}
    assert got["d1"] == (True, pytest.approx(0.03), pytest.approx(np.std([0.01, 0.03, 0.05])), 3)
    got = {r.metric: (r["mean"], r.n_runs) for r in roll.collect()}
    assert got == {"max_daily_fpr": (pytest.approx(0.05), 3), "mean_daily_recall": (pytest.approx(0.6), 3),
                   "mean_daily_macro_recall": (pytest.approx(0.4), 3)}


@pytest.mark.parametrize("other, what", [(drift(43, target=0.05), "target_fpr"), (drift(43, days=("d1",)), "test_days"),
                                         (drift(43, labels=False), "labels")])
def test_drift_artifacts_must_agree(spark, tmp_path, other, what):
    points = studies.drift_points(stored(spark, tmp_path, drift(42), other), "combined")
    with pytest.raises(ValueError, match=what):
        studies.drift_over_seeds(points)


def test_kinds_are_read_as_one_table(spark, tmp_path):
    row = {"variant": "a", "threshold": 4.5, "macro_attack_family_recall": 0.8, "precision": 0.7, "fpr": 0.01, "p95_latency_ms": float("inf")}
    point = {"recall": 0.9, "precision": 0.8, "f1": 0.85, "observed_test_fpr": 0.03}
    read = stored(spark, tmp_path, drift(42), {"candidates": [row, row | {"variant": "b"}], "winner": row},
                  {"bundle_seed": 42, "variants": {"x": {"frozen_operating_point": point, "macro_attack_family_recall": 0.6}}},
                  {"bundle_seed": 43, "variants": {"x": {"frozen_operating_point": point | {"recall": 0.7}, "macro_attack_family_recall": None}}})
    assert studies.drift_points(read, "combined").count() == 2
    got = studies.selection_summary(read).drop("artifact").sort("variant").collect()
    assert [tuple(r) for r in got] == [(None, "a", 4.5, v, 0.8, 0.7, 0.01) for v in "ab"]
    means = studies.variants_over_seeds(studies.ablation_summary(read), ["recall", "macro_recall"])
    assert {r.metric: (pytest.approx(r["mean"]), r.n_runs) for r in means.collect()} == {"recall": (0.8, 2), "macro_recall": (0.6, 1)}


def test_incomplete_artifacts_raise(spark, tmp_path):
    read = stored(spark, tmp_path, {"candidates": [{"variant": "a"}]}, {"variants": {"x": {"macro_attack_family_recall": 0.5}}})
    with pytest.raises(Exception, match="no winner"):
        studies.selection_summary(read).collect()
    with pytest.raises(Exception, match="no frozen_operating_point"):
        studies.ablation_summary(read).collect()


def test_points_survive_the_round_trip(spark, tmp_path):
    rows = [(s, "combined", p, d, s / 1000, 0.5, None, p == "frozen") for s in (42, 43) for p in ("frozen", "moving") for d in ("d1", "d2")]
    points = spark.createDataFrame(rows, "seed long, variant string, policy string, day string, fpr double, recall double, macro_recall double, labels_used boolean")
    sinks.write_studies(studies.drift_artifacts(points, 0.01), str(tmp_path / "out"))
    back = studies.drift_points(files.read_studies(spark, str(tmp_path / "out")), "combined")
    assert sorted(map(tuple, back.select("seed", "policy", "day", "fpr", "recall", "macro_recall", "labels_used").collect()), key=repr) == sorted(
        [(r[0], *r[2:]) for r in rows], key=repr)
