"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion into a no-op sink. ``fit_detector`` is timed on its own;
the scoring and study queries then use its tables, as a deployment would.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lanternflow import catalog  # noqa: E402
from lanternflow.catalog import shared  # noqa: E402
from lanternflow.catalog.views import flows  # noqa: E402
from lanternflow.plans.detection import top_alerts  # noqa: E402
from lanternflow.session import local_session  # noqa: E402

HEADLINE = ["A2_load_events", "B2_adapt_cicids", "B14_chronological_split", "C7_token_ids", "D2_window_features",
            "D3_multiscale_features", "D3_multiscale_long_entities", "E1_baselines", "E8_next_event_nll", "E9_top_predictions",
            "E10_next_event_evaluation", "E14_score_stream", "E14_score_stream_with_cooldown", "F1_threshold_per_supplier",
            "F3c_cooldown_long_entities", "F6_day_thresholds", "G2_roc_auc", "G5_family_metrics", "G11_ablation_study",
            "G12_drift_study", "G13b_fp_concentration", "H1_stream_scores", "H7_predict_next", "I1_symbol_entropy"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    only = sys.argv[1:]
    # One throwaway query starts the JVM's code paths.
    drain(flows(spark, sf).groupBy("entity_id").count())
    times: dict[str, float] = {}

    def timed(name, run) -> None:
        if only and name not in only:
            return
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:34s} {times[name]:8.3f}s", file=sys.stderr, flush=True)

    timed("top_alerts", lambda: drain(top_alerts(flows(spark, sf))))
    timed("fit_detector", lambda: shared.detector(spark, sf))
    shared.train_scores(spark, sf)
    shared.stream_threshold(spark, sf)
    for name in HEADLINE:
        timed(name, lambda: drain(catalog.QUERIES[name](spark, sf)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
