"""Headline timings: prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "s2_decode_captures", "p1_featurise_flows", "p5_median_imputer", "p8_standard_scale", "p26_synth_timestamps", "j1_enrich_threats", "j4_augment_with_score",
    "a1_window_features", "a2_assemble_flows", "a3_assemble_flows_3tuple", "a4_resample", "a8_timeline_bins", "a11_classification_report",
    "a13_roc_auc", "a15_average_precision", "a17_best_f1_threshold", "a18_threshold_sweep", "a20_cohens_d", "a22_winsorised_histogram", "a23_kde", "a24_box_stats",
    "w1_episodes", "w2_bucket_best", "w3_severity_rank", "w4_rank_attribution", "l1_top_talkers", "l4_history_page", "u2_sample_n", "u4_stratified_split", "u5_stratified_folds",
    "m1_isolation_forest", "m2_forest_score", "m8_hybrid", "m9_local_attribution", "t1_context_window", "t3_stream_flows", "t5_snapshot", "q1_triage",
    "q1_analyze_traffic", "q2_offline_detect",
]


def main() -> None:
    from checks.registry import queries
    from flowarden.session import local_session, owned_intermediates

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's code paths
    chosen = sys.argv[1:] or HEADLINE
    times = {}
    for name in chosen:
        start = time.perf_counter()
        with owned_intermediates(spark):
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
