"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sensorgate.plans import catalog
from sensorgate.session import build_session

HEADLINE = [
    "flagship_gate",
    "s07_json_metadata",
    "p04_timestamp_fallback_chain",
    "p09_dates_from_text",
    "p20_spectrum_descriptors",
    "j05_daily_to_hourly",
    "j06_asof_alignment",
    "j10_band_farthest_match",
    "d01_keep_first_dedup",
    "a01_hourly_video",
    "a03_audio_bin_stats",
    "a04_partial_final_volume",
    "a05_quarter_hour_tier",
    "a17_correlation_matrix",
    "a19_quantile_report",
    "w02_gap_list",
    "w06_session_checks",
    "w11_slow_fast_variant_a",
    "w12_rolling_median_raw_frames",
    "w22_causal_hour_ewma",
    "n01_robust_scale",
    "n08_shrunk_mahalanobis",
    "n09_core_mahalanobis_2d",
    "g05_or_fusion",
    "g17_matched_false_alarm",
    "b06_event_outcomes",
    "b11_roc_auc_average_rank",
    "b14_benchmark_fixed_thresholds",
    "b15_permutation_test",
    "b17_habituation_metrics",
    "t02_stream_gate",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalog.queries(), {}
    queries["a12_value_counts"](spark, folder).collect()  # start the executor before the clock
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
