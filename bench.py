"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rasterlake.catalog import all_queries  # noqa: E402
from rasterlake.session import local_session  # noqa: E402

HEADLINE = [
    "a01_psnr_buffers", "r01_unpack_bytes", "a11_gain_base_class", "a02_psnr_multiframe", "a04_ssim_blocks",
    "a09_gamut_fit", "a10_gain_range", "a13_block_mean", "r06_transform_volume", "r06_transform_pixels", "r06_transform_hdr_to_sdr",
    "r07_compute_gain_map", "j18_gain_bilinear", "j22_same_colour_outliers", "j15_tag_coverage_diff",
    "a16_ledger_summary", "w01_assign_output_names", "w06_silence_gaps", "a18_bench_arm_summary", "a21_throughput_best_of",
    "a22_linear_fit", "p01_plan_color", "p13_build_jobs", "x01_job_status_counts",
    "r06_transform_volume_buffers", "r06_by_plan_buffers", "a02_psnr_multiframe_buffers", "a04_ssim_blocks_buffers", "a09_gamut_fit_buffers",
    "a11_gain_base_class_buffers", "r07_compute_gain_map_buffers", "j22_same_colour_outliers_buffers",
]


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    queries = all_queries().QUERIES
    # One untimed run starts the JVM's worker threads and class loading.
    queries["a13_block_mean"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        # The best of three runs: the first one compiles the plan's code.
        seconds[name] = round(min(timed(queries[name], spark, folder) for _ in range(3)), 3)
    samples = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("sum(octet_length(text)) n").first()["n"]
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores,
        "mpix_per_sec": {
            q: round(samples / 1e6 / seconds[q], 2) for q in (
                "a01_psnr_buffers", "r01_unpack_bytes", "a11_gain_base_class", "a11_gain_base_class_buffers", "r06_transform_volume",
                "r06_transform_volume_buffers")},
    }))


if __name__ == "__main__":
    main()
