"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the data folder and BENCH_CPUS the number of local cores. Every
query runs BENCH_RUNS times after one warm-up, fully evaluated into the no-op sink;
the median counts.

The given tables are one file with one row group each, which one core reads, whatever their size. A large
table never is, so they are written once as FILES files before any timing, and the figures are of that
layout. ``given_layout`` has one run of each query over the files as given.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

import pyarrow.dataset as ds
import pyarrow.parquet as pq

from authorloom.plans.catalogue import QUERIES
from authorloom.session import local_session

HEADLINE = [
    "users_enriched",
    "clean_content",
    "ingest_content",
    "pseudonymise",
    "media_urls_text",
    "flag_pattern",
    "relabel",
    "merge_content",
    "author_length_stats",
    "box_stats_length",
    "box_stats_activity",
    "community_media_rate",
    "word_freq",
    "word_freq_by_label",
    "theme_means",
    "median_scores",
    "yearly_median_content",
    "activity_ratio",
    "lang_detect",
    "author_split",
    "nb_predict",
    "experiment_result",
    "parse_json_answer",
    "publish_manifest",
]


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


FILES = 16


def in_many_files(folder: str, target: str, files: int = FILES) -> None:
    """The same tables, rows and order, each as a folder of files; small ones stay whole."""
    for name in sorted(os.listdir(folder)):
        table = ds.dataset(f"{folder}/{name}").to_table()
        parts = files if table.num_rows >= 1000 else 1
        size = -(-max(table.num_rows, 1) // parts)
        os.mkdir(f"{target}/{name}")
        for i in range(parts):
            part = table.slice(i * size, size)
            if part.num_rows or not i:
                pq.write_table(part, f"{target}/{name}/part-{i:05d}.parquet")


def main() -> None:
    given = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, "bench")
    times, as_given = {}, {}
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        in_many_files(given, folder)
        for name in HEADLINE:
            seconds(spark, name, folder)
            times[name] = round(statistics.median(seconds(spark, name, folder) for _ in range(runs)), 3)
            as_given[name] = round(seconds(spark, name, given), 3)
            print(f"{name} {times[name]} {as_given[name]}", file=sys.stderr)
    scale = os.path.basename(os.path.normpath(given)).removeprefix("sf")
    line = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "layout": f"each table in {FILES} files",
        "given_layout": {"value": round(sum(as_given.values()), 3), "queries": as_given},
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
        "cores": cores,
        "spark": spark.version,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
