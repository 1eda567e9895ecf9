"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import workload  # noqa: E402

HEADLINE = [
    "event_study", "forward_outcomes", "rsi_outcomes", "catalogue_scan", "smoothed_indicators", "rolling_indicators", "entry_exit_pairs",
    "wide_screen_groups", "screen_verdict", "grammar_signal_counts", "cooldown", "event_overlap", "hac_tests", "rule_ranking", "context_profiles",
    "normalize_bars", "row_issues", "member_year_coverage", "fill_gaps", "daily_ic", "latest_visible_revision", "effective_session",
    "search_cards", "html_text_builtin", "document_first_copies", "span_revisions", "incremental_outcomes",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "20g")
        .config("spark.ui.enabled", "false")
        # no call-site capture per Column: plans here have thousands of them
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # the derived bars are a few megabytes but cost windows, not I/O: keep
        # all cores busy instead of merging them into one partition
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = workload.load()
    names = sys.argv[1:] or HEADLINE
    queries["build_bars"](spark, sf).write.format("noop").mode("overwrite").save()  # JVM warm-up
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    label = os.path.basename(sf.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(label) if label.replace(".", "").isdigit() else label}))
    spark.stop()


if __name__ == "__main__":
    main()
