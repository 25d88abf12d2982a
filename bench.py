"""Headline queries at one scale: median of three runs after a warm-up, as one
JSON line. The search index is built before, for all of them; building it again is timed
as its own entry."""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from pyspark.sql import SparkSession

from checks import registry

HEADLINE = ["changed_pages", "main_content", "chunk_text", "embed_hash", "build_postings", "bm25_topk",
            "knn_exact", "knn_approx", "hybrid_rrf", "facet_counts", "search_response"]
RUNS = 3


def session(cpus: str) -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
            .config("spark.sql.shuffle.partitions", cpus)
            .config("spark.driver.memory", "16g")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    registry.index_of(spark, sf_dir)
    seconds = {"index_build": timed(lambda: registry.new_index(spark, sf_dir))}
    for name in sys.argv[1:] or HEADLINE:
        def run(fn=registry.QUERIES[name]) -> None:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs = [timed(run) for _ in range(RUNS + 1)]
        seconds[name] = round(statistics.median(runs[1:]), 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": float(scale.group(1)) if scale else sf_dir}))


if __name__ == "__main__":
    main()
