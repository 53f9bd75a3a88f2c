"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from matchloom.plans import registry

HEADLINES = (
    "score_weighted_match",
    "live_composite",
    "suggestions_live",
    "jd_keywords_enhanced",
    "term_frequencies",
    "bigram_counts",
    "resume_features",
    "similar_keywords",
    "resumes_with_latest_score",
    "score_history_improvement",
    "user_dashboard",
    "stream_over_limit_users",
    "bullet_grammar",
    "normalise_strip_markup",
)


def main() -> int:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in HEADLINES:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
