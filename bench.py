"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from deskspark.workload.queries import REGISTRY

HEADLINE = [
    "triage_decisions",
    "escalation_policy",
    "rules_regex",
    "rules_substring",
    "clean_text",
    "length_profile",
    "top_bigrams",
    "build_threads",
    "thread_length",
    "reply_guard",
    "signal_rates",
    "compare_systems",
    "calibrate",
    "spearman",
    "cohens_kappa",
    "knn_topk",
    "knn_by_label",
    "stratified_backfill",
    "systematic_sample",
    "parse_responses",
    "tfidf_terms",
    "knn_cells_recall",
    "silhouette_squared",
    "evaluate_systems",
    "triage_full",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("deskspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.mode("overwrite").format("noop").save()
        return round(time.perf_counter() - start, 3)

    # JVM and Python workers start outside the measured runs.
    run("rules_regex")
    run("knn_topk")
    times = {name: run(name) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
