"""Headline queries, timed end to end. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from pairsieve.plans import checks
from pairsieve.plans.checks.tables import NAMES, text_pairs
from pairsieve.session import JOB_SETTINGS

HEADLINE = [
    "noise_breakdown",
    "clean_pairs_counts",
    "first_match_label",
    "text_pairs_label",
    "clean_text_pairs_counts",
    "relevance_score",
    "inclusive_counts",
    "dictionary_semi_join",
    "dictionary_hits",
    "top_patterns_large_dictionary",
    "dedup_keep_first",
    "label_threshold",
    "threshold_sweep",
    "class_sweep",
    "regression_metrics",
    "spearman",
    "spearman_many_values",
    "residual_bins",
    "describe_by_group",
    "stratified_split",
    "prepare_splits",
    "apply_verdicts",
    "unbalanced_text",
    "document_tokens",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
    )
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in NAMES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").count()

    queries = checks.all_queries()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    pairs = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    texts = text_pairs(spark, sf_dir)
    documents = texts.count()
    # The cleaning job labels the rows that are left of repeated tests.
    distinct = texts.select("target").distinct().count()
    chars = texts.selectExpr("avg(length(src_fm) + length(target))").first()[0]
    labels = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    rates = {
        f"{name}_rows_per_sec": round(rows / times[name])
        # clean_pairs_counts labels only the few pairs that are left of the repeated ones,
        # so its input rows a second would say nothing about labelling.
        for name, rows in (
            ("first_match_label", pairs),
            ("text_pairs_label", documents),
            ("clean_text_pairs_counts", distinct),
            ("label_threshold", labels),
        )
        if name in times
    }
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "text_pairs_mean_chars": round(chars),
                "text_pairs_labelled_share": round(distinct / max(documents, 1), 3),
                **rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
