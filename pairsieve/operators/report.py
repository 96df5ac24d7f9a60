"""Counts over a labelled table (columns ``noise_type`` and, for the judge, two flags)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.functions.text import ratio
from pairsieve.operators.rules import stage_of


def breakdown(labelled: DataFrame) -> DataFrame:
    """(noise_type, n), most frequent first."""
    return (
        labelled.filter(F.col("noise_type").isNotNull())
        .groupBy("noise_type")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "noise_type")
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    """(noise_type, n) with kept rows under null; the few rows all totals derive from."""
    return labelled.groupBy("noise_type").agg(F.count("*").alias("n"))


def shares(labelled: DataFrame) -> DataFrame:
    """(noise_type, n, share of all rows) per removed type."""
    counts = label_counts(labelled)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.filter(F.col("noise_type").isNotNull()).select(
        "noise_type", "n", ratio(F.col("n"), total.scalar()).alias("share")
    )


def report_row(labelled: DataFrame) -> DataFrame:
    """One row: totals, breakdown map, judge counters, removal rate.

    ``judged`` and ``overridden`` (questions asked and labels overruled per row) are
    summed if the table has them.
    """
    def flagged(name):
        return F.sum(name) if name in labelled.columns else F.sum(F.lit(0))

    per_label = labelled.groupBy("noise_type").agg(
        F.count("*").alias("n"),
        flagged("judged").alias("judged"),
        flagged("overridden").alias("overridden"),
    )
    removed = F.col("noise_type").isNotNull()
    entry = F.when(removed, F.struct("noise_type", "n"))
    row = per_label.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_samples"),
        F.coalesce(F.sum(F.when(removed, F.col("n"))), F.lit(0)).alias("removed_samples"),
        F.coalesce(F.sum(F.when(~removed, F.col("n"))), F.lit(0)).alias("kept_samples"),
        F.map_from_entries(F.collect_list(entry)).alias("breakdown"),
        F.coalesce(F.sum("judged"), F.lit(0)).alias("llm_calls"),
        F.coalesce(F.sum("overridden"), F.lit(0)).alias("llm_overrides"),
    )
    return row.withColumn(
        "removal_rate", ratio(F.col("removed_samples"), F.col("total_samples"))
    )


def funnel(labelled: DataFrame, rules=None) -> DataFrame:
    """(stage, noise_type, removed) with subtotals: null type = stage, null stage = all."""
    return (
        labelled.filter(F.col("noise_type").isNotNull())
        .withColumn("stage", stage_of(F.col("noise_type"), rules))
        .rollup("stage", "noise_type")
        .agg(F.count("*").alias("removed"))
    )


def stage_remaining(labelled: DataFrame, stages) -> DataFrame:
    """(stage, removed, remaining) in stage order, from one pass over the labels."""
    counts = labelled.groupBy(stage_of(F.col("noise_type")).alias("stage")).agg(
        F.count("*").alias("n")
    )
    total = F.coalesce(F.sum("n"), F.lit(0))
    sums = [
        F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("n"))), F.lit(0)) for s in stages
    ]
    rows, gone = [], F.lit(0)
    for i, stage in enumerate(stages):
        gone = gone + sums[i]
        rows.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(stage).alias("stage"),
                sums[i].alias("removed"), (total - gone).alias("remaining"),
            )
        )
    return counts.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def ranked_breakdown(labelled: DataFrame) -> DataFrame:
    """(position, noise_type, n): labels by falling count, ties by name, counted from 1."""
    # One row per label.
    by_count = Window.orderBy(F.desc("n"), "noise_type")
    return label_counts(labelled.filter("noise_type is not null")).select(
        F.row_number().over(by_count).alias("position"), "noise_type", "n"
    )
