"""Exact duplicates: keep the first row of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_digest(column: str) -> Column:
    """32 bytes in place of a long text: cheaper to shuffle, sort and compare."""
    return F.unhex(F.sha2(F.col(column), 256))


def keep_first(df: DataFrame, key: str = "target", order_by=("row_id",)) -> DataFrame:
    """One row per key, the first by ``order_by``; null keys count as equal.

    Written as ``row_number() = 1`` so that Spark keeps only one row per key in every map
    task before the shuffle (window group limit). A key that holds a third of all rows
    then sends one row per map task, not a third of the table, to its reducer.
    """
    first = Window.partitionBy("_key").orderBy(*order_by)
    return (
        df.withColumn("_key", key_digest(key))
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") == 1)
        .drop("_key", "_rank")
    )


def dedup_counts(df: DataFrame, key: str = "target") -> DataFrame:
    """One row: rows before, rows after, duplicates. Two-step count, no hot group."""
    per_key = df.groupBy(key_digest(key).alias("k")).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
    ).withColumn("duplicates", F.col("rows_before") - F.col("rows_after"))
