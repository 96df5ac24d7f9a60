"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of the contracts: space and the five control characters 09-0D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text, never null; null text counts as empty."""
    key = F.concat(
        F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit(""))
    )
    return F.unhex(F.md5(key.cast("binary")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``row_key`` is in ``kept`` (one column of distinct keys).

    Of rows with equal id and text one stays. One shuffle of the table: the window stands
    on the partitioning of the join, and its group limit cuts repeated rows early.
    """
    key, rank = fresh(docs, "row_key"), fresh(docs, "row_rank")
    found = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text"))).join(
        kept.toDF(key), key, "left_semi"
    )
    once = found.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return once.filter(F.col(rank) == 1).select(*docs.columns)
