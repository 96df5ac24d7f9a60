"""Readers: pair tables, pattern dictionaries, event logs."""

from __future__ import annotations

import csv
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairsieve.session import stored_table
from pairsieve.sources.schema import (
    EVENT_LOG_SCHEMA,
    REQUIRED,
    ROW_ID,
    SOURCE_FILE,
    require_columns,
    schema_for,
)

_CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _path_kind(spark: SparkSession, path: str) -> str | None:
    """'dir', 'file' or None, asked of the file system the path belongs to."""
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if any(c in path for c in "*?{["):
        found = fs.globStatus(hadoop_path)
        return "dir" if found and len(found) else None
    if not fs.exists(hadoop_path):
        return None
    return "dir" if fs.getFileStatus(hadoop_path).isDirectory() else "file"


def read_csv_pairs(spark: SparkSession, path: str, required=REQUIRED) -> DataFrame:
    """A CSV file (or a folder or glob of them) of pairs, validated.

    Only the header line is looked at before the job; the data are read once. Number columns
    are read as text and converted row by row: a value that is no number becomes null, and
    the label rules and audits see it as a missing one.
    """
    kind = _path_kind(spark, path)
    if kind is None:
        raise FileNotFoundError(f"no pairs at {path}")
    if kind == "file" and not path.endswith(".csv"):
        raise ValueError(f"{path} is a file without the ending .csv")
    first = spark.read.text(path, lineSep="\n").limit(1).collect()
    header = next(csv.reader([first[0][0].rstrip("\r")])) if first else []
    texts = T.StructType([T.StructField(c, T.StringType()) for c in header])
    df = spark.read.options(**_CSV_OPTIONS).schema(texts).csv(path)
    typed = {
        f.name: F.col(f.name).try_cast(f.dataType)
        for f in schema_for(header)
        if f.dataType != T.StringType()
    }
    return require_columns(df.withColumns(typed) if typed else df, required)


def _has(df: DataFrame, column: str) -> bool:
    """Whether rows know this of the file they come from."""
    try:
        df.select(column)
    except AnalysisException:
        return False
    return True


def _only_rows_of_files(df: DataFrame) -> bool:
    """False where rows may stand for several rows, or several for one of a file.

    Told by the plan; a column that is named like such a step counts as one.
    """
    plan = df._jdf.queryExecution().analyzed().toString()
    steps = r"\b(?:Join|Generate|Expand|Union|Aggregate|Sample)\b"
    return _has(df, "_metadata.file_path") and not re.search(steps, plan)


def with_row_id(df: DataFrame) -> DataFrame:
    """Add ``row_id`` and ``source_file``: rows numbered from 0 through the files in path order.

    The id depends on the order of the files and of the rows in them, not on how files are
    split or packed into tasks, nor on the number of cores: so samples and keep-first rows that
    go by it stay the same. Rows that do not know their place in the file (CSV) are stored
    first; the rows of a file are read in order, so their places follow from the order of the
    numbers they got. A column ``idx`` stays a column of its own: values may repeat between
    files or be empty; a filter before leaves gaps in the numbers. Tables that are more than the
    rows of files (joins, unions, aggregates) have an empty ``source_file`` and an id that
    is only unique: store the result before using it twice.
    """
    if ROW_ID in df.columns:
        return df
    if not _only_rows_of_files(df):
        return df.withColumn(SOURCE_FILE, F.lit("")).withColumn(
            ROW_ID, F.monotonically_increasing_id()
        )
    df = df.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
    if _has(df, "_metadata.row_index"):
        rows = df.withColumn("_at", F.col("_metadata.row_index"))
        first, rows_of = F.lit(0).cast("long"), F.max("_at") + 1
    else:
        started = F.col("_metadata.file_block_start")
        rows = df.withColumn("_block", started).withColumn("_at", F.monotonically_increasing_id())
        rows = stored_table(rows, "rows-to-number")
        first, rows_of = F.min("_at"), F.count("*")
    parts = [SOURCE_FILE] + (["_block"] if "_block" in rows.columns else [])
    # One row per file and block.
    sizes = rows.groupBy(*parts).agg(rows_of.alias("_n"), first.alias("_first"))
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *parts, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    numbered = rows.join(offsets, parts).withColumn(
        ROW_ID, F.col("_before") + F.col("_at") - F.col("_first")
    )
    return numbered.select(*[c for c in df.columns], ROW_ID)


def ingest_pairs(spark: SparkSession, csv_path: str, table_path: str) -> DataFrame:
    """CSV to a parquet table with stored row ids; returns the stored table."""
    with_row_id(read_csv_pairs(spark, csv_path)).write.mode("overwrite").parquet(table_path)
    return spark.read.parquet(table_path)


def read_named_sets(spark: SparkSession, **paths: str) -> DataFrame:
    """Several pair files as one table with a ``split`` column."""
    frames = [
        read_csv_pairs(spark, path).withColumn("split", F.lit(name))
        for name, path in paths.items()
    ]
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def head_rows(df: DataFrame, n: int, order_by=(ROW_ID,)) -> DataFrame:
    """The first n rows in file order."""
    return df.orderBy(*order_by).limit(n)


def read_patterns(spark: SparkSession, path: str | None) -> DataFrame | None:
    """One literal pattern per line, blanks significant, empty lines skipped.

    No path or no such file: None, and the dictionary rule never fires.
    """
    if path is None or _path_kind(spark, path) is None:
        return None
    return (
        spark.read.text(path, lineSep="\n")
        .select(F.col("value").alias("pattern"))
        .filter(F.col("pattern") != "")
    )


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{kind, step, epoch, wall_time, ...}``."""
    return spark.read.schema(EVENT_LOG_SCHEMA).json(path)
