"""Session and shared-folder helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on. Shuffle partition counts are left to the cluster: adaptive
# execution coalesces small ones and splits skewed ones.
JOB_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Labelling is bound by computation, not by bytes: do not merge small partitions so
    # far that cores stand idle.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "pairsieve", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in JOB_SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a session in one process (``local[n]``) without that setting falls back to a temporary
    folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="pairsieve-")


def stored_table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, short lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Asked of the file system the path belongs to."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def spread_rows(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores, for work that takes long per row."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


# Narrow rows that one task gets of work that takes up to a millisecond per row.
ROWS_PER_TASK = 50_000


def spread_counted(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Narrow rows dealt to as many tasks as their number calls for, one per core at least.

    One split of a file may hold millions of narrow rows, so its bytes do not tell how long a
    task takes. For columns of a table as it is read: the rows are counted first (which reads
    no column of a Parquet file), and shuffled before wide texts are made of them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows_per_task)))


# Below this many bytes per core an input counts as small for work bound by computation.
SMALL_PER_CORE = 8 << 20


def spread_small(df: DataFrame) -> DataFrame:
    """Give every core a share of a small input (say, one file of one row group).

    Large inputs have enough partitions and pass unchanged, without a shuffle.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(estimate)) < SMALL_PER_CORE * cores else df
