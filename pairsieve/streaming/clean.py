"""The same rules on streams.

Rules are row-local, so a stream needs no state for them. Only duplicates and running
counts hold state, bounded by a watermark where one is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairsieve.operators.dedup import key_digest
from pairsieve.operators.dictionary import fits_bounds, windowed_dictionary
from pairsieve.operators.rules import RuleOptions
from pairsieve.plans.cleaning import label_pairs
from pairsieve.sources.schema import EVENT_LOG_SCHEMA


def read_pair_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
    return reader.load(path)


def label_stream(
    pairs: DataFrame, patterns: DataFrame | None = None, options: RuleOptions | None = None
) -> DataFrame:
    """Stateless; append mode. The dictionary is read once, when the query starts."""
    return label_pairs(pairs, patterns, options)


def clean_stream(pairs: DataFrame, patterns=None, options=None) -> DataFrame:
    return label_stream(pairs, patterns, options).filter(F.col("noise_type").isNull())


def start_batches(
    stream: DataFrame,
    work: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Apply a batch plan to every micro-batch and write its rows under ``path``.

    For plans a stream cannot run, such as joins that regroup by text. A batch writes a folder
    of its own, over whatever an earlier try of it left, so each row comes out once.
    """

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .trigger(**(trigger or {"availableNow": True}))
        .option("checkpointLocation", checkpoint)
        .start()
    )


def start_clean(
    pairs: DataFrame,
    path: str,
    checkpoint: str,
    patterns: DataFrame | None = None,
    options: RuleOptions | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the rows of a stream that no rule removes; takes dictionaries of any size.

    A dictionary over the bounds is keyed and stored once, when the query starts. Each
    micro-batch joins the keys its texts show to it, verifies, and groups by the texts' digests,
    as a batch job does: no state is held between batches.
    """
    options = options or RuleOptions()
    if patterns is not None and not options.keyed:
        if options.dictionary_form == "join" or not fits_bounds(patterns):
            options = replace(options, dictionary_form="join", keyed=windowed_dictionary(patterns))

    def kept(batch: DataFrame) -> DataFrame:
        return label_pairs(batch, patterns, options).filter(F.col("noise_type").isNull())

    return start_batches(pairs, kept, path, checkpoint, trigger)


def _watermarked(df: DataFrame, time_column: str, delay: str) -> DataFrame:
    if dict(df.dtypes)[time_column] == "timestamp_ntz":
        df = df.withColumn(time_column, F.col(time_column).cast("timestamp"))
    return df.withWatermark(time_column, delay)


def dedup_stream(
    pairs: DataFrame, time_column: str, delay: str = "1 day", key: str = "target"
) -> DataFrame:
    """First seen row per key; a key is remembered for the delay. State holds digests."""
    return (
        _watermarked(pairs, time_column, delay)
        .withColumn("_key", key_digest(key))
        .dropDuplicatesWithinWatermark(["_key"])
        .drop("_key")
    )


def running_report(labelled: DataFrame) -> DataFrame:
    """(noise_type, n) so far; complete or update mode. State has one row per label."""
    return labelled.groupBy("noise_type").agg(F.count("*").alias("n"))


def windowed_report(
    labelled: DataFrame, time_column: str, window: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """(window_start, noise_type, n) per tumbling window; append mode after the delay."""
    return (
        _watermarked(labelled, time_column, delay)
        .groupBy(F.window(time_column, window), "noise_type")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "noise_type", "n")
    )


def event_log_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT_LOG_SCHEMA).json(path)


def event_monitor(log: DataFrame, value: str, by: str = "kind", order: str = "step") -> DataFrame:
    """(by, entries, latest order, latest value); complete or update mode."""
    return log.groupBy(by).agg(
        F.count("*").alias("entries"),
        F.max(order).alias(order),
        F.max_by(value, order).alias(value),
    )
