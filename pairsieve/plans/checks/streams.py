"""Streaming queries: bounded runs over the files, checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairsieve.operators.dictionary import with_hit_flag, windowed_dictionary
from pairsieve.plans.checks.documents import ACCENTS
from pairsieve.plans.checks.tables import document_patterns, registry, table
from pairsieve.functions import code_structure as cs
from pairsieve.operators.rules import SYNTAX, Rule, first_match
from pairsieve.session import folder_exists, shared_folder
from pairsieve.streaming import clean as streams

QUERIES, ORACLES, query = registry()


def _stream(spark, sf_dir, name):
    """The table as a stream, be it one file or a folder of files.

    A file stream takes folders and patterns, no single file: the path is written as a pattern.
    """
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _drain(df, mode):
    """Run to the end of the files and return what came out.

    Row streams go to files; small running totals to memory, where complete mode is allowed.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option(
        "checkpointLocation", f"{folder}/checkpoint"
    )
    if mode == "append":
        writer.format("parquet").start(f"{folder}/rows").awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{folder}/rows")
    name = "t_" + uuid.uuid4().hex
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)


def _labelled(spark, sf_dir):
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    flagged = with_hit_flag(docs, "text", document_patterns(spark, sf_dir), "_hit")
    rules = [
        Rule("dictionary_hit", SYNTAX, F.col("_hit")),
        Rule("non_english", SYNTAX, cs.in_char_ranges(F.col("text"), ACCENTS)),
    ]
    return flagged.select("doc_id", first_match(rules).alias("noise_type"))


_LABEL = """CASE WHEN EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))
  THEN 'dictionary_hit'
  WHEN regexp_matches(d.text, '[\\x{00c0}-\\x{00ff}]') THEN 'non_english' END"""


@query(f"SELECT doc_id FROM documents d WHERE {_LABEL} IS NULL")
def stream_clean(spark, sf_dir):
    kept = _labelled(spark, sf_dir).filter(F.col("noise_type").isNull()).select("doc_id")
    return _drain(kept, "append")


@query(f"SELECT doc_id FROM documents d WHERE {_LABEL} IS NULL")
def stream_clean_joined_dictionary(spark, sf_dir):
    """As ``stream_clean``, with the form for dictionaries over the bounds, batch by batch."""
    patterns = document_patterns(spark, sf_dir)
    keyed = windowed_dictionary(patterns)

    def kept(docs):
        flagged = with_hit_flag(docs, "text", patterns, "_hit", "join", keyed)
        clean = ~F.col("_hit") & ~cs.in_char_ranges(F.col("text"), ACCENTS)
        return flagged.filter(clean).select("doc_id")

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = _stream(spark, sf_dir, "documents").select("doc_id", "text")
    streams.start_batches(docs, kept, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    if not folder_exists(spark, f"{folder}/rows"):  # no file, no batch
        return spark.createDataFrame([], docs.select("doc_id").schema)
    return spark.read.parquet(f"{folder}/rows").select("doc_id")


@query(f"SELECT {_LABEL} AS noise_type, count(*) AS n FROM documents d GROUP BY 1")
def stream_report(spark, sf_dir):
    return _drain(streams.running_report(_labelled(spark, sf_dir)), "complete")


@query("""SELECT count(*) AS n, count(DISTINCT key) AS n_keys FROM (
SELECT DISTINCT event_type || '/' || user_id AS key FROM events)""")
def stream_dedup(spark, sf_dir):
    """First seen row per key, within a watermark longer than the data."""
    events = _stream(spark, sf_dir, "events").withColumn(
        "key", F.concat_ws("/", "event_type", F.col("user_id").cast("string"))
    )
    rows = _drain(streams.dedup_stream(events, "ts", "3650 days", "key"), "append")
    return rows.agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS noise_type, count(*) AS n
FROM events GROUP BY ALL""")
def stream_windowed_report(spark, sf_dir):
    """Daily counts per label; complete mode, so that the last day is shown too."""
    events = _stream(spark, sf_dir, "events").withColumn("noise_type", F.col("event_type"))
    daily = _drain(streams.windowed_report(events, "ts", "1 day", "1 day"), "complete")
    return daily.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "noise_type", "n"
    )


@query("""SELECT event_type AS kind, count(*) AS entries, max(event_id) AS step,
arg_max(value, event_id) AS value FROM events GROUP BY event_type""")
def stream_event_monitor(spark, sf_dir):
    log = _stream(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"), F.col("event_id").alias("step"), "value"
    )
    return _drain(streams.event_monitor(log, "value"), "complete")
