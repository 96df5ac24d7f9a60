"""Quality classifier by importance resampling.

Two generative models of hashed n-grams (words and marks, and pairs of them, in ``BUCKETS``
buckets): one of the *target*, the documents labelled good, and one of the *raw* text, which is
every document. A document's importance is the log-ratio of its n-grams' probabilities under
the two. Documents are sampled without replacement by Gumbel top-k: a standard Gumbel number
is added to each log-ratio and the k largest sums stay, where k is the good share of the
labels times the number of documents.

The raw counts, scores and the selection cover all documents and whole texts. Only the labelled
rows the target model is fitted on are bounded: the ``FIT_ROWS`` rows with the smallest hash
of their id, whose ids (some 100 kB) are broadcast. The k-th largest score is found by counting
the scores into ever finer ranges, not by a global sort.

Defined results: null and empty texts have no n-grams and a log-ratio of zero. A document with
several labels is good only if all are. Without labelled rows every document stays. Gumbel
numbers come from the digest of id and text, so repeated rows stay or go together; all rows
with exactly the k-th score stay. Other columns are carried by ``keep_good`` and not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.llm.common import fresh, row_key, table
from pairsieve.session import stored_table

BUCKETS = 1 << 14
FIT_ROWS = 20_000
SMOOTHING = 1.0
_TOKEN = re.compile(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff\s]+")


def buckets(data: bytes) -> np.ndarray:
    """Bucket of every word, mark and neighbouring pair of a UTF-8 text.

    A word that follows itself has one more bucket, whatever the word.
    """
    tokens = _TOKEN.findall(data.lower())
    one = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    pair = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pair ^= pair >> np.uint64(31)
    found = (np.concatenate((one, pair)) % np.uint64(BUCKETS)).astype(np.int64)
    again = np.count_nonzero(one[:-1] == one[1:])
    return np.append(found, np.full(again, BUCKETS))


def _texts(batch: pa.RecordBatch):
    for text in batch.column("text"):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def _count_batches(batches):
    raw, target = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
    for batch in batches:
        for data, good in zip(_texts(batch), batch.column("good").to_pylist()):
            found = buckets(data)
            np.add.at(raw, found, 1)
            if good:
                np.add.at(target, found, 1)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at), pa.array(raw[at]), pa.array(target[at])],
        names=["bucket", "raw", "target"],
    )


def good_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, good): one row per labelled document."""
    known = labels.filter("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))


def log_ratios(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """Log of target over raw probability per bucket (or None), and the good share."""
    each = good_labels(labels)
    share = each.agg(F.avg(F.col("good").cast("int"))).first()[0]
    if not share:
        return None, 1.0
    sample = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    fit = sample.filter("good").select(F.col("doc_id").alias("labelled"))
    marked = docs.select("doc_id", "text").join(
        F.broadcast(fit), F.col("doc_id") == F.col("labelled"), "left"
    )
    flagged = marked.select("text", F.col("labelled").isNotNull().alias("good"))
    counts = flagged.mapInArrow(_count_batches, "bucket long, raw long, target long")
    sums = counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for bucket, r, t in sums:  # BUCKETS + 1 rows at most
        raw[bucket], target[bucket] = r, t
    if not target.sum():
        return None, 1.0
    p_raw = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    p_target = (target + SMOOTHING) / (target.sum() + SMOOTHING * BUCKETS)
    return np.log(p_target) - np.log(p_raw), share


def _score_batches(ratios: np.ndarray):
    def run(batches):
        for batch in batches:
            out = [float(ratios[buckets(data)].sum()) for data in _texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(out, pa.float64())],
                names=["doc_id", "row_key", "log_ratio"],
            )

    return run


def gumbel(key: Column) -> Column:
    """A standard Gumbel number from a 128-bit key."""
    digits = F.substring(F.hex(key), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(scores: DataFrame, column: str, k: int, small: int = 10_000) -> float:
    """Exact k-th largest number; what is fetched is bounded by ``small`` and bin counts."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    left = scores
    while low < high and left.count() > small:
        width = (high - low) / 1000
        if low + width <= low:
            break
        at = F.least(F.floor((F.col(column) - low) / width), F.lit(999))
        bins = left.groupBy(at.alias("at")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        for row in sorted(bins.collect(), reverse=True):
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high = row["low"], row["high"]
        left = scores.filter(F.col(column).between(low, high))
    if low == high:
        return low
    return left.select(column).orderBy(F.desc(column)).limit(k).agg(F.min(column)).first()[0]


def select_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, row_key, log_ratio, perturbed, kept of every row."""
    ratios, share = log_ratios(docs, labels, fit_rows)
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        "text",
    )
    ratios = np.zeros(BUCKETS + 1) if ratios is None else ratios
    made = narrow.mapInArrow(
        _score_batches(ratios), "doc_id long, row_key binary, log_ratio double"
    )
    noisy = made.withColumn("perturbed", F.col("log_ratio") + gumbel(F.col("row_key")))
    scores = stored_table(noisy, "quality-scores")
    k = round(share * scores.count())
    cut = kth_largest(scores, "perturbed", k) if k else float("inf")
    return scores.withColumn("kept", F.col("perturbed") >= cut)


def keep_good(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The selected rows, columns unchanged, repeated rows included."""
    gone = select_documents(docs, labels, fit_rows).filter("not kept").select("row_key")
    key = fresh(docs, "row_key")
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(gone.distinct().toDF(key), key, "left_anti").select(*docs.columns)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = select_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "log_ratio", "kept")


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
