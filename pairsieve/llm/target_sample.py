"""Importance resampling towards a target distribution, with an exact distributed cut-off.

Features are all runs of one to three words. Hashed into buckets they are counted over all
documents and over the target texts, and every bucket gets a gain: the floored log-ratio of its
smoothed probabilities. A document's weight is the sum of its features' gains; a Gumbel
number drawn from its id is added, and the documents with the largest sums are drawn.

*Array-scored weights*: a text's words become arrays of checksums and lengths. The checksum of
a run follows from those of its words, since CRC-32 is linear, so no run is ever spelled
out. Long texts are worked off in pieces that overlap by two words.

*Selection by weighted median of medians*: every partition reports the median of its remaining
keys and how many remain. At least a quarter of all remaining keys lie on either side of the
median of these medians, weighted by those counts, so each round discards at least a
quarter, until few enough remain to look at. The driver holds one key per partition. The keys
end with a stored row number, so no two are equal and the cut-off is exact.

*Winners* are sorted over ranges; a range's rows are numbered on from the rows before it.

Defined results: null and empty texts have no words, weight 0, and are drawn never. A null id
is hashed as the empty text and comes last among ties. Repeated rows are documents of their own.
Empty targets or an empty table work by the same formula. Other columns are not read.
"""

from __future__ import annotations

import math
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsieve.llm.common import table
from pairsieve.session import stored_table

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
SHARE = (5, 100)
SEED = 42
# Keys left when the rest is looked at on the driver.
FEW = 10_000
PIECE = 1 << 20

# Words are ASCII letters, digits and all characters beyond ASCII; A to Z become a to z.
_PLAIN = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)
) + bytes(range(128, 256))
_DIRECT = 32
KEY = ["low", "no_id", "id", "n_features", "row"]


def _zero_byte() -> np.ndarray:
    """CRC-32 of a register's lowest byte after one zero byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out.astype(np.uint32)


def _apply(shift: np.ndarray, crc: np.ndarray, at: np.ndarray | int = 0) -> np.ndarray:
    """Registers after the change in the flat table ``shift``, which starts at ``at``."""
    return (
        shift.take(at + (crc & 255))
        ^ shift.take(at + 256 + ((crc >> 8) & 255))
        ^ shift.take(at + 512 + ((crc >> 16) & 255))
        ^ shift.take(at + 768 + (crc >> 24))
    )


def _shift_tables():
    """How registers change by 0 to 31 zero bytes, and by 32, 64, 128, ... of them."""
    zero = _zero_byte()
    parts = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    direct = [parts.ravel()]
    for _ in range(_DIRECT):
        last = direct[-1]
        direct.append(zero[last & 255] ^ (last >> 8))
    doubled = [direct.pop()]
    for _ in range(26):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.concatenate(direct), doubled


_SHIFTS, _DOUBLED = _shift_tables()


def after_bytes(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What checksums become when ``n`` more bytes follow, before those bytes' own."""
    out = _apply(_SHIFTS, crc, 1024 * (n % _DIRECT))
    far = n // _DIRECT
    for shift in _DOUBLED:
        if not far.any():
            break
        odd = np.flatnonzero(far & 1)
        out[odd] = _apply(shift, out[odd])
        far = far >> 1
    return out


def run_buckets(data: bytes, buckets: int = BUCKETS):
    """(words, buckets of all runs) of each piece of a UTF-8 text."""
    data = data.translate(_PLAIN)
    crc, size = np.empty(0, np.uint32), np.empty(0, np.int64)
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        if end < len(data):
            gap = data.find(b" ", end)
            end = gap if gap >= 0 else len(data)
        words = data[at:end].split()
        at = end
        before, n = len(crc), len(words)
        crc = np.concatenate((crc, np.fromiter(map(crc32, words), np.uint32, n)))
        size = np.concatenate((size, np.fromiter(map(len, words), np.int64, n)))
        spaced = after_bytes(np.full(len(crc), crc32(b" "), np.uint32), size) ^ crc
        run, found = crc, [crc[before:]]
        for more in range(1, LONGEST_RUN):
            run = after_bytes(run[:-1], size[more:] + 1) ^ spaced[more:]
            # runs that end before this piece are counted already
            found.append(run[max(0, before - more) :])
        yield n, np.concatenate(found).astype(np.int64) % buckets
        crc, size = crc[1 - LONGEST_RUN :], size[1 - LONGEST_RUN :]


def _texts(batch: pa.RecordBatch):
    for text in batch.column("text"):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all texts; each task sends one row per bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in _texts(batch):
                for _, found in run_buckets(data, buckets):
                    total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    made = texts.select("text").mapInArrow(count, "b long, n long")
    out = np.zeros(buckets, np.int64)
    for b, n in made.groupBy("b").agg(F.sum("n")).collect():  # `buckets` rows at most
        out[b] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored 1000-fold log-ratio of the smoothed probabilities, per bucket."""
    more_raw = float(raw.sum()) + len(raw)
    more_target = float(target.sum()) + len(target)
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * more_raw / ((s + 1.0) * more_target)))
            for s, t in zip(raw.tolist(), target.tolist())
        ],
        np.int64,
    )


def gumbel_points(doc_id: Column, seed: int = SEED) -> Column:
    """Floored 1000-fold Gumbel number of an id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def score_documents(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """Stored table of row, doc_id, n_words, n_features, weight, score of every document."""
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))

    def score(batches):
        for batch in batches:
            words, features, weight = [], [], []
            for data in _texts(batch):
                n = runs = total = 0
                for more, found in run_buckets(data, buckets):
                    n, runs = n + more, runs + len(found)
                    total += int(gain[found].sum())
                words.append(n)
                features.append(runs)
                weight.append(total)
            made = [pa.array(x, pa.int64()) for x in (words, features, weight)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), *made],
                names=["row", "doc_id", "n_words", "n_features", "weight"],
            )

    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
    )
    made = narrow.mapInArrow(
        score, "row long, doc_id long, n_words long, n_features long, weight long"
    )
    score_of = F.col("weight") + gumbel_points(F.col("doc_id"), seed)
    return stored_table(made.withColumn("score", score_of), "target-scores")


def with_key(scores: DataFrame) -> DataFrame:
    """Add the columns of ``KEY``: ascending, they order documents by descending score, then id."""
    return scores.withColumns(
        {
            "low": -F.col("score"),
            "no_id": F.col("doc_id").isNull().cast("long"),
            "id": F.coalesce("doc_id", F.lit(0)).cast("long"),
        }
    )


def _key_struct() -> Column:
    return F.struct(*KEY)


def _literal(key: tuple) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(KEY, key)])


def _partition_median(batches):
    parts = [batch for batch in batches if batch.num_rows]
    if parts:
        columns = [
            np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in parts])
            for c in KEY
        ]
        order = np.lexsort(columns[::-1])
        middle = order[(len(order) - 1) // 2]
        values = [pa.array([int(c[middle])], pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(
            [*values, pa.array([len(order)], pa.int64())], names=[*KEY, "n"]
        )


def weighted_median(medians) -> tuple:
    """The first of the sorted (key, weight) pairs at which half of the weight is reached."""
    medians = sorted(medians)
    half = sum(n for _, n in medians) / 2
    for (key, _), seen in zip(medians, accumulate(n for _, n in medians)):
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff_key(keys: DataFrame, k: int, few: int = FEW) -> tuple:
    """The k-th smallest of the distinct keys in the columns ``KEY``; 1 <= k <= their number."""
    left, remaining = keys.select(*KEY), keys.count()
    above = below = None  # keys known to be within and beyond the k smallest
    while remaining > few:
        found = left.mapInArrow(_partition_median, ", ".join(f"{c} long" for c in [*KEY, "n"]))
        # one row per partition
        pivot = weighted_median([(tuple(r[:-1]), r[-1]) for r in found.collect()])
        upto = left.filter(_key_struct() <= _literal(pivot)).count()
        if upto == k:
            return pivot
        if upto > k:
            below, remaining = pivot, upto - 1
        else:
            above, k, remaining = pivot, k - upto, remaining - upto
        left = keys.select(*KEY)
        if above:
            left = left.filter(_key_struct() > _literal(above))
        if below:
            left = left.filter(_key_struct() < _literal(below))
    return sorted(tuple(r) for r in left.collect())[k - 1]


def ranked(winners: DataFrame) -> DataFrame:
    """Add ``rank``, counted from 1 in the order of ``KEY``, without a sort in one task."""
    spread = winners.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id())
    parts = stored_table(spread, "target-winners")
    sizes = sorted(parts.groupBy("part").count().collect())  # one row per partition
    before = [0, *accumulate(r["count"] for r in sizes)]
    offsets = winners.sparkSession.createDataFrame(
        [(r["part"], n) for r, n in zip(sizes, before)], "part int, ahead long"
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(*KEY))
    numbered = parts.withColumn("place", place).join(F.broadcast(offsets), "part")
    return numbered.withColumn("rank", F.col("ahead") + F.col("place"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = SHARE,
    least_words: int = LEAST_WORDS,
    few: int = FEW,
    **options,
) -> DataFrame:
    """Every document: doc_id, n_features, weight, score, rank (null where not drawn)."""
    columns = ["doc_id", "n_features", "weight", "score"]
    scores = with_key(score_documents(docs, target, **options))
    known = scores.filter(F.col("n_words") >= least_words)
    k = share[0] * known.count() // share[1]
    no_rank = F.lit(None).cast("long").alias("rank")
    if not k:
        return scores.select(*columns, no_rank)
    wins = (F.col("n_words") >= least_words) & (
        _key_struct() <= _literal(cutoff_key(known, k, few))
    )
    drawn = ranked(scores.filter(wins)).select(*columns, "rank")
    return drawn.union(scores.filter(~wins).select(*columns, no_rank))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The ids of the drawn documents in ``rank`` order of importance: doc_id, rank."""
    return resample(docs, target, **options).filter("rank is not null").select("doc_id", "rank")


def op11_target_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_target_sample": op11_target_sample}
# DuckDB has no CRC-32; the tests hold it against a plain version.
ORACLES: dict[str, str] = {}
