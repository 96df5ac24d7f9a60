"""Near-duplicates by SimHash fingerprints, found with covering masks.

Fingerprints are 64 bits: a bit is 1 if it is set in over half of the XXH64 values of a
text's word shingles. Two fingerprints link at ``RADIUS`` or fewer differing bits, and linked
fingerprints form components.

Candidates come from *covering* locality-sensitive hashing. Every bit position gets a nonzero
vector of ``RADIUS + 1`` bits, and every nonzero vector v of that size gives a table that
keeps the positions whose vector has an odd product with v. Any ``RADIUS`` positions span
fewer dimensions than the vectors have, so some v is orthogonal to all of them: a pair
within the radius agrees on all kept bits of some table, without exception. 15 tables keep
about 34 bits each.

Only distinct fingerprints are compared, so copies cost nothing. A bucket over ``LIMIT``
fingerprints is cut again by the same construction over its dropped bits, which loses no
pair; about 14 bits are then free, so no second bucket exceeds 16,384 fingerprints. A bucket
emits the edges of a spanning forest, not its pairs. Components come from alternating
large-star and small-star rounds, each written to the shared folder.

Defined results: null, empty and blank texts have no words and the fingerprint zero, linked
like any other. A component's id is its smallest ``doc_id``, null only if it has none.
Repeated rows fall into one component. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsieve.llm.common import keep_rows, row_key, table
from pairsieve.session import stored_table

RADIUS = 3
SHINGLE = 3
LIMIT = 4096
_ALL = list(range(64))


def shingle_hashes(data: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of the word shingles of a UTF-8 text, A-Z lower-cased."""
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # on bytes both treat ASCII only
    if not words:
        return []
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    spans = zip(starts, ends[size - 1 :]) if len(words) >= size else [(0, ends[-1])]
    return [xxh64_intdigest(line[a : b - 1], 42) for a, b in spans]


def fingerprint(data: bytes, size: int = SHINGLE) -> int:
    """Majority bits of the shingle hashes, as an unsigned integer."""
    hashes = np.array(shingle_hashes(data, size), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches):
    for batch in batches:
        out = [
            fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"")
            for t in batch.column("text").cast(pa.binary())
        ]
        signed = pa.array(np.array(out, dtype=np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row_key"), signed],
            names=["doc_id", "row_key", "fp"],
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, fp (the 64 bits as a signed long), stored."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
        "text",
    )
    made = narrow.mapInArrow(_fingerprint_batches, "doc_id long, row_key binary, fp long")
    return stored_table(made, "fingerprints")


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """Bit masks such that any ``radius`` of the positions are all outside some mask."""
    count = (1 << (radius + 1)) - 1
    vector = {p: i % count + 1 for i, p in enumerate(positions)}
    return [
        sum(1 << p for p in positions if (vector[p] & v).bit_count() % 2)
        for v in range(1, count + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(_signed(v)).cast("long") for v in values])


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def spanning_edges(values: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, root) for all but one value of each component of a bucket."""
    if len(values) == 2:
        near = ((int(values[0]) ^ int(values[1])) & (1 << 64) - 1).bit_count() <= radius
        return [(int(values[1]), int(values[0]))] if near else []
    bits = values.view(np.uint64)
    parent = list(range(len(bits)))
    for at in range(0, len(bits), 512):
        block = bits[at : at + 512]
        near = np.bitwise_count(block[:, None] ^ bits[None, at:]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, 1))):
            a, b = _root(parent, at + int(i)), _root(parent, at + int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = [_root(parent, i) for i in range(len(bits))]
    return [(int(values[i]), int(values[r])) for i, r in enumerate(roots) if i != r]


def _edge_batches(radius: int):
    def run(batches):
        for batch in batches:
            edges = []
            for bucket in batch.column("fps"):
                edges += spanning_edges(bucket.values.to_numpy(zero_copy_only=False), radius)
            u, v = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"]
            )

    return run


def _bucket_edges(rows: DataFrame, keys: list[str], radius: int) -> DataFrame:
    buckets = rows.groupBy(*keys).agg(F.collect_list("fp").alias("fps"))
    many = buckets.filter(F.size("fps") > 1).select("fps")
    return many.mapInArrow(_edge_batches(radius), "u long, v long")


def links(fps: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """Edges (u, v) that connect what is within the radius; ``fps`` holds distinct values."""
    masks = covering_masks(_ALL, radius)
    tables = F.posexplode(F.transform(_longs(masks), lambda m: m.bitwiseAND(F.col("fp"))))
    keyed = fps.select("fp", tables.alias("t", "key"))
    sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy("t", "key")))
    shared = stored_table(sized.filter("n > 1"), "fingerprint-buckets")
    light = _bucket_edges(shared.filter(F.col("n") <= limit), ["t", "key"], radius)
    # Large buckets: the same construction over the bits their table drops.
    finer = F.array(*[
        _longs([m | s for s in covering_masks([p for p in _ALL if not m >> p & 1], radius)])
        for m in masks
    ])
    again = shared.filter(F.col("n") > limit).select(
        "fp",
        "t",
        F.posexplode(
            F.transform(F.get(finer, F.col("t")), lambda m: m.bitwiseAND(F.col("fp")))
        ).alias("s", "key"),
    )
    heavy = _bucket_edges(again, ["t", "s", "key"], radius)
    return light.union(heavy).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every node that is not its component's smallest; edges (u, v).

    Rounds of large-star and small-star until nothing changes. Nothing but each round's
    count and checksum reaches the driver.
    """
    edges = stored_table(edges.filter("u <> v"), "edges")
    seen = None
    while True:
        sums = F.bit_xor(F.xxhash64("u", "v")).alias("x")
        now = edges.agg(F.count("*").alias("n"), sums).first()
        if now == seen or not now["n"]:
            return edges.select("u", F.col("v").alias("root"))
        seen = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), "m")
        large = large.distinct().withColumnRenamed("m", "v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), "m")
        edges = stored_table(
            small.union(low).distinct().withColumnRenamed("m", "v"), "edges"
        )


def near_duplicates(docs: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, row_key, fp, root (a fingerprint per component), component_id."""
    rows = fingerprints(docs)
    distinct = stored_table(
        rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints"
    )
    stars = components(links(distinct.select("fp"), radius, limit))
    rooted = distinct.join(stars, distinct.fp == stars.u, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(ids, "root"), "fp")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The table with one document of each component: the one with the smallest id."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    kept = near_duplicates(docs).groupBy("root").agg(first).select("first.row_key")
    return keep_rows(docs, kept)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
