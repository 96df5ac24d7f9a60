"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text, freed of white space, is cut where its content says so: after at least 512
characters, behind the next punctuation mark, at the latest after 4,096. A document's recipe
is the ordered list of its chunks' identifiers. Two texts are equal exactly when their
recipes are, because

* equal texts are cut alike, and
* identifiers are verified: every distinct chunk is compared with the others of its digest
  once (``verify``). Should two different chunks ever share a digest, the next digest of the
  list is taken, so no decision rests on an unchecked hash.

Long texts move once, as distinct chunks after a map-side ``distinct``. Grouping, the choice
of the row that stays and the way back to the documents handle recipes only. A group with a
third of all rows is counted map-side; its way back is a sort-merge join whose hot
partition adaptive execution splits.

Defined results: null text is empty; all empty texts form one group. A null ``doc_id`` loses
against any other. Of repeated rows (same id, same text) exactly one is kept. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.llm.common import SPACE, keep_rows, row_key, table
from pairsieve.session import stored_table

MARKS = "[.!?,;:|]"
CHUNK = rf"(?s).{{512,4095}}?{MARKS}|.{{1,4096}}"


def _sha(bits: int):
    return lambda chunk: F.unhex(F.sha2(chunk, bits))


DIGESTS = (_sha(256), _sha(512))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def chunks(norm: Column) -> Column:
    """The pieces of a text, in order; together they are the text."""
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def verify(docs: DataFrame, digest) -> bool:
    """True if every digest stands for one chunk content, over all documents."""
    pieces = docs.select(F.explode(chunks(normalised(F.col("text")))).alias("chunk"))
    distinct = pieces.select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    clash = distinct.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    return clash.isEmpty()


def recipes(docs: DataFrame, digests=DIGESTS) -> DataFrame:
    """One narrow row per document: row, doc_id, row_key, n_chars, text_sha256, recipe."""
    # Named first, so that the normalised text is made once per row.
    norm = docs.select("doc_id", "text", normalised(F.col("text")).alias("norm"))
    for digest in digests:
        made = norm.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            row_key(F.col("doc_id"), F.col("text")).alias("row_key"),
            F.length(F.coalesce("text", F.lit(""))).alias("n_chars"),
            F.sha2("norm", 256).alias("text_sha256"),
            F.transform(chunks(F.col("norm")), digest).alias("recipe"),
        )
        if verify(docs, digest):
            return stored_table(made, "recipes")
    raise ValueError("two chunks share every digest given")


def exact_duplicates(docs: DataFrame, digests=DIGESTS) -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256, row_key.

    The row with most characters stays, then the one with the smallest ``doc_id``.
    """
    rows = recipes(docs.select("doc_id", "text"), digests)
    # bitwise_not turns an order around without overflow
    rank = F.struct(
        F.col("n_chars"),
        F.col("doc_id").isNotNull().alias("known"),
        F.bitwise_not("doc_id").alias("low"),
        F.bitwise_not("row").alias("first"),
    )
    groups = rows.groupBy("recipe").agg(
        F.count("*").alias("group_size"), F.max(rank).alias("best")
    )
    return rows.join(groups, "recipe").select(
        "doc_id",
        F.bitwise_not(F.col("best.low")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.bitwise_not(F.col("best.first"))).alias("kept"),
        "text_sha256",
        "row_key",
    )


def keep_first_texts(docs: DataFrame) -> DataFrame:
    """The table without exact duplicates, columns unchanged."""
    kept = exact_duplicates(docs).filter("kept").select("row_key")
    return keep_rows(docs, kept)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("row_key")


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
ORACLES = {"op7_exact_dedup": SQL}
