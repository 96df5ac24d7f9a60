"""A corpus pipeline of five operators: quality, exact and near-duplicates, mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. ``run`` writes
every stage's rows as Parquet to the shared folder and reads them again, so each stage's work
is done once and a lost executor repeats one stage at most.

All stages but the last return the columns of ``documents``; the last returns a row per
document that is left: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairsieve.llm.byte_bpe import round_trip
from pairsieve.llm.common import table
from pairsieve.llm.exact_dedup import keep_first_texts
from pairsieve.llm.mixing import sample_documents
from pairsieve.llm.quality import keep_good
from pairsieve.llm.simhash import keep_one_of_each
from pairsieve.session import stored_table

# Share of the tokens that mixing samples.
MIX_SHARE = 0.82


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_documents(docs, share=MIX_SHARE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("mixing", mix),
    ("byte_bpe", token_ids),
]

# Quality, fingerprints and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored_table(stage(spark, docs, sf_dir), name)
    return docs
