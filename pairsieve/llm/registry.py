"""The operators' registered queries and their SQL."""

from pairsieve.llm import (
    byte_bpe,
    centroids,
    class_model,
    exact_dedup,
    licenses,
    mixing,
    neighbours,
    pii,
    quality,
    simhash,
    target_sample,
    templates,
    wavelet,
)

_PARTS = (
    simhash,
    byte_bpe,
    neighbours,
    wavelet,
    quality,
    class_model,
    exact_dedup,
    templates,
    pii,
    mixing,
    target_sample,
    centroids,
    licenses,
)


def all_queries():
    return {name: fn for part in _PARTS for name, fn in part.QUERIES.items()}


def all_oracles():
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
