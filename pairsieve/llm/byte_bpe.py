"""Byte-level BPE encoding with offsets, and decoding.

Encoding runs the tokenizers library over Arrow batches (``pieces``). The tokens of a text,
put together, are its UTF-8 bytes, so offsets follow from the tokens' byte lengths and the
byte-to-character map of the text. Decoding reverses the byte table; a character may be
split over tokens, and ``StreamDecoder`` holds back its first bytes until the rest comes.

Row-local: no shuffle, memory bounded by a slice of a batch (or one text, if that is longer).

Defined results: null text counts as empty and has no tokens; empty text likewise. Repeated
rows give repeated results. Other columns are not read. An empty table gives an empty result.
Ids outside the vocabulary fail; ids that are no valid UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.llm.common import table
from pairsieve.llm.pieces import character_offsets, encoder, slices


# Bytes of text encoded at a time: a worker's peak is some hundred bytes for each of its tokens.
PART = 2_000_000


def vocabulary(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class StreamDecoder:
    """Text of ids that arrive in parts; a split character waits for its last byte."""

    def __init__(self, path: str):
        self._table = encoder(path).token_bytes
        self._utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids, final: bool = False) -> str:
        return self._utf8.decode(b"".join(self._table[i] for i in ids), final)


def _parts(batch: pa.RecordBatch, path: str):
    """(first row, texts, ids, counts) for slices of a batch."""
    texts = batch.column("text")
    for a, b in slices(texts, PART):
        part = texts.slice(a, b - a)
        yield a, part, *encoder(path).encode(part)


def _encode_batches(path: str):
    def run(batches):
        for batch in batches:
            for at, texts, ids, counts in _parts(batch, path):
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                lengths = encoder(path)._byte_count[ids]
                starts, ends = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                done = 0
                for text, n in zip(texts, counts):
                    if n:
                        span = slice(done, done + int(n))
                        data = text.as_buffer().to_pybytes()
                        starts[span], ends[span] = character_offsets(data, lengths[span])
                        done += int(n)
                lists = [
                    pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32)))
                    for v in (ids, starts, ends)
                ]
                doc = batch.column("doc_id").slice(at, len(counts))
                yield pa.RecordBatch.from_arrays(
                    [doc, *lists], names=["doc_id", "ids", "starts", "ends"]
                )

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, starts, ends: token ids and their spans in code points (end exclusive)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, ids array<int>, starts array<int>, ends array<int>"
    return narrow.mapInArrow(_encode_batches(path or vocabulary()), schema)


def _decode_batches(path: str):
    def run(batches):
        for batch in batches:
            texts = [
                StreamDecoder(path).feed(ids.as_py() or (), final=True)
                for ids in batch.column("ids")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())],
                names=["doc_id", "text"],
            )

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of (doc_id, ids)."""
    narrow = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return narrow.mapInArrow(
        _decode_batches(path or vocabulary()), "doc_id long, text string"
    )


def _round_trip_batches(path: str):
    def run(batches):
        for batch in batches:
            for at, _, ids, counts in _parts(batch, path):
                raw = ids.astype("<u4").tobytes()
                data, lengths = encoder(path).decode(ids)
                data = data.tobytes()
                ends = np.cumsum(counts)
                byte_at = np.append(0, np.cumsum(lengths))
                ids_sha, text_sha = [], []
                for a, b in zip(ends - counts, ends):
                    ids_sha.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                    part = data[byte_at[a] : byte_at[b]]
                    text_sha.append(hashlib.sha256(part).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(counts)),
                        pa.array(counts),
                        pa.array(ids_sha, pa.string()),
                        pa.array(text_sha, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, digest of the ids, digest of the bytes they decode to."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(_round_trip_batches(path or vocabulary()), schema)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
