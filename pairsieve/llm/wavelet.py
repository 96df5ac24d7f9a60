"""Token files as wavelet matrices, one file per shard.

A wavelet matrix keeps a sequence of n numbers of b bits as b bit-planes. Each plane has one
bit of every number, highest bit first; before the next plane the numbers with a 0 move in
front of those with a 1, in order. With counts of ones every ``BLOCK`` bits a plane answers
rank and select, and the planes together answer which token stands at a place (``access``),
how often one occurs before it (``rank``), where its k-th occurrence is (``select``).

A shard is one Parquet file of segments. A segment holds whole documents of about
``SEGMENT`` tokens (or one longer document): their ids, their sizes and the compressed
matrix. Spark's writer commits the files, so a lost executor leaves none half written, and any
store Spark reaches can hold them. Documents are range-partitioned by ``doc_id``, so shards
and segments in order hold the corpus in order.

Defined results: null text counts as empty; an empty document has the end id only. Null
``doc_id`` comes first. Repeated ids stand in the order of the hash of their text. Other
columns are not read. An empty table gives a readable folder without segments.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsieve.llm.common import table
from pairsieve.llm.pieces import SLICE, encoder, slices
from pairsieve.session import shared_folder

END = 0
SEGMENT = 1_000_000
BLOCK = 512
_HEAD = struct.Struct("<4sBxxxQ")
_MAGIC = b"WVM1"


class WaveletMatrix:
    """Succinct sequence of unsigned numbers."""

    def __init__(self, size: int, planes: list[np.ndarray], zeros: list[int]):
        self.size, self.planes, self.zeros = size, planes, zeros
        self._ones: list[np.ndarray | None] = [None] * len(planes)

    @classmethod
    def build(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = [], []
        for shift in range(bits - 1, -1, -1):
            on = (values & values.dtype.type(1 << shift)) != 0
            planes.append(np.packbits(on))
            low = np.flatnonzero(~on)
            moved = np.empty_like(values)
            values.take(low, out=moved[: len(low)])
            values.take(np.flatnonzero(on), out=moved[len(low) :])
            zeros.append(len(low))
            values = moved
        return cls(len(values), planes, zeros)

    def decode(self) -> np.ndarray:
        """The whole sequence, plane by plane from the last."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        values = np.zeros(self.size, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            on = np.unpackbits(self.planes[level], count=self.size).view(bool)
            low, back = self.zeros[level], np.empty_like(values)
            back[np.flatnonzero(~on)] = values[:low]
            bit = kind(1 << (len(self.planes) - 1 - level))
            back[np.flatnonzero(on)] = values[low:] | bit
            values = back
        return values

    # Rank and select on one plane. Counts of ones before each block are made on first use.

    def _blocks(self, level: int) -> np.ndarray:
        if self._ones[level] is None:
            each = np.bitwise_count(self.planes[level]).astype(np.int64)
            starts = np.arange(0, max(len(each), 1), BLOCK // 8)
            sums = np.add.reduceat(each, starts) if len(each) else np.zeros(1, np.int64)
            self._ones[level] = np.append(0, np.cumsum(sums))
        return self._ones[level]

    def _rank1(self, level: int, at: int) -> int:
        block = at // BLOCK
        part = self.planes[level][block * BLOCK // 8 : (at + 7) // 8]
        within = np.unpackbits(part, count=at - block * BLOCK)
        return int(self._blocks(level)[block]) + int(within.sum())

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (7 - (at & 7)) & 1

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit."""
        ones = self._blocks(level)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        part = self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        places = np.flatnonzero(np.unpackbits(part) == bit)
        return block * BLOCK + int(places[k - int(before[block])])

    def access(self, at: int) -> int:
        value = 0
        for level, low in enumerate(self.zeros):
            bit = self._bit(level, at)
            ones = self._rank1(level, at)
            at = low + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, at: int) -> tuple[int, int]:
        """Where occurrences of a token before ``at`` end up behind the last plane."""
        first, last = 0, at
        for level, low in enumerate(self.zeros):
            a, b = self._rank1(level, first), self._rank1(level, last)
            if token >> (len(self.planes) - 1 - level) & 1:
                first, last = low + a, low + b
            else:
                first, last = first - a, last - b
        return first, last

    def rank(self, token: int, at: int) -> int:
        """Occurrences of a token before place ``at``."""
        if token >> len(self.planes):
            return 0
        first, last = self._range(token, at)
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.size)

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.size)[0] + k
        for level in range(len(self.planes) - 1, -1, -1):
            bit = token >> (len(self.planes) - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] * bit)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def to_bytes(self) -> bytes:
        import zstandard

        head = _HEAD.pack(_MAGIC, len(self.planes), self.size)
        zeros = np.array(self.zeros, "<u8").tobytes()
        body = b"".join(p.tobytes() for p in self.planes)
        return head + zeros + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        import zstandard

        magic, bits, size = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("no wavelet matrix")
        at = _HEAD.size + 8 * bits
        zeros = np.frombuffer(data[_HEAD.size : at], "<u8").tolist()
        body = zstandard.ZstdDecompressor().decompress(data[at:])
        width = (size + 7) // 8
        planes = [
            np.frombuffer(body, np.uint8, count=width, offset=i * width) for i in range(bits)
        ]
        return cls(size, planes, zeros)


SHARDS = (
    "shard long, segment int, first long, n_tokens long, doc_ids array<long>,"
    " sizes array<int>, matrix binary"
)


def _segment(shard, number, first, docs, sizes, tokens, bits) -> pa.RecordBatch:
    kind = np.uint16 if bits <= 16 else np.uint32
    matrix = WaveletMatrix.build(np.concatenate(tokens).astype(kind), bits).to_bytes()
    sizes = np.concatenate(sizes)
    ids = [i for part in docs for i in part]
    columns = {
        "shard": pa.array([shard], pa.int64()),
        "segment": pa.array([number], pa.int32()),
        "first": pa.array([first], pa.int64()),
        "n_tokens": pa.array([int(sizes.sum())], pa.int64()),
        "doc_ids": pa.array([ids], pa.list_(pa.int64())),
        "sizes": pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
        "matrix": pa.array([matrix], pa.binary()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _write_batches(path: str, end: int, segment: int):
    def run(batches):
        shard = TaskContext.get().partitionId()
        tool = encoder(path)
        bits = max(1, (len(tool.token_bytes) - 1).bit_length())
        docs, sizes, tokens = [], [], []
        number = first = held = 0
        for batch in batches:
            for a, b in slices(batch.column("text"), min(SLICE, segment * 8)):
                ids, counts = tool.encode(batch.column("text").slice(a, b - a))
                docs.append(batch.column("doc_id").slice(a, b - a).to_pylist())
                tokens.append(np.insert(ids, np.cumsum(counts), end))
                sizes.append(counts + 1)
                held += len(tokens[-1])
                if held >= segment:
                    yield _segment(shard, number, first, docs, sizes, tokens, bits)
                    number, first, held = number + 1, first + held, 0
                    docs, sizes, tokens = [], [], []
        if docs:
            yield _segment(shard, number, first, docs, sizes, tokens, bits)

    return run


def write_shards(
    docs: DataFrame, folder: str, path: str, end: int = END, segment: int = SEGMENT
) -> None:
    """Write the ids of all texts, in ascending ``doc_id`` order, as one file per shard."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("tie"),
    )
    ordered = narrow.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    made = ordered.select("doc_id", "text").mapInArrow(
        _write_batches(path, end, segment), SHARDS
    )
    made.write.option("compression", "none").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(folder)


def _document_batches(batches):
    for batch in batches:
        for row in batch.to_pylist():
            tokens = WaveletMatrix.from_bytes(row["matrix"]).decode().astype("<u4")
            sizes = np.array(row["sizes"], np.int64)
            ends = np.cumsum(sizes)
            crcs = [zlib.crc32(tokens[e - n : e]) for n, e in zip(sizes, ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sizes), row["shard"])),
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first"] + ends - sizes),
                    pa.array(sizes),
                    pa.array(crcs, pa.int64()),
                ],
                names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def _token_batches(token: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(row["matrix"])
                places = row["first"] + np.array(matrix.occurrences(token), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), row["shard"])), pa.array(places)],
                    names=["shard", "at"],
                )

    return run


def _with_start(spark: SparkSession, folder: str, found: DataFrame) -> DataFrame:
    """Add the ids before a place in the whole corpus; ``at`` counts within the shard."""
    totals = read_shards(spark, folder).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row per shard file, that is per partition of the writing job: a few MB at most.
    return found.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("at"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files."""
    found = read_shards(spark, folder).mapInArrow(
        _document_batches, "shard long, doc_id long, at long, n_tokens long, ids_crc32 long"
    )
    return _with_start(spark, folder, found).select("doc_id", "start", "n_tokens", "ids_crc32")


def find_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """Places of a token in the corpus, found by select without decoding."""
    found = read_shards(spark, folder).mapInArrow(_token_batches(token), "shard long, at long")
    return _with_start(spark, folder, found).select(F.col("start").alias("place"))


def op4_wavelet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token-shards-{uuid.uuid4().hex}"
    path = public_tokenizers.path("byte_bpe_50k.json")
    write_shards(table(spark, sf_dir, "documents"), folder, path)
    return read_documents(spark, folder)


QUERIES = {"op4_wavelet_ids": op4_wavelet_ids}
ORACLES: dict[str, str] = {}
