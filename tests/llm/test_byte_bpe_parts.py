"""A worker encodes a bounded part of a batch at a time."""

import pyarrow as pa

from pairsieve.llm import byte_bpe


def test_parts_of_a_batch_are_bounded():
    texts = ["word " * 200_000, "other " * 200_000, None, "x", "third " * 200_000]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5), pa.int64()), pa.array(texts)], names=["doc_id", "text"]
    )
    parts = list(byte_bpe._round_trip_batches(byte_bpe.vocabulary())([batch]))
    assert [p.num_rows for p in parts] == [1, 3, 1]
    whole = pa.Table.from_batches(parts).to_pydict()
    assert whole["doc_id"] == [0, 1, 2, 3, 4]
    alone = [
        next(iter(byte_bpe._round_trip_batches(byte_bpe.vocabulary())([batch.slice(i, 1)])))
        for i in range(5)
    ]
    assert whole == pa.Table.from_batches(alone).to_pydict()
