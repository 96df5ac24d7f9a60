"""Registered stream queries over tables of one file and of a folder of files."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pairsieve.plans.checks.streams import QUERIES

TEXTS = ["plain words", "holds the secret phrase inside", "café au lait", None, "more words"]


def _write(path, columns, parts):
    """One file, or a folder with the rows dealt over several."""
    if not parts:
        pq.write_table(pa.table(columns), path)
        return
    path.mkdir()
    for i in range(parts):
        some = {name: values.slice(i * 3, 3) for name, values in columns.items()}
        pq.write_table(pa.table(some), path / f"part-{i}.parquet")


@pytest.mark.parametrize("parts", [0, 2])
def test_stream_reads_files_and_folders(spark, tmp_path, parts):
    ids = pa.array(range(len(TEXTS)), pa.int64())
    _write(tmp_path / "documents.parquet", {"doc_id": ids, "text": pa.array(TEXTS)}, parts)
    _write(tmp_path / "benchmark.parquet", {"text": pa.array(["secret phrase"])}, 0)
    # a neighbour that is not the table
    _write(tmp_path / "documents.parquet.old", {"doc_id": ids, "text": pa.array(TEXTS)}, 0)
    for name in ("stream_clean", "stream_clean_joined_dictionary"):
        got = sorted(r.doc_id for r in QUERIES[name](spark, str(tmp_path)).collect())
        assert got == [0, 3, 4], name


def test_stream_of_an_empty_folder(spark, tmp_path, monkeypatch):
    from pairsieve.plans.checks import streams as checks

    (tmp_path / "documents.parquet").mkdir()
    _write(tmp_path / "benchmark.parquet", {"text": pa.array(["secret phrase"])}, 0)
    known = checks.table

    def table(spark, sf_dir, name):
        if name == "documents":
            return spark.createDataFrame([], "doc_id long, text string")
        return known(spark, sf_dir, name)

    monkeypatch.setattr(checks, "table", table)
    got = QUERIES["stream_clean_joined_dictionary"](spark, str(tmp_path))
    assert got.columns == ["doc_id"] and got.count() == 0
