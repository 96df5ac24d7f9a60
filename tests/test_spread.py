"""Queries that scan every pair deal the pairs by their number, however few bytes they take."""

from functools import partial

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pairsieve import session
from pairsieve.plans.checks import code, files, judge, tables


@pytest.fixture()
def narrow(tmp_path, monkeypatch):
    """Orders in one file of one row group, and any input taken for a large one."""
    monkeypatch.setattr(session, "SMALL_PER_CORE", 0)
    orders = {"o_orderkey": list(range(40)), "o_orderstatus": ["O", "F", None, "P"] * 10}
    pq.write_table(pa.table(orders), tmp_path / "orders.parquet")
    return str(tmp_path)


def test_rows_are_counted(spark, narrow):
    orders = spark.read.parquet(f"{narrow}/orders.parquet")
    assert orders.rdd.getNumPartitions() == 1
    assert session.spread_counted(orders, 6).rdd.getNumPartitions() == 7
    assert session.spread_counted(orders).rdd.getNumPartitions() == 4
    assert session.spread_counted(orders.limit(0)).rdd.getNumPartitions() == 4
    assert sorted(session.spread_counted(orders, 6).collect()) == sorted(orders.collect())


@pytest.mark.parametrize(
    "query",
    [
        code.first_match_label, code.inclusive_labels, code.empty_handler, code.ambiguous_type,
        code.empty_method, code.assertion_score, judge.judge_triage,
    ],
)
def test_scans_do_not_follow_the_files(spark, narrow, query):
    assert query(spark, narrow).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("labelled", [code._labelled, files._labelled])
def test_labelling_does_not_follow_the_files(spark, narrow, labelled):
    assert labelled(spark, narrow).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("query", [code.first_match_label, code.empty_handler, judge.judge_triage])
def test_counted_tasks_are_kept_while_bytes_are_few(spark, tmp_path, monkeypatch, query):
    orders = {"o_orderkey": list(range(40)), "o_orderstatus": ["O", "F", None, "P"] * 10}
    pq.write_table(pa.table(orders), tmp_path / "orders.parquet")
    counted = partial(session.spread_counted, rows_per_task=6)
    monkeypatch.setattr(tables, "spread_counted", counted)
    assert query(spark, str(tmp_path)).rdd.getNumPartitions() == 7


@pytest.mark.parametrize(
    ("query", "texts"),
    [
        (code.empty_handler, 1), (code.empty_method, 1), (code.ambiguous_type, 1),
        (code.declared_methods, 1), (code.invoked_methods, 1), (code.assertion_score, 1),
        (code.relevance_score, 2), (code.grammar_error, 2),
    ],
)
def test_only_texts_that_are_read_are_scanned(spark, narrow, monkeypatch, query, texts):
    scans, scan_code = [], code.cs.scan_code
    monkeypatch.setattr(code.cs, "scan_code", lambda c: scans.append(c) or scan_code(c))
    query(spark, narrow)
    assert len(scans) == texts
