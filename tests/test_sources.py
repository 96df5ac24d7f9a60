import json

import pytest

from pairsieve.operators import eventlog
from pairsieve.sources import readers, writers
from pairsieve.sources.schema import require_columns


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_with_commas_quotes_and_newlines(spark, tmp_path):
    text = 'src_fm,target,condition_cover_rate\n"f(a, b) { ""x""; }","t()\n{ }",0.5\n"g","h",\n'
    df = readers.read_csv_pairs(spark, _write(tmp_path / "p.csv", text))
    rows = df.collect()
    assert rows[0].src_fm == 'f(a, b) { "x"; }' and rows[0].target == "t()\n{ }"
    assert rows[0].condition_cover_rate == 0.5 and rows[1].condition_cover_rate is None


def test_csv_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_csv_pairs(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="ending .csv"):
        readers.read_csv_pairs(spark, _write(tmp_path / "p.txt", "src_fm,target\na,b\n"))
    with pytest.raises(ValueError, match="lacks target"):
        readers.read_csv_pairs(spark, _write(tmp_path / "q.csv", "src_fm,x\na,b\n"))
    bad = _write(tmp_path / "r.csv", "src_fm,target,condition_cover_rate\na,b,high\n")
    kept = readers.read_csv_pairs(spark, bad).collect()
    assert [(r.src_fm, r.condition_cover_rate) for r in kept] == [("a", None)]


def test_csv_round_trip_and_projection(spark, tmp_path):
    rows = [('say "hi",\nthere', "t", 1), ("a\\b", 'x""y', 2)]
    df = spark.createDataFrame(rows, "src_fm string, target string, extra int")
    out = writers.write_csv(df, str(tmp_path / "out"), ["src_fm", "target"])
    back = readers.read_csv_pairs(spark, out)
    assert back.columns == ["src_fm", "target"]
    assert sorted(map(tuple, back.collect())) == sorted(r[:2] for r in rows)


def test_row_ids(spark, tmp_path):
    path = _write(tmp_path / "p.csv", "src_fm,target\na,x\nb,x\nc,y\n")
    table = readers.ingest_pairs(spark, path, str(tmp_path / "t"))
    assert [r.src_fm for r in table.orderBy("row_id").collect()] == ["a", "b", "c"]
    assert [r.src_fm for r in readers.head_rows(table, 2).collect()] == ["a", "b"]
    for name in ("1", "2"):
        (tmp_path / "two").mkdir(exist_ok=True)
        _write(tmp_path / "two" / f"{name}.csv", "src_fm,target,idx\na,x,1\nb,y,2\nc,z,\n")
    two = readers.ingest_pairs(spark, str(tmp_path / "two"), str(tmp_path / "both"))
    assert len({r.row_id for r in two.collect()}) == 6
    assert len({r.source_file for r in two.collect()}) == 2
    made = readers.with_row_id(spark.createDataFrame([("a", "b")] * 3, "src_fm string, target string"))
    assert len({r.row_id for r in made.collect()}) == 3


def test_patterns(spark, tmp_path):
    path = _write(tmp_path / "d.txt", "@Get\n\n  @Post(\n")
    got = {r.pattern for r in readers.read_patterns(spark, path).collect()}
    assert got == {"@Get", "  @Post("}
    assert readers.read_patterns(spark, None) is None
    assert readers.read_patterns(spark, str(tmp_path / "none")) is None


def test_named_sets_and_splits(spark, tmp_path):
    a = _write(tmp_path / "a.csv", "src_fm,target\na,x\n")
    b = _write(tmp_path / "b.csv", "src_fm,target,idx\nb,y,1\n")
    both = readers.read_named_sets(spark, train=a, valid=b)
    assert {(r.src_fm, r.split) for r in both.collect()} == {("a", "train"), ("b", "valid")}
    for fmt in ("parquet", "csv"):
        writers.write_splits(both, str(tmp_path / fmt), fmt)
        assert (tmp_path / fmt / "split=train").exists()
    writers.write_head_sample(both, str(tmp_path / "head"), 1, ["src_fm"])
    assert spark.read.parquet(str(tmp_path / "head")).count() == 1


def test_required_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError):
        require_columns(df)


def test_event_log(spark, tmp_path):
    lines = [
        {"kind": "log", "step": 1, "epoch": 0.1, "wall_time": 1.0, "loss": 0.5},
        {"kind": "eval", "step": 2, "epoch": 0.2, "wall_time": 2.0, "eval_mae": 0.4},
        {"kind": "eval", "step": 4, "epoch": 0.4, "wall_time": 3.0, "mae": 0.3},
        {"kind": "eval", "step": 6, "epoch": 0.6, "wall_time": 4.0, "mae": 0.35},
    ]
    path = _write(tmp_path / "m.jsonl", "\n".join(json.dumps(x) for x in lines))
    log = readers.read_event_log(spark, path)
    evals = eventlog.evaluations(log, ["mae"])
    assert [r.mae for r in evals.orderBy("step").collect()] == [0.4, 0.3, 0.35]
    moves = eventlog.trajectory(evals, "mae")
    assert [r.best_so_far for r in moves.orderBy("step").collect()] == [0.4, 0.3, 0.3]
    assert eventlog.monotone_runs(moves).first().is_monotone is False
    assert {(r.kind, r.n) for r in eventlog.kind_counts(log).collect()} == {("log", 1), ("eval", 3)}
    last = eventlog.last_entries(log, 1).select("kind", "step").collect()
    assert {tuple(r) for r in last} == {("log", 1), ("eval", 6)}
