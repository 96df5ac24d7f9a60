"""Answers paid once, row ids that do not depend on the plan, a scorer that is calibrated."""

import csv
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pairsieve.operators import judging, scoring
from pairsieve.operators.dedup import keep_first
from pairsieve.operators.sampling import sample_rows
from pairsieve.plans.cleaning import CleaningOptions, clean
from pairsieve.sources import readers


def _prompts(spark, texts):
    rows = [(i, "classify", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_id long, question string, prompt string").repartition(3)


def _judge(folder, fail=(), stop=()):
    """Writes one line per call, so that calls in other processes are counted too."""

    def judge(prompt):
        with open(f"{folder}/calls", "a") as calls:
            calls.write(json.dumps(prompt) + "\n")
        if prompt in stop:
            raise KeyboardInterrupt("no credit left")
        if prompt in fail:
            raise ValueError(prompt)
        return "KEEP " + prompt

    return judge


def _calls(folder):
    path = Path(folder) / "calls"
    return sorted(map(json.loads, path.read_text().split("\n")[:-1])) if path.exists() else []


def test_each_prompt_is_asked_once(spark, tmp_path):
    texts = [f"p{i % 7}" for i in range(60)] + [None]
    store, routed = str(tmp_path / "store"), _prompts(spark, texts)
    got = {r.row_id: r.answer for r in judging.ask_stored(routed, _judge(tmp_path), store).collect()}
    assert got == {i: t and "KEEP " + t for i, t in enumerate(texts)}
    assert _calls(tmp_path) == [f"p{i}" for i in range(7)]
    more = _prompts(spark, [*texts, "p7"])
    judging.ask_stored(more, _judge(tmp_path), store, per_wave=2).collect()
    assert _calls(tmp_path) == [f"p{i}" for i in range(8)]


@pytest.mark.parametrize("per_wave", [2, 100])
def test_a_failed_run_loses_no_answer(spark, tmp_path, per_wave):
    texts, store = [f"p{i}" for i in range(9)], str(tmp_path / "store")
    routed = _prompts(spark, texts)
    with pytest.raises(RuntimeError, match="no credit left"):
        judging.ask_stored(routed, _judge(tmp_path, stop=["p4"]), store, per_wave=per_wave)
    kept = judging.stored_answers(spark, store).count()
    assert kept == len(_calls(tmp_path)) - 1
    judging.ask_stored(routed, _judge(tmp_path, fail=["p5"]), store, tries=2, wait=0).collect()
    found = judging.ask_stored(routed, _judge(tmp_path), store)
    assert sorted(r.answer for r in found.collect()) == ["KEEP " + t for t in texts]
    calls = _calls(tmp_path)
    # the prompt that broke off and the failing one (once or twice more) only
    assert {c for c in calls if calls.count(c) > 1} <= {"p4", "p5"}


def test_no_prompts(spark, tmp_path):
    found = judging.ask_stored(_prompts(spark, []), _judge(tmp_path), str(tmp_path / "store"))
    assert found.count() == 0 and _calls(tmp_path) == []


def test_cleaning_again_costs_nothing(spark, tmp_path):
    rows = [(i, f"public int f{i}(int x) {{ return x", "t();") for i in range(3)]
    pairs = spark.createDataFrame(rows, "row_id long, src_fm string, target string")
    pairs = pairs.withColumn("target", F.concat("target", F.col("row_id").cast("string")))
    options = CleaningOptions(judge=_judge(tmp_path), answer_store=str(tmp_path / "store"))
    for run in ("one", "two"):
        result = clean(pairs, str(tmp_path / run), None, options)
        assert result.labelled.count() == 3
    calls = _calls(tmp_path)
    assert calls and len(calls) == len(set(calls))


def _csv_files(folder, parts):
    folder.mkdir()
    for i, rows in enumerate(parts):
        with open(folder / f"part-{i:03}.csv", "w", newline="") as out:
            writer = csv.writer(out)
            writer.writerow(["src_fm", "target"])
            writer.writerows(rows)
    return str(folder)


def test_row_ids_do_not_depend_on_files_or_tasks(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"void f{i}() {{\n}}", f"t{rng.randrange(40)}();") for i in range(300)]
    one = _csv_files(tmp_path / "one", [rows])
    many = _csv_files(tmp_path / "many", [rows[:7], rows[7:8], rows[8:200], [], rows[200:]])
    small = "spark.sql.files.maxPartitionBytes"
    found = []
    for path, size in ((one, "128m"), (many, "128m"), (many, "200b")):
        spark.conf.set(small, size)
        try:
            table = readers.ingest_pairs(spark, path, f"{tmp_path}/t{len(found)}")
        finally:
            spark.conf.unset(small)
        first = keep_first(table)
        sample = sample_rows(table, "row_id", 20)
        found.append(
            [
                sorted((r.row_id, r.src_fm, r.target) for r in t.collect())
                for t in (table, first, sample)
            ]
        )
    assert found[0][0] == [(i, *row) for i, row in enumerate(rows)]
    assert found[0] == found[1] == found[2]


def test_row_ids_of_split_parquet_files(spark, tmp_path):
    path, small = str(tmp_path / "p"), "spark.sql.files.maxPartitionBytes"
    rows = spark.range(0, 50_000, 1, 3).selectExpr("id AS n", "concat('f', id) AS src_fm")
    rows.write.option("parquet.block.size", 50_000).parquet(path)
    found = []
    for size in ("128m", "30000b"):
        spark.conf.set(small, size)
        try:
            df = readers.with_row_id(spark.read.parquet(path))
            found.append(sorted(map(tuple, df.select("row_id", "n").collect())))
        finally:
            spark.conf.unset(small)
    assert found[0] == found[1]
    assert [r for r, _ in found[0]] == list(range(50_000))


def test_row_ids_stay_unique_after_filters_and_joins(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(0, 1000, 1, 4).selectExpr("id AS n").write.parquet(path)
    df = spark.read.parquet(path)
    for made in (df.filter("n % 7 = 3"), df.union(df), df.join(df.withColumnRenamed("n", "m"))):
        some = made.limit(3000) if "m" in made.columns else made
        ids = [r.row_id for r in readers.with_row_id(some).collect()]
        assert ids and len(ids) == len(set(ids))


def _scored(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        good = rng.random() < 0.6
        words = rng.choices(["solid", "useful", "plain"] if good else ["junk", "spam", "plain"], k=12)
        rows.append((i, " ".join(words), "t", 1.0 if good else 0.0))
    return spark.createDataFrame(
        rows, "row_id long, src_fm string, target string, condition_cover_rate double"
    ).repartition(2)


def test_calibrated_scores_beat_the_mean_and_rise_with_the_raw_ones(spark):
    df = _scored(spark)
    error = scoring.held_out_error(df, features=1 << 8).first()
    assert error.n == 400 and error.mse < 0.3 * error.mse_of_mean
    model = scoring.fit_calibrated(df, features=1 << 8)
    raw = sorted(map(tuple, model.transform(scoring.with_pair_text(df)).select("_raw_score", scoring.SCORE).collect()))
    assert all(a[1] <= b[1] for a, b in zip(raw, raw[1:]))
    scored = scoring.score(df, model)
    assert scored.columns == [*df.columns, scoring.SCORE]


def test_labels_that_are_noise_are_not_learnt(spark):
    rng = random.Random(6)
    rows = [(i, f"w{rng.randrange(30)} x", "t", float(rng.random() < 0.5)) for i in range(300)]
    df = spark.createDataFrame(
        rows, "row_id long, src_fm string, target string, condition_cover_rate double"
    )
    error = scoring.held_out_error(df, features=1 << 8).first()
    assert error.mse > 0.9 * error.mse_of_mean
