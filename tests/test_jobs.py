"""Whole jobs: cleaning with and without a judge, command line, scoring, streams."""

import json

from pyspark.sql import functions as F

from pairsieve import cli
from pairsieve.operators import judging, scoring
from pairsieve.plans.cleaning import CleaningOptions, clean, coverage_only, deduplicate
from pairsieve.streaming import clean as streams
from tests.conftest import PAIRS


def test_clean_job(pairs, tmp_path):
    unique = deduplicate(pairs)
    result = clean(pairs, str(tmp_path / "out"), options=CleaningOptions(csv_output=True))
    r = result.report.first()
    expected = {}
    for row in unique.filter("expected IS NOT NULL").collect():
        expected[row.expected] = expected.get(row.expected, 0) + 1
    assert r.breakdown == expected
    assert r.total_samples == unique.count() == r.kept_samples + r.removed_samples
    assert r.llm_calls == 0
    assert result.kept.filter("expected IS NOT NULL").count() == 0
    for name in ("labelled", "filtered_data", "noise_report", "summary"):
        assert (tmp_path / "out" / name).exists()


def test_clean_job_with_judge(pairs, tmp_path):
    """The judge keeps everything it is asked about, relevance only on reflection."""

    def judge(prompt):
        if "NOISE: reason" in prompt:
            return "keep: looks fine"
        return "RELEVANT: 1" if "Think again" in prompt else "IRRELEVANT"

    plain = clean(pairs, str(tmp_path / "plain")).report.first().breakdown
    half = clean(pairs, str(tmp_path / "half"), options=CleaningOptions(judge=judge)).report.first()
    assert "syntax_error" not in half.breakdown and "empty_method" not in half.breakdown
    # Rows whose syntax label was overruled go on to the relevance stage.
    assert half.breakdown["no_relevance"] > plain["no_relevance"]
    full = clean(
        pairs, str(tmp_path / "full"), options=CleaningOptions(judge=judge, reflection=True)
    ).report.first()
    assert "no_relevance" not in full.breakdown
    assert full.llm_calls == half.llm_calls
    assert full.llm_overrides == full.llm_calls
    assert full.breakdown["ambiguous_type"] == plain["ambiguous_type"]


def test_failing_judge_has_no_answer(spark):
    prompts = spark.createDataFrame([(1, "syntax", "good"), (2, "syntax", "bad")],
                                    "row_id long, question string, prompt string")

    def judge(prompt):
        if prompt == "bad":
            raise RuntimeError("no service")
        return "KEEP"

    got = {r.row_id: r.answer for r in judging.ask(prompts, judge, tries=2, wait=0).collect()}
    assert got == {1: "KEEP", 2: None}


def test_whole_table_classification(pairs):
    asked = judging.route_all(pairs, few_shot=True)
    answers = judging.ask(asked.filter("row_id < 3"), lambda p: "this is noise", tries=1)
    labelled = judging.classify_answers(pairs, answers, "zero_shot")
    assert labelled.filter("zero_shot = 'NOISE'").count() == 3
    assert labelled.filter("zero_shot = 'CLEAN'").count() == len(PAIRS) - 3


def test_command_line(spark, tmp_path):
    csv = tmp_path / "p.csv"
    csv.write_text(
        'src_fm,target,condition_cover_rate\n"void f() { g(); }","void t() { f(); }",0.5\n'
        '"@Get void f() { g(); }","void u() { f(); }",0.5\n'
        '"void f() { g(); }","void v() { f(); }",0.001\n'
        '"void f() { g(); }","void t() { f(); }",0.9\n'
    )
    dictionary = tmp_path / "d.txt"
    dictionary.write_text("@Get\n")
    out = tmp_path / "o"
    cli.main(["clean", "--input", str(csv), "--output", str(out), "--patterns", str(dictionary), "--csv"])
    line = next((out / "noise_report").glob("part-*")).read_text()
    data = json.loads(line)
    assert data["total_samples"] == 3 and data["kept_samples"] == 1
    assert data["breakdown"] == {"unnecessary_annotations": 1, "low_coverage": 1}
    for job in ("syntax", "relevance", "coverage"):
        cli.main([job, "--input", str(csv), "--output", str(tmp_path / job)])
        assert (tmp_path / job / "filtered_data").exists()
    cli.main(["clean", "--input", str(csv), "--output", str(tmp_path / "s"), "--skip-coverage"])
    assert json.loads(next((tmp_path / "s" / "noise_report").glob("part-*")).read_text())["kept_samples"] == 3


def test_scorer(spark):
    rows = [(i, "good code" if i % 2 else "bad code", f"t{i}", float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(
        rows, "row_id long, src_fm string, target string, condition_cover_rate double"
    )
    model = scoring.fit_scorer(df, features=1 << 10)
    bare = df.drop("condition_cover_rate")
    labelled = coverage_only(bare, 0.5, model)
    low = {r.row_id for r in labelled.filter("noise_type = 'low_coverage'").collect()}
    assert low == {i for i in range(60) if i % 2 == 0}
    predictions = df.select("row_id", F.col("condition_cover_rate").alias("predicted_cover_rate"))
    assert coverage_only(bare, 0.5, predictions=predictions).filter("noise_type IS NOT NULL").count() == 30


def test_streams(spark, pairs, tmp_path):
    source = tmp_path / "in"
    pairs.withColumn("ts", F.timestamp_seconds(F.col("row_id") * 86400 + 1_700_000_000)).repartition(3).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema

    def drain(df, mode, name):
        q = (
            df.writeStream.outputMode(mode).format("memory").queryName(name)
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
        return spark.table(name)

    def read():
        return streams.read_pair_stream(spark, str(source), schema)

    kept = drain(streams.clean_stream(read()), "append", "kept")
    assert {r.row_id for r in kept.collect()} == {i for i, p in enumerate(PAIRS) if p[2] is None}
    labelled = streams.label_stream(read())
    totals = drain(streams.running_report(labelled), "complete", "totals")
    assert totals.agg(F.sum("n")).first()[0] == len(PAIRS)
    windowed = drain(streams.windowed_report(labelled, "ts"), "complete", "windowed")
    assert windowed.count() == len(PAIRS)
    unique = drain(streams.dedup_stream(read(), "ts", "900 days"), "append", "uniq")
    assert unique.count() == pairs.select("target").distinct().count()
