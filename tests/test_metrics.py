import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairsieve.operators import metrics, report
from pairsieve.plans.comparison import compare_methods, comparison_sample
from pairsieve.plans.splitting import evaluate, write_evaluation
from pairsieve.sources import writers


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    y = rng.random(500).round(2)
    p = (y + rng.normal(scale=0.2, size=500)).round(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "y double, p double")
    return df.persist(), pd.DataFrame({"y": y, "p": p})


def test_regression_and_ranks(scored):
    df, f = scored
    r = metrics.regression(df, "y", "p").first()
    err = f.p - f.y
    assert np.isclose(r.mae, err.abs().mean()) and np.isclose(r.mse, (err**2).mean())
    assert np.isclose(r.r2, 1 - (err**2).sum() / ((f.y - f.y.mean()) ** 2).sum())
    assert np.isclose(r.pearson_r, np.corrcoef(f.y, f.p)[0, 1])
    rho = metrics.spearman(df, "y", "p").first()[0]
    assert np.isclose(rho, np.corrcoef(f.y.rank(), f.p.rank())[0, 1])


def test_constant_labels(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "y double, p double")
    r = metrics.regression(df, "y", "p").first()
    assert math.isnan(r.r2) and r.pearson_r is None
    assert metrics.spearman(df, "y", "p").first()[0] is None


def test_sweeps_agree_with_single_thresholds(scored):
    df, f = scored
    grid = [0.1, 0.5, 0.9]
    for strict in (True, False):
        rows = {r.threshold: r for r in metrics.class_sweep(df, "y", "p", grid, strict).collect()}
        for t in grid:
            one = metrics.threshold_confusion(df, "y", "p", t, strict).first()
            assert (rows[t].tp, rows[t].fp, rows[t].fn, rows[t].tn) == (one.tp, one.fp, one.fn, one.tn)
    removed = [r.removed for r in metrics.label_sweep(df, "y", grid).orderBy("threshold").collect()]
    assert removed == [int((f.y < t).sum()) for t in grid]


def test_unknown_labels_are_below_no_threshold(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,)], "y double")
    row = metrics.label_sweep(df, "y", [0.5]).first()
    assert (row.removed, row.kept) == (1, 2)


def test_scores_are_zero_when_undefined(spark):
    df = spark.createDataFrame([(False, False)], "a boolean, b boolean")
    r = metrics.confusion(df, F.col("a"), F.col("b")).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_bins_and_survey(spark, scored):
    df, f = scored
    bins = metrics.residual_bins(df, "y", "p", [0.0, 0.5, 1.0]).collect()
    assert {r.bin: r.n for r in bins} == {
        "[0, 0.5)": int((f.y < 0.5).sum()), "[0.5, 1]": int((f.y >= 0.5).sum())
    }
    lengths = spark.createDataFrame([(i,) for i in range(1, 401)], "n int")
    row = metrics.length_survey(lengths, "n").first()
    assert (row.p50, row.p95, row.max_length) == (200, 380, 384)
    assert np.isclose(row.share_over_256, 144 / 400)


def test_evaluate(scored, tmp_path):
    df, _ = scored
    named = df.select(F.col("y").alias("condition_cover_rate"), F.col("p").alias("predicted_cover_rate"))
    row = evaluate(named, threshold=0.5).first()
    assert row.n == 500 and sum(row.confusion) == 500 and row.threshold == 0.5
    write_evaluation(named, str(tmp_path), threshold=0.5)
    assert df.sparkSession.read.json(str(tmp_path / "test_metrics")).count() == 1


def test_report_numbers_and_files(spark, tmp_path):
    rows = [("syntax_error",)] * 7 + [("no_relevance",)] * 3 + [(None,)] * 90
    labelled = spark.createDataFrame(rows, "noise_type string")
    row = report.report_row(labelled)
    r = row.first()
    assert (r.total_samples, r.removed_samples, r.kept_samples, r.removal_rate) == (100, 10, 90, 0.1)
    assert r.breakdown == {"syntax_error": 7, "no_relevance": 3}
    writers.write_report_json(row, str(tmp_path / "j"))
    data = spark.read.json(str(tmp_path / "j")).first()
    assert data.removal_rate == "10.00%" and data.breakdown.syntax_error == 7
    writers.write_report_markdown(row, str(tmp_path / "m"))
    text = "\n".join(x.value for x in spark.read.text(str(tmp_path / "m")).collect())
    assert "**Kept**: 90" in text
    assert text.index("| syntax_error | 7 |") < text.index("| no_relevance | 3 |")
    steps = report.stage_remaining(labelled, ["syntax", "relevance", "coverage"]).orderBy("position")
    assert [(s.removed, s.remaining) for s in steps.collect()] == [(7, 93), (3, 90), (0, 90)]


def test_empty_report(spark):
    r = report.report_row(spark.createDataFrame([], "noise_type string")).first()
    assert (r.total_samples, r.removal_rate, r.breakdown) == (0, 0.0, {})


def test_method_comparison(pairs):
    sample = comparison_sample(pairs, None, n=20)
    assert sample.count() == 20
    tried = sample.withColumn("always", F.lit("NOISE"))
    rows = {r.method: r for r in compare_methods(tried, ["rule_label", "always"]).collect()}
    assert rows["rule_label"].f1 == 1.0 and rows["always"].recall == 1.0 and rows["always"].fn == 0
