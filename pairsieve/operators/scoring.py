"""A label-free scorer: pair text to predicted label, trained and applied by Spark ML.

It fills the place of a fine-tuned network: the threshold filter can use its score where
no label is known. Predictions of any other model can be joined in instead.

A regression's raw score is no probability of anything, so a threshold on it means little.
``fit_calibrated`` scores every training row by a model that has not seen its fold, and fits a
monotone step function of those scores to the labels (pool adjacent violators). The final
model, fitted on all rows, is read through that function, and the held-out scores tell how
good it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsieve.functions.text import clip, pair_text
from pairsieve.operators.rules import below_threshold
from pairsieve.session import stored_table
from pairsieve.sources.schema import LABEL, ROW_ID, SRC, TARGET

SCORE = "predicted_cover_rate"
_RAW = "_raw_score"
FOLDS = 3


def with_pair_text(df: DataFrame, column: str = "_text") -> DataFrame:
    return df.withColumn(column, pair_text(F.col(SRC), F.col(TARGET)))


def build_scorer(
    text: str = "_text",
    label: str = LABEL,
    features: int = 1 << 18,
    trees: bool = False,
    output: str = SCORE,
) -> Pipeline:
    """Hashed word counts, weighted by rarity, into a regression."""
    words = RegexTokenizer(
        inputCol=text, outputCol="_words", pattern=r"[A-Za-z_$][A-Za-z0-9_$]*",
        gaps=False, toLowercase=False,
    )
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    weights = IDF(inputCol="_tf", outputCol="_features", minDocFreq=2)
    common = {"featuresCol": "_features", "labelCol": label, "predictionCol": output}
    model = (
        GBTRegressor(maxIter=20, seed=42, **common)
        if trees
        else LinearRegression(maxIter=20, regParam=0.1, solver="l-bfgs", **common)
    )
    return Pipeline(stages=[words, counts, weights, model])


def _labelled(train: DataFrame, label: str) -> DataFrame:
    """Rows with a known label, limited to [0, 1]."""
    ready = with_pair_text(train).withColumn(label, clip(F.col(label).cast("double")))
    return ready.filter(F.col(label).isNotNull() & ~F.isnan(label))


def fit_scorer(train: DataFrame, label: str = LABEL, **options) -> PipelineModel:
    """Fit on rows with a known label, limited to [0, 1]."""
    ready = _labelled(train, label)
    return build_scorer(label=label, **options).fit(ready.select("_text", label))


def held_out_scores(
    train: DataFrame, label: str = LABEL, folds: int = FOLDS, **options
) -> DataFrame:
    """(row_id, fold, label, raw score) of every labelled row, by a model without its fold.

    Folds go by the text, so that copies of a row never stand on both sides.
    """
    fold = F.pmod(F.xxhash64("_text"), F.lit(folds)).cast("int")
    ready = _labelled(train, label).select(ROW_ID, "_text", label, fold.alias("fold"))
    ready = stored_table(ready, "scorer-folds")
    parts = []
    for k in range(folds):
        model = build_scorer(label=label, output=_RAW, **options).fit(
            ready.filter(F.col("fold") != k).select("_text", label)
        )
        parts.append(model.transform(ready.filter(F.col("fold") == k)))
    scored = reduce(DataFrame.union, [p.select(ROW_ID, "fold", label, _RAW) for p in parts])
    return stored_table(scored, "held-out-scores")


def fit_calibrated(
    train: DataFrame, label: str = LABEL, folds: int = FOLDS, **options
) -> PipelineModel:
    """A scorer whose score is a monotone function of the raw one, fitted to held-out rows."""
    held = held_out_scores(train, label, folds, **options)
    steps = IsotonicRegression(featuresCol=_RAW, labelCol=label, predictionCol=SCORE).fit(held)
    ready = _labelled(train, label)
    model = build_scorer(label=label, output=_RAW, **options).fit(ready.select("_text", label))
    return PipelineModel([*model.stages, steps])


def held_out_error(
    train: DataFrame, label: str = LABEL, folds: int = FOLDS, **options
) -> DataFrame:
    """One row: n, mse of calibrated held-out scores, mse of the constant mean.

    The calibration of each fold is fitted to the other folds' scores, so that neither the
    model nor the steps have seen the row they are judged by.
    """
    held = held_out_scores(train, label, folds, **options)
    parts = []
    for k in range(folds):
        steps = IsotonicRegression(featuresCol=_RAW, labelCol=label, predictionCol=SCORE)
        rest = held.filter(F.col("fold") != k)
        mean = rest.agg(F.avg(label)).first()[0]
        scored = steps.fit(rest).transform(held.filter(F.col("fold") == k))
        parts.append(scored.withColumn("_mean", F.lit(mean)))
    every = reduce(DataFrame.union, parts)
    y = F.col(label)
    return every.agg(
        F.count("*").alias("n"),
        F.avg(F.pow(F.col(SCORE) - y, 2)).alias("mse"),
        F.avg(F.pow(F.col("_mean") - y, 2)).alias("mse_of_mean"),
    )


def score(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the score, limited to [0, 1]."""
    scored = model.transform(with_pair_text(df))
    return scored.drop("_text", "_words", "_tf", "_features", _RAW).withColumn(
        SCORE, clip(F.col(SCORE))
    )


def join_predictions(df: DataFrame, predictions: DataFrame, score_col: str = SCORE) -> DataFrame:
    """Align predictions of another model by row id."""
    return df.join(predictions.select(ROW_ID, score_col), ROW_ID)


def score_filter(df: DataFrame, threshold: float, score_col: str = SCORE) -> DataFrame:
    """Label rows whose score is strictly below the threshold; no score, no removal."""
    if score_col not in df.columns:
        return df.withColumn("noise_type", F.lit(None).cast("string"))
    return df.withColumn(
        "noise_type",
        F.when(below_threshold(F.col(score_col), threshold), F.lit("low_coverage")),
    )
