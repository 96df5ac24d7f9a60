"""Classification and regression measures, each one aggregation over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsieve.functions.text import ratio
from pairsieve.operators.quantiles import average_ranks, exact_quantiles
from pairsieve.session import stored_table


def _scores(tp: Column, fp: Column, fn: Column, tn: Column, digits: int | None = 4):
    """precision, recall, f1 and accuracy columns; 0.0 where undefined."""
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    values = {
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
    }
    return [(F.round(v, digits) if digits else v).alias(k) for k, v in values.items()]


def confusion(
    df: DataFrame,
    truth: Column,
    predicted: Column,
    by: Sequence[str] = (),
    digits: int | None = 4,
    weight: Column | None = None,
) -> DataFrame:
    """tp, fp, fn, tn and the scores. ``truth`` and ``predicted`` are boolean (noise?).

    ``weight`` says how many rows a row stands for, if the table is already counted.
    """
    one = F.lit(1) if weight is None else weight

    def cell(condition, name):
        return F.coalesce(F.sum(F.when(condition, one)), F.lit(0)).cast("long").alias(name)

    cells = df.groupBy(*by).agg(
        cell(truth & predicted, "tp"),
        cell(~truth & predicted, "fp"),
        cell(truth & ~predicted, "fn"),
        cell(~truth & ~predicted, "tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cells.select("*", *_scores(tp, fp, fn, tn, digits))


def _low(value: Column, threshold: float, strict: bool) -> Column:
    low = value < F.lit(threshold) if strict else value <= F.lit(threshold)
    return F.coalesce(low & ~F.isnan(value), F.lit(False))


def threshold_confusion(
    df: DataFrame, y: str, p: str, threshold: float, strict: bool = True
) -> DataFrame:
    """Confusion where 'positive' means below the threshold (or at it, if not strict)."""
    return confusion(
        df,
        _low(F.col(y), threshold, strict),
        _low(F.col(p), threshold, strict),
        digits=None,
    ).withColumn("threshold", F.lit(threshold))


def _both_known(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.filter(
        F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    )


def regression(df: DataFrame, y: str, p: str, tiny: float = 0.0) -> DataFrame:
    """n, mae, mse, rmse, r2, pearson_r in one pass.

    r2 is NaN if the labels do not vary (total squares at most ``tiny``), pearson_r is
    null if either side does not vary.
    """
    error = F.col(p) - F.col(y)
    sums = _both_known(df, y, p).agg(
        F.count("*").alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.var_pop(y).alias("var_y"),
        F.stddev_pop(p).alias("std_p"),
        F.covar_pop(p, y).alias("cov"),
    )
    varies = (F.sqrt("var_y") > 1e-9) & (F.col("std_p") > 1e-9)
    spread = F.nullif(F.sqrt("var_y") * F.col("std_p"), F.lit(0.0))
    return sums.select(
        "n",
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        F.when(
            F.col("var_y") * F.col("n") > F.lit(tiny),
            1 - F.col("mse") / F.nullif("var_y", F.lit(0.0)),
        ).otherwise(F.lit(float("nan"))).alias("r2"),
        F.when(varies, F.col("cov") / spread).alias("pearson_r"),
    )


def spearman(df: DataFrame, y: str, p: str) -> DataFrame:
    """Correlation of average ranks.

    Rows are counted per (y, p) once and stored, so repeated pairs travel once and both rank
    tables read the counts; a y value with very many different p is left to the adaptive
    skew join.
    """
    known = _both_known(df, y, p).select(
        F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")
    )
    pairs = stored_table(known.groupBy("y", "p").agg(F.count("*").alias("w")), "rank-pairs")
    rank_y = average_ranks(pairs, "y", "w").select(
        F.col("value").alias("y"), F.col("avg_rank").alias("ry")
    )
    rank_p = average_ranks(pairs, "p", "w").select(
        F.col("value").alias("p"), F.col("avg_rank").alias("rp")
    )
    # Ranks are centred first: sums of large ranks would lose digits.
    n = pairs.agg(F.sum("w")).scalar()
    ranked = pairs.join(rank_y, "y").join(rank_p, "p").select(
        "w",
        (F.col("ry") - (n + 1) / 2).alias("a"),
        (F.col("rp") - (n + 1) / 2).alias("b"),
    )
    sums = ranked.agg(
        F.sum(F.col("w") * F.col("a") * F.col("b")).alias("ab"),
        F.sum(F.col("w") * F.col("a") * F.col("a")).alias("aa"),
        F.sum(F.col("w") * F.col("b") * F.col("b")).alias("bb"),
    )
    spread = F.sqrt("aa") * F.sqrt("bb")
    return sums.select(
        F.when(spread > 0, F.col("ab") / F.nullif(spread, F.lit(0.0))).alias("spearman_rho")
    )


def _step(value: Column, thresholds: Sequence[float], strict: bool) -> Column:
    """How many thresholds a value is *not* below; null and NaN are below none."""
    passed = sum(
        ((value >= F.lit(t)) if strict else (value > F.lit(t))).cast("int")
        for t in thresholds
    )
    return F.coalesce(passed, F.lit(len(thresholds)))


def _grid(thresholds: Sequence[float]) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold"))
            for i, t in enumerate(thresholds)
        ]
    )


def label_sweep(df: DataFrame, y: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, removed, removed_pct, kept) of the strict threshold filter.

    Rows are counted per step between thresholds first; the grid only meets those counts.
    """
    thresholds = sorted(thresholds)
    steps = df.groupBy(_step(F.col(y), thresholds, True).alias("step")).agg(
        F.count("*").alias("n")
    )
    below = F.coalesce(F.sum(F.when(F.col("step") <= F.col("i"), F.col("n"))), F.lit(0))
    return (
        steps.select("step", "n", F.inline(_grid(thresholds)))
        .groupBy("threshold")
        .agg(below.alias("removed"), F.sum("n").alias("total"))
        .select(
            "threshold",
            "removed",
            (ratio(F.col("removed"), F.col("total")) * 100).alias("removed_pct"),
            (F.col("total") - F.col("removed")).alias("kept"),
        )
    )


def class_sweep(
    df: DataFrame, y: str, p: str, thresholds: Sequence[float], strict: bool = True
) -> DataFrame:
    """Per threshold: positives, positives_pct, confusion cells and scores."""
    thresholds = sorted(thresholds)
    cells = df.groupBy(
        _step(F.col(y), thresholds, strict).alias("sy"),
        _step(F.col(p), thresholds, strict).alias("sp"),
    ).agg(F.count("*").alias("n"))
    true_low, pred_low = F.col("sy") <= F.col("i"), F.col("sp") <= F.col("i")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    sums = (
        cells.select("sy", "sp", "n", F.inline(_grid(thresholds)))
        .groupBy("threshold")
        .agg(
            total(true_low).alias("positives"),
            F.sum("n").alias("_n"),
            total(true_low & pred_low).alias("tp"),
            total(~true_low & pred_low).alias("fp"),
            total(true_low & ~pred_low).alias("fn"),
            total(~true_low & ~pred_low).alias("tn"),
        )
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return sums.select(
        "threshold",
        "positives",
        F.round(ratio(F.col("positives"), F.col("_n")) * 100, 2).alias("positives_pct"),
        "tp", "fp", "fn", "tn",
        *_scores(tp, fp, fn, tn)[:3],
    )


def bin_label(value: Column, edges: Sequence[float]) -> Column:
    """Text of the bin ``[a, b)`` a value falls in, the last one closed; null outside."""
    chain = F.lit(None).cast("string")
    last = len(edges) - 2
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        upper = value <= F.lit(b) if i == last else value < F.lit(b)
        text = f"[{a:g}, {b:g}" + ("]" if i == last else ")")
        chain = F.when((value >= F.lit(a)) & upper, F.lit(text)).otherwise(chain)
    return chain


def residual_bins(df: DataFrame, y: str, p: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n, pct, mean_y, mean_pred, mae, bias) by true value."""
    error = F.col(p) - F.col(y)
    binned = _both_known(df, y, p).groupBy(bin_label(F.col(y), edges).alias("bin")).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("mean_y"),
        F.avg(p).alias("mean_pred"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error).alias("bias"),
    )
    total = binned.agg(F.sum("n")).scalar()
    return binned.filter(F.col("bin").isNotNull()).select(
        "bin", "n", (ratio(F.col("n"), total) * 100).alias("pct"),
        "mean_y", "mean_pred", "mae", "bias",
    )


def relative_error(df: DataFrame, y: str, p: str) -> DataFrame:
    """n, y_mean, y_std, mae, and mae in percent of the mean label."""
    return (
        _both_known(df, y, p)
        .agg(
            F.count("*").alias("n"),
            F.avg(y).alias("y_mean"),
            F.stddev_samp(y).alias("y_std"),
            F.avg(F.abs(F.col(p) - F.col(y))).alias("mae"),
        )
        .withColumn("relative_mae_pct", ratio(F.col("mae"), F.col("y_mean")) * 100)
    )


def miss_rate(df: DataFrame, noise_type: str, predicted_clean: Column) -> DataFrame:
    """(noise_type, total, missed, miss_rate): noise a method let through, per type."""
    return (
        df.filter(F.col(noise_type).isNotNull())
        .groupBy(noise_type)
        .agg(F.count("*").alias("total"), F.count_if(predicted_clean).alias("missed"))
        .withColumn("miss_rate", ratio(F.col("missed"), F.col("total")))
    )


def noise_ratio(df: DataFrame, is_noise: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("size"),
        F.count_if(is_noise).alias("noise"),
    ).withColumn("noise_ratio", ratio(F.col("noise"), F.col("size")))


def length_survey(df: DataFrame, length: str, limits=(256, 384, 512)) -> DataFrame:
    """Length percentiles, share of rows over each limit, and the limit to use.

    The smallest limit that holds the 95th percentile is chosen, else the largest one.
    Percentiles are cut to whole numbers.
    """
    probs = {"p50": 0.5, "p80": 0.8, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    quantiles = exact_quantiles(df, length, probs).select(
        *[F.floor(c).cast("long").alias(c) for c in probs]
    )
    shares = df.agg(
        F.count(length).alias("n"),
        F.min(length).cast("long").alias("min"),
        F.max(length).cast("long").alias("max"),
        F.avg(length).alias("mean"),
        *[
            F.avg((F.col(length) > n).cast("int")).alias(f"share_over_{n}") for n in limits
        ],
    )
    decided = F.lit(limits[-1])
    for n in reversed(limits[:-1]):
        decided = F.when(F.col("p95") <= n, F.lit(n)).otherwise(decided)
    row = quantiles.select(F.struct(*probs).alias("q")).scalar()
    return shares.withColumn("q", row).select(*shares.columns, "q.*").withColumn(
        "max_length", decided
    )


def label_audit(df: DataFrame, label: str, required: Sequence[str] = ()) -> DataFrame:
    """One row: rows dropped for missing or non-numeric labels, rows above 1, below 0."""
    number = F.col(label).try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number)
    for c in required:
        usable = usable & F.col(c).isNotNull()
    return df.agg(
        F.count("*").alias("rows_total"),
        F.count_if(~usable).alias("rows_dropped_na"),
        F.count_if(usable & (number > 1.0)).alias("rows_above_one"),
        F.count_if(usable & (number < 0.0)).alias("rows_below_zero"),
    )


def method_table(results: dict[str, DataFrame]) -> DataFrame:
    """Confusion rows of several methods under each other."""
    merged = None
    for name, frame in results.items():
        named = frame.select(F.lit(name).alias("method"), "*")
        merged = named if merged is None else merged.unionByName(named)
    return merged
