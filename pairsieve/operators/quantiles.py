"""Exact ranks, quantiles and summaries without a global sort in one task.

Values are counted first (a value that fills a third of the table becomes one row), cut
into ranges at approximate quantiles, and counted per range. A running total over the few
ranges plus a running total inside each range gives every value its exact rank. The counts are
stored once; their number sets how many ranges there are, so a range keeps its size as data grow.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.session import stored_table

# Ranges at least, and distinct values in a range at most (about; one task sorts a range).
RANGES = 128
PER_RANGE = 10_000_000


def range_count(values: int, per_range: int = PER_RANGE) -> int:
    """A power of two, so many that no range has more than about ``per_range`` values."""
    return max(RANGES, 1 << max(0, -(-values // per_range) - 1).bit_length())


def value_counts(
    df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """(by..., value, n): rows per value, or the sum of their ``weight``."""
    return (
        df.filter(F.col(value).isNotNull() & ~F.isnan(value))
        .groupBy(*by, F.col(value).cast("double").alias("value"))
        .agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    )


def with_ranges(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """Add ``_range``, the number of the range a value lies in, ranges of like size.

    The cuts are approximate quantiles. A value finds its range by halving the list of
    cuts; ``ranges`` is a power of two. Each step is a projection of its own, so no step
    is evaluated twice.
    """
    cuts = df.agg(
        F.percentile_approx(
            F.col(value).cast("double"),
            [i / ranges for i in range(1, ranges)],
            max(10_000, 10 * ranges),
        )
    ).scalar()
    df = df.withColumn("_cuts", cuts).withColumn("_range", F.lit(0))
    step = ranges // 2
    while step:
        passed = F.get("_cuts", F.col("_range") + (step - 1)) <= F.col(value)
        df = df.withColumn(
            "_range",
            F.col("_range") + F.when(passed, F.lit(step)).otherwise(F.lit(0)),
        )
        step //= 2
    return df.drop("_cuts")


def cumulative_counts(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    per_range: int = PER_RANGE,
) -> DataFrame:
    """(by..., value, n, before, total): occurrences of a value, rows below it, all rows."""
    counts = stored_table(value_counts(df, value, by, weight), "value-counts")
    ranges = range_count(counts.count(), per_range)
    ranged = with_ranges(counts, "value", ranges)
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most `ranges` rows per group of `by`.
    offsets = ranged.groupBy(*by, "_range").agg(F.sum("n").alias("_n")).select(
        *by,
        "_range",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias("total"),
    )
    inside = Window.partitionBy(*by, "_range").orderBy("value").rowsBetween(
        Window.unboundedPreceding, -1
    )
    joined = ranged.join(offsets if by else F.broadcast(offsets), [*by, "_range"])
    return joined.select(
        *by,
        "value",
        "n",
        (F.col("_offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"),
        "total",
    )


def average_ranks(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """(value, n, avg_rank): ties share the mean of their ranks, counted from 1."""
    return cumulative_counts(df, value, weight=weight).select(
        "value", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("avg_rank")
    )


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """One row per group with a column per named probability, linearly interpolated."""
    placed = cumulative_counts(df, value, by)

    def at(index):
        inside = (F.col("before") <= index) & (index < F.col("before") + F.col("n"))
        return F.max(F.when(inside, F.col("value")))

    columns = []
    for name, p in probs.items():
        position = F.lit(p) * (F.col("total") - 1)
        low, high = F.floor(position), F.ceil(position)
        lower, upper = at(low), at(high)
        part = F.max(position - low)
        columns.append((lower + (upper - lower) * part).alias(name))
    return placed.groupBy(*by).agg(*columns)


def approximate_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (), accuracy=10_000
) -> DataFrame:
    """The cheap form: one pass, error at most 1/accuracy of the rank."""
    return df.groupBy(*by).agg(
        *[F.percentile_approx(value, p, accuracy).alias(name) for name, p in probs.items()]
    )


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., n_rows, min, median, mean, max, std); std is the sample deviation."""
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    moments = valid.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.min(value).alias("min"),
        F.avg(value).alias("mean"),
        F.max(value).alias("max"),
        F.stddev_samp(value).alias("std"),
    )
    medians = exact_quantiles(df, value, {"median": 0.5}, by)
    if by:
        return moments.join(medians, list(by))
    return moments.withColumn("median", medians.scalar())
