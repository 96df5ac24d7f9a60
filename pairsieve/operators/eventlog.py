"""Training event logs: kinds, evaluation trajectory, latest entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.operators.quantiles import with_ranges


def kind_counts(log: DataFrame, kind: str = "kind") -> DataFrame:
    return log.groupBy(kind).agg(F.count("*").alias("n"))


def metric(log: DataFrame, name: str):
    """A metric under its own name or, failing that, under ``eval_`` + name."""
    present = [F.col(c) for c in (name, f"eval_{name}") if c in log.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("double")


def evaluations(log: DataFrame, names) -> DataFrame:
    """Rows of kind 'eval' with the named metrics."""
    return log.filter(F.col("kind") == "eval").select(
        "step", "epoch", *[metric(log, n).alias(n) for n in names]
    )


def trajectory(
    evals: DataFrame, value: str, order: str = "step", by=(), lower_is_better: bool = True
) -> DataFrame:
    """Add change since the previous entry, best so far, and whether this one is best.

    ``by`` names the run. A long run is cut into ranges of ``order``, so that no single
    task has to walk it: each range is handled alone, and the last and best value of the
    ranges before it are carried in.
    """
    best_of = F.min if lower_is_better else F.max
    better = F.least if lower_is_better else F.greatest
    ranged = with_ranges(evals, order)
    run = Window.partitionBy(*by).orderBy("_range")
    carried = (
        ranged.groupBy(*by, "_range")
        .agg(F.max_by(value, order).alias("_last"), best_of(value).alias("_best"))
        .select(
            *by,
            "_range",
            F.lag("_last").over(run).alias("_last"),
            best_of("_best").over(run.rowsBetween(Window.unboundedPreceding, -1)).alias("_best"),
        )
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.when(F.row_number().over(inside) == 1, F.col("_last")).otherwise(
        F.lag(value).over(inside)
    )
    return (
        ranged.join(carried, [*by, "_range"])
        .withColumn("change", F.col(value) - previous)
        .withColumn("best_so_far", better(best_of(value).over(so_far), F.col("_best")))
        .withColumn("is_best", F.col(value) == F.col("best_so_far"))
        .drop("_range", "_last", "_best")
        .select(*evals.columns, "change", "best_so_far", "is_best")
    )


def monotone_runs(moves: DataFrame, by=(), lower_is_better: bool = True) -> DataFrame:
    """(by..., entries, is_monotone): whether a trajectory never got worse."""
    worse = F.col("change") > 0 if lower_is_better else F.col("change") < 0
    return moves.groupBy(*by).agg(
        F.count("*").alias("entries"), (F.count_if(worse) == 0).alias("is_monotone")
    )


def last_entries(log: DataFrame, k: int, by=("kind",), order=("step",)) -> DataFrame:
    """The last k rows of every group; each map task keeps k of a group before the shuffle."""
    latest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return (
        log.withColumn("_r", F.row_number().over(latest))
        .filter(F.col("_r") <= k)
        .drop("_r")
    )


def latest_values(log: DataFrame, value: str, by: str = "kind", order: str = "step") -> DataFrame:
    return log.groupBy(by).agg(
        F.max(order).alias(order), F.max_by(value, order).alias(value)
    )
