"""From labelled pairs to train / valid / test, and from predictions to metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsieve.functions.text import clip
from pairsieve.operators import metrics, sampling
from pairsieve.operators.dedup import keep_first
from pairsieve.session import stored_table
from pairsieve.sources.schema import LABEL, ROW_ID, SRC, TARGET, require_columns
from pairsieve.sources.writers import write_json, write_parquet, write_splits


@dataclass
class SplitOptions:
    train: float = 0.8
    valid: float = 0.1
    seed: int = 42
    n_strata: int = 5
    clip_max: float = 1.0
    max_rows: int | None = None
    deduplicate: bool = True
    drop_repeated_edges: bool = False


def usable_rows(df: DataFrame, clip_max: float = 1.0) -> DataFrame:
    """Rows with both texts and a numeric label, the label limited to [0, clip_max].

    Only labels outside [0, 1] make the limit bite, and then it bites all of them.
    """
    require_columns(df, (SRC, TARGET, LABEL))
    number = df.withColumn(LABEL, F.col(LABEL).try_cast("double"))
    usable = number.filter(
        F.col(SRC).isNotNull() & F.col(TARGET).isNotNull()
        & F.col(LABEL).isNotNull() & ~F.isnan(LABEL)
    )
    if clip_max >= 1.0:
        # Values inside [0, 1] stay as they are either way.
        return usable.withColumn(LABEL, clip(F.col(LABEL), 0.0, clip_max))
    outside = usable.agg(
        F.coalesce(F.bool_or((F.col(LABEL) > 1.0) | (F.col(LABEL) < 0.0)), F.lit(False))
    ).scalar()
    return usable.withColumn(
        LABEL, F.when(outside, clip(F.col(LABEL), 0.0, clip_max)).otherwise(F.col(LABEL))
    )


def split_pairs(df: DataFrame, options: SplitOptions | None = None) -> DataFrame:
    """Add ``split`` to the usable, distinct rows, stratified by label quantile."""
    o = options or SplitOptions()
    if o.train + o.valid >= 1.0:
        raise ValueError("train + valid must leave room for test")
    rows = usable_rows(df, o.clip_max)
    if o.deduplicate:
        rows = keep_first(rows, TARGET)
    # Edges, counts and cut-offs each read the rows: remove duplicates once.
    rows = stored_table(rows, "distinct_pairs")
    rows = sampling.cap_rows(rows, ROW_ID, o.max_rows, o.seed)
    edges_of = sampling.distinct_edges if o.drop_repeated_edges else sampling.quantile_edges
    edges = edges_of(rows, LABEL, o.n_strata)
    strata = rows.withColumn("stratum", sampling.stratum_of(F.col(LABEL), edges))
    return sampling.stratified_split(
        strata, ROW_ID, "stratum", o.train, o.valid, o.seed, few_groups=True
    ).drop("stratum")


def write_split_job(df: DataFrame, output: str, options: SplitOptions | None = None) -> DataFrame:
    """Store the splits, then summarise the stored table."""
    write_splits(split_pairs(df, options), f"{output}/splits")
    stored = df.sparkSession.read.parquet(f"{output}/splits")
    summary = sampling.split_summary(stored, LABEL)
    write_json(summary, f"{output}/split_summary")
    write_json(
        metrics.label_audit(df, LABEL, (SRC, TARGET)), f"{output}/label_audit"
    )
    return stored


def evaluate(
    scored: DataFrame, y: str = LABEL, p: str = "predicted_cover_rate",
    threshold: float = 0.05, strict: bool = True,
) -> DataFrame:
    """One row: regression measures, rank correlation and low-label detection."""
    low = metrics.threshold_confusion(scored, y, p, threshold, strict)
    row = metrics.regression(scored, y, p)
    rho = metrics.spearman(scored, y, p)
    detail = low.select(
        F.struct(
            "threshold",
            F.struct("tp", "fp", "fn", "tn").alias("confusion"),
            F.col("precision").alias("precision_low"),
            F.col("recall").alias("recall_low"),
            F.col("f1").alias("f1_low"),
        ).alias("low")
    )
    return (
        row.withColumn("spearman_rho", rho.scalar())
        .withColumn("low", detail.scalar())
        .select(*row.columns, "spearman_rho", "low.*")
    )


def write_evaluation(scored: DataFrame, output: str, **options) -> DataFrame:
    """Store predictions, then metrics over the stored table."""
    write_parquet(scored, f"{output}/predictions")
    stored = scored.sparkSession.read.parquet(f"{output}/predictions")
    write_json(evaluate(stored, **options), f"{output}/test_metrics")
    return stored
