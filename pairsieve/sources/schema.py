"""Declared schemas and column checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the pair tables.
SRC, TARGET, LABEL = "src_fm", "target", "condition_cover_rate"
REQUIRED = (SRC, TARGET)
ROW_ID, SOURCE_FILE = "row_id", "source_file"

PAIR_FIELDS = {
    "idx": T.LongType(),
    SRC: T.StringType(),
    TARGET: T.StringType(),
    LABEL: T.DoubleType(),
    "line_cover_rate": T.DoubleType(),
    "predicted_cover_rate": T.DoubleType(),
    "pred_coverage": T.DoubleType(),
    "noise_type": T.StringType(),
    "rule_label": T.StringType(),
}

EVENT_LOG_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("epoch", T.DoubleType()),
        T.StructField("wall_time", T.DoubleType()),
        T.StructField("loss", T.DoubleType()),
        T.StructField("learning_rate", T.DoubleType()),
    ]
    + [
        T.StructField(prefix + name, T.DoubleType())
        for prefix in ("", "eval_")
        for name in ("mae", "mse", "rmse", "r2", "pearson_r", "spearman_rho")
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str] = REQUIRED) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def schema_for(header: Iterable[str]) -> T.StructType:
    """A declared schema for a file header: known columns typed, others kept as text."""
    return T.StructType(
        [T.StructField(c, PAIR_FIELDS.get(c, T.StringType())) for c in header]
    )
