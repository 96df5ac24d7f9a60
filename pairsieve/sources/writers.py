"""Writers: pair tables, splits, predictions, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> str:
    """White space at the ends of values is kept."""
    (df.select(*columns) if columns else df).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return path


def write_parquet(df: DataFrame, path: str, columns: list[str] | None = None) -> str:
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)
    return path


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """One sub-folder per split (``split=train`` and so on)."""
    writer = df.write.mode("overwrite").partitionBy("split")
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(
        fmt
    ).save(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """Metrics, split summaries and other results of a few rows, as JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def write_head_sample(df: DataFrame, path: str, n: int = 1000, order_by=("row_id",)) -> str:
    """The first n rows, for spot checks."""
    df.orderBy(*order_by).limit(n).write.mode("overwrite").parquet(path)
    return path


def _write_line(df: DataFrame, column, path: str) -> str:
    df.select(column.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_report_json(report: DataFrame, path: str) -> str:
    """The one-row report (see operators.report) with the rate as ``xx.xx%``."""
    rate = F.format_string("%.2f%%", F.col("removal_rate") * 100)
    fields = [c for c in report.columns if c != "removal_rate"]
    return _write_line(
        report, F.to_json(F.struct(*fields, rate.alias("removal_rate"))), path
    )


def write_report_markdown(report: DataFrame, path: str) -> str:
    """Totals and a breakdown table sorted by count."""
    entries = F.sort_array(
        F.transform(
            F.map_entries("breakdown"),
            lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("name")),
        )
    )
    table = F.array_join(
        F.transform(
            entries,
            lambda e: F.concat(
                F.lit("| "), e["name"], F.lit(" | "), (-e["k"]).cast("string"), F.lit(" |")
            ),
        ),
        "\n",
    )
    text = F.concat(
        F.format_string(
            "# Noise report\n\n"
            "- **Total samples**: %d\n- **Removed**: %d (%.2f%%)\n- **Kept**: %d\n"
            "- **Judge calls**: %d\n- **Judge overrides**: %d\n\n"
            "## Breakdown by noise type\n\n| Noise type | Count |\n|---|---|\n",
            "total_samples", "removed_samples", F.col("removal_rate") * 100,
            "kept_samples", "llm_calls", "llm_overrides",
        ),
        table,
    )
    return _write_line(report, text, path)
