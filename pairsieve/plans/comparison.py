"""Compare labelling methods with the rule labels as truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsieve.functions.text import binary_label
from pairsieve.operators import metrics, sampling
from pairsieve.operators.rules import RELEVANCE, SYNTAX, RuleOptions
from pairsieve.plans.cleaning import deduplicate, label_pairs
from pairsieve.session import stored_table


def comparison_sample(
    df: DataFrame, patterns: DataFrame | None, n: int = 500, seed: int = 42
) -> DataFrame:
    """A seeded sample of distinct pairs with ``noise_type`` and ``rule_label``."""
    picked = sampling.sample_rows(
        stored_table(deduplicate(df), "distinct_pairs"), "row_id", n, seed
    )
    labelled = label_pairs(picked, patterns, RuleOptions(stages=(SYNTAX, RELEVANCE)))
    return labelled.withColumn("rule_label", binary_label(F.col("noise_type")))


def compare_methods(labelled: DataFrame, methods: list[str], truth: str = "rule_label"):
    """One row of scores per prediction column, all from one pass over the table."""
    stacked = labelled.select(
        F.col(truth).alias("truth"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("method"), F.col(m).alias("predicted"))
                    for m in methods
                ]
            )
        ),
    )
    return metrics.confusion(
        stacked, F.col("truth") == "NOISE", F.col("predicted") == "NOISE", by=["method"]
    )
