"""Whole jobs: label a table of pairs, keep the clean rows, report what was removed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.operators import judging, report
from pairsieve.operators.dedup import keep_first
from pairsieve.operators.rules import (
    COVERAGE,
    RELEVANCE,
    SYNTAX,
    RuleOptions,
    first_match,
    kept,
    standard_rules,
    with_structure,
)
from pairsieve.operators.scoring import fit_scorer, join_predictions, score, score_filter
from pairsieve.sources.readers import with_row_id
from pairsieve.sources.schema import ROW_ID, SOURCE_FILE, require_columns
from pairsieve.sources.writers import write_csv, write_report_json, write_report_markdown


def _ordered(df: DataFrame) -> list[str]:
    return [c for c in (SOURCE_FILE, ROW_ID) if c in df.columns]


def deduplicate(df: DataFrame) -> DataFrame:
    """Keep the first row of every target, in file order."""
    df = with_row_id(require_columns(df))
    return keep_first(df, "target", _ordered(df))


def label_pairs(
    df: DataFrame,
    patterns: DataFrame | None = None,
    options: RuleOptions | None = None,
    keep_later_labels: bool = False,
) -> DataFrame:
    """Add ``noise_type``: the first rule that fires over all stages, null for clean rows.

    A row removed by one stage never reaches the next, so one pass with the rules of all
    stages in order gives the labels of the staged process. ``keep_later_labels`` also
    adds what the later stages alone would say, needed when a judge overrules a stage.
    """
    options = options or RuleOptions()
    columns = df.columns
    prepared = with_structure(df, patterns, options)
    rules = standard_rules(prepared, options)
    labels = {"noise_type": first_match(rules)}
    if keep_later_labels:
        labels["after_syntax"] = first_match([r for r in rules if r.stage != SYNTAX])
        labels["after_relevance"] = first_match([r for r in rules if r.stage == COVERAGE])
    return prepared.select(*columns, *[c.alias(n) for n, c in labels.items()])


@dataclass
class CleaningResult:
    labelled: DataFrame
    kept: DataFrame
    report: DataFrame


@dataclass
class CleaningOptions:
    rules: RuleOptions = field(default_factory=RuleOptions)
    skip_coverage: bool = False
    judge: Callable[[str], str] | None = None
    reflection: bool = False
    csv_output: bool = False
    # folder of answers already paid for; None: one under the output
    answer_store: str | None = None


def clean(
    pairs: DataFrame,
    output: str,
    patterns: DataFrame | None = None,
    options: CleaningOptions | None = None,
) -> CleaningResult:
    """Deduplicate, label, optionally judge, and write rows and report under ``output``.

    The labelled table is written once, in folders by label. Kept rows, prompts and the
    report are all read from it: the kept rows are one folder, the report touches only
    the label column, and a lost executor never makes the labelling run again.
    """
    options = options or CleaningOptions()
    rules = options.rules
    if options.skip_coverage:
        rules = replace(rules, stages=(SYNTAX, RELEVANCE))

    labelled = label_pairs(
        deduplicate(pairs), patterns, rules, keep_later_labels=options.judge is not None
    )
    labelled = _store(labelled, f"{output}/labelled")
    if options.judge is not None:
        labelled = _judge(labelled, output, options)

    result = CleaningResult(labelled, kept(labelled), report.report_row(labelled))
    if options.csv_output:
        columns = [c for c in pairs.columns if c in labelled.columns]
        write_csv(result.kept, f"{output}/filtered_data", columns)
    write_report_json(result.report, f"{output}/noise_report")
    write_report_markdown(result.report, f"{output}/summary")
    return result


def _store(labelled: DataFrame, path: str) -> DataFrame:
    # Null is a value of its own in partition folders, so the label itself stays a column.
    # The prefix keeps every rule name apart from the kept rows, and a text.
    label = F.coalesce(F.concat(F.lit("by-"), "noise_type"), F.lit("kept"))
    labelled.withColumn("label", label).write.mode("overwrite").partitionBy("label").parquet(path)
    stored = labelled.sparkSession.read.parquet(path)
    name = F.substring("label", 4, 1000)
    return stored.withColumn(
        "noise_type", F.when(F.col("label").startswith("by-"), name)
    ).drop("label")


def _judge(labelled: DataFrame, output: str, options: CleaningOptions) -> DataFrame:
    spark = labelled.sparkSession
    store = options.answer_store or f"{output}/paid_answers"

    def ask(routed: DataFrame, name: str) -> DataFrame:
        path = f"{output}/answers_{name}"
        answers = judging.ask_stored(routed, options.judge, store)
        answers.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    answers = ask(judging.route_syntax(labelled), "syntax")
    first = judging.apply_syntax_verdicts(
        labelled, judging.final_answers(answers), "after_syntax"
    )
    relevance = ask(judging.route_relevance(first), "relevance")
    if options.reflection:
        relevance = relevance.unionByName(
            ask(judging.route_reflection(relevance), "reflection")
        )
    judged = judging.apply_relevance_verdicts(
        first, judging.final_answers(relevance), "after_relevance"
    )
    return _store(judged, f"{output}/judged")


def syntax_only(df: DataFrame, patterns: DataFrame | None = None, **rule_options) -> DataFrame:
    """Deduplicate and apply the syntax stage alone."""
    return label_pairs(
        deduplicate(df), patterns, RuleOptions(stages=(SYNTAX,), **rule_options)
    )


def relevance_only(df: DataFrame, **rule_options) -> DataFrame:
    """Deduplicate and apply the relevance stage alone."""
    return label_pairs(deduplicate(df), None, RuleOptions(stages=(RELEVANCE,), **rule_options))


def coverage_only(
    df: DataFrame, threshold: float = 0.01, model=None, predictions: DataFrame | None = None
) -> DataFrame:
    """Deduplicate and apply the threshold stage alone.

    With a fitted model or a prediction table its score is compared, else the label
    column; without either nothing is removed.
    """
    unique = deduplicate(df)
    if model is not None:
        return score_filter(score(unique, model), threshold)
    if predictions is not None:
        return score_filter(join_predictions(unique, predictions), threshold)
    options = RuleOptions(stages=(COVERAGE,), coverage_threshold=threshold)
    rules = standard_rules(unique, options)
    return unique.withColumn("noise_type", first_match(rules))


def check_sample(
    spark: SparkSession, src: str, target: str, patterns: DataFrame | None = None
) -> str | None:
    """Label of a single pair."""
    one = spark.createDataFrame(
        [(0, src, target)], "row_id long, src_fm string, target string"
    )
    return label_pairs(one, patterns).first()["noise_type"]


__all__ = [
    "CleaningOptions", "CleaningResult", "check_sample", "clean", "coverage_only",
    "deduplicate", "fit_scorer", "label_pairs", "relevance_only", "syntax_only",
]
