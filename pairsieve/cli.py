"""Command line: ``spark-submit -m pairsieve <job> --input ... --output ...``."""

from __future__ import annotations

import argparse
import importlib
import uuid

from pairsieve.operators import report
from pairsieve.operators.rules import RuleOptions, kept
from pairsieve.plans import cleaning, splitting
from pairsieve.session import build_session, shared_folder
from pairsieve.sources import readers, writers


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pairsieve", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("clean", "syntax", "relevance", "coverage", "split"):
        job = jobs.add_parser(name)
        job.add_argument("--input", required=True, help="CSV file, folder or parquet table")
        job.add_argument("--output", required=True)
        if name in ("clean", "syntax"):
            job.add_argument("--patterns", help="file with one literal pattern per line")
        if name in ("clean", "coverage"):
            job.add_argument("--coverage-threshold", type=float, default=0.01)
        if name == "clean":
            job.add_argument("--skip-coverage", action="store_true")
            job.add_argument("--judge", help="module:function taking a prompt, giving a text")
            job.add_argument("--reflection", action="store_true")
            job.add_argument("--csv", action="store_true", help="also write kept rows as CSV")
        if name == "coverage":
            job.add_argument("--model", help="folder of a fitted scorer")
        if name == "split":
            job.add_argument("--train-ratio", type=float, default=0.8)
            job.add_argument("--valid-ratio", type=float, default=0.1)
            job.add_argument("--n-strata", type=int, default=5)
            job.add_argument("--seed", type=int, default=42)
            job.add_argument("--clip-label-max", type=float, default=1.0)
            job.add_argument("--max-rows", type=int)
    return parser


def _load(spark, path):
    """Parquet as it is; CSV is stored with row ids first."""
    if path.endswith(".csv") or "*.csv" in path:
        return readers.ingest_pairs(spark, path, f"{shared_folder(spark)}/ingested_pairs-{uuid.uuid4().hex}")
    return readers.with_row_id(spark.read.parquet(path))


def main(argv=None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session()
    pairs = _load(spark, args.input)
    if args.job == "split":
        splitting.write_split_job(
            pairs,
            args.output,
            splitting.SplitOptions(
                args.train_ratio, args.valid_ratio, args.seed, args.n_strata,
                args.clip_label_max, args.max_rows,
            ),
        )
        return
    if args.job == "clean":
        judge = None
        if args.judge:
            module, _, function = args.judge.partition(":")
            judge = getattr(importlib.import_module(module), function)
        options = cleaning.CleaningOptions(
            RuleOptions(coverage_threshold=args.coverage_threshold),
            args.skip_coverage, judge, args.reflection, args.csv,
        )
        patterns = readers.read_patterns(spark, args.patterns)
        result = cleaning.clean(pairs, args.output, patterns, options)
        result.report.show(truncate=False)
        return
    if args.job == "syntax":
        labelled = cleaning.syntax_only(pairs, readers.read_patterns(spark, args.patterns))
    elif args.job == "relevance":
        labelled = cleaning.relevance_only(pairs)
    else:
        model = None
        if args.model:
            from pyspark.ml import PipelineModel

            model = PipelineModel.load(args.model)
        labelled = cleaning.coverage_only(pairs, args.coverage_threshold, model)
    stored = cleaning._store(labelled, f"{args.output}/labelled")
    writers.write_csv(kept(stored), f"{args.output}/filtered_data")
    report.breakdown(stored).show(truncate=False)
