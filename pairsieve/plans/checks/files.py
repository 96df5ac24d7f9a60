"""Queries on sinks, sources and the judge's answers: written in full, read back, compared."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairsieve.operators import judging, report, sampling
from pairsieve.operators.rules import COVERAGE, RELEVANCE, SYNTAX
from pairsieve.operators.scoring import SCORE
from pairsieve.plans.checks.judge import LABELLED_SQL, _labelled
from pairsieve.plans.checks.samples import _EDGES, _H, _SPLIT, _split
from pairsieve.plans.checks.tables import registry, table
from pairsieve.plans.cleaning import coverage_only
from pairsieve.session import shared_folder
from pairsieve.sources import readers, writers

QUERIES, ORACLES, query = registry()


def _path(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Documents with a label by length and language.
_LABEL = "CASE WHEN n_chars < 300 THEN 'short' WHEN lang <> 'en' THEN 'other_language' END"
_TOTALS = f"""d AS (SELECT {_LABEL} AS noise_type FROM documents),
t AS (SELECT count(*) AS total, count(noise_type) AS removed FROM d),
b AS (SELECT noise_type, count(*) AS n FROM d WHERE noise_type IS NOT NULL GROUP BY 1)"""


def _report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.expr(_LABEL).alias("noise_type"))
    return report.report_row(docs)


@query(f"""WITH {_TOTALS} SELECT noise_type, n, total AS total_samples,
removed AS removed_samples, total - removed AS kept_samples,
printf('%.2f%%', removed * 100.0 / total) AS removal_rate FROM b, t""")
def report_json(spark, sf_dir):
    path = writers.write_report_json(_report(spark, sf_dir), _path(spark, "report-json"))
    fields = "total_samples long, removed_samples long, kept_samples long, removal_rate string"
    read = spark.read.schema(f"{fields}, breakdown map<string, long>").json(path)
    totals = ["total_samples", "removed_samples", "kept_samples", "removal_rate"]
    return read.select(F.explode("breakdown").alias("noise_type", "n"), *totals)


@query(f"""WITH {_TOTALS} SELECT unnest(['# Noise report', '- **Total samples**: ' || total,
printf('- **Removed**: %d (%.2f%%)', removed, removed * 100.0 / total),
'- **Kept**: ' || (total - removed), '- **Judge calls**: 0', '- **Judge overrides**: 0',
'## Breakdown by noise type', '| Noise type | Count |', '|---|---|']) AS line FROM t
UNION ALL SELECT '| ' || noise_type || ' | ' || n || ' |' FROM b""")
def report_markdown(spark, sf_dir):
    path = writers.write_report_markdown(_report(spark, sf_dir), _path(spark, "report-md"))
    return spark.read.text(path).filter("value <> ''").select(F.col("value").alias("line"))


@query("SELECT ' ' || p_name || ' ' AS pattern FROM part")
def pattern_lines(spark, sf_dir):
    """Blanks at both ends are kept, empty lines skipped."""
    name = F.concat(F.lit(" "), "p_name", F.lit(" "))
    lines = table(spark, sf_dir, "part").select(F.explode(F.array(name, F.lit(""))))
    path = _path(spark, "patterns")
    lines.write.text(path)
    return readers.read_patterns(spark, path)


@query("""SELECT 'docs' AS split, count(*) AS n, sum(length(text))::bigint AS src_chars,
sum(length(source))::bigint AS target_chars FROM documents
UNION ALL SELECT 'pages', count(*), sum(length(html))::bigint, sum(length(url))::bigint
FROM pages""")
def named_sets(spark, sf_dir):
    """Whole documents and pages as CSV files, read as one table."""
    docs = table(spark, sf_dir, "documents").selectExpr("text AS src_fm", "source AS target")
    pages = table(spark, sf_dir, "pages").selectExpr("html AS src_fm", "url AS target")
    sets = readers.read_named_sets(
        spark,
        docs=writers.write_csv(docs, _path(spark, "docs-csv")),
        pages=writers.write_csv(pages, _path(spark, "pages-csv")),
    )
    return sets.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(F.length("src_fm")).alias("src_chars"),
        F.sum(F.length("target")).alias("target_chars"),
    )


@query(f"WITH {_EDGES}, {_SPLIT} SELECT split, doc_id, n_chars FROM split")
def split_folders(spark, sf_dir):
    split = _split(spark, sf_dir).select("split", "doc_id", "n_chars")
    path = writers.write_splits(split, _path(spark, "splits"), "csv")
    return spark.read.schema("doc_id long, n_chars long, split string").csv(path, header=True)


@query(f"""WITH {_EDGES}, {_SPLIT} SELECT split, count(*) AS n_rows, min(n_chars)::double AS min,
max(n_chars)::double AS max FROM split GROUP BY split""")
def summary_json(spark, sf_dir):
    values = _split(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("double"))
    path = writers.write_json(sampling.split_summary(values, "n_chars"), _path(spark, "summary"))
    return spark.read.schema("split string, n_rows long, min double, max double").json(path)


@query("""SELECT event_type AS kind, event_id AS step, value AS loss FROM events""")
def event_log_lines(spark, sf_dir):
    events = table(spark, sf_dir, "events").selectExpr(
        "event_type AS kind", "event_id AS step", "value AS loss"
    )
    path = _path(spark, "event-log")
    events.write.json(path)
    return readers.read_event_log(spark, path).select("kind", "step", "loss")


@query("SELECT o_orderkey AS row_id, o_orderstatus FROM orders ORDER BY row_id LIMIT 1000")
def head_sample(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS row_id", "o_orderstatus")
    return spark.read.parquet(writers.write_head_sample(orders, _path(spark, "head")))


@query(f"SELECT doc_id FROM documents ORDER BY {_H} LIMIT 500")
def cap_rows(spark, sf_dir):
    return sampling.cap_rows(table(spark, sf_dir, "documents"), "doc_id", 500).select("doc_id")


@query("SELECT doc_id, n_chars FROM documents")
def shuffle_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sampling.shuffle_rows(docs, "doc_id")


@query(f"""{LABELLED_SQL}, g AS (SELECT CASE WHEN noise_type = 'no_relevance' THEN 1
  WHEN noise_type = 'low_coverage' THEN 2 WHEN noise_type IS NOT NULL THEN 0 END AS place FROM l),
s AS (SELECT unnest([0, 1, 2]) AS position, unnest(['syntax', 'relevance', 'coverage']) AS stage)
SELECT position, stage, (SELECT count(*) FROM g WHERE place = position) AS removed,
(SELECT count(*) FROM g WHERE place IS NULL OR place > position) AS remaining FROM s""")
def stage_remaining(spark, sf_dir):
    return report.stage_remaining(_labelled(spark, sf_dir), (SYNTAX, RELEVANCE, COVERAGE))


@query(f"""{LABELLED_SQL} SELECT noise_type, count(*) AS n FROM l
WHERE noise_type IS NOT NULL GROUP BY 1""")
def label_breakdown(spark, sf_dir):
    return report.breakdown(_labelled(spark, sf_dir))


def language_judge(prompt: str) -> str:
    """Answers by the language that the prompt names; has no answer for German."""
    if "lang-is-de" in prompt:
        raise ValueError("no answer")
    return "noise: english" if "lang-is-en" in prompt else "clean"


def _classified(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS row_id", "text AS src_fm", "'lang-is-' || lang AS target"
    )
    return docs, judging.ask(judging.route_all(docs), language_judge, tries=2, wait=0.0)


@query("""SELECT doc_id AS row_id, CASE WHEN lang = 'en' THEN 'NOISE' ELSE 'CLEAN' END AS verdict
FROM documents""")
def classify_documents(spark, sf_dir):
    docs, answers = _classified(spark, sf_dir)
    return judging.classify_answers(docs, answers, "verdict").select("row_id", "verdict")


@query("""SELECT 'classify' AS question, count(*) AS asked,
(count(*) FILTER (lang = 'de'))::bigint AS unanswered FROM documents""")
def unanswered_questions(spark, sf_dir):
    return judging.unanswered(_classified(spark, sf_dir)[1])


_SCORES = """s AS (SELECT doc_id AS row_id, least(n_chars / 1000.0, 1.0)::double AS score
FROM documents)"""


@query(f"""WITH {_SCORES} SELECT 'predictions' AS mode, count(*) AS n,
  (count(*) FILTER (score < 0.5))::bigint AS removed FROM s
UNION ALL SELECT 'labels', count(*), 0 FROM s
UNION ALL SELECT 'neither', count(*), 0 FROM s""")
def coverage_modes(spark, sf_dir):
    """Given predictions decide, then labels; without either nothing is removed."""
    docs = table(spark, sf_dir, "documents")
    plain = docs.selectExpr("doc_id AS row_id", "text AS src_fm", "string(doc_id) AS target")
    known = plain.withColumn("condition_cover_rate", F.lit(1.0))
    scores = docs.select(
        F.col("doc_id").alias("row_id"), F.least(F.col("n_chars") / 1000, F.lit(1.0)).alias(SCORE)
    )
    runs = {
        "predictions": coverage_only(plain, 0.5, predictions=scores),
        "labels": coverage_only(known, 0.5),
        "neither": coverage_only(plain, 0.5),
    }
    counts = [
        df.agg(F.count("*").alias("n"), F.count("noise_type").alias("removed")).select(
            F.lit(mode).alias("mode"), "n", "removed"
        )
        for mode, df in runs.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])
