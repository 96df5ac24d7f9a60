"""Queries on documents, conversations and pages: dictionary, rules, report, text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve.functions import code_structure as cs
from pairsieve.functions import text
from pairsieve.operators import dictionary, metrics, report
from pairsieve.operators.dedup import dedup_counts, keep_first
from pairsieve.operators.rules import (
    COVERAGE,
    SYNTAX,
    Rule,
    below_threshold,
    first_match,
    remove_listed,
    scanned_once,
)
from pairsieve.plans.checks.code import cells_sql, scores_sql
from pairsieve.plans.checks.tables import (
    DUCK_TOKEN,
    document_patterns,
    registry,
    scan_sql,
    table,
)
from pairsieve.session import spread_small
from pairsieve.sources.readers import head_rows

QUERIES, ORACLES, query = registry()
ACCENTS = [("À", "ÿ")]
ACCENT_SQL = "[\\x{00c0}-\\x{00ff}]"


_FIRST_DOC = "QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
_HIT = "EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))"
LABELLED_SQL = f"""unique_docs AS (SELECT * FROM documents {_FIRST_DOC}),
labelled AS (SELECT d.doc_id, CASE
  WHEN {_HIT} THEN 'dictionary_hit'
  WHEN regexp_matches(d.text, '{ACCENT_SQL}') THEN 'non_english'
  WHEN l.quality < 1 THEN 'low_quality' END AS noise_type, l.quality, l.toxic
FROM unique_docs d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def document_rules(docs, patterns):
    """Dictionary, character range and label threshold, as on code pairs."""
    flagged = dictionary.with_hit_flag(docs, "text", patterns, "_hit")
    rules = [
        Rule("dictionary_hit", SYNTAX, F.col("_hit")),
        Rule("non_english", SYNTAX, cs.in_char_ranges(F.col("text"), ACCENTS)),
        Rule("low_quality", COVERAGE, below_threshold(F.col("quality").cast("double"), 1.0)),
    ]
    return flagged, rules


def labelled_documents(spark, sf_dir):
    docs = keep_first(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"]
    )
    docs = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flagged, rules = document_rules(docs, document_patterns(spark, sf_dir))
    return flagged.select(
        "doc_id", first_match(rules).alias("noise_type"), "quality", "toxic"
    )


@query(f"WITH {LABELLED_SQL} SELECT noise_type, count(*) AS n FROM labelled GROUP BY ALL")
def noise_breakdown(spark, sf_dir):
    """Flagship: distinct documents, first-match labels of three rules, counts."""
    return report.label_counts(labelled_documents(spark, sf_dir))


@query(f"""WITH {LABELLED_SQL} SELECT count(*) AS total_samples,
count(noise_type) AS removed_samples, count(*) - count(noise_type) AS kept_samples,
(SELECT string_agg(noise_type || '=' || n, ',' ORDER BY noise_type) FROM
  (SELECT noise_type, count(*) AS n FROM labelled WHERE noise_type IS NOT NULL GROUP BY 1))
  AS breakdown,
0::bigint AS llm_calls, 0::bigint AS llm_overrides,
printf('%.2f%%', 100.0 * count(noise_type) / count(*)) AS removal_rate FROM labelled""")
def report_summary(spark, sf_dir):
    row = report.report_row(labelled_documents(spark, sf_dir))
    entries = F.array_sort(
        F.transform(
            F.map_entries("breakdown"),
            lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
        )
    )
    return row.withColumn("breakdown", F.array_join(entries, ",")).withColumn(
        "removal_rate", text.percent(F.col("removal_rate"))
    )


@query(f"""WITH {LABELLED_SQL}, s AS (SELECT noise_type,
  CASE WHEN noise_type = 'low_quality' THEN 'coverage' ELSE 'syntax' END AS stage
  FROM labelled WHERE noise_type IS NOT NULL)
SELECT stage, noise_type, count(*) AS removed FROM s GROUP BY ROLLUP (stage, noise_type)""")
def stage_funnel(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("quality", F.lit(1))
    _, rules = document_rules(docs, None)
    return report.funnel(labelled_documents(spark, sf_dir), rules)


@query(f"""WITH {LABELLED_SQL}, c AS (SELECT noise_type, count(*) AS n FROM labelled GROUP BY ALL)
SELECT noise_type, n, round(n / (SELECT sum(n) FROM c), 6) AS share
FROM c WHERE noise_type IS NOT NULL""")
def noise_shares(spark, sf_dir):
    return report.shares(labelled_documents(spark, sf_dir)).withColumn(
        "share", F.round("share", 6)
    )


@query(f"SELECT doc_id, n_chars FROM documents {_FIRST_DOC}")
def dedup_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    return keep_first(docs, "text", ["doc_id"]).select("doc_id", "n_chars")


@query("""SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after,
count(*) - count(DISTINCT text) AS duplicates FROM documents""")
def dedup_report(spark, sf_dir):
    return dedup_counts(table(spark, sf_dir, "documents").select("text"), "text")


_HITS = """hits AS (SELECT d.doc_id, p.pattern FROM documents d
JOIN (SELECT DISTINCT text AS pattern FROM benchmark) p ON contains(d.text, p.pattern))"""


@query(f"WITH {_HITS} SELECT doc_id, pattern FROM hits")
def dictionary_hits(spark, sf_dir):
    return dictionary.hits(
        table(spark, sf_dir, "documents"), "doc_id", "text", document_patterns(spark, sf_dir)
    )


@query(f"SELECT d.doc_id FROM documents d WHERE {_HIT}")
def dictionary_semi_join(spark, sf_dir):
    return dictionary.with_any_hit(
        table(spark, sf_dir, "documents"), "text", document_patterns(spark, sf_dir)
    ).select("doc_id")


@query(f"""SELECT doc_id, {_HIT} AS by_expression, {_HIT} AS by_join FROM documents d""")
def dictionary_flag_both_forms(spark, sf_dir):
    """The row-local form and the join form of the flag side by side."""
    patterns = document_patterns(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    local = dictionary.with_hit_flag(docs, "text", patterns, "by_expression", "local")
    both = dictionary.with_hit_flag(local, "text", patterns, "by_join", "join")
    return both.select("doc_id", "by_expression", "by_join")


@query("""WITH d AS (
  SELECT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 100 END AS id, text FROM documents
  UNION ALL SELECT doc_id % 100, text FROM documents)
SELECT id, pattern, count(*) AS by_broadcast, count(*) AS by_join
FROM d JOIN (SELECT DISTINCT text AS pattern FROM benchmark) p ON contains(d.text, p.pattern)
GROUP BY id, pattern""")
def dictionary_hits_both_forms(spark, sf_dir):
    """Both forms of the join, each forced, on rows with repeated and missing ids."""
    docs = table(spark, sf_dir, "documents")
    few = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 100)
    rows = docs.select(few.alias("id"), "text").union(docs.select(F.col("doc_id") % 100, "text"))
    patterns = document_patterns(spark, sf_dir)
    parts = [
        dictionary.hits(rows, "id", "text", patterns, form).withColumn("form", F.lit(form))
        for form in ("broadcast", "join")
    ]
    return (
        parts[0]
        .union(parts[1])
        .groupBy("id", "pattern")
        .agg(
            F.count_if(F.col("form") == "broadcast").alias("by_broadcast"),
            F.count_if(F.col("form") == "join").alias("by_join"),
        )
    )


# Every document gives its first line as a pattern: a large dictionary.
_PREFIXES = """SELECT DISTINCT split_part(text, chr(10), 1) AS pattern FROM documents
WHERE split_part(text, chr(10), 1) <> ''"""


@query(f"""SELECT p.pattern, count(*) AS n_texts FROM documents d
JOIN ({_PREFIXES}) p ON contains(d.text, p.pattern) GROUP BY p.pattern
ORDER BY n_texts DESC, p.pattern LIMIT 25""")
def top_patterns_large_dictionary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    line = F.substring_index("text", "\n", 1)
    patterns = docs.filter(line != "").select(line.alias("pattern")).distinct()
    return dictionary.top_patterns(dictionary.hits(docs, "doc_id", "text", patterns), 25)


@query(f"""WITH {_HITS} SELECT pattern, count(*) AS n_texts FROM hits GROUP BY pattern
ORDER BY n_texts DESC, pattern LIMIT 10""")
def top_patterns(spark, sf_dir):
    pairs = dictionary.hits(
        table(spark, sf_dir, "documents"), "doc_id", "text", document_patterns(spark, sf_dir)
    )
    return dictionary.top_patterns(pairs, 10)


@query(f"SELECT doc_id, regexp_matches(text, '{ACCENT_SQL}') AS flag FROM documents")
def char_range(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", cs.in_char_ranges(F.col("text"), ACCENTS).alias("flag")
    )


_DOC_SCAN = "d AS (SELECT doc_id AS id, text AS code FROM documents), " + scan_sql("d", "d")


@query(f"""WITH {_DOC_SCAN} SELECT doc_id, doc_id IN (SELECT id FROM d_broken WHERE broken) AS flag
FROM documents""")
def unbalanced_text(spark, sf_dir):
    """The bracket and literal part of the grammar rule, over whole documents."""
    docs = scanned_once(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        {"scan": cs.scan_code(F.col("text"))},
    )
    return docs.select("doc_id", F.col("scan.broken").alias("flag"))


@query(f"""SELECT doc_id, len(t)::bigint AS n_tokens, md5(array_to_string(t, ' ')) AS token_hash
FROM (SELECT doc_id, regexp_extract_all(text, '{DUCK_TOKEN}') AS t FROM documents)""")
def document_tokens(spark, sf_dir):
    tok = text.tokens(F.col("text"))
    return (
        spread_small(table(spark, sf_dir, "documents").select("doc_id", "text"))
        .select("doc_id", tok.alias("t"))
        .select(
            "doc_id",
            F.size("t").cast("long").alias("n_tokens"),
            F.md5(F.array_join("t", " ")).alias("token_hash"),
        )
    )


@query(f"""SELECT page_id, len(regexp_extract_all(html, '{DUCK_TOKEN}'))::bigint AS n_tokens
FROM pages""")
def page_tokens(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", text.token_count(F.col("html")).alias("n_tokens")
    )


@query(f"""SELECT doc_id, array_to_string(t[1:384], ' ') AS head, least(len(t), 384)::bigint AS n
FROM (SELECT doc_id, regexp_extract_all(text, '{DUCK_TOKEN}') AS t FROM documents)""")
def token_truncate(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", text.truncate_tokens(F.col("text"), 384).alias("t"))
        .select(
            "doc_id", F.array_join("t", " ").alias("head"), F.size("t").cast("long").alias("n")
        )
    )


@query("""SELECT doc_id, md5(substring(text, 1, 1500)) AS head,
length(substring(text, 1, 1500)) AS n FROM documents""")
def char_truncate(spark, sf_dir):
    cut = text.truncate_chars(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(cut).alias("head"), F.length(cut).cast("long").alias("n")
    )


_TURNS = """turns AS (SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user')"""


def _turns(spark, sf_dir):
    """User turns with the answer that follows (null if none does)."""
    talk = table(spark, sf_dir, "conversations")
    user = talk.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("src")
    )
    answers = talk.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return user.join(answers, ["conv_id", "turn"], "left")


@query(f"""WITH {_TURNS} SELECT conv_id, turn,
md5(coalesce(src, '') || ' [SEP] ' || coalesce(tgt, '')) AS pair FROM turns""")
def pair_text(spark, sf_dir):
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", F.md5(text.pair_text(F.col("src"), F.col("tgt"))).alias("pair")
    )


_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""WITH {_TURNS} SELECT conv_id, turn,
coalesce(len(list_intersect({_WORDS.format('src')}, {_WORDS.format('tgt')})), 0)::bigint
  AS overlap FROM turns""")
def word_overlap(spark, sf_dir):
    """Set intersection per pair, on words instead of calls."""
    def words(c):
        return F.regexp_extract_all(
            F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)
        )

    return _turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.size(F.array_intersect(words(F.col("src")), words(F.col("tgt"))))
        .cast("long").alias("overlap"),
    )


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN "
       "(SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_anti_join(spark, sf_dir):
    removed = table(spark, sf_dir, "labels").filter("toxic = 1")
    return remove_listed(table(spark, sf_dir, "documents").select("doc_id"), removed, "doc_id")


_METHODS_SQL = f"""judged AS (SELECT l.toxic = 1 AS truth, {_HIT} AS by_dictionary,
regexp_matches(d.text, '{ACCENT_SQL}') AS by_range, l.quality < 1 AS by_quality
FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _methods(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    flagged = dictionary.with_hit_flag(
        both, "text", document_patterns(spark, sf_dir), "by_dictionary"
    )
    return flagged.select(
        (F.col("toxic") == 1).alias("truth"),
        "by_dictionary",
        cs.in_char_ranges(F.col("text"), ACCENTS).alias("by_range"),
        (F.col("quality") < 1).alias("by_quality"),
    )


@query(f"WITH {_METHODS_SQL} SELECT * EXCLUDE (precision_, recall_) "
       f"FROM ({scores_sql(cells_sql('judged', 'truth', 'by_range'))})")
def confusion(spark, sf_dir):
    return metrics.confusion(_methods(spark, sf_dir), F.col("truth"), F.col("by_range"))


_TABLE_SQL = " UNION ALL ".join(
    cells_sql("judged", "truth", m).replace("SELECT ", f"SELECT '{m}' AS method, ", 1)
    for m in ("by_dictionary", "by_range", "by_quality")
)


@query(f"WITH {_METHODS_SQL} SELECT * EXCLUDE (precision_, recall_) "
       f"FROM ({scores_sql(_TABLE_SQL)})")
def method_table(spark, sf_dir):
    """Three labelling methods against one truth, all from one pass."""
    from pairsieve.plans.comparison import compare_methods

    def word(c):
        return F.when(F.col(c), F.lit("NOISE")).otherwise(F.lit("CLEAN")).alias(c)

    names = ["by_dictionary", "by_range", "by_quality"]
    labelled = _methods(spark, sf_dir).select(word("truth"), *[word(n) for n in names])
    return compare_methods(labelled, names, "truth")


@query(f"""WITH {_METHODS_SQL} SELECT count(*) AS size, (count(*) FILTER (by_range))::bigint AS noise,
round((count(*) FILTER (by_range)) / count(*), 6) AS noise_ratio FROM judged""")
def noise_ratio(spark, sf_dir):
    return metrics.noise_ratio(_methods(spark, sf_dir), F.col("by_range")).withColumn(
        "noise_ratio", F.round("noise_ratio", 6)
    )


@query(f"""WITH {LABELLED_SQL} SELECT noise_type, count(*) AS total,
(count(*) FILTER (coalesce(toxic, 0) = 0))::bigint AS missed,
round((count(*) FILTER (coalesce(toxic, 0) = 0)) / count(*), 6) AS miss_rate
FROM labelled WHERE noise_type IS NOT NULL GROUP BY noise_type""")
def miss_rate(spark, sf_dir):
    return metrics.miss_rate(
        labelled_documents(spark, sf_dir), "noise_type", F.coalesce("toxic", F.lit(0)) == 0
    ).withColumn("miss_rate", F.round("miss_rate", 6))


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 1000")
def first_rows(spark, sf_dir):
    return head_rows(table(spark, sf_dir, "documents"), 1000, ["doc_id"]).select(
        "doc_id", "source"
    )
