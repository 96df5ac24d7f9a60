"""Queries on code pairs: structure, rules, relevance, labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairsieve.functions import code_structure as cs
from pairsieve.functions.text import token_count, tokens
from pairsieve.operators import report
from pairsieve.operators.rules import (
    LABELS,
    RuleOptions,
    ablation,
    co_occurrence,
    flag_profile,
    inclusive_match,
    profile_counts,
    scanned_once,
    standard_rules,
    with_structure,
)
from pairsieve.plans.checks.tables import (
    CODE_PAIRS,
    DUCK_TOKEN,
    PATTERN,
    code_pairs,
    one_pattern,
    registry,
    scan_sql,
    table,
    TEXT_PAIRS,
    text_pairs,
)
from pairsieve.plans.cleaning import coverage_only, deduplicate, label_pairs, syntax_only
from pairsieve.sources.readers import read_csv_pairs
from pairsieve.sources.schema import PAIR_FIELDS
from pairsieve.sources.writers import write_csv
from pairsieve.session import shared_folder

THRESHOLD = 0.05
NAMES = [name for name, _ in LABELS]
QUERIES, ORACLES, query = registry()


PAIRS = f"pairs AS ({CODE_PAIRS})"
SRC_SCAN = f"{PAIRS}, src AS (SELECT row_id AS id, src_fm AS code FROM pairs), " + scan_sql("src", "s")
TGT_SCAN = "tgt AS (SELECT row_id AS id, target AS code FROM pairs), " + scan_sql("tgt", "t")
CJK = "[\\x{4e00}-\\x{9fa5}\\x{ac00}-\\x{d7ff}\\x{30a0}-\\x{30ff}\\x{3040}-\\x{309f}]"
FLAGS = f"""
flags AS (
  SELECT p.*,
    contains(src_fm, '{PATTERN}') AS unnecessary_annotations,
    regexp_matches(src_fm, '<[A-Z][A-Za-z, ]*> [A-Za-z0-9_]+ [A-Za-z0-9_]+\\(')
      AND NOT regexp_matches(src_fm, '> [A-Za-z0-9_]+ [A-Za-z0-9_]+\\(.*extends')
      AND NOT regexp_matches(src_fm, '<[^<>]*extends[^<>]*> [A-Za-z0-9_]+ [A-Za-z0-9_]+\\(')
      AS ambiguous_type,
    row_id IN (SELECT id FROM s_broken WHERE broken)
      OR row_id IN (SELECT id FROM t_broken WHERE broken)
      OR row_id IN (SELECT id FROM s_bad) OR row_id IN (SELECT id FROM t_bad)
      OR row_id IN (SELECT id FROM s_groups WHERE kind = 'declaration' AND tail = 'none')
      OR row_id IN (SELECT id FROM t_groups WHERE kind = 'declaration' AND tail = 'none')
      AS syntax_error,
    row_id IN (SELECT id FROM s_groups WHERE name = 'catch' AND is_empty)
      OR row_id IN (SELECT a.id FROM s_t a JOIN s_t b ON a.id = b.id AND b.pos = a.pos + 1
                    JOIN s_t c ON a.id = c.id AND c.pos = a.pos + 2
                    WHERE a.tok = 'finally' AND b.tok = '{{' AND c.tok = '}}')
      AS empty_exception,
    row_id IN (SELECT id FROM s_groups WHERE kind = 'declaration' AND is_empty) AS empty_method,
    regexp_matches(src_fm, '{CJK}') OR regexp_matches(target, '{CJK}') AS non_english,
    coalesce(score, 0) = 0 AS no_relevance,
    condition_cover_rate < {THRESHOLD} AS low_coverage
  FROM pairs p LEFT JOIN (
    SELECT id, count(*) AS score FROM (
      SELECT id, name, arity FROM s_groups WHERE kind = 'declaration'
      INTERSECT SELECT id, name, arity FROM t_groups WHERE kind = 'invocation')
    GROUP BY id) r ON r.id = p.row_id)"""
WITH_FLAGS = f"WITH {SRC_SCAN}, {TGT_SCAN}, {FLAGS}"


_UNIQUE = "QUALIFY row_number() OVER (PARTITION BY target ORDER BY row_id) = 1"


def case_sql(names):
    return "CASE " + " ".join(f"WHEN {n} THEN '{n}'" for n in names) + " END"


def _scanned(spark, sf_dir, **texts):
    """The pairs with a scan per name of a text column, dealt by their number."""
    pairs = code_pairs(spark, sf_dir, spread=True).select("row_id", *texts.values())
    scans = {name: cs.scan_code(F.col(column)) for name, column in texts.items()}
    return scanned_once(pairs, scans, spread=False)


@query(f"{WITH_FLAGS} SELECT row_id, syntax_error AS flag FROM flags")
def grammar_error(spark, sf_dir):
    return _scanned(spark, sf_dir, src="src_fm", tgt="target").select(
        "row_id", (cs.grammar_error(F.col("src")) | cs.grammar_error(F.col("tgt"))).alias("flag")
    )


@query(f"{WITH_FLAGS} SELECT row_id, empty_exception AS flag FROM flags")
def empty_handler(spark, sf_dir):
    scanned = _scanned(spark, sf_dir, src="src_fm")
    return scanned.select("row_id", cs.empty_handler(F.col("src")).alias("flag"))


@query(f"{WITH_FLAGS} SELECT row_id, empty_method AS flag FROM flags")
def empty_method(spark, sf_dir):
    scanned = _scanned(spark, sf_dir, src="src_fm")
    return scanned.select("row_id", cs.empty_method(F.col("src")).alias("flag"))


@query(f"{WITH_FLAGS} SELECT row_id, ambiguous_type AS flag FROM flags")
def ambiguous_type(spark, sf_dir):
    scanned = _scanned(spark, sf_dir, src="src_fm")
    return scanned.select("row_id", cs.ambiguous_type(F.col("src")).alias("flag"))


@query(f"WITH {PAIRS} SELECT row_id, regexp_matches(src_fm, '{CJK}') OR "
       f"regexp_matches(target, '{CJK}') AS flag FROM pairs")
def non_english_code(spark, sf_dir):
    return code_pairs(spark, sf_dir).select(
        "row_id",
        (cs.in_char_ranges(F.col("src_fm")) | cs.in_char_ranges(F.col("target"))).alias("flag"),
    )


@query(f"""WITH {SRC_SCAN} SELECT id AS row_id, name, arity::bigint AS arity, count(*) AS n
FROM s_groups WHERE kind = 'declaration' GROUP BY ALL""")
def declared_methods(spark, sf_dir):
    return (
        _scanned(spark, sf_dir, src="src_fm")
        .select("row_id", F.inline(cs.declared_methods(F.col("src"))))
        .groupBy("row_id", "name", F.col("arity").cast("long").alias("arity"))
        .agg(F.count("*").alias("n"))
    )


@query(f"""WITH {PAIRS}, {TGT_SCAN} SELECT id AS row_id, name, arity::bigint AS arity,
count(*) AS n FROM t_groups WHERE kind = 'invocation' GROUP BY ALL""")
def invoked_methods(spark, sf_dir):
    return (
        _scanned(spark, sf_dir, tgt="target")
        .select("row_id", F.inline(cs.invoked_methods(F.col("tgt"))))
        .groupBy("row_id", "name", F.col("arity").cast("long").alias("arity"))
        .agg(F.count("*").alias("n"))
    )


@query(r"""SELECT page_id, name, arity, count(*) AS n FROM (
  SELECT page_id, regexp_extract(call, '^([A-Za-z_]+)', 1) AS name,
    CASE WHEN call LIKE '%()' THEN 0 ELSE 1 + len(call) - len(replace(call, ',', '')) END::bigint
      AS arity
  FROM (SELECT page_id, unnest(regexp_extract_all(script, '[A-Za-z_]+\([^()]*\)')) AS call
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<script>(.*?)</script>', 1)) AS script
          FROM pages)))
GROUP BY ALL""")
def invoked_in_scripts(spark, sf_dir):
    """Calls inside the script elements of whole pages."""
    scripts = table(spark, sf_dir, "pages").select(
        "page_id",
        F.explode(
            F.regexp_extract_all("html", F.lit("<script>(.*?)</script>"), F.lit(1))
        ).alias("script"),
    )
    return (
        scripts.select("page_id", F.inline(cs.invoked_methods(cs.scan_code(F.col("script")))))
        .groupBy("page_id", "name", F.col("arity").cast("long").alias("arity"))
        .agg(F.count("*").alias("n"))
    )


@query(f"""{WITH_FLAGS}, scores AS (SELECT id, count(*) AS score FROM (
      SELECT id, name, arity FROM s_groups WHERE kind = 'declaration'
      INTERSECT SELECT id, name, arity FROM t_groups WHERE kind = 'invocation') GROUP BY id)
SELECT row_id, coalesce(score, 0) AS score FROM pairs LEFT JOIN scores ON id = row_id""")
def relevance_score(spark, sf_dir):
    return _scanned(spark, sf_dir, src="src_fm", tgt="target").select(
        "row_id",
        cs.relevance_score(F.col("src"), F.col("tgt")).cast("long").alias("score"),
    )


@query(f"""WITH {PAIRS}, k AS (SELECT row_id,
  regexp_extract_all(src_fm, '{DUCK_TOKEN}') AS t FROM pairs)
SELECT row_id, len(t)::bigint AS n_tokens, md5(array_to_string(t, ' ')) AS token_hash FROM k""")
def code_tokens(spark, sf_dir):
    return code_pairs(spark, sf_dir).select(
        "row_id",
        token_count(F.col("src_fm")).alias("n_tokens"),
        F.md5(F.array_join(tokens(F.col("src_fm")), " ")).alias("token_hash"),
    )


def _labelled(spark, sf_dir):
    return label_pairs(
        code_pairs(spark, sf_dir, spread=True), one_pattern(spark),
        RuleOptions(coverage_threshold=THRESHOLD, spread=False),
    )


@query(f"{WITH_FLAGS} SELECT row_id, {case_sql(NAMES)} AS noise_type FROM flags")
def first_match_label(spark, sf_dir):
    return _labelled(spark, sf_dir).select("row_id", "noise_type")


@query(f"""{WITH_FLAGS.replace(CODE_PAIRS, TEXT_PAIRS)}
SELECT row_id, {case_sql(NAMES)} AS noise_type FROM flags""")
def text_pairs_label(spark, sf_dir):
    """First-match labels of pairs with whole documents in their comments and literals."""
    labelled = label_pairs(
        text_pairs(spark, sf_dir), one_pattern(spark), RuleOptions(coverage_threshold=THRESHOLD)
    )
    return labelled.select("row_id", "noise_type")


@query(f"""{WITH_FLAGS.replace(CODE_PAIRS, TEXT_PAIRS)},
l AS (SELECT row_id, {case_sql(NAMES)} AS noise_type FROM (SELECT * FROM flags {_UNIQUE}))
SELECT noise_type, count(*) AS n FROM l GROUP BY noise_type""")
def clean_text_pairs_counts(spark, sf_dir):
    """The cleaning job on the same pairs, most of which are distinct."""
    pairs = deduplicate(text_pairs(spark, sf_dir))
    options = RuleOptions(coverage_threshold=THRESHOLD)
    return report.label_counts(label_pairs(pairs, one_pattern(spark), options))


def _with_rules(spark, sf_dir):
    options = RuleOptions(
        coverage_threshold=THRESHOLD, first_match_only=False, spread=False
    )
    pairs = code_pairs(spark, sf_dir, spread=True)
    prepared = with_structure(pairs, one_pattern(spark), options)
    return prepared, standard_rules(prepared, options)


@query(f"""{WITH_FLAGS} SELECT row_id,
concat_ws('|', {', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in NAMES)}) AS noise_types
FROM flags""")
def inclusive_labels(spark, sf_dir):
    prepared, rules = _with_rules(spark, sf_dir)
    return prepared.select(
        "row_id", F.array_join(inclusive_match(rules), "|").alias("noise_types")
    )


_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{n}' AS noise_type, {n} AS fires, coalesce(first = '{n}', false) AS is_first "
    "FROM firsts"
    for n in NAMES
)


@query(f"""{WITH_FLAGS}, firsts AS (SELECT *, {case_sql(NAMES)} AS first FROM flags)
SELECT noise_type, count_if(fires)::bigint AS inclusive, count_if(is_first)::bigint AS exclusive
FROM ({_UNPIVOT}) GROUP BY noise_type""")
def inclusive_counts(spark, sf_dir):
    prepared, rules = _with_rules(spark, sf_dir)
    return profile_counts(flag_profile(prepared, rules), NAMES)


_PAIR_COUNTS = " UNION ALL ".join(
    f"SELECT '{a}' AS type_a, '{b}' AS type_b, count_if({a} AND {b})::bigint AS n FROM flags"
    for i, a in enumerate(NAMES)
    for b in NAMES[i + 1:]
)


@query(f"{WITH_FLAGS} SELECT * FROM ({_PAIR_COUNTS}) WHERE n > 0")
def rule_co_occurrence(spark, sf_dir):
    prepared, rules = _with_rules(spark, sf_dir)
    return co_occurrence(flag_profile(prepared, rules), NAMES)


VARIANTS = {
    "all": [],
    "no_dictionary": ["unnecessary_annotations"],
    "no_relevance": ["no_relevance"],
    "syntax_only": ["unnecessary_annotations", "no_relevance", "low_coverage"],
}


def scores_sql(cells):
    return f"""SELECT *, round(precision_, 4) AS precision, round(recall_, 4) AS recall,
      round(CASE WHEN precision_ + recall_ = 0 THEN 0.0
            ELSE 2 * precision_ * recall_ / (precision_ + recall_) END, 4) AS f1,
      round(CASE WHEN tp + fp + fn + tn = 0 THEN 0.0
            ELSE (tp + tn) / (tp + fp + fn + tn) END, 4) AS accuracy
    FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision_,
                    CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall_
          FROM ({cells}))"""


def cells_sql(source, truth, predicted, group=""):
    comma = f"{group}, " if group else ""
    return f"""SELECT {comma}
      (count(*) FILTER (WHERE ({truth}) AND ({predicted})))::bigint AS tp,
      (count(*) FILTER (WHERE NOT ({truth}) AND ({predicted})))::bigint AS fp,
      (count(*) FILTER (WHERE ({truth}) AND NOT ({predicted})))::bigint AS fn,
      (count(*) FILTER (WHERE NOT ({truth}) AND NOT ({predicted})))::bigint AS tn
    FROM {source} {'GROUP BY ' + group if group else ''}"""


_ANY = " OR ".join(NAMES)
_ABLATION = " UNION ALL ".join(
    cells_sql("flags", _ANY, " OR ".join(n for n in NAMES if n not in off)).replace(
        "SELECT ", f"SELECT '{v}' AS variant, ", 1
    )
    for v, off in VARIANTS.items()
)


@query(f"{WITH_FLAGS} SELECT * EXCLUDE (precision_, recall_) FROM ({scores_sql(_ABLATION)})")
def rule_ablation(spark, sf_dir):
    prepared, rules = _with_rules(spark, sf_dir)
    return ablation(flag_profile(prepared, rules), NAMES, VARIANTS)


@query(f"""{WITH_FLAGS}, l AS (SELECT row_id, {case_sql(NAMES)} AS noise_type
FROM (SELECT * FROM flags {_UNIQUE}))
SELECT noise_type, count(*) AS n FROM l GROUP BY noise_type""")
def clean_pairs_counts(spark, sf_dir):
    """The whole cleaning job on pairs: duplicates out, then labels, then counts."""
    labelled = label_pairs(
        deduplicate(code_pairs(spark, sf_dir)), one_pattern(spark),
        RuleOptions(coverage_threshold=THRESHOLD),
    )
    return report.label_counts(labelled)


@query(f"""{WITH_FLAGS} SELECT {case_sql(NAMES[:6])} AS noise_type, count(*) AS n
FROM (SELECT * FROM flags {_UNIQUE}) GROUP BY 1""")
def syntax_filter_job(spark, sf_dir):
    return report.label_counts(syntax_only(code_pairs(spark, sf_dir), one_pattern(spark)))


@query(f"""{WITH_FLAGS} SELECT CASE WHEN no_relevance THEN 'no_relevance' END AS noise_type,
count(*) AS n FROM (SELECT * FROM flags {_UNIQUE}) GROUP BY 1""")
def relevance_filter_job(spark, sf_dir):
    from pairsieve.plans.cleaning import relevance_only

    return report.label_counts(relevance_only(code_pairs(spark, sf_dir)))


@query(f"""WITH {PAIRS} SELECT CASE WHEN condition_cover_rate < {THRESHOLD}
THEN 'low_coverage' END AS noise_type, count(*) AS n
FROM (SELECT * FROM pairs {_UNIQUE}) GROUP BY 1""")
def coverage_filter_job(spark, sf_dir):
    return report.label_counts(coverage_only(code_pairs(spark, sf_dir), THRESHOLD))


@query(f"""{WITH_FLAGS}, l AS (SELECT {case_sql(NAMES)} AS noise_type FROM flags),
s AS (SELECT noise_type, CASE WHEN noise_type = 'no_relevance' THEN 'relevance'
  WHEN noise_type = 'low_coverage' THEN 'coverage' ELSE 'syntax' END AS stage
  FROM l WHERE noise_type IS NOT NULL)
SELECT stage, noise_type, count(*) AS removed FROM s GROUP BY ROLLUP (stage, noise_type)""")
def code_stage_funnel(spark, sf_dir):
    return report.funnel(_labelled(spark, sf_dir))


_TIER = """CASE WHEN noise_type IS NULL THEN 'CLEAN'
  WHEN noise_type IN ('unnecessary_annotations', 'syntax_error') THEN 'DEFINITE_NOISE'
  ELSE 'PROBABLE_NOISE' END"""


@query(f"""{WITH_FLAGS}, l AS (SELECT {case_sql(NAMES)} AS noise_type FROM flags)
SELECT {_TIER} AS tier, count(*) AS n,
  (count(*) FILTER ({_TIER} <> 'CLEAN'))::bigint AS removed_aggressive,
  (count(*) FILTER ({_TIER} = 'DEFINITE_NOISE'))::bigint AS removed_conservative
FROM l GROUP BY 1""")
def noise_tiers(spark, sf_dir):
    from pairsieve.operators.rules import noise_tier, tier_removed

    tier = F.col("tier")
    return (
        _labelled(spark, sf_dir)
        .select(noise_tier(F.col("noise_type")).alias("tier"))
        .groupBy("tier")
        .agg(
            F.count("*").alias("n"),
            F.count_if(tier_removed(tier, True)).alias("removed_aggressive"),
            F.count_if(tier_removed(tier, False)).alias("removed_conservative"),
        )
    )


@query(f"""WITH {PAIRS}, {TGT_SCAN} SELECT row_id,
(count(*) FILTER (kind = 'invocation' AND name LIKE 'assert%'))::bigint AS assertions,
(count(*) FILTER (kind = 'invocation'))::bigint AS calls
FROM pairs LEFT JOIN t_groups ON id = row_id GROUP BY row_id""")
def assertion_score(spark, sf_dir):
    calls = cs.invoked_methods(F.col("tgt"))
    asserts = F.filter(calls, lambda c: F.startswith(c["name"], F.lit("assert")))
    return _scanned(spark, sf_dir, tgt="target").select(
        "row_id",
        F.size(asserts).cast("long").alias("assertions"),
        F.size(calls).cast("long").alias("calls"),
    )


@query(f"""WITH {PAIRS}, t AS (
  SELECT row_id, CASE WHEN status = 'P' THEN 'n/a' ELSE cast(condition_cover_rate AS string) END
    AS label FROM pairs)
SELECT label = 'n/a' AS unreadable, count(*) AS pairs,
  count(try_cast(label AS double)) AS labels, max(try_cast(label AS double)) AS highest
FROM t GROUP BY 1""")
def csv_bad_labels(spark, sf_dir):
    """A CSV file with labels that are no numbers keeps its rows; those labels are missing."""
    rate = F.col("condition_cover_rate").cast("string")
    label = F.when(F.col("status") == "P", F.lit("n/a")).otherwise(rate)
    pairs = code_pairs(spark, sf_dir).withColumn("rule_label", label)
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    columns = ["src_fm", "target", "condition_cover_rate", "rule_label"]
    write_csv(pairs.withColumn("condition_cover_rate", label), path, columns)
    back = read_csv_pairs(spark, path)
    return back.groupBy((F.col("rule_label") == "n/a").alias("unreadable")).agg(
        F.count("*").alias("pairs"),
        F.count("condition_cover_rate").alias("labels"),
        F.max("condition_cover_rate").alias("highest"),
    )


@query(f"WITH {PAIRS} SELECT row_id, src_fm, target, condition_cover_rate FROM pairs")
def csv_round_trip(spark, sf_dir):
    """Pairs written as CSV and read back through the validating reader."""
    pairs = code_pairs(spark, sf_dir).withColumn("idx", F.col("row_id"))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    write_csv(pairs, path, ["idx", "src_fm", "target", "condition_cover_rate"])
    back = read_csv_pairs(spark, path)
    assert back.schema["condition_cover_rate"].dataType == PAIR_FIELDS["condition_cover_rate"]
    return back.withColumnRenamed("idx", "row_id")
