"""Queries on judge routing. Verdicts are derived from the order status and the row id."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pairsieve.functions import prompts, text
from pairsieve.functions import code_structure as cs
from pairsieve.operators import judging, report, scoring
from pairsieve.operators.rules import RuleOptions, scanned_once
from pairsieve.plans.checks.code import NAMES, THRESHOLD, WITH_FLAGS, case_sql
from pairsieve.plans.checks.documents import _TURNS, _turns
from pairsieve.plans.checks.tables import (
    CODE_PAIRS,
    DUCK_TOKEN,
    code_pairs,
    one_pattern,
    registry,
    table,
)
from pairsieve.plans.cleaning import label_pairs
from pairsieve.plans.comparison import comparison_sample
from pairsieve.plans.splitting import evaluate, write_evaluation
from pairsieve.session import shared_folder, stored_table

QUERIES, ORACLES, query = registry()

_SYNTAX_ANSWER = "CASE WHEN status = 'O' THEN 'keep: fine' ELSE 'NOISE: broken' END"
_FIRST_ANSWER = "CASE WHEN row_id % 3 = 0 THEN ' relevant: wrapper' ELSE 'IRRELEVANT: no' END"
_SECOND_ANSWER = "CASE WHEN row_id % 5 = 0 THEN 'RELEVANT: rule 2' ELSE 'irrelevant' END"

LABELLED_SQL = f"""{WITH_FLAGS}, l AS (SELECT row_id, status, src_fm,
  {case_sql(NAMES)} AS noise_type, {case_sql(NAMES[6:])} AS after_syntax,
  {case_sql(NAMES[7:])} AS after_relevance FROM flags)"""
JUDGED_SQL = f"""{LABELLED_SQL}, s AS (SELECT *,
  noise_type IN ('syntax_error', 'empty_method') AS asked1,
  noise_type IN ('syntax_error', 'empty_method') AND status = 'O' AS over1 FROM l),
m AS (SELECT *, CASE WHEN over1 THEN after_syntax ELSE noise_type END AS label1 FROM s),
r AS (SELECT *, coalesce(label1 = 'no_relevance', false) AS asked2,
  coalesce(label1 = 'no_relevance', false) AND (row_id % 3 = 0 OR row_id % 5 = 0) AS over2 FROM m),
final AS (SELECT row_id, CASE WHEN over2 THEN after_relevance ELSE label1 END AS noise_type,
  coalesce(asked1, false)::int + asked2::int AS judged,
  coalesce(over1, false)::int + over2::int AS overridden FROM r)"""


def _labelled(spark, sf_dir):
    """Stored once, as the cleaning job does before it asks a judge."""
    labelled = label_pairs(
        code_pairs(spark, sf_dir, spread=True), one_pattern(spark),
        RuleOptions(coverage_threshold=THRESHOLD, spread=False), keep_later_labels=True,
    )
    return stored_table(labelled, "labelled")


def _answers(routed, labelled, answer):
    return (
        routed.select("row_id", "question")
        .join(labelled.select("row_id", "status"), "row_id")
        .select("row_id", "question", F.expr(answer).alias("answer"))
    )


def _judged(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    answers = _answers(judging.route_syntax(labelled), labelled, _SYNTAX_ANSWER)
    first = judging.apply_syntax_verdicts(
        labelled, judging.final_answers(answers), "after_syntax"
    )
    relevance = _answers(judging.route_relevance(first), labelled, _FIRST_ANSWER)
    second = _answers(judging.route_reflection(relevance), labelled, _SECOND_ANSWER)
    verdicts = judging.final_answers(relevance.unionByName(second))
    return judging.apply_relevance_verdicts(first, verdicts, "after_relevance")


@query(f"""{LABELLED_SQL} SELECT row_number() OVER (ORDER BY count(*) DESC, noise_type) AS position,
noise_type, count(*) AS n FROM l WHERE noise_type IS NOT NULL GROUP BY noise_type""")
def label_breakdown_in_order(spark, sf_dir):
    ranked = report.ranked_breakdown(_labelled(spark, sf_dir))
    return ranked.withColumn("position", F.col("position").cast("long"))


@query(f"""{LABELLED_SQL} SELECT row_id, CASE WHEN noise_type = 'no_relevance' THEN 'relevance'
ELSE 'syntax' END AS question FROM l
WHERE noise_type IN ('syntax_error', 'empty_method', 'no_relevance')""")
def route(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    both = judging.route_syntax(labelled).unionByName(judging.route_relevance(labelled))
    return both.select("row_id", "question")


@query(f"""{JUDGED_SQL} SELECT row_id, noise_type, judged::bigint AS judged,
overridden::bigint AS overridden FROM final""")
def apply_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select(
        "row_id", "noise_type", F.col("judged").cast("long").alias("judged"),
        F.col("overridden").cast("long").alias("overridden"),
    )


@query(f"""{JUDGED_SQL} SELECT sum(judged)::bigint AS llm_calls,
sum(overridden)::bigint AS llm_overrides FROM final""")
def judge_counters(spark, sf_dir):
    return judging.counters(_judged(spark, sf_dir))


@query(f"{JUDGED_SQL} SELECT noise_type, count(*) AS n FROM final GROUP BY noise_type")
def judged_breakdown(spark, sf_dir):
    return report.label_counts(_judged(spark, sf_dir))


_BOTH = f"""b AS (SELECT row_id,
  CASE WHEN row_id % 3 = 0 THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS before,
  CASE WHEN row_id % 3 = 0 OR row_id % 5 = 0 THEN 'RELEVANT' ELSE 'IRRELEVANT' END AS after
  FROM l WHERE noise_type = 'no_relevance')"""


@query(f"""{LABELLED_SQL}, {_BOTH} SELECT count(*) AS total,
(count(*) FILTER (before <> after))::bigint AS total_changes,
(count(*) FILTER (before = 'IRRELEVANT' AND after = 'RELEVANT'))::bigint AS rescued,
(count(*) FILTER (before = 'RELEVANT' AND after = 'IRRELEVANT'))::bigint AS reversed,
(count(*) FILTER (before = 'RELEVANT'))::bigint AS relevant_before,
(count(*) FILTER (after = 'RELEVANT'))::bigint AS relevant_after,
round(100 * (count(*) FILTER (before <> after)) / count(*), 1) AS change_rate FROM b""")
def judge_compare(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    first = _answers(judging.route_relevance(labelled), labelled, _FIRST_ANSWER)
    second = _answers(judging.route_reflection(first), labelled, _SECOND_ANSWER)
    before = judging.final_answers(first).select("row_id", F.col("relevance").alias("before"))
    after = judging.final_answers(first.unionByName(second)).select(
        "row_id", F.col("relevance").alias("after")
    )
    return judging.compare_verdicts(before.join(after, "row_id"), "before", "after")


def _prompt_sql(template, **fields):
    out = template.replace("'", "''")
    for name, sql in fields.items():
        out = out.replace("{" + name + "}", f"' || coalesce({sql}, '') || '")
    return f"md5('{out}')"


@query(f"""WITH {_TURNS} SELECT conv_id, turn,
{_prompt_sql(prompts.CONFIRM_SYNTAX, noise_type="'syntax_error'",
             rule_result="'Detected syntax_error in focal method'", code="src")} AS confirm,
{_prompt_sql(prompts.JUDGE_RELEVANCE, src_fm="src", target="tgt")} AS relevance,
{_prompt_sql(prompts.REFLECT, answer="tgt")} AS reflection,
{_prompt_sql(prompts.CLASSIFY, src_fm="src[:1500]", target="tgt[:1500]")} AS zero_shot,
{_prompt_sql(prompts.CLASSIFY_EXAMPLES + prompts.CLASSIFY, src_fm="src[:1500]",
             target="tgt[:1500]")} AS few_shot
FROM turns""")
def render_prompts(spark, sf_dir):
    src, tgt = F.col("src"), F.col("tgt")
    return _turns(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.md5(prompts.confirm_syntax_prompt(src, F.lit("syntax_error"))).alias("confirm"),
        F.md5(prompts.relevance_prompt(src, tgt)).alias("relevance"),
        F.md5(prompts.reflection_prompt(tgt)).alias("reflection"),
        F.md5(prompts.classify_prompt(src, tgt)).alias("zero_shot"),
        F.md5(prompts.classify_prompt(src, tgt, few_shot=True)).alias("few_shot"),
    )


# Turns serve as answers; some are given the words the parsers look for.
_ANSWER = """CASE conv_id % 5 WHEN 0 THEN concat('  keep: ', text) WHEN 1 THEN
concat('RELEVANT ', text) WHEN 2 THEN concat(text, ' noise') WHEN 3 THEN NULL ELSE text END"""


@query(f"""SELECT conv_id, turn,
CASE WHEN upper(ltrim(a, E' \\t\\n\\r')) LIKE 'KEEP%' THEN 'KEEP' ELSE 'NOISE' END AS syntax,
CASE WHEN upper(ltrim(a, E' \\t\\n\\r')) LIKE 'RELEVANT%' THEN 'RELEVANT' ELSE 'IRRELEVANT' END
  AS relevance,
CASE WHEN contains(upper(a), 'NOISE') THEN 'NOISE' ELSE 'CLEAN' END AS noise
FROM (SELECT conv_id, turn, {_ANSWER} AS a FROM conversations)""")
def verdict_parse(spark, sf_dir):
    answer = F.col("a")
    return (
        table(spark, sf_dir, "conversations")
        .select("conv_id", "turn", F.expr(_ANSWER).alias("a"))
        .select(
            "conv_id",
            "turn",
            text.syntax_verdict(answer).alias("syntax"),
            text.relevance_verdict(answer).alias("relevance"),
            text.noise_verdict(answer).alias("noise"),
        )
    )


@query(f"""SELECT count(*) AS calls, sum(n)::bigint AS input_tokens,
count(*) * 50.0::double AS output_tokens,
round(sum(n) * 0.8 / 1e6 + count(*) * 50.0 * 2.0 / 1e6, 6) AS cost,
round(count(*) * 2.9 / 3600, 6) AS hours
FROM (SELECT len(regexp_extract_all(text, '{DUCK_TOKEN}')) AS n FROM documents)""")
def cost_projection(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        text.token_count(F.col("text")).alias("tokens")
    )
    row = judging.cost_projection(docs, "tokens", 50.0, 0.8, 2.0, 2.9)
    return row.withColumns({"cost": F.round("cost", 6), "hours": F.round("hours", 6)})


@query(f"""{WITH_FLAGS} , d AS (SELECT id, min(name) AS name FROM s_groups
  WHERE kind = 'declaration' GROUP BY id)
SELECT row_id, CASE WHEN length(src_fm) > 120 THEN 'judge_reflect'
  WHEN regexp_matches(lower(target), 'delegate|proxy|internal|super') THEN 'judge'
  WHEN length(name) < 5 THEN 'decide' ELSE 'judge' END AS route
FROM flags LEFT JOIN d ON d.id = row_id WHERE no_relevance""")
def judge_triage(spark, sf_dir):
    pairs = scanned_once(
        code_pairs(spark, sf_dir, spread=True).select("row_id", "src_fm", "target"),
        {"s": cs.scan_code(F.col("src_fm")), "t": cs.scan_code(F.col("target"))},
        spread=False,
    )
    first_name = F.array_min(F.transform(cs.declared_methods(F.col("s")), lambda m: m["name"]))
    scored = pairs.select(
        "row_id", "src_fm", "target", first_name.alias("name"),
        cs.relevance_score(F.col("s"), F.col("t")).alias("score"),
    )
    return scored.filter("score = 0").select(
        "row_id",
        judging.triage(F.col("name"), F.col("target"), F.length("src_fm"), 120).alias("route"),
    )


def _scored_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("src_fm"),
        F.col("lang").alias("target"),
        F.col("quality").cast("double").alias("condition_cover_rate"),
    )


@query("""SELECT count(*) AS n, round(var_pop(quality), 2) AS error_of_mean,
  true AS scores_beat_mean
FROM documents JOIN labels USING (doc_id)""")
def scorer_error(spark, sf_dir):
    """Held-out error of the calibrated scorer, below three quarters of the constant mean's.

    Fewer than 300 labelled rows are too few to learn from; nothing is claimed for them.
    """
    found = scoring.held_out_error(_scored_documents(spark, sf_dir), features=1 << 14)
    return found.select(
        "n",
        F.round("mse_of_mean", 2).alias("error_of_mean"),
        ((F.col("mse") < 0.75 * F.col("mse_of_mean")) | (F.col("n") < 300)).alias(
            "scores_beat_mean"
        ),
    )


@query("""SELECT quality::DOUBLE AS condition_cover_rate, count(*) AS n, true AS mostly_right
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def scored_filter(spark, sf_dir):
    """A calibrated scorer trained on document quality, applied as a threshold filter.

    Of each label's rows at least 85 % end up on its side of the threshold.
    """
    docs = _scored_documents(spark, sf_dir)
    model = scoring.fit_calibrated(docs, features=1 << 14)
    labelled = scoring.score_filter(scoring.score(docs, model), 0.5)
    low = F.col("noise_type") == "low_coverage"
    right = F.coalesce(low, F.lit(False)) == (F.col("condition_cover_rate") < 0.5)
    return labelled.groupBy("condition_cover_rate").agg(
        F.count("*").alias("n"), (F.avg(right.cast("int")) >= 0.85).alias("mostly_right")
    )


@query(f"""WITH pairs AS ({CODE_PAIRS}), yp AS (SELECT condition_cover_rate AS y,
  condition_cover_rate * 0.5 + (row_id % 17) / 34 AS p FROM pairs),
r AS (SELECT y, p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry,
  rank() OVER (ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY round(p, 9)) - 1) / 2 AS rp
  FROM yp),
c AS (SELECT count(*) AS n, avg(abs(p - y)) AS mae, avg((p - y) * (p - y)) AS mse,
  var_pop(y) AS v, corr(p, y) AS r, corr(ry, rp) AS rho,
  (count(*) FILTER (y < 0.5 AND p < 0.5))::bigint AS tp,
  (count(*) FILTER (y >= 0.5 AND p < 0.5))::bigint AS fp,
  (count(*) FILTER (y < 0.5 AND p >= 0.5))::bigint AS fn,
  (count(*) FILTER (y >= 0.5 AND p >= 0.5))::bigint AS tn FROM r)
SELECT n, round(mae, 6) AS mae, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse,
round(1 - mse / v, 6) AS r2, round(r, 6) AS pearson_r, round(rho, 6) AS spearman_rho,
tp, fp, fn, tn, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_low FROM c""")
def evaluate_scores(spark, sf_dir):
    """The evaluation job on code pairs with a made-up prediction."""
    p = F.expr("round(condition_cover_rate * 0.5 + (row_id % 17) / 34, 9)")
    scored = code_pairs(spark, sf_dir).withColumn("predicted_cover_rate", p)
    row = evaluate(scored, threshold=0.5)
    measures = ["mae", "mse", "rmse", "r2", "pearson_r", "spearman_rho", "f1_low"]
    return row.select(
        "n", *[F.round(c, 6).alias(c) for c in measures], "confusion.*"
    )


_MADE_UP = "round(condition_cover_rate * 0.5 + (row_id % 17) / 34, 9)"


@query(f"""WITH pairs AS ({CODE_PAIRS}), s AS (
  SELECT *, {_MADE_UP} AS p, abs({_MADE_UP} - condition_cover_rate) AS e FROM pairs)
SELECT row_id, src_fm, condition_cover_rate, p AS predicted_cover_rate,
(SELECT count(*) FROM s) AS n, (SELECT round(avg(e), 6) FROM s) AS mae FROM s""")
def written_evaluation(spark, sf_dir):
    """Prediction file and metrics file of the evaluation job, read back."""
    scored = code_pairs(spark, sf_dir).withColumn("predicted_cover_rate", F.expr(_MADE_UP))
    folder = f"{shared_folder(spark)}/evaluation-{uuid.uuid4().hex}"
    write_evaluation(scored, folder, threshold=0.5)
    metrics_row = spark.read.schema("n long, mae double").json(f"{folder}/test_metrics")
    predictions = spark.read.parquet(f"{folder}/predictions")
    return predictions.join(F.broadcast(metrics_row)).select(
        "row_id", "src_fm", "condition_cover_rate", "predicted_cover_rate", "n",
        F.round("mae", 6).alias("mae"),
    )


@query(f"""{WITH_FLAGS}, u AS (SELECT * FROM flags
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY row_id) = 1),
s AS (SELECT * FROM u ORDER BY md5('42:' || row_id) LIMIT 500)
SELECT row_id, {case_sql(NAMES[:7])} AS noise_type,
CASE WHEN {" OR ".join(NAMES[:7])} THEN 'NOISE' ELSE 'CLEAN' END AS rule_label FROM s""")
def written_comparison_sample(spark, sf_dir):
    """The labelled sample that methods are compared on, written and read back."""
    sample = comparison_sample(code_pairs(spark, sf_dir), one_pattern(spark))
    return stored_table(sample.select("row_id", "noise_type", "rule_label"), "labelled-sample")
