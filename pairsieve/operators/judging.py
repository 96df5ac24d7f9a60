"""External judge: route borderline rows, ask, apply the answers.

The engine prepares prompts and uses answers. Answers come as a table
``(row_id, question, answer)`` or from a user's function run next to the data.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.functions import prompts
from pairsieve.functions.text import noise_verdict, ratio, relevance_verdict, syntax_verdict
from pairsieve.operators.dedup import key_digest
from pairsieve.session import folder_exists, spread_rows, stored_table
from pairsieve.sources.schema import ROW_ID, SRC, TARGET

# Labels the judge may overrule.
BORDERLINE_SYNTAX = ["syntax_error", "empty_method"]
NO_RELEVANCE = "no_relevance"

ANSWER_SCHEMA = "row_id long, question string, answer string"


def route_syntax(labelled: DataFrame) -> DataFrame:
    """(row_id, question, prompt) for borderline syntax rows."""
    return labelled.filter(F.col("noise_type").isin(*BORDERLINE_SYNTAX)).select(
        ROW_ID,
        F.lit("syntax").alias("question"),
        prompts.confirm_syntax_prompt(F.col(SRC), F.col("noise_type")).alias("prompt"),
    )


def route_relevance(labelled: DataFrame) -> DataFrame:
    """(row_id, question, prompt) for rows without a matching call."""
    return labelled.filter(F.col("noise_type") == NO_RELEVANCE).select(
        ROW_ID,
        F.lit("relevance").alias("question"),
        prompts.relevance_prompt(F.col(SRC), F.col(TARGET)).alias("prompt"),
    )


def route_reflection(first_answers: DataFrame) -> DataFrame:
    """(row_id, question, prompt) for rows first judged IRRELEVANT."""
    return first_answers.filter(
        (F.col("question") == "relevance")
        & (relevance_verdict(F.col("answer")) == "IRRELEVANT")
    ).select(
        ROW_ID,
        F.lit("reflection").alias("question"),
        prompts.reflection_prompt(F.col("answer")).alias("prompt"),
    )


def route_all(pairs: DataFrame, few_shot: bool = False) -> DataFrame:
    """(row_id, question, prompt) for every row, to classify a whole table."""
    return pairs.select(
        ROW_ID,
        F.lit("classify").alias("question"),
        prompts.classify_prompt(F.col(SRC), F.col(TARGET), few_shot).alias("prompt"),
    )


def _patient(judge: Callable[[str], str], tries: int, wait: float):
    """The judge with retries; a prompt that keeps failing has no answer."""

    def answer(prompt: str) -> str | None:
        for attempt in range(tries):
            try:
                return judge(prompt)
            except Exception:
                if attempt + 1 < tries:
                    time.sleep(wait)
        return None

    return answer


def ask(
    routed: DataFrame, judge: Callable[[str], str], tries: int = 3, wait: float = 2.0
) -> DataFrame:
    """Run the user's function on every prompt; a prompt that keeps failing has no answer.

    Answers cost money: store the result before using it more than once, or use
    ``ask_stored``, which asks each prompt once for all.
    """
    answer = _patient(judge, tries, wait)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[[ROW_ID, "question"]].assign(answer=frame["prompt"].map(answer))

    return routed.mapInPandas(batches, ANSWER_SCHEMA)


STORED_ANSWERS = "prompt_key binary, answer string"
# Prompts asked before their answers are written for good.
PER_WAVE = 20_000


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """(prompt_key, answer): the answers in a store, one for each prompt; maybe none yet."""
    if not folder_exists(spark, store):
        return spark.createDataFrame([], STORED_ANSWERS)
    found = spark.read.schema(STORED_ANSWERS).parquet(store)
    # Two jobs may have asked the same at the same time.
    return found.groupBy("prompt_key").agg(F.min("answer").alias("answer"))


def ask_stored(
    routed: DataFrame,
    judge: Callable[[str], str],
    store: str,
    tries: int = 3,
    wait: float = 2.0,
    per_wave: int = PER_WAVE,
) -> DataFrame:
    """(row_id, question, answer), each distinct prompt asked and paid once for all.

    ``store`` is a folder that only grows: answers by the digest of their prompt. Prompts with
    an answer there are not asked. The others are asked in waves of about ``per_wave``
    prompts, and a wave's answers are written before the next wave starts. A prompt that
    keeps failing gets no answer and no entry; the next run asks it again, and it alone. A
    judge that breaks off (any other exception, such as an interrupt) ends its task's
    questions; the answers it had given are written first, then the run fails. So a failed
    run loses nothing that was answered, but for tasks an executor takes down with it.

    One store belongs to one judge: change the folder with the model.
    """
    spark = routed.sparkSession
    keyed = stored_table(
        routed.select(ROW_ID, "question", "prompt", key_digest("prompt").alias("prompt_key")),
        "prompts",
    )
    distinct = keyed.filter("prompt is not null").select("prompt_key", "prompt")
    missing = stored_table(
        distinct.dropDuplicates(["prompt_key"]).join(
            stored_answers(spark, store), "prompt_key", "left_anti"
        ),
        "prompts-to-ask",
    )
    answer = _patient(judge, tries, wait)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        broken = None
        for frame in frames:
            answers, errors = [], []
            for prompt in frame["prompt"]:
                found = None
                if broken is None:
                    try:
                        found = answer(prompt)
                    except BaseException as error:  # written below, raised by the driver
                        broken = f"{type(error).__name__}: {error}"
                answers.append(found)
                errors.append(broken)
            yield pd.DataFrame(
                {"prompt_key": frame["prompt_key"], "answer": answers, "error": errors}
            )

    waves = -(-missing.count() // per_wave)
    for wave in range(waves):
        part = missing.filter(F.pmod(F.xxhash64("prompt_key"), F.lit(waves)) == wave)
        asked = stored_table(
            spread_rows(part).mapInPandas(batches, STORED_ANSWERS + ", error string"),
            "answers-of-a-wave",
        )
        given = asked.filter("answer is not null").select("prompt_key", "answer")
        given.write.mode("append").parquet(store)
        error = asked.agg(F.min("error")).first()[0]
        if error:
            raise RuntimeError(f"the judge broke off: {error}")
    return keyed.join(stored_answers(spark, store), "prompt_key", "left").select(
        ROW_ID, "question", "answer"
    )


def unanswered(answers: DataFrame) -> DataFrame:
    """(question, asked, unanswered): shows a judge that fails."""
    return answers.groupBy("question").agg(
        F.count("*").alias("asked"), F.count_if(F.col("answer").isNull()).alias("unanswered")
    )


def final_answers(answers: DataFrame) -> DataFrame:
    """(row_id, syntax, relevance): verdicts, the reflection answer replacing the first."""
    def of(question):
        return F.max(F.when(F.col("question") == question, F.col("answer")))

    wide = answers.groupBy(ROW_ID).agg(
        of("syntax").alias("s"), of("relevance").alias("r1"), of("reflection").alias("r2")
    )
    return wide.select(
        ROW_ID,
        F.when(F.col("s").isNotNull(), syntax_verdict(F.col("s"))).alias("syntax"),
        F.when(
            F.coalesce("r2", "r1").isNotNull(), relevance_verdict(F.coalesce("r2", "r1"))
        ).alias("relevance"),
    )


def classify_answers(pairs: DataFrame, answers: DataFrame, column: str) -> DataFrame:
    """Add a NOISE / CLEAN column; no answer counts as CLEAN."""
    found = answers.filter(F.col("question") == "classify").select(
        ROW_ID, noise_verdict(F.col("answer")).alias(column)
    )
    return pairs.join(found, ROW_ID, "left").withColumn(
        column, F.coalesce(column, F.lit("CLEAN"))
    )


def apply_syntax_verdicts(
    labelled: DataFrame, verdicts: DataFrame, label_without_syntax: str | None = None
) -> DataFrame:
    """Overrule syntax labels answered KEEP.

    Later syntax rules are not tried again; the row continues with the later stages,
    whose label the column ``label_without_syntax`` holds (null: none of them fires).
    Only routed rows meet the verdict table, the others bypass the join. Give a stored
    table, so that labelling is not run once for each side.
    """
    after = F.col(label_without_syntax) if label_without_syntax else F.lit(None)
    return _apply(
        labelled,
        verdicts.select(ROW_ID, F.col("syntax").alias("_v")),
        F.col("noise_type").isin(*BORDERLINE_SYNTAX),
        F.col("_v") == "KEEP",
        after.cast("string"),
    )


def apply_relevance_verdicts(
    labelled: DataFrame, verdicts: DataFrame, label_without_relevance: str | None = None
) -> DataFrame:
    """Overrule ``no_relevance`` labels answered RELEVANT."""
    after = F.col(label_without_relevance) if label_without_relevance else F.lit(None)
    return _apply(
        labelled,
        verdicts.select(ROW_ID, F.col("relevance").alias("_v")),
        F.col("noise_type") == NO_RELEVANCE,
        F.col("_v") == "RELEVANT",
        after.cast("string"),
    )


def _apply(labelled, verdicts, routed, overruled, after):
    for flag in ("judged", "overridden"):
        if flag not in labelled.columns:
            labelled = labelled.withColumn(flag, F.lit(0))
    is_routed = F.coalesce(routed, F.lit(False))
    overruled = F.coalesce(overruled, F.lit(False))
    answered = (
        labelled.filter(is_routed)
        .join(verdicts, ROW_ID, "left")
        .withColumns(
            {
                "noise_type": F.when(overruled, after).otherwise(F.col("noise_type")),
                "judged": F.col("judged") + 1,
                "overridden": F.col("overridden") + overruled.cast("int"),
            }
        )
        .drop("_v")
    )
    return labelled.filter(~is_routed).unionByName(answered)


def counters(judged: DataFrame) -> DataFrame:
    """llm_calls (one per routed question) and llm_overrides."""
    return judged.agg(
        F.coalesce(F.sum("judged"), F.lit(0)).alias("llm_calls"),
        F.coalesce(F.sum("overridden"), F.lit(0)).alias("llm_overrides"),
    )


def compare_verdicts(df: DataFrame, before: str, after: str) -> DataFrame:
    """Before / after a second pass: changes, rescues, reversals, relevant on each side."""
    a, b = F.col(before), F.col(after)
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(a != b).alias("total_changes"),
        F.count_if((a == "IRRELEVANT") & (b == "RELEVANT")).alias("rescued"),
        F.count_if((a == "RELEVANT") & (b == "IRRELEVANT")).alias("reversed"),
        F.count_if(a == "RELEVANT").alias("relevant_before"),
        F.count_if(b == "RELEVANT").alias("relevant_after"),
    ).withColumn(
        "change_rate", F.round(ratio(F.col("total_changes"), F.col("total")) * 100, 1)
    )


def cost_projection(
    routed: DataFrame,
    tokens: str,
    output_tokens: float,
    price_in: float,
    price_out: float,
    seconds_per_call: float,
) -> DataFrame:
    """Calls, tokens, cost and hours for a set of prompts. Prices are per million tokens."""
    return routed.agg(
        F.count("*").alias("calls"),
        F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("input_tokens"),
    ).select(
        "calls",
        "input_tokens",
        (F.col("calls") * output_tokens).alias("output_tokens"),
        (
            F.col("input_tokens") * price_in / 1e6
            + F.col("calls") * output_tokens * price_out / 1e6
        ).alias("cost"),
        (F.col("calls") * seconds_per_call / 3600).alias("hours"),
    )


def triage(name, target, code_length, long_code: int = 1500):
    """Route of a row without a matching call: decide, judge, or judge with reflection.

    Long code is judged twice, tests that hint at wrappers once; short method names are
    decided by the rule.
    """
    wrapper = F.lower(target).rlike("delegate|proxy|internal|super")
    return (
        F.when(code_length > long_code, F.lit("judge_reflect"))
        .when(wrapper, F.lit("judge"))
        .when(F.length(name) < 5, F.lit("decide"))
        .otherwise(F.lit("judge"))
    )
