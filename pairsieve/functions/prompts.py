"""Prompt texts for the external judge, rendered as columns.

The wording is ours; every function takes another template. The answer words
(KEEP / NOISE, RELEVANT / IRRELEVANT, NOISE / CLEAN) are what the verdict parsers in
``functions.text`` look for.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairsieve.functions.text import truncate_chars

CONFIRM_SYNTAX = """A static check marked this Java method as {noise_type} ({rule_result}).

{code}

Should the sample be left out of a training set?
Reply with "NOISE: reason" or "KEEP: reason" on one line."""

JUDGE_RELEVANCE = """Method under test:

{src_fm}

Unit test:

{target}

The test calls no method with the name and argument count of the method under test.
It may still exercise it indirectly, for example through a wrapper or a subclass.
Reply with "RELEVANT: reason" or "IRRELEVANT: reason" on one line."""

REFLECT = """You judged a method and its test to be unrelated. Your answer was: {answer}

Think again:
1. Does the test call something that itself calls the method?
2. Does the test check a state only the method can have produced?
3. Does the test observe interactions the method triggers?
4. Do the names of the test and the method mean the same?
5. Would the test fail if the method were removed?

If any answer is yes, reply "RELEVANT: number and reason"; if not, "IRRELEVANT"."""

CLASSIFY = """Decide whether this pair of a Java method and its unit test is fit for training.
Unfit are broken syntax, empty handlers or bodies, unbounded generics, framework
annotations, non-English text and tests that do not concern the method.

Method:
{src_fm}

Test:
{target}

Reply with one word: NOISE or CLEAN."""

CLASSIFY_EXAMPLES = """Method: void run() { }
Test: @Test void t() { run(); }
Reply: NOISE

Method: int twice(int x) { return 2 * x; }
Test: @Test void t() { assertEquals(4, twice(2)); }
Reply: CLEAN

"""


def render(template: str, **fields: Column) -> Column:
    """Fill ``{field}`` marks with columns (null as empty). Field texts are not re-read."""
    parts = []
    for i, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if i % 2:
            parts.append(F.coalesce(fields[piece].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def confirm_syntax_prompt(code: Column, noise_type: Column, template=CONFIRM_SYNTAX) -> Column:
    result = F.concat(F.lit("Detected "), noise_type, F.lit(" in focal method"))
    return render(template, code=code, noise_type=noise_type, rule_result=result)


def relevance_prompt(src: Column, target: Column, template=JUDGE_RELEVANCE) -> Column:
    return render(template, src_fm=src, target=target)


def reflection_prompt(answer: Column, template=REFLECT) -> Column:
    return render(template, answer=answer)


def classify_prompt(
    src: Column, target: Column, few_shot: bool = False, template=CLASSIFY, max_chars: int = 1500
) -> Column:
    """Zero-shot, or few-shot with the examples in front. Each side is cut to max_chars."""
    return render(
        (CLASSIFY_EXAMPLES if few_shot else "") + template,
        src_fm=truncate_chars(src, max_chars),
        target=truncate_chars(target, max_chars),
    )
