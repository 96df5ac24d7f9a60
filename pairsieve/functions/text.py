"""Scalar text and number columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comments and literals win over punctuation. Possessive loops keep long literals from
# exhausting the matcher's stack. A comment that is never closed reaches to the end, so no
# part of a text is scanned twice.
TOKEN = (
    r"(?s)//[^\n]*+|/\*.*?(?:\*/|\z)"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"' r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|\.\.\.|->|::|[A-Za-z_$][A-Za-z0-9_$]*+|[0-9][A-Za-z0-9_.]*+|\S"
)


def tokens(text: Column) -> Column:
    """Lexical tokens; null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def truncate_tokens(text: Column, n: int) -> Column:
    return F.slice(tokens(text), 1, n)


def truncate_chars(text: Column, n: int = 1500) -> Column:
    return F.substring(text, 1, n)


def pair_text(src: Column, target: Column, separator: str = "[SEP]") -> Column:
    """Both sides of a pair as one text; a missing side counts as empty."""
    return F.concat_ws(
        f" {separator} ", F.coalesce(src, F.lit("")), F.coalesce(target, F.lit(""))
    )


def to_number(value: Column) -> Column:
    """Number or null, never an error."""
    return value.try_cast("double")


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit to a range; null and NaN stay as they are."""
    return F.when(F.isnan(value), value).otherwise(
        F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))
    )


def logistic(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / F.nullif(whole, F.lit(0)))


def percent(rate: Column) -> Column:
    return F.format_string("%.2f%%", rate * 100)


def binary_label(noise_type: Column) -> Column:
    """CLEAN for rows without a noise type (null or 'clean'), NOISE otherwise."""
    return F.when(
        noise_type.isNull() | (noise_type == "clean"), F.lit("CLEAN")
    ).otherwise(F.lit("NOISE"))


def verdict_by_prefix(answer: Column, wanted: str, default: str) -> Column:
    """``wanted`` if the answer starts with it (any case), else the careful default."""
    return F.when(
        F.startswith(F.upper(F.regexp_replace(answer, r"^\s+", "")), F.lit(wanted)),
        F.lit(wanted),
    ).otherwise(F.lit(default))


def syntax_verdict(answer: Column) -> Column:
    return verdict_by_prefix(answer, "KEEP", "NOISE")


def relevance_verdict(answer: Column) -> Column:
    return verdict_by_prefix(answer, "RELEVANT", "IRRELEVANT")


def noise_verdict(answer: Column) -> Column:
    """NOISE if the word occurs anywhere in the answer, else CLEAN."""
    return F.when(
        F.contains(F.upper(answer), F.lit("NOISE")), F.lit("NOISE")
    ).otherwise(F.lit("CLEAN"))
