"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions.

Documents fall into cells of source, language and topic; a cell's mass is its tokens. Raking
scales the cells' masses until their sums over each of the three marginals meet that marginal's
target. The quotient of raked and actual mass is a cell's weight. Given the ``share`` of all tokens
to sample, a document's probability is min(1, c * weight), with c such that the expected tokens are
that share: a rare cell with a large weight is kept whole (and stays below its target) and takes
nothing from the others. Without ``share`` it is the weight divided by the largest one, the
largest sample that meets the marginals in expectation; one rare value makes that sample
small. A document is taken if a number
made from the digest of its id is below its probability, so any rerun and any engine takes the
same documents.

Targets are the marginals' own shares to a power below one, renormalised, which moves weight
from dominant values to rare ones, or weights the caller gives by value; values without one keep
their share. The query states targets for languages and topics and the share to sample.

A round scales the three marginals in turn. Rounds end once no value's sum differs from its
target by more than ``TOLERANCE``, relative to the target (looked at after every fifth round), or
after ``ROUNDS``, as targets that contradict each other (a value that stands in one cell only) are never met. The largest
difference left is reported as ``target_error`` on every row.

Cells are few against documents; they are counted map-side, so a source with a third of all
rows is one partial row per task. Raking sums a marginal by group and joins the sums back: a
language with nearly all cells is one partial row per task too. Only when the cells are
counted to be at most ``BROADCAST_CELLS`` are they raked in one partition, without shuffles, and
broadcast to the documents; beyond that both are shuffled, with equal results.

Defined results: null source or language is the value ``unknown``; null text is empty. A
document without words weighs nothing and takes its cell's probability. Cells without words
have probability one. Repeated rows are sampled alike. Null ``doc_id`` is digested as empty text.
Other columns are carried by ``sample_documents`` and not read. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsieve.llm.common import WORD, fresh, table
from pairsieve.session import stored_table

POWERS = {"source": 0.9, "lang": 0.9, "topic": 1.0}
ROUNDS = 20
TOLERANCE = 1e-12
BROADCAST_CELLS = 50_000

# The query's targets; sources, an open list, take the power of their shares.
GOALS = {
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.75, "figures": 0.15, "table": 0.07, "exclamation": 0.03},
}
SHARE = 0.5


def topic_of(text: Column) -> Column:
    """A coarse topic where a corpus has no such column: the form of the text."""
    return (
        F.when(text.contains(" | "), "table")
        .when(text.contains("!!"), "exclamation")
        .when(text.rlike("[0-9]"), "figures")
        .otherwise("prose")
    )


def cell_columns(docs: DataFrame) -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    return {
        "source": F.coalesce("source", F.lit("unknown")),
        "lang": F.coalesce("lang", F.lit("unknown")),
        "topic": topic_of(text),
    }


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def rake(cells: DataFrame, powers=None, rounds: int = ROUNDS, goals=None) -> DataFrame:
    """Add ``weight`` (raked share over actual share) and ``target_error`` to the cells.

    ``goals``: {marginal: {value: weight above zero}}, instead of powers of the shares.
    Cells are (source, lang, topic, tokens); those without tokens are left out.
    """
    powers = powers or POWERS
    goals = goals or {}
    if set(goals) - set(powers) or any(w <= 0 for g in goals.values() for w in g.values()):
        raise ValueError("goals need known marginals and weights above zero")
    tokens = F.col("tokens").cast("double")
    total = cells.agg(F.sum("tokens").cast("double").alias("total"))
    shares = cells.filter("tokens > 0").join(F.broadcast(total))  # one row
    shares = shares.select(*powers, "tokens", (tokens / F.col("total")).alias("share"))
    targets = shares
    for name, power in powers.items():
        margin = shares.groupBy(name).agg(F.sum("share").alias("s"))
        goal = F.pow("s", F.lit(power))
        if given := goals.get(name):
            goal = F.col("s")
            for value, weight in given.items():
                goal = F.when(F.col(name) == value, F.lit(float(weight))).otherwise(goal)
        raised = margin.select(name, goal.alias(f"{name}_target"))
        norm = raised.agg(F.sum(f"{name}_target").alias("norm"))
        scaled = raised.join(F.broadcast(norm)).select(
            name, (F.col(f"{name}_target") / F.col("norm")).alias(f"{name}_target")
        )
        targets = targets.join(scaled, name)
    small = cells.count() <= BROADCAST_CELLS

    def stored(df: DataFrame) -> DataFrame:
        kept = stored_table(df, "raking")
        return kept.coalesce(1) if small else kept

    def scaled_to(raked: DataFrame, name: str) -> DataFrame:
        goal, mass = F.col(f"{name}_target"), F.col("mass")
        if small:  # one partition: no shuffle
            total = F.sum("mass").over(Window.partitionBy(name))
            return raked.withColumn("mass", mass * (goal / total))
        sums = raked.groupBy(name).agg(F.sum("mass").alias("sum"))
        joined = raked.join(sums, name).withColumn("mass", mass * (goal / F.col("sum")))
        return stored(joined.select(*raked.columns))

    raked = stored(targets.withColumn("mass", F.col("share")))
    for at in range(rounds):
        for name in powers:
            raked = scaled_to(raked, name)
        if at % 5 == 4 or at == rounds - 1:  # short plans and lineage
            raked = stored(raked)
            if target_error(raked, powers) <= TOLERANCE:
                break
    error = target_error(raked, powers)
    return raked.select(
        *powers,
        "tokens",
        (F.col("mass") / F.col("share")).alias("weight"),
        F.lit(error).alias("target_error"),
    )


def target_error(raked: DataFrame, powers) -> float:
    """The largest difference of a value's mass from its target, relative to the target."""
    gaps = [
        raked.groupBy(name).agg(
            F.abs(F.sum("mass") / F.first(f"{name}_target") - 1).alias("gap")
        )
        for name in powers
    ]
    return reduce(DataFrame.union, gaps).agg(F.max("gap")).first()[0] or 0.0


def uniform(doc_id: Column) -> Column:
    """A number in [0, 1) from the digest of an id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 32))


def _factor(weighed: DataFrame, share: float) -> float:
    """c for which min(1, c * weight) samples ``share`` of the tokens in expectation.

    A step adds the cells that came to one; each fetches one row of sums.
    """
    c, n_whole = 0.0, -1
    while True:
        whole = F.col("weight") * F.lit(c) >= 1
        total, kept, rest, n = weighed.filter("weight > 0").agg(
            F.sum("tokens"),
            F.sum(F.when(whole, F.col("tokens")).otherwise(0)),
            F.sum(F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("weight"))),
            F.count_if(whole),
        ).first()
        if not rest or n == n_whole:
            return c if rest else math.inf
        c, n_whole = max(c, (share * total - kept) / rest), n


def probabilities(
    docs: DataFrame, powers=None, rounds: int = ROUNDS, goals=None, share: float | None = None
) -> DataFrame:
    """source, lang, topic, tokens, weight, target_error, probability of every cell."""
    if share is not None and not 0 < share <= 1:
        raise ValueError("share is above zero and at most one")
    keys = cell_columns(docs)
    tokens = docs.select(*[c.alias(n) for n, c in keys.items()], n_words(F.col("text")).alias("n"))
    cells = tokens.groupBy(*keys).agg(F.sum("n").alias("tokens"))
    cells = stored_table(cells, "cells")
    raked = rake(cells, powers, rounds, goals).drop("tokens")
    if share is None:
        top = raked.agg(F.max("weight").alias("top"))
        weighed = cells.join(raked, list(keys), "left").join(F.broadcast(top))  # one row
        chance = F.col("weight") / F.col("top")
    else:
        weighed = stored_table(cells.join(raked, list(keys), "left"), "weights")
        chance = F.when(
            F.col("weight").isNotNull(),
            F.least(F.lit(1.0), F.col("weight") * F.lit(_factor(weighed, share))),
        )
    return stored_table(
        weighed.select(
            *keys,
            "tokens",
            "weight",
            "target_error",
            F.coalesce(chance, F.lit(1.0)).alias("probability"),
        ),
        "probabilities",
    )


def _with_cell(docs: DataFrame, *options, **named) -> tuple[DataFrame, str]:
    """The table with a struct column holding its cell's row, and that column's name."""
    cells = probabilities(docs, *options, **named)
    cell = fresh(docs, "mixing_cell")
    packed = cells.select(F.struct(*cells.columns).alias(cell))
    if cells.count() <= BROADCAST_CELLS:
        packed = F.broadcast(packed)
    keys = cell_columns(docs)
    match = [c == F.col(cell)[n] for n, c in keys.items()]
    return docs.join(packed, match), cell


def sample_documents(
    docs: DataFrame, powers=None, rounds: int = ROUNDS, goals=None, share: float | None = None
) -> DataFrame:
    """The sampled rows, columns unchanged."""
    joined, cell = _with_cell(docs, powers, rounds, goals, share)
    taken = uniform(F.col("doc_id")) < F.col(cell)["probability"]
    return joined.filter(taken).select(*docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    joined, cell = _with_cell(docs, goals=GOALS, share=SHARE)
    of = F.col(cell)
    return joined.select(
        "doc_id",
        of["source"].alias("source"),
        of["lang"].alias("lang"),
        of["topic"].alias("topic"),
        n_words(F.col("text")).alias("n_tokens"),
        F.round(of["weight"], 6).alias("weight"),
        F.round(of["target_error"], 6).alias("target_error"),
        F.round(of["probability"], 6).alias("probability"),
        (uniform(F.col("doc_id")) < of["probability"]).alias("sampled"),
    )


def _oracle() -> str:
    keys = list(POWERS)

    def goal(name: str) -> str:
        if name not in GOALS:
            return f"pow(sum(share), {POWERS[name]})"
        given = " ".join(f"WHEN '{v}' THEN {w}::DOUBLE" for v, w in GOALS[name].items())
        return f"CASE {name} {given} ELSE sum(share) END"

    targets = ", ".join(
        f"""{n}_t AS (SELECT {n}, {goal(n)} AS raised FROM s GROUP BY {n}),
{n}_target AS (SELECT {n}, raised / (SELECT sum(raised) FROM {n}_t) AS target FROM {n}_t)"""
        for n in keys
    )
    gaps = " UNION ALL ".join(
        f"SELECT abs(sum(mass) / first({n}_target) - 1) AS gap FROM {{last}} GROUP BY {n}"
        for n in keys
    )
    steps, last = [], "m0"
    for i in range(ROUNDS):
        for n in keys:
            name = f"m{i}_{n}"
            steps.append(
                f"{name} AS (SELECT * REPLACE (mass * {n}_target / sum(mass) OVER"
                f" (PARTITION BY {n}) AS mass) FROM {last})"
            )
            last = name
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
         WHEN contains(coalesce(text, ''), '!!') THEN 'exclamation'
         WHEN regexp_matches(coalesce(text, ''), '[0-9]') THEN 'figures'
         ELSE 'prose' END AS topic,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens
  FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM d GROUP BY ALL),
s AS (SELECT *, tokens / (SELECT sum(tokens) FROM c) AS share FROM c WHERE tokens > 0),
{targets},
m0 AS (
  SELECT s.*, share AS mass, {', '.join(f'{n}_target.target AS {n}_target' for n in keys)}
  FROM s {' '.join(f'JOIN {n}_target USING ({n})' for n in keys)}),
{', '.join(steps)},
w AS (SELECT source, lang, topic, tokens, mass / share AS weight FROM {last}),
e AS (SELECT max(gap) AS target_error FROM ({gaps.format(last=last)})),
o AS (
  SELECT *, {SHARE} * (SELECT sum(tokens) FROM w) - coalesce(sum(tokens) OVER (
      ORDER BY weight DESC, source, lang, topic
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wanted,
    sum(tokens * weight) OVER (ORDER BY weight DESC, source, lang, topic
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass_left
  FROM w),
f AS (SELECT max_by(wanted / mass_left, weight) AS factor FROM o WHERE wanted / mass_left * weight <= 1)
SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(weight, 6) AS weight,
  round(CASE WHEN weight IS NOT NULL THEN target_error END, 6) AS target_error,
  round(coalesce(least(1.0, weight * factor), 1.0), 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0
    < CASE WHEN weight IS NULL THEN 1.0 ELSE least(1.0, weight * factor) END AS sampled
FROM d LEFT JOIN w ON d.source = w.source AND d.lang = w.lang AND d.topic = w.topic, e, f"""


QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLES = {"op10_mix_sources": _oracle()}
