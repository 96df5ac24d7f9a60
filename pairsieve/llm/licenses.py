"""License scan: an exact set-similarity join of text blocks and templates, in DataFrame functions.

Blocks are windows of two spans of words, one starting at each span; a span is as long as the
longest template. So any passage as long as a template lies in one block as a whole, however it
is broken into lines, and every word of a text is in a block.

A block has a template's label if it holds at least ``THRESHOLD`` of the template's distinct
words. The join finds exactly these pairs:

* *order*: words are ordered by how many blocks hold them, over the whole corpus, rarest first;
* *prefix*: with ``m`` of ``n`` words needed, one of the template's first ``n - m + 1`` must
  be in the block, so only these are joined, as equal words;
* *length*: a block with fewer than ``m`` template words is no candidate;
* *position*: the words behind the place where the two meet must still give ``m``;
* the candidates' overlap is counted exactly.

Words that no template has cannot count, so blocks keep only those that one has; templates
are configuration (``MOST_WORDS`` at most, checked), and their prefixes are broadcast. Each text
is read once. Its blocks are stored with a row number, and only (row, label) pairs that match
are grouped, so a license line on a third of all documents is one narrow row each.

Base phrases are looked for as consecutive words besides. The score of a document is 1 with a
base phrase, else the largest containment among its matches, else 0.

Defined results: a null or empty text has no words, no labels and score 0. Repeated rows give a
row each; a null id is carried. Phrases that overlap count each. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.llm.common import table
from pairsieve.session import stored_table

THRESHOLD = Fraction(4, 5)
MOST_WORDS = 20_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The telling sentences of public notices and their labels.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the Software), to deal in the Software "
        "without restriction",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file "
        "except in compliance with the License",
    ),
    ("gnu", "GNU General Public License"),
    (
        "gnu",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
    ),
    ("creative-commons", "Creative Commons Attribution License"),
    (
        "bsd",
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    (
        "cc0",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with "
        "or without fee is hereby granted",
    ),
    ("all-rights-reserved", "All rights reserved"),
]


def template_words(text: str) -> list[str]:
    """The words of a template or phrase, which are ASCII."""
    return re.findall(r"[0-9a-z]+", text.lower())


def needed(n: int, threshold: Fraction = THRESHOLD) -> int:
    """How many of ``n`` distinct words make up the threshold."""
    return max(1, -(-n * threshold.numerator // threshold.denominator))


def spaced_words(text: Column) -> Column:
    """Lower-case words with one blank between them.

    Of all characters beyond ASCII only two turn into ASCII letters; others stand in for them.
    """
    kept = F.replace(
        F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")),
        F.lit("İ"),
        F.lit("ı"),
    )
    return F.trim(F.regexp_replace(F.lower(kept), NO_WORD, " "))


def phrase_places(spaced: Column, words: Column, phrase: list[str]) -> Column:
    """The word numbers, from 0, at which a phrase starts."""
    inside = F.contains(F.concat(F.lit(" "), spaced, F.lit(" ")), F.lit(f" {' '.join(phrase)} "))
    wanted = F.array(*map(F.lit, phrase))
    starts = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(phrase)),
        lambda i: (F.get(words, i) == phrase[0]) & (F.slice(words, i + 1, len(phrase)) == wanted),
    )
    return F.when(inside, starts).otherwise(F.array().cast("array<int>"))


def _no_tokens() -> Column:
    return F.array().cast("array<string>")


def scanned(docs: DataFrame, templates, phrases, threshold: Fraction) -> DataFrame:
    """Stored: row, doc_id, n_words, places (one array a phrase), blocks (start, tokens)."""
    sets = [set(template_words(t)) for _, t in templates]
    known = sorted(set().union(*sets))
    span = max(len(template_words(t)) for _, t in templates)
    least = min(needed(len(s), threshold) for s in sets)
    # Named step by step, so that no step is made twice.
    spaced = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        spaced_words(F.col("text")).alias("spaced"),
    )
    words = spaced.withColumn(
        "words", F.when(F.col("spaced") == "", _no_tokens()).otherwise(F.split("spaced", " "))
    )
    parts = words.select(
        "row",
        "doc_id",
        F.size("words").alias("n_words"),
        F.array(
            *[phrase_places(F.col("spaced"), F.col("words"), template_words(p)) for p in phrases]
        ).alias("places"),
        F.transform(
            F.sequence(F.lit(0), F.floor(F.size("words") / span).cast("int")),
            lambda k: F.filter(
                F.slice("words", k * span + 1, span), lambda w: w.isin(known)
            ),
        ).alias("parts"),
    )
    block = F.transform(
        "parts",
        lambda part, k: F.struct(
            (k * span).alias("start"),
            F.array_distinct(
                F.concat(part, F.coalesce(F.get("parts", k + 1), _no_tokens()))
            ).alias("tokens"),
        ),
    )
    made = parts.select(
        "row",
        "doc_id",
        "n_words",
        "places",
        F.filter(block, lambda b: F.size(b["tokens"]) >= least).alias("blocks"),
    )
    return stored_table(made, "license-blocks")


def word_order(blocks: DataFrame, known: set[str]) -> list[str]:
    """The templates' words, those that fewest blocks hold first."""
    counts = blocks.select(F.explode("tokens").alias("token")).groupBy("token").count()
    n = dict(counts.collect())  # a row for each template word at most
    return sorted(known, key=lambda w: (n.get(w, 0), w))


def matches(scan: DataFrame, templates, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(row, start, label, containment): every block and template that reach the threshold."""
    sets = [(label, set(template_words(t))) for label, t in templates]
    known = set().union(*[s for _, s in sets])
    if len(known) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} template words")
    blocks = scan.select("row", F.inline("blocks"))
    order = word_order(blocks, known)
    place = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, words in sets:
        ordered, m = sorted(words, key=place.get), needed(len(words), threshold)
        for i, token in enumerate(ordered[: len(words) - m + 1]):
            prefixes.append((token, label, i, len(words), m, ordered))
    prefix = scan.sparkSession.createDataFrame(
        prefixes, "token string, label string, i int, n int, m int, wanted array<string>"
    )
    least = min(m for *_, m, _ in prefixes)
    ordered = blocks.select(
        "row",
        "start",
        # keeps the order of its first argument
        F.array_intersect(F.array(*map(F.lit, order)), "tokens").alias("tokens"),
    )
    # A block, too, must show one of its rarest words.
    shown = F.posexplode(F.slice("tokens", 1, F.size("tokens") - (least - 1))).alias("j", "token")
    met = ordered.select("*", F.size("tokens").alias("size"), shown).join(
        F.broadcast(prefix), "token"
    )
    behind = F.least(F.col("n") - F.col("i"), F.col("size") - F.col("j"))
    overlap = F.size(F.array_intersect("tokens", "wanted"))
    close = met.filter((F.col("size") >= F.col("m")) & (behind >= F.col("m")))
    return (
        close.select("row", "start", "label", "n", "m", overlap.alias("overlap"))
        .filter("overlap >= m")
        .select("row", "start", "label", (F.col("overlap") / F.col("n")).alias("containment"))
        .distinct()
    )


def scan_licenses(
    docs: DataFrame,
    templates=TEMPLATES,
    phrases=PHRASES,
    threshold: Fraction = THRESHOLD,
) -> DataFrame:
    """Every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scan = scanned(docs, templates, phrases, threshold)
    found = (
        matches(scan, templates, threshold)
        .groupBy("row")
        .agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    )
    # a label for each phrase that has a place
    names = [
        F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label))
        for i, label in enumerate(phrases.values())
    ]
    base = reduce(
        F.concat,
        [F.when(n.isNotNull(), F.array(n)).otherwise(_no_tokens()) for n in names],
        _no_tokens(),
    )
    rows = scan.select(
        "row",
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.flatten("places").alias("all"),
        F.array_sort(F.array_distinct(base)).alias("base"),
    ).join(found, "row", "left")
    both = F.array_union("base", F.coalesce("found", _no_tokens()))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("all").cast("long").alias("n_base"),
        F.array_min("all").cast("long").alias("first_word"),
        F.array_max("all").cast("long").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(both)).alias("labels"),
        F.when(F.size("all") > 0, F.lit(1.0))
        .otherwise(F.coalesce("best", F.lit(0.0)))
        .alias("score"),
    )


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql() -> str:
    """Every block against every template, without filters."""
    span = max(len(template_words(t)) for _, t in TEMPLATES)
    sets = [(label, sorted(set(template_words(t)))) for label, t in TEMPLATES]
    values = ", ".join(f"('{label}', {_list(s)}, {needed(len(s))})" for label, s in sets)
    places = [
        f"SELECT n, '{label}' AS label, unnest(list_filter(range(len(words)), "
        f"lambda i: words[i + 1 : i + {len(template_words(p))}] = {_list(template_words(p))}))"
        " AS place FROM d"
        for p, label in PHRASES.items()
    ]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM documents),
p AS MATERIALIZED ({" UNION ALL ".join(places)}),
b AS MATERIALIZED (
  SELECT n, list_distinct(words[k * {span} + 1 : (k + 2) * {span}]) AS block
  FROM (SELECT n, words, unnest(range(len(words) // {span} + 1)) AS k FROM d)),
t(label, wanted, m) AS (VALUES {values}),
h AS MATERIALIZED (
  SELECT n, label, len(list_intersect(block, wanted)) / len(wanted) AS containment
  FROM b CROSS JOIN t WHERE len(list_intersect(block, wanted)) >= m),
ps AS (
  SELECT n, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM p GROUP BY n),
best AS (SELECT n, max(containment) AS best FROM h GROUP BY n),
ls AS (
  SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT n, label FROM p UNION ALL SELECT n, label FROM h) GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN ps USING (n) LEFT JOIN best USING (n) LEFT JOIN ls USING (n)"""


QUERIES = {"op13_license_scan": op13_license_scan}
ORACLES = {"op13_license_scan": _sql()}
