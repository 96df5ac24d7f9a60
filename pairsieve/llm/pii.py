"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame functions.

*Base spans* are the matches of four fixed patterns (email, ip, card, phone) that pass a check
of their numbers. *Generators* of high recall propose more spans, which may overlap: addresses
with a written-out "at", groups of digits with any separators, phone-like groups without a
plus. Every candidate and base span gets features of its format (digits, parts, last part,
capitals) and context (neighbouring characters, cue words, digits before it).

The trees learn which formats and contexts make a span of a kind, over all documents. Labels come
from what no feature holds. Base spans are positives of their kind. Negatives are matches whose
numbers fail the kind's check (Luhn, octets, number of digits, part of a longer number), lists
with commas, and "at" with a sentence's end behind it. Neither the check nor what tells a base
pattern from a generator ("@", "+", the kind of separators) is a feature, so the trees have to tell
both sides by format and context. Candidates that do not fail and are no base spans have no
label: they are not trained on, and their score decides. Labelled negatives are never added.

All features are small codes, so the training set is a table of distinct feature
rows with two counts and two folds; its size is bounded by the product of the code ranges
(147,456 rows of counts) and does not grow with the corpus. It is all that reaches the driver. Trees
become one column expression. For each kind the threshold is the smallest score from which on the
labelled matches in the held-out fold are base spans with ``PRECISION``, half way to the next score
below, and never under even odds; a kind whose contexts do not tell its base spans from failing matches adds none, nor does
a kind without base spans. Unlabelled candidates over their
threshold that touch no base span, longest and then best first, are added; base spans always stay.

Patterns start at the first character of a run or behind the previous match and repeat
possessively, which gives the same matches as the plain patterns in time linear in the text.
Texts never move: the first pass leaves narrow rows of matches, later steps use only those.

Defined results: null and empty texts have no spans. Offsets are code points, end exclusive.
Repeated rows are judged one by one and give equal results. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsieve.llm.common import table
from pairsieve.session import stored_table

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_DOMAIN}]++(?:\.[{_DOMAIN}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: (kind of the span, pattern).
GENERATORS = {
    "spoken_email": (
        "email",
        rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?(?:\(at\)|\[at\]| at ) ?[{_DOMAIN}]++"
        rf"(?: ?(?:\(dot\)|\[dot\]|\.) ?[{_DOMAIN}]++)++",
    ),
    "spaced_ip": ("ip", r"(?<![0-9.])[0-9]{1,3}+(?: ?[.,] ?[0-9]{1,3}+){3}(?![0-9])"),
    "digits": ("card", r"(?<![0-9])[0-9]{4}+(?:[\x20._/-]?[0-9]{3,6}+){2,4}(?![0-9])"),
    "local_phone": (
        "phone",
        r"(?<![0-9+(])\(?[0-9]{2,4}+\)?[\x20.-][0-9]{3,4}+[\x20.-][0-9]{3,4}+(?![0-9])",
    ),
}
# A character every match of a pattern has, to pass over texts without it quickly.
_NEEDS = {"email": "@", "phone": "+"}
# Words before a span that speak of a kind.
CUES = {
    "email": "mail|contact|write|addr",
    "ip": r"\bip\b|host|server|addr",
    "card": "card|visa|account|konto",
    "phone": "phone|tel|fax|call|mobile",
}
PRECISION = 0.99
ROUNDS, RATE = 40, 0.3
FEATURES = {
    "kind": 4, "cue": 3, "digits": 8, "nearby": 3, "left": 4, "right": 4, "parts": 4, "last": 4,
    "upper": 2,
}


def _matches(text: Column, source: str, pattern: str, needs: str | None) -> Column:
    """All matches in order: text before each (its length), the match, its surroundings."""
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.transform(
        found,
        lambda value, i: F.struct(
            F.lit(source).alias("source"),
            i.alias("i"),
            F.length(F.get(gaps, i)).alias("gap"),
            value.alias("value"),
            F.right(F.get(gaps, i), F.lit(24)).alias("before"),
            F.left(F.get(gaps, i + 1), F.lit(2)).alias("after"),
        ),
    )
    possible = text.contains(needs) if needs else text.rlike("[0-9]")
    return F.when(possible, rows).otherwise(F.filter(rows, lambda _: F.lit(False)))


def _all_matches(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id and the matches of every pattern; one pass over the texts, stored."""
    row = F.monotonically_increasing_id() if row is None else row
    text = F.coalesce("text", F.lit(""))
    sources = {k: (p, _NEEDS.get(k)) for k, p in BASE.items()}
    sources |= {k: (p, " " if k == "spoken_email" else None) for k, (_, p) in GENERATORS.items()}
    arrays = [_matches(F.col("text"), k, p, n) for k, (p, n) in sources.items()]
    narrow = docs.select(row.alias("row"), "doc_id", text.alias("text"))
    made = narrow.select(
        "row",
        "doc_id",
        F.filter(F.concat(*arrays), lambda m: m["value"].isNotNull()).alias("matches"),
    )
    return stored_table(made, "pii-matches")


def luhn(digits: Column) -> Column:
    """The checksum of card numbers, over a string of digits."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    total = F.aggregate(
        F.transform(
            figures,
            lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    return total % 10 == 0


def _octets(value: str) -> Column:
    return F.expr(
        f"size(regexp_extract_all({value}, '[0-9]+', 0)) = 4 and forall("
        f"regexp_extract_all({value}, '[0-9]+', 0), p -> length(ltrim('0', p)) <= 3"
        " and coalesce(try_cast(p as bigint) <= 255, false))"
    )


def _spans(matches: DataFrame) -> DataFrame:
    """One row per match: row, doc_id, source, kind, start, end, base, feature codes."""
    order = Window.partitionBy("row", "m.source").orderBy("m.i")
    length = F.length("m.value")
    placed = matches.select("row", "doc_id", F.explode("matches").alias("m")).select(
        "row",
        "doc_id",
        "m.*",
        (F.sum(F.col("m.gap") + length).over(order)).alias("end"),
        length.alias("size"),
        F.regexp_replace("m.value", "[^0-9]", "").alias("figures"),
    )
    kind = F.col("source")
    for name, (of, _) in GENERATORS.items():
        kind = F.when(F.col("source") == name, F.lit(of)).otherwise(kind)
    n = F.length("figures")
    good = (
        F.when(F.col("source") == "email", F.lit(True))
        .when(F.col("source") == "ip", _octets("value"))
        .when(F.col("source") == "card", n.between(12, 19) & luhn(F.col("figures")))
        .when(F.col("source") == "phone", n.between(9, 15))
        .otherwise(F.lit(False))
    )

    def beside(c: Column) -> Column:
        return (
            F.when(c == "", 0)
            .when(c.rlike("[0-9]"), 1)
            .when(c.rlike(r"[\p{L}]"), 2)
            .otherwise(3)
        )

    value, before, after = F.col("value"), F.col("before"), F.coalesce("after", F.lit(""))
    cues = {k: before.rlike(f"(?i)(?:{words})[^\\n]{{0,20}}$") for k, words in CUES.items()}
    own = F.lit(False)
    for name, found in cues.items():
        own = F.when(kind == name, found).otherwise(own)
    other = before.rlike(f"(?i)(?:{'|'.join(CUES.values())})[^\\n]{{0,20}}$")
    # Base spans are no failures; neither are base matches that pass their check.
    bare = value.contains(" at ")
    fails = (
        F.when(F.col("source") == "spoken_email", bare & value.rlike(r"\. | \.") | value.rlike("[^A-Za-z][A-Za-z]?$"))
        .when(F.col("source") == "spaced_ip", ~_octets("value") | value.contains(","))
        .when(F.col("source") == "digits", ~(n.between(12, 19) & luhn(F.col("figures"))))
        .when(
            F.col("source") == "local_phone", ~n.between(9, 15) | after.rlike(r"^[\x20.-][0-9]")
        )
        .otherwise(~good)
    )
    plain = F.regexp_replace(value, r"(?i) ?(?:[(\[]at[)\]]| at ) ?", "@")
    plain = F.regexp_replace(plain, r"(?i) ?[(\[]dot[)\]] ?", ".")
    # An address counts by its domain, whatever stands before the "@".
    parts = F.regexp_extract_all(F.substring_index(plain, "@", -1), F.lit("[0-9A-Za-z]+"), F.lit(0))
    last = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit(""))
    near = F.length(F.regexp_replace("before", "[^0-9]", ""))
    email = kind == "email"
    codes = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), kind) - 1,
        "cue": F.when(own, 2).when(other, 1).otherwise(0),
        "digits": F.when(email, 0).when(n < 9, 1).when(n < 12, 2).when(n < 13, 3)
        .when(n < 16, 4).when(n < 17, 5).when(n < 20, 6).otherwise(7),
        "nearby": F.when(near == 0, 0).when(near < 5, 1).otherwise(2),
        "left": beside(F.right("before", F.lit(1))),
        "right": beside(F.left(after, F.lit(1))),
        "parts": F.least(F.size(parts), F.lit(4)) - 1,
        "last": F.when((kind == "ip") | (F.length(last) < 2), 0).when(F.length(last) < 4, 1)
        .when(F.length(last) < 5, 2).otherwise(3),
        "upper": last.rlike("[A-Z]").cast("int"),
    }
    return placed.select(
        "row",
        "doc_id",
        kind.alias("kind"),
        (F.col("end") - F.col("size")).alias("start"),
        "end",
        good.alias("base"),
        fails.alias("fails"),
        *[c.cast("int").alias(f"f_{k}") for k, c in codes.items()],
    )


def _labelled(spans: DataFrame) -> DataFrame:
    """Spans with ``label`` and a fold by row.

    The label is true where place and kind are a base span's, false for matches that fail,
    and null for other candidates.
    """
    same = Window.partitionBy("row", "kind", "start", "end")
    label = F.when(F.max("base").over(same), True).when(F.col("fails"), False)
    return spans.withColumn("label", label).withColumn(
        "fold", F.pmod(F.xxhash64("row"), F.lit(5)) == 0
    )


# Boosted trees of depth two over a table of (codes, positives, negatives).


def _best_split(rows, weights, names):
    """The (feature, code limit) with most gain; codes are ordered."""
    best = (1e-9, None, None)
    g_all = sum(w[0] for w in weights)
    h_all = sum(w[1] for w in weights)
    for f in names:
        sums: dict[int, list[float]] = {}
        for row, (g, h) in zip(rows, weights):
            s = sums.setdefault(row[f], [0.0, 0.0])
            s[0] += g
            s[1] += h
        g_low = h_low = 0.0
        for code in sorted(sums)[:-1]:
            g_low += sums[code][0]
            h_low += sums[code][1]
            gain = g_low**2 / (h_low + 1) + (g_all - g_low) ** 2 / (h_all - h_low + 1)
            gain -= g_all**2 / (h_all + 1)
            if gain > best[0]:
                best = (gain, f, code)
    return best[1], best[2]


def _grow(rows, weights, names, depth):
    """A tree: a number, or (feature, limit, tree up to the limit, tree above)."""
    f, limit = _best_split(rows, weights, names) if depth else (None, None)
    if f is None:
        return -RATE * sum(w[0] for w in weights) / (sum(w[1] for w in weights) + 1)
    low = [i for i, r in enumerate(rows) if r[f] <= limit]
    high = [i for i, r in enumerate(rows) if r[f] > limit]
    sides = [
        _grow([rows[i] for i in part], [weights[i] for i in part], names, depth - 1)
        for part in (low, high)
    ]
    return (f, limit, *sides)


def _value(tree, row) -> float:
    while isinstance(tree, tuple):
        f, limit, low, high = tree
        tree = low if row[f] <= limit else high
    return tree


def boost(rows: list[dict], rounds: int = ROUNDS) -> list:
    """Trees for the log-odds of a label; rows have codes and counts ``pos`` and ``neg``."""
    names = list(FEATURES)
    scores = [0.0] * len(rows)
    trees = []
    for _ in range(rounds):
        weights = []
        for row, s in zip(rows, scores):
            p = 1 / (1 + math.exp(-s))
            n = row["pos"] + row["neg"]
            weights.append((n * p - row["pos"], n * p * (1 - p)))
        tree = _grow(rows, weights, names, 2)
        trees.append(tree)
        scores = [s + _value(tree, row) for s, row in zip(scores, rows)]
    return trees


def thresholds(rows: list[dict], trees, precision: float = PRECISION) -> dict[int, float]:
    """For each kind the smallest score from which on held-out precision is met.

    A kind without positives in the held-out fold is judged by the other one.
    """
    found = {}
    for kind in {r["kind"] for r in rows}:
        own = [(sum(_value(t, r) for t in trees), r) for r in rows if r["kind"] == kind]
        own.sort(key=lambda x: -x[0])
        held = "_held" if any(r["pos_held"] for _, r in own) else ""
        pos = neg = 0
        found[kind] = math.inf
        for i, (score, row) in enumerate(own):
            pos, neg = pos + row[f"pos{held}"], neg + row[f"neg{held}"]
            below = own[i + 1][0] if i + 1 < len(own) else -math.inf
            if below < score and pos and pos >= precision * (pos + neg):
                # Without a score below, the log-odds of the precision asked for.
                sure = min(score, math.log(precision / (1 - precision)))
                limit = sure if below == -math.inf else (score + below) / 2
                # Few held-out matches say little: never below even odds.
                found[kind] = max(limit, 0.0)
    return found


def _tree_column(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    f, limit, low, high = tree
    return f"CASE WHEN f_{f} <= {limit} THEN {_tree_column(low)} ELSE {_tree_column(high)} END"


def feature_counts(labelled: DataFrame) -> list[dict]:
    """Distinct feature rows of labelled spans with their counts in the two folds."""
    codes = [F.col(f"f_{k}").alias(k) for k in FEATURES]
    yes = {"pos": "label", "neg": "not label"}
    counts = [F.count_if(F.expr(f"{v} and not fold")).alias(k) for k, v in yes.items()]
    counts += [F.count_if(F.expr(f"{v} and fold")).alias(f"{k}_held") for k, v in yes.items()]
    # At most the product of the code ranges, however large the corpus.
    labelled = labelled.filter("label is not null")
    rows = labelled.groupBy(*codes).agg(*counts).orderBy(*FEATURES).collect()
    return [r.asDict() for r in rows]


def train(labelled: DataFrame):
    """Trees and thresholds from counts of feature rows over all documents."""
    rows = feature_counts(labelled)
    trees = boost(rows) if rows else []
    return trees, thresholds(rows, trees)


def held_out(rows: list[dict], trees, limits: dict[int, float]) -> dict[str, tuple[int, int, int]]:
    """By kind: base spans over the threshold, failing matches over it, and all base spans of
    the held-out fold."""
    found = {k: [0, 0, 0] for k in KINDS}
    for row in rows:
        own = found[KINDS[row["kind"]]]
        own[2] += row["pos_held"]
        if sum(_value(t, row) for t in trees) >= limits.get(row["kind"], math.inf):
            own[0] += row["pos_held"]
            own[1] += row["neg_held"]
    return {k: tuple(v) for k, v in found.items()}


def added_spans(labelled: DataFrame, trees, limits: dict[int, float]) -> DataFrame:
    """Candidates over their threshold that touch no base span and no better candidate."""
    if not trees or not any(map(math.isfinite, limits.values())):
        return labelled.filter("false").select("row", "kind", "start", "end")
    score = F.expr(" + ".join(_tree_column(t) for t in trees))
    limit = F.lit(math.inf)
    for kind, value in limits.items():
        limit = F.when(F.col("f_kind") == kind, F.lit(value)).otherwise(limit)
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1
    )
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    base_end = F.max(F.when(F.col("base"), F.col("end")))
    base_start = F.min(F.when(F.col("base"), F.col("start")))
    free = (
        labelled.withColumn("score", score)
        .withColumn("base_end", base_end.over(before))
        .withColumn("base_start", base_start.over(after))
        .filter(F.col("label").isNull() & (F.col("score") >= limit))
        .filter(F.coalesce(F.col("base_end") <= F.col("start"), F.lit(True)))
        .filter(F.coalesce(F.col("base_start") >= F.col("end"), F.lit(True)))
        .dropDuplicates(["row", "kind", "start", "end"])
    )
    # Overlapping candidates form runs; the longest of a run is taken, and of those the best.
    reach = F.max("end").over(before)
    run = Window.partitionBy("row").orderBy("start", "end")
    runs = free.withColumn(
        "new", F.coalesce((reach <= F.col("start")).cast("int"), F.lit(1))
    ).withColumn("run", F.sum("new").over(run))
    best = Window.partitionBy("row", "run").orderBy(
        F.desc(F.col("end") - F.col("start")), F.desc("score"), "start", "end", "kind"
    )
    return (
        runs.withColumn("place", F.row_number().over(best))
        .filter("place = 1")
        .select("row", "kind", "start", "end")
    )


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id of every document), (row, kind, start, end, base of every span)."""
    matches = _all_matches(docs.select("doc_id", "text"))
    labelled = stored_table(_labelled(_spans(matches)), "pii-spans")
    trees, limits = train(labelled)
    base = labelled.filter("base").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    more = added_spans(labelled, trees, limits).withColumn("base", F.lit(False))
    return matches.select("row", "doc_id"), base.union(more)


def redact(docs: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets.

    Overlapping spans (two base kinds in one place) are replaced together, under the first.
    """
    number = F.monotonically_increasing_id().alias("row")
    numbered = stored_table(docs.select(number, "doc_id", "text"), "pii-texts")
    matches = _all_matches(numbered, F.col("row"))
    labelled = stored_table(_labelled(_spans(matches)), "pii-spans")
    base = labelled.filter("base").select("row", "kind", "start", "end")
    spans = base.union(added_spans(labelled, *train(labelled)))
    lists = spans.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("spans")
    )
    step = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(
            F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")
        )).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(
                a["out"],
                F.substring(F.col("text"), a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")),
                F.lit("["), s["kind"], F.lit("]"),
            ).alias("out"),
        )),
    )
    joined = numbered.join(lists, "row", "left").withColumn("step", step)
    rest = F.substring(F.col("text"), F.col("step.at").cast("int") + 1, F.length("text"))
    return joined.select("doc_id", F.concat(F.col("step.out"), rest).alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = find_spans(table(spark, sf_dir, "documents"))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    item = F.struct("start", place.alias("k"), "end", "kind")
    each = spans.groupBy("row").agg(
        *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{k}") for k in KINDS],
        F.array_sort(F.collect_list(F.when(F.col("base"), item))).alias("base"),
        F.array_sort(F.collect_list(item)).alias("every"),
    )

    def joined(column: str) -> Column:
        shown = F.transform(
            column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
        )
        return F.coalesce(F.array_join(shown, ","), F.lit(""))

    return rows.join(each, "row", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("every").alias("spans"),
    )


QUERIES = {"op9_pii": op9_pii}
ORACLES: dict[str, str] = {}
