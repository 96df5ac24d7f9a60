"""Quality rules and labelling.

A rule is a name, a stage and a boolean column. A rule list in priority order gives the
first-match label (one ``noise_type`` per row) or the inclusive labels (all that apply).
Users extend the engine by adding rules to the list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsieve.functions import code_structure as cs
from pairsieve.operators.dictionary import Windowed, with_hit_flag
from pairsieve.session import spread_small
from pairsieve.sources.schema import LABEL, ROW_ID, SRC, TARGET

SYNTAX, RELEVANCE, COVERAGE = "syntax", "relevance", "coverage"

# Rule labels in priority order, and the stage of each.
LABELS = [
    ("unnecessary_annotations", SYNTAX),
    ("ambiguous_type", SYNTAX),
    ("syntax_error", SYNTAX),
    ("empty_exception", SYNTAX),
    ("empty_method", SYNTAX),
    ("non_english", SYNTAX),
    ("no_relevance", RELEVANCE),
    ("low_coverage", COVERAGE),
]


@dataclass(frozen=True)
class Rule:
    name: str
    stage: str
    flag: Column

    @property
    def fires(self) -> Column:
        """A rule that cannot decide (null) keeps the row."""
        return F.coalesce(self.flag, F.lit(False))


@dataclass
class RuleOptions:
    """What the standard rule list looks at."""

    stages: Sequence[str] = (SYNTAX, RELEVANCE, COVERAGE)
    disabled: Sequence[str] = ()
    coverage_threshold: float = 0.01
    coverage_column: str = LABEL
    # "syntax_error": missing code is broken code. "text": it is read as the text 'nan'.
    null_policy: str = "syntax_error"
    char_ranges: Sequence[tuple[str, str]] = field(
        default_factory=lambda: list(cs.NON_ENGLISH_RANGES)
    )
    # Skip the structure scan for rows the dictionary rule removes anyway.
    first_match_only: bool = True
    # How the dictionary rule runs ('local' or 'join'; None: by size), and a dictionary made
    # ready before, so that several tables share the work.
    dictionary_form: str | None = None
    keyed: Windowed | None = None
    # Deal a small input to all cores. False: the rows have been dealt, by their number say.
    spread: bool = True


def below_threshold(value: Column, threshold: float) -> Column:
    """Strictly below; null and NaN are not below anything."""
    return F.coalesce((value < F.lit(threshold)) & ~F.isnan(value), F.lit(False))


def with_structure(
    df: DataFrame, patterns: DataFrame | None, options: RuleOptions
) -> DataFrame:
    """Add ``_hit``, ``_src`` and ``_tgt``: what the standard rules read, computed once."""
    if options.null_policy not in ("syntax_error", "text"):
        raise ValueError(f"unknown null_policy: {options.null_policy}")
    src, target = F.col(SRC), F.col(TARGET)
    if options.null_policy == "text":
        src, target = F.coalesce(src, F.lit("nan")), F.coalesce(target, F.lit("nan"))
    wanted = "unnecessary_annotations" not in options.disabled and SYNTAX in options.stages
    df = with_hit_flag(
        df, SRC, patterns if wanted else None, "_hit", options.dictionary_form, options.keyed,
        options.spread,
    )
    scan_src, scan_target = cs.scan_code(src), cs.scan_code(target)
    if options.first_match_only:
        scan_src = F.when(~F.col("_hit"), scan_src)
        scan_target = F.when(~F.col("_hit"), scan_target)
    return scanned_once(df, {"_src": scan_src, "_tgt": scan_target}, options.spread)


def scanned_once(df: DataFrame, scans: dict[str, Column], spread: bool = True) -> DataFrame:
    """Add costly columns behind a generator of one row.

    Filters on what derives from them cannot move below a generator, where the optimizer
    would otherwise copy the whole scan into the filter condition and run it again.
    ``spread``: deal a small input to all cores first.
    """
    row = F.struct(*[c.alias(name) for name, c in scans.items()])
    return (spread_small(df) if spread else df).select("*", F.inline(F.array(row)))


def standard_rules(df: DataFrame, options: RuleOptions) -> list[Rule]:
    """The standard rules over a table prepared by ``with_structure``, in priority order.

    Without the coverage column its rule is left out and nothing is removed by it.
    """
    src, target = F.col("_src"), F.col("_tgt")
    flags = {
        "unnecessary_annotations": F.col("_hit"),
        "ambiguous_type": cs.ambiguous_type(src),
        "syntax_error": cs.grammar_error(src) | cs.grammar_error(target),
        "empty_exception": cs.empty_handler(src),
        "empty_method": cs.empty_method(src),
        "non_english": cs.in_char_ranges(F.col(SRC), options.char_ranges)
        | cs.in_char_ranges(F.col(TARGET), options.char_ranges),
        "no_relevance": cs.relevance_score(src, target) == 0,
    }
    if options.coverage_column in df.columns:
        flags["low_coverage"] = below_threshold(
            F.col(options.coverage_column), options.coverage_threshold
        )
    return [
        Rule(name, stage, flags[name])
        for name, stage in LABELS
        if name in flags and stage in options.stages and name not in options.disabled
    ]


def _chain(rules: Sequence[Rule], value) -> Column:
    chain = None
    for rule in rules:
        out = F.lit(value(rule))
        chain = F.when(rule.fires, out) if chain is None else chain.when(rule.fires, out)
    return F.lit(None).cast("string") if chain is None else chain


def first_match(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that fires, null for a clean row."""
    return _chain(rules, lambda r: r.name)


def inclusive_match(rules: Sequence[Rule]) -> Column:
    """Names of all rules that fire, in priority order."""
    return F.filter(
        F.array(*[F.when(r.fires, F.lit(r.name)) for r in rules]).cast("array<string>"),
        lambda name: name.isNotNull(),
    )


def stage_of(noise_type: Column, rules: Sequence[Rule] | None = None) -> Column:
    """Stage a label belongs to."""
    pairs = LABELS if rules is None else [(r.name, r.stage) for r in rules]
    chain = F.lit(None).cast("string")
    for stage in dict.fromkeys(s for _, s in pairs):
        names = [n for n, s in pairs if s == stage]
        chain = F.when(noise_type.isin(*names), F.lit(stage)).otherwise(chain)
    return chain


def kept(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("noise_type").isNull())


def remove_listed(df: DataFrame, removed: DataFrame, key: str = ROW_ID) -> DataFrame:
    """Drop the rows on a remove list (any table with the key column)."""
    return df.join(removed.select(key), key, "left_anti")


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def noise_tier(noise_type: Column) -> Column:
    """DEFINITE_NOISE for rules that cannot err, PROBABLE_NOISE for others, else CLEAN."""
    return (
        F.when(noise_type.isNull(), F.lit("CLEAN"))
        .when(
            noise_type.isin("unnecessary_annotations", "syntax_error"),
            F.lit("DEFINITE_NOISE"),
        )
        .otherwise(F.lit("PROBABLE_NOISE"))
    )


def tier_removed(tier: Column, aggressive: bool = True) -> Column:
    """Aggressive mode removes both noise tiers, conservative mode the definite one."""
    return (tier != "CLEAN") if aggressive else (tier == "DEFINITE_NOISE")


def flag_profile(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One boolean column per rule and the count ``n`` of rows with that combination.

    At most 2^rules rows, from one pass over the table. Inclusive counts, co-occurrence
    and ablations all read this profile instead of the rows.
    """
    return df.groupBy(*[r.fires.alias(r.name) for r in rules]).agg(F.count("*").alias("n"))


def _first_of(names: Sequence[str]) -> Column:
    chain = F.lit(None).cast("string")
    for name in reversed(names):
        chain = F.when(F.col(name), F.lit(name)).otherwise(chain)
    return chain


def profile_counts(profile: DataFrame, names: Sequence[str]) -> DataFrame:
    """(noise_type, inclusive, exclusive): all rows a rule fires on / is first on."""
    first = _first_of(names)
    return profile.select(
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("noise_type"),
                        F.col(name).alias("fires"),
                        F.coalesce(first == name, F.lit(False)).alias("is_first"),
                    )
                    for name in names
                ]
            )
        ),
    ).groupBy("noise_type").agg(
        F.coalesce(F.sum(F.when(F.col("fires"), F.col("n"))), F.lit(0)).alias("inclusive"),
        F.coalesce(F.sum(F.when(F.col("is_first"), F.col("n"))), F.lit(0)).alias("exclusive"),
    )


def co_occurrence(profile: DataFrame, names: Sequence[str]) -> DataFrame:
    """(type_a, type_b, n): rows on which both rules fire, for every pair of rules."""
    pairs = [
        F.struct(
            F.lit(a).alias("type_a"), F.lit(b).alias("type_b"),
            (F.col(a) & F.col(b)).alias("both"),
        )
        for i, a in enumerate(names)
        for b in names[i + 1:]
    ]
    return (
        profile.select("n", F.inline(F.array(*pairs)))
        .filter("both")
        .groupBy("type_a", "type_b")
        .agg(F.sum("n").alias("n"))
    )


def ablation(profile: DataFrame, names: Sequence[str], variants: dict) -> DataFrame:
    """(variant, tp, fp, fn, tn, scores): the rule list without some rules against all of it.

    ``variants`` maps a name to the rules switched off. All variants come from one pass.
    """
    from pairsieve.operators.metrics import confusion

    def any_of(kept):
        flag = F.lit(False)
        for name in kept:
            flag = flag | F.col(name)
        return flag

    rows = [
        F.struct(
            F.lit(variant).alias("variant"),
            any_of(names).alias("truth"),
            any_of([n for n in names if n not in off]).alias("predicted"),
        )
        for variant, off in variants.items()
    ]
    weighted = profile.select("n", F.inline(F.array(*rows)))
    return confusion(
        weighted, F.col("truth"), F.col("predicted"), by=["variant"], weight=F.col("n")
    )
