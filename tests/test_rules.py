from pyspark.sql import functions as F

from pairsieve import check_sample
from pairsieve.operators import report
from pairsieve.operators.rules import (
    LABELS,
    Rule,
    RuleOptions,
    below_threshold,
    first_match,
    flag_profile,
    inclusive_match,
    profile_counts,
    remove_listed,
    standard_rules,
    with_structure,
)
from pairsieve.plans.cleaning import coverage_only, label_pairs, relevance_only, syntax_only
from tests.conftest import PAIRS

OPEN = RuleOptions(first_match_only=False)


def labels(df):
    return {r.row_id: r.noise_type for r in df.select("row_id", "noise_type").collect()}


def test_expected_labels(pairs):
    got = labels(label_pairs(pairs))
    wrong = [(PAIRS[i], got[i]) for i in got if got[i] != PAIRS[i][2]]
    assert not wrong


def test_labels_do_not_depend_on_partitions_and_are_stable(pairs):
    one = labels(label_pairs(pairs.repartition(1)))
    assert one == labels(label_pairs(pairs.repartition(7)))
    kept = pairs.join(label_pairs(pairs).filter("noise_type IS NULL").select("row_id"), "row_id")
    assert set(labels(label_pairs(kept)).values()) == {None}


def test_first_match_is_first_inclusive(pairs, spark):
    patterns = spark.createDataFrame([("public <T>",), ("abstract",)], "pattern string")
    prepared = with_structure(pairs, patterns, OPEN)
    rules = standard_rules(prepared, OPEN)
    rows = prepared.select(
        first_match(rules).alias("one"), inclusive_match(rules).alias("all")
    ).collect()
    assert all(r.one == (r["all"][0] if r["all"] else None) for r in rows)
    assert any(len(r["all"]) > 1 for r in rows)


def test_dictionary_rule_comes_first_and_is_case_sensitive(pairs, spark):
    patterns = spark.createDataFrame([("public <T>",), ("ABSTRACT",)], "pattern string")
    got = labels(label_pairs(pairs, patterns))
    assert got[1] == "unnecessary_annotations"
    assert "unnecessary_annotations" not in {got[i] for i, p in enumerate(PAIRS) if p[0] and "public <T>" not in p[0]}


def test_all_rules_off_removes_nothing(pairs):
    options = RuleOptions(disabled=[n for n, _ in LABELS])
    assert set(labels(label_pairs(pairs, None, options)).values()) == {None}


def test_null_policy_text(pairs):
    got = labels(label_pairs(pairs, None, RuleOptions(null_policy="text")))
    null_src = next(i for i, p in enumerate(PAIRS) if p[0] is None)
    assert got[null_src] == "no_relevance"


def test_threshold_is_strict_and_keeps_unknown_labels(spark):
    df = spark.createDataFrame(
        [(0, 0.1), (1, 0.3), (2, None), (3, float("nan")), (4, 0.29)], "row_id long, y double"
    )
    got = [r[0] for r in df.filter(below_threshold(F.col("y"), 0.3)).select("row_id").collect()]
    assert sorted(got) == [0, 4]


def test_coverage_job(spark):
    rows = [(i, "s", f"t{i}", y) for i, y in enumerate([0.1, 0.2, 0.5, 0.8, 0.9])]
    df = spark.createDataFrame(
        rows, "row_id long, src_fm string, target string, condition_cover_rate double"
    )
    assert coverage_only(df, 0.3).filter("noise_type = 'low_coverage'").count() == 2
    assert coverage_only(df, 0.01).filter("noise_type IS NOT NULL").count() == 0
    bare = df.drop("condition_cover_rate")
    assert coverage_only(bare, 0.3).filter("noise_type IS NOT NULL").count() == 0
    counts = [
        coverage_only(df, t).filter("noise_type IS NOT NULL").count() for t in (0.05, 0.15, 0.6, 1)
    ]
    assert counts == sorted(counts)


def test_single_stage_jobs(pairs):
    syntax = set(labels(syntax_only(pairs)).values())
    assert "no_relevance" not in syntax and "syntax_error" in syntax
    assert set(labels(relevance_only(pairs)).values()) == {None, "no_relevance"}


def test_profile_counts_agree_with_rows(pairs):
    prepared = with_structure(pairs, None, OPEN)
    rules = standard_rules(prepared, OPEN)
    names = [r.name for r in rules]
    counts = {
        r.noise_type: (r.inclusive, r.exclusive)
        for r in profile_counts(flag_profile(prepared, rules), names).collect()
    }
    rows = prepared.select(
        first_match(rules).alias("one"), inclusive_match(rules).alias("all")
    ).collect()
    for name in names:
        assert counts[name] == (
            sum(name in r["all"] for r in rows), sum(name == r.one for r in rows)
        )


def test_custom_rule(pairs):
    rule = Rule("too_short", "syntax", F.length("src_fm") < 20)
    one = pairs.select("row_id", first_match([rule]).alias("noise_type"))
    assert {r.noise_type for r in report.breakdown(one).collect()} == {"too_short"}


def test_remove_list(pairs, spark):
    gone = spark.createDataFrame([(0,), (3,)], "row_id long")
    assert remove_listed(pairs, gone).count() == len(PAIRS) - 2


def test_single_sample(spark):
    assert check_sample(spark, "void f() { }", "void t() { f(); }") == "empty_method"
    assert check_sample(spark, "void f() { g(); }", "void t() { f(); }") is None


def test_structure_is_scanned_once(pairs):
    plan = report.funnel(label_pairs(pairs))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if line.strip(" +-:").startswith("Filter")]
    assert filters and all("reverse(" not in line for line in filters)
    assert plan.count("Generate") == 1
