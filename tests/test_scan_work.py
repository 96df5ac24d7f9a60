"""What the structure scan and the keys of a text cost, read from expressions and plans."""

from pyspark.sql import functions as F

from pairsieve.functions import code_structure as cs
from pairsieve.operators import dictionary


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_let_builds_no_array_of_its_value(spark):
    let = cs._let(F.upper(F.col("t")), lambda v: F.concat(v, v))
    df = spark.createDataFrame([("a",), (None,)], "t string").select(let.alias("x"))
    assert [r.x for r in df.collect()] == ["AA", None]
    assert "transform(" not in _plan(df)


def test_words_share_one_look_for_their_start(spark):
    assert cs.MALFORMED.count(f"(?<!{cs._W})(?:") == 1
    texts = ["int x = 5 y", "a b c", "int a b", "x.a b c", "if x", "y.if x", "a1 b", "1 2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(F.col("t").rlike(cs.MALFORMED)).collect()]
    assert found == [True, True, True, False, True, False, False, True]


def test_keys_are_made_before_their_generator(spark):
    texts = spark.createDataFrame([("one two two, three", 1), (None, 2)], "text string, id long")
    patterns = spark.createDataFrame([(" two,",), ("none of it",)], "pattern string")
    keyed = dictionary.keyed_dictionary(patterns)
    shown = dictionary.with_shown_keys(texts, "text", keyed)
    assert "Generate explode(_keys" in _plan(shown)
    assert "array_distinct" in _plan(shown)
    assert "array_distinct" not in _plan(
        dictionary.with_shown_keys(texts, "text", keyed, distinct=False)
    )
    for form in ("broadcast", "join"):
        found = dictionary.hits(texts, "id", "text", patterns, form).collect()
        assert [tuple(r) for r in found] == [(1, " two,")]
