import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairsieve.operators import quantiles, sampling
from pairsieve.operators.dedup import dedup_counts, keep_first
from pairsieve.plans.splitting import SplitOptions, split_pairs, usable_rows, write_split_job


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.full(1100, 3.0), rng.normal(size=600).round(2), rng.random(300)])
    rows = [(i, float(v), "abc"[i % 3]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, v double, g string").repartition(5).persist()
    return df, values


def _order(ids, seed):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def test_sample_is_the_hash_order_prefix(numbers):
    df, values = numbers
    for n in (0, 1, 37, 2000, 5000):
        got = {r.id for r in sampling.sample_rows(df, "id", n, 9).collect()}
        assert got == set(_order(range(len(values)), 9)[:n])
    assert sampling.sample_fraction(df, "id", 0.25).count() == 500
    assert sampling.sample_fraction(df, "id", 0.00001).count() == 1
    assert sampling.cap_rows(df, "id", None) is df
    held = sampling.hold_out(df, "id", 0.1).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in held} == {"train": 1800, "valid": 200}


def test_shuffle_keeps_rows(numbers):
    df, values = numbers
    got = [r.id for r in sampling.shuffle_rows(df, "id", 1).collect()]
    assert got == _order(range(len(values)), 1)


def test_stratified_split_sizes(numbers):
    df, _ = numbers
    split = sampling.stratified_split(df, "id", "g", 0.7, 0.2)
    counts = {(r.g, r.split): r["count"] for r in split.groupBy("g", "split").count().collect()}
    for g, n in {r.g: r["count"] for r in df.groupBy("g").count().collect()}.items():
        assert counts[g, "train"] == int(n * 0.7) and counts[g, "valid"] == int(n * 0.2)
    assert split.select("id").distinct().count() == 2000
    with pytest.raises(ValueError):
        sampling.stratified_split(df, "id", "g", 0.9, 0.1)


def test_stratified_sample(numbers):
    df, _ = numbers
    got = sampling.stratified_sample(df, "id", "g", 0.1).groupBy("g").count().collect()
    assert {r.g: r["count"] for r in got} == {"a": 66, "b": 66, "c": 66}


def test_quantiles_equal_numpy(numbers):
    df, values = numbers
    probs = {f"p{i}": i / 20 for i in range(21)}
    got = quantiles.exact_quantiles(df, "v", probs).first()
    assert np.allclose(list(got), np.quantile(values, list(probs.values())))
    by = {r.g: r for r in quantiles.describe(df, "v", ["g"]).collect()}
    frame = pd.DataFrame({"v": values, "g": ["abc"[i % 3] for i in range(2000)]})
    for g, part in frame.groupby("g"):
        row = by[g]
        assert row.n_rows == len(part) and np.isclose(row.median, part.v.median())
        assert np.isclose(row["std"], part.v.std()) and np.isclose(row["mean"], part.v.mean())
    near = quantiles.approximate_quantiles(df, "v", {"m": 0.5}).first().m
    assert abs(near - np.median(values)) < 0.2


def test_ranges_grow_with_the_values(spark):
    assert quantiles.range_count(0) == quantiles.range_count(10**9) == quantiles.RANGES
    assert quantiles.range_count(10**11) == 16384
    df = spark.range(1000).select((F.col("id") % 700).cast("double").alias("v"))
    for per_range in (1, 10**6):
        found = quantiles.cumulative_counts(df, "v", per_range=per_range).collect()
        assert len(found) == 700 and {r.total for r in found} == {1000}
        assert all(r.before == r.value + min(r.value, 300) for r in found)


def test_average_ranks_equal_pandas(numbers):
    df, values = numbers
    got = {r.value: r.avg_rank for r in quantiles.average_ranks(df, "v").collect()}
    ranks = pd.Series(values).rank()
    assert all(np.isclose(got[v], r) for v, r in zip(values, ranks))


def test_strata_with_repeated_edges(numbers):
    df, values = numbers
    edges = sampling.quantile_edges(df, "v", 5)
    assert all(a < b for a, b in zip(edges, edges[1:]))
    strata = df.select("v", sampling.stratum_of(F.col("v"), edges).alias("s")).collect()
    expected = pd.cut(values, bins=edges, labels=False, include_lowest=True)
    by_value = dict(zip(values, np.nan_to_num(expected).astype(int)))
    assert all(r.s == by_value[r.v] for r in strata)
    assert len(sampling.distinct_edges(df, "v", 5)) < 6


def test_keep_first(spark):
    rows = [(3, "x"), (1, "x"), (2, "y"), (5, None), (4, None), (0, "")]
    df = spark.createDataFrame(rows, "row_id long, target string").repartition(3)
    assert sorted(r.row_id for r in keep_first(df).collect()) == [0, 1, 2, 4]
    assert tuple(dedup_counts(df).first()) == (6, 4, 2)


def test_hot_key_is_cut_down_before_the_shuffle(spark):
    df = spark.range(10000).select(F.col("id").alias("row_id"), F.col("id") < 0)
    df = df.toDF("row_id", "target").withColumn("target", F.col("target").cast("string"))
    kept = keep_first(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert [r.row_id for r in kept.collect()] == [0]


def test_split_job(spark, tmp_path):
    rows = [(i, f"s{i}", f"t{i // 2}", str(i / 50 - 0.2) if i % 9 else "bad") for i in range(200)]
    df = spark.createDataFrame(
        rows, "row_id long, src_fm string, target string, condition_cover_rate string"
    )
    usable = usable_rows(df)
    assert usable.agg(F.min("condition_cover_rate"), F.max("condition_cover_rate")).first()[:] == (0.0, 1.0)
    assert usable_rows(df, 0.5).agg(F.max("condition_cover_rate")).first()[0] == 0.5
    inside = df.filter("try_cast(condition_cover_rate AS double) BETWEEN 0 AND 1")
    assert usable_rows(inside, 0.5).agg(F.max("condition_cover_rate")).first()[0] > 0.9
    stored = write_split_job(df, str(tmp_path), SplitOptions(max_rows=60))
    assert stored.count() == 60 and stored.select("target").distinct().count() == 60
    assert {r.split for r in stored.select("split").distinct().collect()} == {"train", "valid", "test"}
    summary = spark.read.json(str(tmp_path / "split_summary"))
    assert summary.agg(F.sum("n_rows")).first()[0] == 60
    again = split_pairs(df.repartition(6), SplitOptions(max_rows=60, drop_repeated_edges=True))
    assert again.count() == 60
