"""Queries on samples and splits. Both engines order rows by the same hash."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve.operators import sampling
from pairsieve.operators.quantiles import describe
from pairsieve.plans.checks.tables import CODE_PAIRS, code_pairs, registry, table
from pairsieve.plans.splitting import SplitOptions, split_pairs

QUERIES, ORACLES, query = registry()

_H = "md5('42:' || doc_id)"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars")


@query(f"SELECT doc_id FROM documents ORDER BY {_H} LIMIT 137")
def sample_rows(spark, sf_dir):
    return sampling.sample_rows(_docs(spark, sf_dir), "doc_id", 137).select("doc_id")


@query(f"""SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {_H})
<= greatest(1, floor(0.3 * (SELECT count(*) FROM documents)))""")
def sample_fraction(spark, sf_dir):
    return sampling.sample_fraction(_docs(spark, sf_dir), "doc_id", 0.3).select("doc_id")


@query(f"""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_H})
<= floor(0.1 * (SELECT count(*) FROM documents)) THEN 'valid' ELSE 'train' END AS split
FROM documents""")
def hold_out(spark, sf_dir):
    return sampling.hold_out(_docs(spark, sf_dir), "doc_id").select("doc_id", "split")


_EDGES = """e AS (SELECT quantile_cont(n_chars::double, 0.0) AS e0,
  quantile_cont(n_chars::double, 0.2) AS e1, quantile_cont(n_chars::double, 0.4) AS e2,
  quantile_cont(n_chars::double, 0.6) AS e3, quantile_cont(n_chars::double, 0.8) AS e4
  FROM documents),
strata AS (SELECT doc_id, n_chars, (n_chars > e1)::int + (n_chars > e2)::int
  + (n_chars > e3)::int + (n_chars > e4)::int AS stratum FROM documents, e)"""
_SPLIT = f"""ranked AS (SELECT doc_id, n_chars, stratum,
  row_number() OVER (PARTITION BY stratum ORDER BY {_H}) AS r,
  count(*) OVER (PARTITION BY stratum) AS n FROM strata),
split AS (SELECT doc_id, n_chars, stratum, CASE WHEN r <= floor(n * 0.8) THEN 'train'
  WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM ranked)"""


def _split(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    edges = sampling.quantile_edges(docs, "n_chars")
    strata = docs.withColumn(
        "stratum", sampling.stratum_of(F.col("n_chars").cast("double"), edges)
    )
    return sampling.stratified_split(strata, "doc_id", "stratum", few_groups=True)


@query(f"WITH {_EDGES}, {_SPLIT} SELECT doc_id, stratum::bigint AS stratum, split FROM split")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select(
        "doc_id", F.col("stratum").cast("long").alias("stratum"), "split"
    )


@query(f"""WITH {_EDGES}, {_SPLIT} SELECT split, count(*) AS n_rows,
min(n_chars)::double AS min, quantile_cont(n_chars::double, 0.5) AS median,
round(avg(n_chars), 6) AS mean, max(n_chars)::double AS max,
round(stddev_samp(n_chars), 6) AS std FROM split GROUP BY split""")
def split_summary(spark, sf_dir):
    values = _split(spark, sf_dir).withColumn("n_chars", F.col("n_chars").cast("double"))
    return sampling.split_summary(values, "n_chars").withColumns(
        {"mean": F.round("mean", 6), "std": F.round("std", 6)}
    )


@query(f"""WITH {_EDGES}, {_SPLIT} SELECT
(row_number() OVER (ORDER BY stratum) - 1)::bigint AS position, stratum::bigint AS stratum,
count(*) AS n_rows, min(n_chars) AS low, max(n_chars) AS high FROM split GROUP BY stratum""")
def strata_in_order(spark, sf_dir):
    found = sampling.strata_summary(_split(spark, sf_dir), "stratum", "n_chars")
    return found.withColumns({c: F.col(c).cast("long") for c in ("position", "stratum")})


@query("""SELECT event_id, event_type FROM events QUALIFY
row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id))
<= floor(0.2 * count(*) OVER (PARTITION BY event_type))""")
def stratified_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.stratified_sample(events, "event_id", "event_type", 0.2, few_groups=True)


@query(f"""WITH pairs AS ({CODE_PAIRS}), usable AS (
  SELECT row_id, target, least(greatest(condition_cover_rate, 0), 1) AS y FROM pairs),
uniq AS (SELECT row_id, y FROM usable
  QUALIFY row_number() OVER (PARTITION BY target ORDER BY row_id) = 1),
q AS (SELECT quantile_cont(y, 0.0) AS e0, quantile_cont(y, 0.2) AS e1,
  quantile_cont(y, 0.4) AS e2, quantile_cont(y, 0.6) AS e3, quantile_cont(y, 0.8) AS e4,
  quantile_cont(y, 1.0) AS e5 FROM uniq),
b1 AS (SELECT *, CASE WHEN e1 <= e0 THEN e0 + 1e-9 ELSE e1 END AS f1 FROM q),
b2 AS (SELECT *, CASE WHEN e2 <= f1 THEN f1 + 1e-9 ELSE e2 END AS f2 FROM b1),
b3 AS (SELECT *, CASE WHEN e3 <= f2 THEN f2 + 1e-9 ELSE e3 END AS f3 FROM b2),
b4 AS (SELECT *, CASE WHEN e4 <= f3 THEN f3 + 1e-9 ELSE e4 END AS f4 FROM b3),
strata AS (SELECT row_id, y, (y > f1)::int + (y > f2)::int + (y > f3)::int + (y > f4)::int
  AS stratum FROM uniq, b4),
ranked AS (SELECT row_id, y, row_number() OVER (PARTITION BY stratum ORDER BY md5('42:' || row_id))
  AS r, count(*) OVER (PARTITION BY stratum) AS n FROM strata)
SELECT row_id, round(y, 6) AS y, CASE WHEN r <= floor(n * 0.8) THEN 'train'
  WHEN r <= floor(n * 0.8) + floor(n * 0.1) THEN 'valid' ELSE 'test' END AS split FROM ranked""")
def prepare_splits(spark, sf_dir):
    """The whole split job on code pairs: usable rows, clip, duplicates out, strata, split."""
    split = split_pairs(code_pairs(spark, sf_dir), SplitOptions())
    return split.select(
        "row_id", F.round("condition_cover_rate", 6).alias("y"), "split"
    )


@query(f"""WITH {_EDGES}, {_SPLIT}, parts AS (
  SELECT 'train' AS name, doc_id FROM split WHERE split = 'train'
  UNION ALL SELECT 'valid', doc_id FROM split WHERE split = 'valid')
SELECT name, count(*) AS n FROM parts GROUP BY name""")
def union_of_sets(spark, sf_dir):
    """Named sets put under each other."""
    split = _split(spark, sf_dir)
    parts = [
        split.filter(F.col("split") == name).select(F.lit(name).alias("name"), "doc_id")
        for name in ("train", "valid")
    ]
    return parts[0].unionByName(parts[1]).groupBy("name").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS n_rows, min(value) AS min,
round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, max(value) AS max,
round(stddev_samp(value), 6) AS std FROM events GROUP BY event_type""")
def describe_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "value")
    return describe(events, "value", ["event_type"]).withColumns(
        {c: F.round(c, 6) for c in ("median", "mean", "std")}
    )
