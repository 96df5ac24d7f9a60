"""Queries on numbers: thresholds, regression and rank measures, summaries, event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairsieve.functions import text
from pairsieve.operators import eventlog, metrics, quantiles
from pairsieve.operators.rules import Rule, below_threshold, first_match
from pairsieve.operators.scoring import join_predictions
from pairsieve.plans.checks.tables import registry, table

QUERIES, ORACLES, query = registry()

THRESHOLDS = [0.01, 0.02, 0.03, 0.05, 0.08, 0.1]
_GRID = ", ".join(f"({t}::double)" for t in THRESHOLDS)
EDGES = [0.0, 0.02, 0.04, 0.07, 0.1]


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _lineitem(spark, sf_dir):
    """l_tax taken as a prediction of l_discount."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_discount").alias("y"), F.col("l_tax").alias("p")
    )


_YP = "yp AS (SELECT l_discount AS y, l_tax AS p FROM lineitem)"


@query("""SELECT CASE WHEN l_discount < 0.03 THEN 'low_coverage' END AS noise_type,
count(*) AS n FROM lineitem GROUP BY 1""")
def label_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_discount")
    rule = Rule("low_coverage", "coverage", below_threshold(F.col("l_discount"), 0.03))
    return (
        rows.select(first_match([rule]).alias("noise_type"))
        .groupBy("noise_type")
        .agg(F.count("*").alias("n"))
    )


@query(f"""WITH {_YP} SELECT count(*) AS n, round(avg(abs(p - y)), 6) AS mae,
round(avg((p - y) * (p - y)), 6) AS mse, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
round(corr(p, y), 6) AS pearson_r FROM yp""")
def regression_metrics(spark, sf_dir):
    return _rounded(
        metrics.regression(_lineitem(spark, sf_dir), "y", "p"),
        "mae", "mse", "rmse", "r2", "pearson_r",
    )


@query("""WITH a AS (SELECT o.o_totalprice AS y, sum(l.l_extendedprice) AS p
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_totalprice)
SELECT count(*) AS n, round(avg(abs(p - y)), 2) AS mae, round(corr(p, y), 6) AS pearson_r FROM a""")
def aligned_predictions(spark, sf_dir):
    """Predictions (line totals) aligned with labels (order totals) by row id."""
    labels = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y")
    )
    predictions = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("row_id"))
        .agg(F.sum("l_extendedprice").alias("p"))
    )
    row = metrics.regression(join_predictions(labels, predictions, "p"), "y", "p")
    return row.select(
        "n", F.round("mae", 2).alias("mae"), F.round("pearson_r", 6).alias("pearson_r")
    )


@query(f"""WITH {_YP}, r AS (SELECT
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry,
  rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp FROM yp)
SELECT round(corr(ry, rp), 6) AS spearman_rho FROM r""")
def spearman(spark, sf_dir):
    return _rounded(metrics.spearman(_lineitem(spark, sf_dir), "y", "p"), "spearman_rho")


@query("""WITH r AS (SELECT
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2
    AS ry,
  rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rp
FROM lineitem) SELECT round(corr(ry, rp), 6) AS spearman_rho FROM r""")
def spearman_many_values(spark, sf_dir):
    """Price against quantity: nearly as many distinct values as rows on one side."""
    rows = table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_quantity")
    return _rounded(
        metrics.spearman(rows, "l_extendedprice", "l_quantity"), "spearman_rho"
    )


_DESCRIBE = """count(*) AS n_rows, round(min({0}), 6) AS min,
round(quantile_cont({0}, 0.5), 6) AS median, round(avg({0}), 6) AS mean,
round(max({0}), 6) AS max, round(stddev_samp({0}), 6) AS std"""


@query(f"SELECT {_DESCRIBE.format('l_discount')} FROM lineitem")
def describe(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_discount")
    return _rounded(
        quantiles.describe(rows, "l_discount"), "min", "median", "mean", "max", "std"
    )


_PROBS = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p80": 0.8, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("SELECT " + ", ".join(
    f"round(quantile_cont(n_chars::double, {p}), 6) AS {n}" for n, p in _PROBS.items()
) + " FROM documents")
def exact_quantiles(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("n_chars")
    return _rounded(quantiles.exact_quantiles(rows, "n_chars", _PROBS), *_PROBS)


@query(f"""SELECT l_returnflag, {_DESCRIBE.format('l_extendedprice')} FROM lineitem
GROUP BY l_returnflag""")
def describe_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    described = quantiles.describe(rows, "l_extendedprice", by=["l_returnflag"])
    return _rounded(described, "min", "median", "mean", "max", "std")


@query(f"""WITH t(threshold) AS (VALUES {_GRID}) SELECT threshold,
(count(*) FILTER (l_discount < threshold))::bigint AS removed,
round(100 * (count(*) FILTER (l_discount < threshold)) / count(*), 6) AS removed_pct,
(count(*) FILTER (NOT l_discount < threshold))::bigint AS kept
FROM lineitem, t GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_discount")
    return _rounded(metrics.label_sweep(rows, "l_discount", THRESHOLDS), "removed_pct")


def _class_sql(op):
    return f"""WITH {_YP}, t(threshold) AS (VALUES {_GRID}), c AS (SELECT threshold,
  count(*) AS n, (count(*) FILTER (y {op} threshold))::bigint AS positives,
  (count(*) FILTER (y {op} threshold AND p {op} threshold))::bigint AS tp,
  (count(*) FILTER (NOT y {op} threshold AND p {op} threshold))::bigint AS fp,
  (count(*) FILTER (y {op} threshold AND NOT p {op} threshold))::bigint AS fn,
  (count(*) FILTER (NOT y {op} threshold AND NOT p {op} threshold))::bigint AS tn
  FROM yp, t GROUP BY threshold),
s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS a,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS b FROM c)
SELECT threshold, positives, round(100 * positives / n, 2) AS positives_pct, tp, fp, fn, tn,
  round(a, 4) AS precision, round(b, 4) AS recall,
  round(CASE WHEN a + b = 0 THEN 0.0 ELSE 2 * a * b / (a + b) END, 4) AS f1 FROM s"""


@query(_class_sql("<"))
def class_sweep(spark, sf_dir):
    return metrics.class_sweep(_lineitem(spark, sf_dir), "y", "p", THRESHOLDS)


@query(_class_sql("<="))
def class_sweep_inclusive(spark, sf_dir):
    return metrics.class_sweep(_lineitem(spark, sf_dir), "y", "p", THRESHOLDS, strict=False)


@query(f"""WITH {_YP}, c AS (SELECT
  (count(*) FILTER (y < 0.05 AND p < 0.05))::bigint AS tp,
  (count(*) FILTER (y >= 0.05 AND p < 0.05))::bigint AS fp,
  (count(*) FILTER (y < 0.05 AND p >= 0.05))::bigint AS fn,
  (count(*) FILTER (y >= 0.05 AND p >= 0.05))::bigint AS tn FROM yp)
SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
0.05::double AS threshold FROM c""")
def threshold_confusion(spark, sf_dir):
    row = metrics.threshold_confusion(_lineitem(spark, sf_dir), "y", "p", 0.05)
    return _rounded(row, "precision", "recall", "f1", "accuracy")


def _bins_sql():
    last = len(EDGES) - 2
    whens = " ".join(
        f"WHEN y >= {a} AND y {'<=' if i == last else '<'} {b} "
        f"THEN '[{a:g}, {b:g}{']' if i == last else ')'}'"
        for i, (a, b) in enumerate(zip(EDGES, EDGES[1:]))
    )
    return f"CASE {whens} END"


@query(f"""WITH {_YP}, b AS (SELECT {_bins_sql()} AS bin, y, p FROM yp)
SELECT bin, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM b), 6) AS pct,
round(avg(y), 6) AS mean_y, round(avg(p), 6) AS mean_pred, round(avg(abs(p - y)), 6) AS mae,
round(avg(p - y), 6) AS bias FROM b WHERE bin IS NOT NULL GROUP BY bin""")
def residual_bins(spark, sf_dir):
    bins = metrics.residual_bins(_lineitem(spark, sf_dir), "y", "p", EDGES)
    return _rounded(bins, "pct", "mean_y", "mean_pred", "mae", "bias")


@query(f"""WITH {_YP} SELECT count(*) AS n, round(avg(y), 6) AS y_mean,
round(stddev_samp(y), 6) AS y_std, round(avg(abs(p - y)), 6) AS mae,
round(100 * avg(abs(p - y)) / avg(y), 6) AS relative_mae_pct FROM yp""")
def relative_error(spark, sf_dir):
    row = metrics.relative_error(_lineitem(spark, sf_dir), "y", "p")
    return _rounded(row, "y_mean", "y_std", "mae", "relative_mae_pct")


@query("""WITH q AS (SELECT n_chars::double AS v FROM documents), p AS (SELECT
  floor(quantile_cont(v, 0.5))::bigint AS p50, floor(quantile_cont(v, 0.8))::bigint AS p80,
  floor(quantile_cont(v, 0.9))::bigint AS p90, floor(quantile_cont(v, 0.95))::bigint AS p95,
  floor(quantile_cont(v, 0.99))::bigint AS p99, count(*) AS n, min(v)::bigint AS min,
  max(v)::bigint AS max, round(avg(v), 6) AS mean, round(avg((v > 256)::int), 6) AS share_over_256,
  round(avg((v > 384)::int), 6) AS share_over_384, round(avg((v > 512)::int), 6) AS share_over_512
  FROM q)
SELECT *, CASE WHEN p95 <= 256 THEN 256 WHEN p95 <= 384 THEN 384 ELSE 512 END::bigint AS max_length
FROM p""")
def length_survey(spark, sf_dir):
    row = metrics.length_survey(table(spark, sf_dir, "documents").select("n_chars"), "n_chars")
    row = _rounded(row, "mean", "share_over_256", "share_over_384", "share_over_512")
    return row.withColumn("max_length", F.col("max_length").cast("long"))


# Balances in thousands serve as labels; every seventh customer has text instead of a number.
_LABEL = """CASE WHEN c_custkey % 7 = 0 THEN 'n/a' WHEN c_custkey % 11 = 0 THEN NULL
  ELSE cast(c_acctbal / 1000 AS {0}) END"""


def _text_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr(_LABEL.format("string")).alias("label")
    )


@query(f"""WITH l AS (SELECT {_LABEL.format('varchar')} AS label FROM customer),
n AS (SELECT try_cast(label AS double) AS v FROM l)
SELECT count(*) AS rows_total, (count(*) FILTER (v IS NULL))::bigint AS rows_dropped_na,
(count(*) FILTER (v > 1))::bigint AS rows_above_one,
(count(*) FILTER (v < 0))::bigint AS rows_below_zero FROM n""")
def label_audit(spark, sf_dir):
    return metrics.label_audit(_text_labels(spark, sf_dir), "label")


@query(f"""SELECT c_custkey, least(greatest(v, 0), 1) AS clipped FROM (
SELECT c_custkey, try_cast({_LABEL.format('varchar')} AS double) AS v FROM customer)
WHERE v IS NOT NULL""")
def coerce_and_clip(spark, sf_dir):
    number = text.to_number(F.col("label"))
    rows = _text_labels(spark, sf_dir).select("c_custkey", text.clip(number).alias("clipped"))
    return rows.na.drop(subset=["clipped"])


@query("""SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS score FROM customer""")
def logistic_score(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(text.logistic(F.col("c_acctbal") / 1000), 6).alias("score")
    )


_LOG = """log AS (SELECT event_type AS kind, event_id AS step,
  cast(json_extract(props, '$.k') AS double) AS k, value FROM events)"""


def _event_log(spark, sf_dir):
    """Events as a training log: type as kind, id as step, user as run."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("kind"),
        F.col("event_id").alias("step"),
        F.col("user_id").alias("run"),
        F.from_json("props", "k double")["k"].alias("k"),
        F.col("value"),
    )


@query(f"WITH {_LOG} SELECT kind, count(*) AS n FROM log GROUP BY kind")
def event_kinds(spark, sf_dir):
    return eventlog.kind_counts(_event_log(spark, sf_dir))


@query("""WITH e AS (SELECT user_id AS run, event_id AS step,
  cast(json_extract(props, '$.k') AS double) AS k FROM events WHERE event_type = 'error')
SELECT run, step, k, k - lag(k) OVER w AS change,
  min(k) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS best_so_far,
  k = min(k) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS is_best
FROM e WINDOW w AS (PARTITION BY run ORDER BY step)""")
def metric_trajectory(spark, sf_dir):
    evals = _event_log(spark, sf_dir).filter("kind = 'error'").select("run", "step", "k")
    return eventlog.trajectory(evals, "k", by=["run"])


@query("""WITH e AS (SELECT user_id AS run,
  cast(json_extract(props, '$.k') AS double)
    - lag(cast(json_extract(props, '$.k') AS double)) OVER (PARTITION BY user_id ORDER BY event_id)
    AS change FROM events WHERE event_type = 'error')
SELECT run, count(*) AS entries, (count(*) FILTER (change > 0)) = 0 AS is_monotone
FROM e GROUP BY run""")
def trajectory_is_monotone(spark, sf_dir):
    return eventlog.monotone_runs(metric_trajectory(spark, sf_dir), by=["run"])


@query(f"""WITH {_LOG} SELECT kind, step, k FROM log
QUALIFY row_number() OVER (PARTITION BY kind ORDER BY step DESC) <= 10""")
def last_log_entries(spark, sf_dir):
    return eventlog.last_entries(_event_log(spark, sf_dir).select("kind", "step", "k"), 10)


@query(f"""WITH {_LOG} SELECT kind, max(step) AS step, arg_max(value, step) AS value
FROM log GROUP BY kind""")
def latest_log_values(spark, sf_dir):
    return eventlog.latest_values(_event_log(spark, sf_dir), "value")
