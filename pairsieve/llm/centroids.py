"""Centroid clustering of integer vectors by Shallot search.

Rounds of assignment and replacement by the floored mean, as plain Lloyd rounds would give
them. Between rounds every vector keeps its centroid, the second-nearest it has seen, an upper
bound on the distance to the first and a lower bound on the distance to all others. When
centroids move, the bounds move with them, and

* a vector whose upper bound stays below the lower one, or below half the way from its
  centroid to the next, keeps its centroid unseen;
* any other first looks at its centroid and at the remembered second, and starts from the
  closer one. The centroids around the start are taken in the order of their distance
  from it. The scan ends at the first that is further from the start than the vector's
  distances to the start and to the second-nearest so far together; as that second
  comes nearer, the search ball shrinks.

Bounds are doubles, always rounded to the safe side. They only rule out; what is left is
compared by exact squared distances in integers, ties to the smaller number. Sums and means
are exact as well.

At scale a round is one pass: vectors stay where they are, are written once with their new
bounds, and each task sends one sum per centroid. The centroids (k vectors) go to all
tasks. A cluster with a third of all rows makes no difference.

Defined results: vectors that are null, of another length than ``dimensions``, or hold null or
non-finite components take no part. Repeated rows count each; a null id is hashed as the empty
text; vectors with equal hashes start in the order of their components. Fewer vectors than
``k`` give as many centroids. An empty centroid stays where it is. Components of ``LARGEST`` or
more are refused with an error, as distances would not fit a long. Other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.llm.common import table
from pairsieve.session import stored_table

K = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
LARGEST = 1 << 27
# More than the rounding error of the few operations a bound goes through.
SLACK = 1e-12


def _up(x):
    return x * (1 + SLACK)


def _down(x):
    return x * (1 - SLACK)


class Ball:
    """Centroids with, around each, all of them in the order of their distance."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids = centroids
        # row by row: never more than k x dimensions numbers at once
        apart = np.sqrt([((centroids - c) ** 2).sum(1).astype(float) for c in centroids])
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = _down(np.take_along_axis(apart, self.order, axis=1))
        # The first place around a centroid may go to an equal one; distances do not care.
        self.half = self.apart[:, 1] / 2 if len(centroids) > 1 else np.full(1, np.inf)
        moved = centroids if before is None else before
        self.moved = _up(np.sqrt(((centroids - moved) ** 2).sum(1).astype(float)))
        # the furthest any *other* centroid has moved
        self.others = np.array(
            [np.delete(self.moved, c).max(initial=0.0) for c in range(len(centroids))]
        )

    def squares(self, points, which) -> np.ndarray:
        gap = points - self.centroids[which]
        return np.einsum("ij,ij->i", gap, gap)


def assign(ball: Ball, points, first, second, upper, lower):
    """New (first, second, upper, lower) of integer vectors; exact in ``first``.

    Without knowledge pass first 0, second 1 (0 if there is one centroid), upper
    infinity, lower 0.
    """
    k = len(ball.centroids)
    first, second = first.copy(), second.copy()
    upper = _up(upper + ball.moved[first])
    lower = np.maximum(_down(lower - ball.others[first]) - SLACK, 0)
    if k == 1:
        return first, second, upper, lower
    left = np.flatnonzero(upper >= np.maximum(lower, ball.half[first]))
    near = ball.squares(points[left], first[left])
    upper[left] = _up(np.sqrt(near.astype(float)))
    still = upper[left] >= np.maximum(lower[left], ball.half[first[left]])
    left, near = left[still], near[still]

    # start from the closer one of the first and the remembered second
    other = ball.squares(points[left], second[left])
    a, b = first[left], second[left]
    swap = (other < near) | ((other == near) & (b < a))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    best, next_ = np.where(swap, other, near), np.where(swap, near, other)
    start, radius = a.copy(), _up(np.sqrt(best.astype(float)))
    known = (a.copy(), b.copy())
    at = np.arange(len(left))
    for place in range(k):
        reach = _up(radius[at] + _up(np.sqrt(next_[at].astype(float))))
        at = at[ball.apart[start[at], place] <= reach]
        if not len(at):
            break
        seen = ball.order[start[at], place]
        new = (seen != known[0][at]) & (seen != known[1][at])
        row, c = at[new], seen[new]
        d = ball.squares(points[left[row]], c)
        wins = (d < best[row]) | ((d == best[row]) & (c < a[row]))
        third = ~wins & (d < next_[row])
        w, t = row[wins], row[third]
        b[w], next_[w] = a[w], best[w]
        a[w], best[w] = c[wins], d[wins]
        b[t], next_[t] = c[third], d[third]
    first[left], second[left] = a, b
    upper[left] = _up(np.sqrt(best.astype(float)))
    lower[left] = _down(np.sqrt(next_.astype(float)))
    return first, second, upper, lower


STATE = "vec_id long, vector array<int>, first int, second int, upper double, lower double"


def _vectors(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    column = batch.column("vector")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.int64)


def _round(ball: Ball, dimensions: int):
    def run(batches):
        for batch in batches:
            points = _vectors(batch, dimensions)
            names = ("first", "second", "upper", "lower")
            known = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            a, b, upper, lower = assign(ball, points, *known)
            made = [
                pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(upper), pa.array(lower),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), *made],
                names=["vec_id", "vector", *names],
            )

    return run


def _distances(ball: Ball, dimensions: int):
    def run(batches):
        for batch in batches:
            points = _vectors(batch, dimensions)
            a = batch.column("first").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("first"),
                    pa.array(ball.squares(points, a), pa.int64()),
                ],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def integer_vectors(
    vectors: DataFrame, column: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """(vec_id, vector): ``floor(scale * x)`` of the vectors that take part."""
    wide = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")
    )
    finite = F.forall(
        "x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    kept = wide.filter(F.coalesce((F.size("x") == dimensions) & finite, F.lit(False)))

    def whole(v):
        n = F.floor(v * F.lit(float(scale)))
        fits = (v * F.lit(float(scale)) < LARGEST) & (v * F.lit(float(scale)) >= -LARGEST)
        refused = F.raise_error(F.lit(f"a component reaches {LARGEST} when scaled"))
        return F.when(fits, n.cast("int")).otherwise(refused.cast("int"))

    return kept.select("vec_id", F.transform("x", whole).alias("vector"))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose seeded id has the smallest hash, in that order."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(key, 256), "vector").limit(k).select("vector").collect()
    return np.array([r[0] for r in rows], np.int64)


def floored_means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact ``floor(sum / count)`` of each cluster; empty ones stay."""
    sums = [F.sum(F.col("vector")[i].cast("long")) for i in range(centroids.shape[1])]
    found = state.groupBy("first").agg(F.array(*sums).alias("sums"), F.count("*").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # one row per centroid
        out[r["first"]] = [total // r["n"] for total in r["sums"]]
    return out


def cluster(
    vectors: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    column: str = "embedding",
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = SEED,
):
    """(assignments, centroids): vec_id, cluster, distance per vector, and the last centroids."""
    whole = integer_vectors(vectors, column, dimensions, scale)
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        nothing = whole.selectExpr("vec_id", "0 AS cluster", "0L AS distance")
        return nothing, centroids
    state = whole.selectExpr(
        "vec_id",
        "vector",
        "0 AS first",
        f"{min(1, len(centroids) - 1)} AS second",
        "double('inf') AS upper",
        "0D AS lower",
    )
    before = None
    for _ in range(rounds):
        ball = Ball(centroids, before)
        state = stored_table(state.mapInArrow(_round(ball, dimensions), STATE), "cluster-round")
        before, centroids = centroids, floored_means(state, centroids)
    ball = Ball(centroids, before)
    last = state.mapInArrow(_round(ball, dimensions), STATE)
    found = last.mapInArrow(_distances(ball, dimensions), "vec_id long, cluster int, distance long")
    return stored_table(found, "clusters"), centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Assignments with the inertia of their cluster and of all, and their centroid's digest."""
    sums = {r[0]: r[1] for r in assigned.groupBy("cluster").agg(F.sum("distance")).collect()}
    total = sum(sums.values())
    rows = [
        (c, sums[c], total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
        for c, v in enumerate(centroids.tolist())
        if c in sums
    ]
    clusters = assigned.sparkSession.createDataFrame(
        rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return assigned.join(F.broadcast(clusters), "cluster").select("vec_id", *clusters.columns, "distance")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*cluster(table(spark, sf_dir, "embeddings")))


def _sql(k: int = K, rounds: int = ROUNDS) -> str:
    """Plain rounds: every vector against every centroid."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (
  SELECT n, c, sum((v.x - m.x) * (v.x - m.x)) AS distance
  FROM v JOIN c{i} m USING (i) GROUP BY n, c),
a{i} AS MATERIALIZED (
  SELECT n, arg_min(c, (distance, c)) AS c, min(distance) AS distance FROM d{i} GROUP BY n)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT m.c, m.i, coalesce(floor_mean, m.x) AS x
  FROM c{i} m LEFT JOIN (
    SELECT c, i, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS HUGEINT)
             AS floor_mean
    FROM v JOIN a{i} USING (n) GROUP BY c, i) USING (c, i))""")
    return f"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id,
         list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
v AS MATERIALIZED (SELECT n, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM w),
s AS (
  SELECT x, row_number() OVER (ORDER BY sha256('{SEED}:' || coalesce(CAST(vec_id AS VARCHAR), '')), x)
           - 1 AS c
  FROM w QUALIFY c < {k}),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM s),
{",".join(steps)},
h AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256
  FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN w USING (n) JOIN h USING (c)"""


QUERIES = {"op12_clusters": op12_clusters}
ORACLES = {"op12_clusters": _sql()}
