"""Approximate nearest neighbours on robust-pruned directed graphs, one graph per shard.

Nearness is the largest inner product. Vectors get one more component, so that all have the
length of the longest; then the largest product is the smallest distance, also between two
stored vectors, and pruning by distance applies.

A shard's graph is built by inserting its vectors in batches that double in size. A greedy
search over the graph so far proposes neighbours; relaxed distance pruning keeps, nearest
first, those not ``ALPHA`` times closer to one already kept, up to ``DEGREE``; the kept ones
get an edge back, pruned again when they have too many. Of more than twice ``DEGREE`` new edges
to one node in a batch the first that many are pruned from; the others get no edge back, which
can cost recall near such a hub and was not measured there. A query runs a beam search over every
shard's graph, and the best of all shards are scored again in double precision on the
original vectors.

Equal vectors share one node. Of each node's ids the ``k + 1`` smallest can be among a
query's k nearest (one may be the query itself), so no more are carried, which is exact and
keeps a vector that a third of all rows share from filling any task. Equal queries are
searched once. A task holds one shard (``SHARD`` vectors on average, dealt by hash) and a
block of queries; a shard travels once and its queries stream past it.

Defined results: rows with null ids, and vectors that are null, empty, zero, of another length
than most, or hold null or non-finite components take no part. Ties go to the smaller id.
Rows that repeat an id count as candidates each. Other columns are not read. Fewer than k
candidates are returned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairsieve.llm.common import table
from pairsieve.session import stored_table

SHARD = 32_768
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 48
SEARCH_BEAM = 192
_EXPAND = 4  # nodes expanded per step and query
_BATCH = 512


def beam_search(points, graph, entries, queries, beam):
    """(ids, products) of the ``beam`` best nodes found for each query, best first.

    All queries of a block take a step together: each expands its best unexpanded nodes. The
    ids of unused places are -1.
    """
    block, size = len(queries), len(points)
    seen = np.zeros((block, size + 1), bool)
    seen[:, size] = True  # stands for "no neighbour"
    ids = np.full((block, beam), size, np.int32)
    score = np.full((block, beam), -np.inf, np.float32)
    open_ = np.zeros((block, beam), bool)
    take = min(beam, len(entries))
    first = queries @ points[entries].T
    best = np.argsort(-first, axis=1)[:, :take]
    ids[:, :take] = entries[best]
    score[:, :take] = np.take_along_axis(first, best, 1)
    open_[:, :take] = True
    seen[:, entries] = True
    rows = np.arange(block)
    while len(rows):
        waiting = np.where(open_[rows], score[rows], -np.inf)
        pick = np.argpartition(-waiting, _EXPAND - 1, axis=1)[:, :_EXPAND]
        live = np.take_along_axis(waiting, pick, 1) > -np.inf
        some = live.any(axis=1)
        rows, pick, live = rows[some], pick[some], live[some]
        if not len(rows):
            break
        nodes = np.where(live, ids[rows[:, None], pick], size)
        open_[rows[:, None], pick] = False
        near = graph[nodes].reshape(len(rows), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = size  # proposed twice
        new = ~seen[rows[:, None], near]
        seen[rows[:, None], near] = True
        near = np.where(new, near, size)
        width = int(new.sum(axis=1).max(initial=0))
        if not width:
            continue
        near = np.sort(near, axis=1)[:, :width]  # ``size`` is the largest value
        product = np.full(near.shape, -np.inf, np.float32)
        r, c = np.nonzero(near < size)
        product[r, c] = np.einsum("nd,nd->n", points[near[r, c]], queries[rows[r]])
        all_ids = np.concatenate((ids[rows], near), axis=1)
        all_score = np.concatenate((score[rows], product), axis=1)
        all_open = np.concatenate((open_[rows], near < size), axis=1)
        keep = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, keep, 1)
        score[rows] = np.take_along_axis(all_score, keep, 1)
        open_[rows] = np.take_along_axis(all_open, keep, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    ids = np.take_along_axis(ids, order, 1)
    return np.where(ids == size, -1, ids), np.take_along_axis(score, order, 1)


def robust_prune(points, own, candidates, degree=DEGREE, alpha=ALPHA):
    """Neighbours for the nodes ``own`` out of rows of candidates (-1: none)."""
    size = len(points)
    length = np.float32(points[0] @ points[0])
    valid = (candidates >= 0) & (candidates != own[:, None])
    vectors = points[candidates]
    distance = length - np.einsum("ncd,nd->nc", vectors, points[own])
    distance = np.where(valid, distance, np.inf)
    order = np.argsort(distance, axis=1, kind="stable")
    candidates = np.take_along_axis(candidates, order, 1)
    distance = np.take_along_axis(distance, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    between = (length - vectors @ vectors.transpose(0, 2, 1)) * np.float32(alpha * alpha)
    alive = np.isfinite(distance)
    kept = np.full((len(own), degree), size, np.int32)
    rows = np.arange(len(own))
    for place in range(degree):
        at = alive.argmax(axis=1)
        some = alive[rows, at]
        if not some.any():
            break
        kept[some, place] = candidates[rows[some], at[some]]
        alive &= ~((between[rows, at] <= distance) & some[:, None])
        alive[rows, at] = False
    return kept


def _add_back(points, graph, sources):
    """Add edges back to the nodes that ``sources`` point to."""
    size, degree = len(points), graph.shape[1]
    to = graph[sources]
    pairs = np.stack((to.ravel(), np.repeat(sources, degree)), axis=1)
    pairs = pairs[pairs[:, 0] < size]
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    nodes, start, count = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    for at in range(0, len(nodes), _BATCH):
        part, n = nodes[at : at + _BATCH], count[at : at + _BATCH]
        # Of very many new edges to one node the first 2 * degree are considered.
        width = min(int(n.max()), 2 * degree)
        place = start[at : at + _BATCH, None] + np.arange(width)
        inside = np.arange(width) < n[:, None]
        fresh = np.where(inside, pairs[np.minimum(place, len(pairs) - 1), 1], -1)
        old = graph[part]
        fresh[(fresh[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        graph[part] = robust_prune(
            points, part, np.concatenate((np.where(old == size, -1, old), fresh), axis=1)
        )


def build_graph(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of every node, entry nodes). Row ``len(points)`` stands for no node."""
    size = len(points)
    graph = np.full((size + 1, DEGREE), size, np.int32)
    order = np.random.default_rng(size).permutation(size).astype(np.int32)
    entries = order[: min(size, 32)]
    graph[entries] = robust_prune(points, entries, np.tile(entries, (len(entries), 1)))
    done = len(entries)
    while done < size:
        batch = order[done : done + min(done, _BATCH)]
        found, _ = beam_search(points, graph, entries, points[batch], BUILD_BEAM)
        graph[batch] = robust_prune(points, batch, found)
        _add_back(points, graph, batch)
        done += len(batch)
    return graph, entries


INDEX = "shard int, ids binary, vectors binary, extra binary, graph binary, entries binary"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    return flat.reshape(len(column), -1)


def _build_shard(longest: float):
    def run(rows: pa.Table) -> pa.Table:
        vectors = _matrix(rows.column("v").combine_chunks())
        squares = np.einsum("nd,nd->n", vectors, vectors, dtype=np.float64)
        extra = np.sqrt(np.maximum(longest - squares, 0)).astype(np.float32)
        points = np.concatenate((vectors, extra[:, None]), axis=1)
        graph, entries = build_graph(points)
        ids = rows.column("rep").to_numpy()
        made = {
            "shard": rows.column("shard").combine_chunks()[:1].cast(pa.int32()),
            **{
                name: pa.array([value.tobytes()], pa.binary())
                for name, value in (
                    ("ids", ids.astype("<i8")),
                    ("vectors", vectors),
                    ("extra", extra),
                    ("graph", graph),
                    ("entries", entries),
                )
            },
        }
        return pa.table(made)

    return run


class Shard:
    """A shard's index, as stored."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(len(self.ids), -1)
        extra = np.frombuffer(row["extra"], np.float32)
        self.points = np.concatenate((self.vectors, extra[:, None]), axis=1)
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(len(self.ids) + 1, -1)
        self.entries = np.frombuffer(row["entries"], np.int32)

    def search(self, queries: np.ndarray, k: int, beam: int):
        """(row of query, id, product in double precision) of the k best of each query."""
        longer = np.concatenate((queries, np.zeros((len(queries), 1), np.float32)), axis=1)
        found, _ = beam_search(self.points, self.graph, self.entries, longer, max(beam, k))
        found = found[:, :k]
        rows, places = np.nonzero(found >= 0)
        nodes = found[rows, places]
        exact = np.einsum(
            "nd,nd->n", self.vectors[nodes].astype(np.float64), queries[rows].astype(np.float64)
        )
        return rows, self.ids[nodes], exact


def _search_batches(k: int, beam: int):
    def run(batches):
        shard = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            at = 0
            while at < batch.num_rows:
                if kinds[at] == 0:  # an index, followed by its queries
                    shard = Shard(batch.slice(at, 1).to_pylist()[0])
                    at += 1
                    continue
                later = np.flatnonzero(kinds[at : at + _BATCH] == 0)
                n = int(later[0]) if len(later) else min(_BATCH, batch.num_rows - at)
                part = batch.slice(at, n)
                rows, ids, scores = shard.search(_matrix(part.column("v")), k, beam)
                reps = part.column("rep").to_numpy()[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps), pa.array(ids), pa.array(scores)],
                    names=["query_rep", "rep", "score"],
                )
                at += n

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col("embedding").cast("array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))
    sizes = rows.groupBy(F.size("v").alias("size")).count()
    most = sizes.orderBy(F.desc("count"), F.desc("size")).first()
    return rows.filter(F.size("v") == (most["size"] if most else 0))


def nearest(
    vectors: DataFrame, is_query, k: int, shard_size: int = SHARD, beam: int = SEARCH_BEAM
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest other rows."""
    rows = usable(vectors)
    place = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k + 1)
    ranked = stored_table(few, "vector-ids")
    members = ranked.withColumn("rep", F.first("vec_id").over(Window.partitionBy("v").orderBy("place")))
    nodes = ranked.filter("place = 1").select(F.col("vec_id").alias("rep"), "v")
    squares = F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    n, longest = nodes.agg(F.count("*"), F.max(squares)).first()
    shards = max(1, -(-n // shard_size))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    built = dealt.groupBy("shard").applyInArrow(_build_shard(longest or 0.0), INDEX)
    index = stored_table(built, "vector-index")

    queries = rows.filter(is_query).join(nodes, "v").select(F.col("vec_id").alias("query_id"), "rep")
    queries = stored_table(queries, "vector-queries")
    asked = nodes.join(queries.select("rep").distinct(), "rep", "left_semi")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    blank = [F.lit(None).cast("binary").alias(c) for c in
             ("ids", "vectors", "extra", "graph", "entries")]
    asked = asked.select(every, F.lit(1).alias("kind"), "rep", "v", *blank)
    stream = index.select(
        "shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("rep"),
        F.lit(None).cast("array<float>").alias("v"),
        "ids", "vectors", "extra", "graph", "entries",
    ).union(asked)
    stream = stream.repartition("shard").sortWithinPartitions("shard", "kind", "rep")
    hits = stream.mapInArrow(
        _search_batches(k + 1, beam), "query_rep long, rep long, score double"
    )
    top = Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep")
    hits = hits.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k + 1)
    named = hits.join(members.select("rep", "vec_id"), "rep")
    order = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
    # A row is left out for the query itself, and only once: k + 1 rows are enough.
    named = named.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.join(named.drop("rep"), queries.rep == named.query_rep)
        .filter("vec_id <> query_id")
        .dropDuplicates(["query_id", "vec_id", "n"])
        .withColumn("rank", F.row_number().over(own))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


QUERIES = {"op3_neighbours": op3_neighbours}
ORACLES: dict[str, str] = {}
