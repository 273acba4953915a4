"""Exact top-k inner products: a ball tree per shard, searched by branch and bound.

Vectors are dealt into shards by id, queries into blocks; a task has one shard and one block of queries. Each query is
answered by its home shard first. Its kth score there goes along to all other shards, which start from it instead of
from nothing. In a shard the leaves of a query come in order of their upper bound (q.c + |q| r, and no more than
that of any ball around them) until that is below the current kth score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SHARD_ROWS = 4096
QUERY_ROWS = 4096
LEAF_ROWS = 64
LEAST = -(1 << 63)
_FOUND = "query bigint, twin bigint, found bigint, score bigint"
_EMPTY = pa.schema([("query", pa.int64()), ("twin", pa.int64()), ("found", pa.int64()), ("score", pa.int64())]).empty_table()


class BallTree:
    def __init__(self, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        centres, radii, ceilings, leaves = [], [], [], []
        todo = [(0, len(vectors), -1)]
        while todo:
            start, end, parent = todo.pop()
            own = vectors[self.order[start:end]]
            centre = own.mean(axis=0)
            away = ((own - centre) ** 2).sum(axis=1)
            me = len(centres)
            centres.append(centre)
            radii.append(math.sqrt(away.max()))
            ceilings.append(parent)
            leaf = end - start <= leaf_rows or radii[-1] == 0
            leaves.append((start, end) if leaf else None)
            if not leaf:
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                half = (end - start) // 2
                split = np.argpartition(own @ (other - far), half)
                self.order[start:end] = self.order[start:end][split]
                todo += [(start, start + half, me), (start + half, end, me)]
        self.centres, self.radii, self.parents = np.array(centres), np.array(radii), ceilings
        self.leaves = [(i, *span) for i, span in enumerate(leaves) if span]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, leaves): no vector of the leaf has a larger inner product."""
        lengths = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        own = queries @ self.centres.T + lengths * self.radii
        own += 1e-9 * (1 + np.abs(own) + lengths * np.abs(self.radii))  # rounding
        for i, parent in enumerate(self.parents):  # parents come before their children
            if parent >= 0:
                own[:, i] = np.minimum(own[:, i], own[:, parent])
        return own[:, [i for i, _, _ in self.leaves]]


def search(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(queries, k) ids and scores of the best vectors not below ``least``, ties to the smaller id; scores of unused places are -inf."""
    tree = BallTree(vectors)
    bounds = tree.bounds(queries)
    ranked = np.argsort(-bounds, axis=1)
    best, best_ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    floor = np.where(np.isfinite(least), least, -np.inf)
    active = np.arange(len(queries))
    for turn in range(ranked.shape[1]):
        leaf = ranked[active, turn]
        going = bounds[active, leaf] >= np.maximum(best[active, -1], floor[active])
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        for at in np.unique(leaf):
            _, start, end = tree.leaves[at]
            rows, who = tree.order[start:end], active[leaf == at]
            scores = queries[who] @ vectors[rows].T
            scores[ids[rows][None, :] == own[who][:, None]] = -np.inf
            scores[scores < floor[who][:, None]] = -np.inf
            scores = np.concatenate((best[who], scores), axis=1)
            named = np.concatenate((best_ids[who], np.broadcast_to(ids[rows], (len(who), len(rows)))), axis=1)
            order = np.lexsort((named, -scores), axis=1)[:, :k]
            best[who], best_ids[who] = np.take_along_axis(scores, order, 1), np.take_along_axis(named, order, 1)
    return best_ids, best


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Exact in double precision as long as inner products are below 2**53."""
    array = column.combine_chunks()
    array = array if isinstance(array, pa.Array) else array.chunk(0)
    return array.flatten().to_numpy().reshape(len(array), -1).astype(np.float64)


def usable(vector: Column) -> Column:
    """Not null, and no component is null, NaN or infinite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def top_k(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "vector", k: int = K,
          shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, ``key``, score): each query's ``k`` best rows by inner product of integer vectors.

    ``vector`` is an array<bigint>; null vectors take no part and vectors meet only those of their length. A row isn't found
    by queries of its own id. Rows that repeat an id are found one by one; a query row that is repeated is answered once. Ties go to the
    smaller id, null first. Empty in, empty out; fewer than ``k`` others give all.
    """
    rows = vectors.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("id"), F.col(vector).alias("vector"), is_query.alias("asks")).where("vector is not null")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = max(1, math.ceil(counts.n / shard_rows)), max(1, math.ceil(counts.q / query_rows))
    place = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    parts = ["dim", "shard", "part"]
    held = rows.select(F.size("vector").alias("dim"), place.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"), "id", "vector")
    asked = (
        rows.where("asks").select(F.size("vector").alias("dim"), place.alias("home"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("part"),
                                  F.col("id").alias("query"), F.xxhash64("vector").alias("twin"), F.col("vector").alias("wanted")).distinct())

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _EMPTY
        own = right["query"].to_numpy()
        ids, scores = search(left["id"].to_numpy(), _matrix(left["vector"]), own, _matrix(right["wanted"]), right["least"].to_numpy(), k)
        at, place = np.nonzero(np.isfinite(scores))
        return pa.table({"query": own[at], "twin": right["twin"].to_numpy()[at], "found": ids[at, place], "score": scores[at, place].astype(np.int64)})

    def answered(questions: DataFrame) -> DataFrame:
        return held.groupBy(parts).cogroup(questions.groupBy(parts)).applyInArrow(answer, _FOUND)

    at_home = answered(asked.select("dim", F.col("home").alias("shard"), "part", "query", "twin", "wanted", F.lit(float("-inf")).alias("least")))
    kth = at_home.groupBy("query", "twin").agg(F.when(F.count("*") == k, F.min("score").cast("double")).otherwise(float("-inf")).alias("least"))
    away = asked.join(kth, ["query", "twin"], "left").select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "home", "part", "query", "twin", "wanted",
        F.coalesce("least", F.lit(float("-inf"))).alias("least")).where("shard <> home").drop("home")
    best = Window.partitionBy("query", "twin").orderBy(F.desc("score"), "found")
    return (
        at_home.union(answered(away)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select(F.col("query").alias("query_id"), "rank", F.when(F.col("found") != LEAST, F.col("found")).alias(key), "score"))
