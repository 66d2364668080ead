"""Exact top-k inner-product search by Fagin's threshold algorithm.

Candidates are dealt to parts of bounded size, each row to one part; the queries stream past every part. A part orders
its rows along its main direction and cuts them into blocks; each block keeps one sorted list for each dimension, built
once. A query visits the blocks from the best bound down and carries its k best along: a block whose bound cannot beat
the k-th of them ends the visit. Within a block it reads the lists from the end that its sign favours, scores what it
meets, and stops when the bound on all rows not met (the query's product with the values at the current depth) cannot
beat the k-th score. A window merges the parts' winners.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import common

#: Candidates of a part (mean) and of a block.
PART, BLOCK = 32_768, 4_096


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v) with whole components floor(256 * x); vectors null, or with a null or non-finite component, are left out."""
    x = F.transform("v", lambda e: e.cast("double"))
    fine = F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(fine).select("id", F.transform(x, lambda e: F.floor(e * 256)).alias("v")).where("id is not null")


class SortedLists:
    """A block of vectors with, for each dimension, the rows in ascending order of their value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, np.ascontiguousarray(x)
        self.rows = np.argsort(self.x, axis=0, kind="stable").T.astype(np.int32)
        self.values = np.take_along_axis(self.x, self.rows.T, 0).T.copy()

    def search(self, q: np.ndarray, k: int, own: int, best_id: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of the rows but ``own`` and of those given, ties to smaller ids; exact."""
        n = len(self.ids)
        dims = np.flatnonzero(q)
        top, low = dims[q[dims] > 0], dims[q[dims] < 0]
        met = np.zeros(n, bool)
        done, depth = 0, 8
        while True:
            depth = min(depth, n) if len(dims) else n
            fresh = np.zeros(n, bool)
            if len(dims) and depth < n:
                fresh[self.rows[top, n - depth : n - done].ravel()] = True
                fresh[self.rows[low, done:depth].ravel()] = True
                fresh &= ~met
            else:
                fresh = ~met
            met |= fresh
            at = np.flatnonzero(fresh)
            if len(at):
                score = self.x[at] @ q
                if len(best) == k:
                    at, score = at[score >= best[-1]], score[score >= best[-1]]
                ids, score = np.concatenate([best_id, self.ids[at]]), np.concatenate([best, score])
                mine = ids != own
                ids, score = ids[mine], score[mine]
                first = np.lexsort((ids, -score))[:k]
                best_id, best = ids[first], score[first]
            if depth == n:
                return best_id, best
            bound = q[top] @ self.values[top, n - depth] + q[low] @ self.values[low, depth - 1]
            if len(best) == k and bound < best[-1]:  # equal scores could still bring a smaller id
                return best_id, best
            done, depth = depth, depth * 4


class Part:
    """The rows of a part in blocks, with each block's range of every dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        axis = np.ones(x.shape[1])
        centred = x - x.mean(0) if len(x) else x
        for _ in range(8):  # power iteration; any direction gives right results, a good one narrow blocks
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = np.argsort(centred @ axis, kind="stable")
        self.blocks = [SortedLists(ids[at], x[at]) for at in np.array_split(order, max(1, math.ceil(len(ids) / BLOCK))) if len(at)]
        self.high = np.array([b.x.max(0) for b in self.blocks]).reshape(len(self.blocks), -1)
        self.low = np.array([b.x.min(0) for b in self.blocks]).reshape(len(self.blocks), -1)

    def search(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        bound = self.high @ np.maximum(q, 0) + self.low @ np.minimum(q, 0) if self.blocks else np.zeros(0)
        for i in np.argsort(-bound):
            if len(best) == k and bound[i] < best[-1]:
                break
            best_id, best = self.blocks[i].search(q, k, own, best_id, best)
        return best_id, best


def vectors(column: pa.ListArray) -> list[np.ndarray]:
    """The vectors of an Arrow column as doubles."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum([0, *column.value_lengths().to_pylist()])
    return [flat[a:b] for a, b in zip(at, at[1:])]


def top_k(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, v) its k best candidates (id, v) by inner product.

    A candidate with the query's id is not its candidate; ties go to smaller ids; fewer candidates give fewer rows;
    vectors of another length than the query's do not meet it; repeated rows of an id count once each. Products are
    exact while they stay below 2 ** 53. An empty table gives no rows; other columns are ignored.
    """
    parts = max(common.partitions(candidates.sparkSession), math.ceil(candidates.count() / PART))
    left = candidates.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("asks"), "id", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("asks"), "id", "v")
    arrow = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        part, held, built = None, {}, None  # rows of the part so far by length, its blocks once a query comes
        for b in common.slices(batches, 512):
            out = []
            for p, asks, i, v in zip(*(b.column(c).to_pylist() for c in range(3)), vectors(b.column(3))):
                if p != part:
                    part, held, built = p, {}, None
                if not asks:
                    ids, x = held.setdefault(len(v), ([], []))
                    ids.append(i)
                    x.append(v)
                    continue
                if built is None:
                    built = {n: Part(np.array(ids, np.int64), np.array(x).reshape(len(ids), n)) for n, (ids, x) in held.items()}
                    held = {}
                if len(v) in built:
                    ids, score = built[len(v)].search(v, k, i)
                    out.append((np.full(len(ids), i), ids, score.astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], schema=arrow)

    # a part's rows come before the queries that stream past it
    met = left.unionByName(right).repartition(parts, "part").sortWithinPartitions("part", "asks")
    found = met.mapInArrow(search, "query_id long, vec_id long, score long")
    order: list[Column] = [F.col("score").desc(), F.col("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(common.load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return top_k(rows.where(F.col("id") % 50 == 0), rows, 5)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
