"""Exact top-k inner products by a k-d tree in each shard.

Rows are dealt to shards of bounded size and queries to blocks of bounded size; one
task builds a shard's tree (median splits on the widest dimension, a tight bounding box a
node) and answers a block of queries on it, best node first by the greatest inner
product that its box allows, until no box can beat a query's k-th score. A first round on one
small shard gives each query a k-th score that the other shards start from, so they prune
from their first node on. Partial results are k rows a query and shard; the last ranking
keeps k.

Shards times blocks grows with rows times queries, as any exact search's work does; each
task holds one shard and one block.

Defined cases: components become floor(1024 x); vectors that are null, empty, or hold a null or
non-finite component take no part; vectors of different lengths have no score with each other;
rows of one id never answer that id's query; rows that repeat an id, with the same vector or another, are rows of their own: each answers,
and each asks, the answers of an id ranked together; null ids take no part; ties go to the smaller id; an empty table, or one without queries, gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import stored

LEAF_ROWS = 512
SHARD_ROWS = 20_000
BLOCK_QUERIES = 16_000
_FOUND = "query_id long, vec_id long, score long"


class Tree:
    """Nodes in arrays; leaf rows contiguous in points."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        self.rows: list[tuple[int, int]] = []

        def build(a: int, b: int) -> int:
            own = points[order[a:b]]
            low, high = own.min(0), own.max(0)
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.rows.append((a, b))
            self.children.append(None)
            if b - a > leaf_rows and (high > low).any():
                widest = int(np.argmax(high - low))
                middle = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, widest], middle)]
                self.children[node] = (build(a, a + middle), build(a + middle, b))
            return node

        build(0, len(points))
        self.points, self.ids = points[order], ids[order]
        self._low, self._high = np.array(self.low), np.array(self.high)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """The greatest inner product with query that each node's box allows."""
        return self._high @ np.maximum(query, 0) + self._low @ np.minimum(query, 0)

    def search(self, query: np.ndarray, own_id: int, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of at least the score kth."""
        bounds = self.bounds(query)
        ids, scores = np.empty(0, np.int64), np.empty(0, self.points.dtype)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < kth:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= kth:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            a, b = self.rows[node]
            found = self.points[a:b] @ query
            fit = (found >= kth) & (self.ids[a:b] != own_id)
            if fit.any():
                ids, scores = np.concatenate([ids, self.ids[a:b][fit]]), np.concatenate([scores, found[fit]])
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    kth = max(kth, scores[-1])
        return ids, scores


def _vectors(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0), np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As doubles where every sum stays a whole number below 2^53, else as they are."""
    if len(a) and len(b) and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return a.astype(float), b.astype(float)
    return a, b


def _answer(k: int):
    def answer(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            points, asked = _exact(_vectors(rows["v"].combine_chunks()), _vectors(queries["q_v"].combine_chunks()))
            tree = Tree(points, rows["id"].to_numpy())
            kth = queries["q_kth"].to_numpy()
            for own, query, least in zip(queries["q_id"].to_pylist(), asked, kth, strict=True):
                ids, scores = tree.search(query, own, k, least)
                out.append((np.full(len(ids), own), ids, scores.astype(np.int64)))
        made = [np.concatenate(c) if out else np.empty(0, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 3)]
        return pa.table([pa.array(c, pa.int64()) for c in made], names=["query_id", "vec_id", "score"])

    return answer


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """id, v (array of long) of the rows that take part."""
    x = F.col(vector_col)
    sound = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return rows.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v"))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. is_query: a predicate over column id."""
    points = stored(quantised(rows, id_col, vector_col, scale).withColumn("dim", F.size("v")), "vectors")
    queries = points.filter(is_query)
    n_rows, n_queries = points.count(), queries.count()
    shards, blocks = max(1, -(-n_rows // shard_rows)), max(1, -(-n_queries // block_queries))
    points = points.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", F.lit(8)), F.lit(blocks)).cast("int"))

    def searched(points: DataFrame, queries: DataFrame, n_shards: int) -> DataFrame:
        each_block = points.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        each_shard = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        keys = ["shard", "block", "dim"]
        # Both sides come of one table, so one side's columns get names of their own.
        asked = each_shard.select(*(F.col(c).alias(f"q_{c}") for c in [*keys, "id", "v", "kth"]))
        return each_block.select(*keys, "id", "v").groupBy(*keys).cogroup(asked.groupBy(*(f"q_{c}" for c in keys))).applyInArrow(_answer(k), _FOUND)

    seeds = points.filter(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(max(1, n_rows // (4 * LEAF_ROWS)))) == 0).withColumn("shard", F.lit(0))
    lowest = F.lit(float("-inf"))
    first = _ranked(searched(seeds, queries.withColumn("kth", lowest), 1), k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
    started = queries.join(first, "id", "left").withColumn("kth", F.coalesce("kth", lowest))
    return _ranked(searched(points, started, shards), k).select("query_id", "rank", "vec_id", "score")
