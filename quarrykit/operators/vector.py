"""Semantic search: exact, and by an inverted file of k-means cells with exact scores."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import compounds
from quarrykit.functions.vectors import hash_slot, is_sound, unit
from quarrykit.operators.ranking import top_k
from quarrykit.sources.shared import shared_dir

#: Vectors that a fit looks at, and queries compared at a time.
SAMPLE_VECTORS, BLOCK_QUERIES = 20_000, 1024
#: Scores of a block's queries with a shard's rows that are in memory together.
SCORES_TOGETHER = 1 << 20
#: Texts whose slots are counted together.
COUNTED_TOGETHER = 1024


def model_violations(vectors: DataFrame) -> DataFrame:
    """Models whose vectors differ in length, or that hold an unsound one: model, n_dimensions, n_unsound."""
    found = vectors.groupBy("model").agg(F.countDistinct(F.size("embedding")).alias("n_dimensions"), F.count_if(~is_sound(F.col("embedding"))).alias("n_unsound"))
    return found.filter("n_dimensions > 1 or n_unsound > 0")


class DimensionError(ValueError):
    """Vectors of different lengths, which have no cosine."""


def dimensions(vectors: DataFrame, queries: DataFrame) -> int | None:
    """The length that all sound vectors and queries have; None without any. Otherwise raises DimensionError."""
    sizes = [sorted(r["n"] for r in df.filter(is_sound(F.col("embedding"))).select(F.size("embedding").alias("n")).distinct().limit(10).collect()) for df in (vectors, queries)]
    if len(sizes[0]) > 1 or len(sizes[1]) > 1:
        raise DimensionError(f"stored vectors have lengths {sizes[0]}, queries {sizes[1]}: mixed dimensions")
    if sizes[0] and sizes[1] and sizes[0] != sizes[1]:
        raise DimensionError(f"queries have {sizes[1][0]} dimensions, stored vectors {sizes[0][0]}")
    return next(iter(sizes[0] or sizes[1]), None)


def search(vectors: DataFrame, queries: DataFrame, k: int, mode: str = "exact", exclude_own: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score by the mode, exact or ann. Both: id, embedding, of one length; unsound queries have no result."""
    if mode not in ("exact", "ann"):
        raise ValueError("mode must be 'exact' or 'ann'")
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise ValueError("k must be a positive integer")
    dimensions(vectors, queries)
    return (exact_top_k if mode == "exact" else ann_top_k)(vectors, queries, k, exclude_own=exclude_own)


def _block_scores(k: int, exclude_own: bool):
    """Of rows of one shard and queries of one block: each query's k best rows there, by one matrix product."""

    def search(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not rows.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        columns = [t.column(c).combine_chunks() for t, c in ((rows, "v"), (queries, "q_v"))]
        if len(lengths := {n for c in columns for n in pc.unique(c.value_lengths()).to_pylist()}) > 1:
            raise DimensionError(f"vectors have lengths {sorted(lengths)}")
        points, asked = (c.flatten().to_numpy().reshape(len(c), -1) for c in columns)
        ids, own = rows["id"].to_numpy(), queries["q_id"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        together = max(1, SCORES_TOGETHER // len(ids))
        for begin in range(0, len(own), together):
            scores = asked[begin : begin + together] @ points.T
            np.clip(scores, -1, 1, out=scores)
            if exclude_own:
                scores[own[begin : begin + together, None] == ids[None, :]] = -np.inf
            keys = np.round(scores, 9)
            # The k-th key of each query; what ties with it is ordered by id among the few that are left.
            least = np.partition(keys, -k, axis=1)[:, -k] if k < keys.shape[1] else np.full(len(keys), -np.inf)
            for query, row, key, kth in zip(own[begin : begin + together], scores, keys, least, strict=True):
                at = np.flatnonzero((key >= kth) & np.isfinite(row))
                at = at[np.lexsort((ids[at], -key[at]))[:k]]
                found.append((np.full(len(at), query), ids[at], row[at]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    return search


def units(vectors: DataFrame) -> DataFrame:
    """id, v of the sound vectors, over their norm. vectors: id, embedding."""
    return vectors.filter(is_sound(F.col("embedding"))).select(F.col("id").cast("long").alias("id"), unit(F.col("embedding")).alias("v"))


def _searched(points: DataFrame, queries: DataFrame, k: int, keys: list[str], exclude_own: bool) -> DataFrame:
    asked = queries.select(*(F.col(c).alias(f"q_{c}") for c in [*keys, "id", "v"]))
    found = points.select(*keys, "id", "v").groupBy(*keys).cogroup(asked.groupBy(*(f"q_{c}" for c in keys))).applyInArrow(_block_scores(k, exclude_own), "query_id long, vec_id long, score double")
    found = found.withColumn("key", F.round("score", 9))
    return top_k(found, ["query_id"], [F.desc("key"), "vec_id"], k).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = 50_000, exclude_own: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest vectors, other than that of its own id unless these are kept. Both: id, embedding. Rows go to shards,
    queries to blocks, both of bounded size; a shard and block is one task."""
    points, asked = units(vectors), units(queries)
    shards, blocks = max(1, -(-points.count() // shard_rows)), max(1, -(-asked.count() // BLOCK_QUERIES))
    points = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return _searched(points, asked, k, ["shard", "block"], exclude_own)


def fit_cells(vectors: DataFrame, n_cells: int, sample: int = SAMPLE_VECTORS, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centres of a bounded sample."""
    rows = units(vectors).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    return k_means(np.array(rows["v"].combine_chunks().flatten()).reshape(rows.num_rows, -1), n_cells, rounds)


def k_means(points: np.ndarray, n_cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means centres of unit vectors."""
    centres = points[:: max(1, len(points) // n_cells)][:n_cells].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        lengths = np.linalg.norm(sums, axis=1)
        centres[lengths > 0] = sums[lengths > 0] / lengths[lengths > 0, None]
    return centres


def _cells(centres: np.ndarray, n: int):
    """The n nearest cells of each vector, one row each."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                points = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                near = np.argsort(-(points @ centres.T), axis=1, kind="stable")[:, :n]
                at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])

    return assign


def ann_top_k(vectors: DataFrame, queries: DataFrame, k: int, n_cells: int | None = None, n_probes: int | None = None, exclude_own: bool = True) -> DataFrame:
    """exact_top_k over each query's nearest cells, of an index made for this call; see ann.CellIndex for one that is kept."""
    from quarrykit.operators.ann import CellIndex

    index = CellIndex(vectors.sparkSession, f"{shared_dir(vectors.sparkSession)}/cells-{uuid.uuid4().hex}")
    index.build(vectors, n_cells)
    return index.search(queries, k, n_probes, exclude_own)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of an exact result that is found."""
    hits = exact.join(found.select("query_id", "vec_id").withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def batches(rows: DataFrame, size: str, keys: list[str], order: list[str], most: int, most_size: int) -> DataFrame:
    """rows with batch, their number within the key: a batch ends at most rows or before size would exceed most_size."""

    def number(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(o, "ascending") for o in order])
        out, batch, n, total = [], 0, 0, 0
        for value in table[size].to_pylist():
            if n and (n == most or total + value > most_size):
                batch, n, total = batch + 1, 0, 0
            n, total = n + 1, total + value
            out.append(batch)
        return table.append_column("batch", pa.array(out, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.groupBy(*keys).applyInArrow(number, f"{fields}, batch long")


def _slot_counts(size: int):
    """Of id, slots: id, how often each slot is there. A text is one row, so its tokens stay in its task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, COUNTED_TOGETHER):
                part = batch.slice(begin, COUNTED_TOGETHER)
                lists = part.column("slots")
                row = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
                counts = np.bincount(row * size + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(lists) * size).astype(float)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * size), pa.array(counts))], names=["id", "counts"])

    return count


def hashed_vectors(texts: DataFrame, size: int = 64) -> DataFrame:
    """id, embedding of each text's hashed bag of words (counts by slot); a text without a word has no row. texts: id, text; texts of one id are one bag."""
    slots = texts.select("id", F.transform(compounds(F.col("text")), lambda t: hash_slot(t, size)).alias("slots")).filter(F.size("slots") > 0)
    counted = slots.mapInArrow(_slot_counts(size), f"id {dict(texts.dtypes)['id']}, counts array<double>")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    return counted.groupBy("id").agg(F.collect_list("counts").alias("all")).select("id", F.reduce("all", F.array_repeat(F.lit(0.0), size), add).alias("embedding"))
