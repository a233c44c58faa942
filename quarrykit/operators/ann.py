"""An inverted file of vectors, kept as a table: cells as partitions, centres and a measured number of probes beside them.

Fitting looks at a bounded sample; every vector is then put into its nearest centre's cell, in one pass. Cells that hold too
many are split by centres of their own. The number of cells that a search probes is chosen once, from exact results of a bounded
number of stored vectors, and kept with the recall that was measured. Searches fit nothing: they send each query to its
nearest cells, and read the partitions of these alone. Rows added later go to the cells that are there.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators import vector
from quarrykit.operators.ranking import top_k
from quarrykit.sources.tables import Pointer

#: Cells that an index has at most, rows from which a cell is split, and rows that a task compares with a block of queries.
MAX_CELLS, MAX_CELL_ROWS, SHARD_ROWS = 16_384, 200_000, 50_000
#: Vectors that a split cell's centres are fitted on, queries of the measurement, its k, and the recall that it must reach.
SPLIT_SAMPLE, MEASURED_QUERIES, MEASURED_K, WANTED_RECALL = 2000, 128, 10, 0.93
_VECTORS = "id long, v array<double>, cell int"


class CellIndex:
    """An index in a folder of the shared file system. One writer; readers keep the centres they began with."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.pointer = spark, folder.rstrip("/"), Pointer(spark, folder)
        self._held: tuple[str | None, tuple] = (None, ())  # the centres read last; a name's centres never change

    def state(self) -> dict:
        now = self.pointer.get()
        if now is None:
            raise FileNotFoundError(f"{self.folder} has no index")
        return now

    def current(self, source: str) -> bool:
        now = self.pointer.get()
        return now is not None and now["source"] == source

    def _centres(self, now: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, their centres, their numbers of rows); MAX_CELLS at most."""
        if self._held[0] != now["centres"]:
            rows = self.spark.read.parquet(f"{self.folder}/centres/{now['centres']}").orderBy("cell").toArrow()
            centres = np.array(rows["centre"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
            self._held = (now["centres"], (rows["cell"].to_numpy(), centres, rows["n"].to_numpy()))
        return self._held[1]

    def _table(self, now: dict) -> DataFrame:
        return self.spark.read.schema(_VECTORS).parquet(f"{self.folder}/{now['vectors']}")

    def _append(self, points: DataFrame, rows: int, at: str) -> None:
        """points (id, v, cell) into their cells' partitions; a cell of many rows is written by several tasks."""
        shards = max(1, -(-rows // SHARD_ROWS))
        salted = points.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(1, min(64, shards)))))
        salted.repartition("cell", "salt").drop("salt").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/{at}")

    def _save(self, now: dict, centres: dict[int, list[float]]) -> dict:
        """Writes the centres with their cells' sizes, and makes them the ones that count."""
        sizes = {r["cell"]: r["n"] for r in self._table(now).filter(F.col("cell").isin(list(centres))).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        name = f"c-{uuid.uuid4().hex}"
        rows = [(cell, centre, sizes.get(cell, 0)) for cell, centre in centres.items()]
        self.spark.createDataFrame(rows, "cell int, centre array<double>, n long").coalesce(1).write.parquet(f"{self.folder}/centres/{name}")
        now = now | {"centres": name, "rows": sum(sizes.values())}
        self.pointer.put(now)
        return now

    def build(self, vectors: DataFrame, n_cells: int | None = None, source: str | None = None) -> dict:
        """Makes the index of vectors (id, embedding) anew, and returns its state. Unsound vectors have no place in it."""
        rows = vectors.count()
        n_cells = max(1, min(MAX_CELLS, round(2 * rows**0.5))) if n_cells is None else n_cells
        centres = vector.fit_cells(vectors, n_cells)
        at = f"vectors-{uuid.uuid4().hex}"
        now = {"source": source, "vectors": at, "centres": None, "rows": 0, "probes": 1, "recall": None, "share": None}
        self._append(vector.units(vectors).mapInArrow(vector._cells(centres, 1), _VECTORS), rows, at)
        now = self._save(now, dict(enumerate(centres.tolist())))
        now = self._split(now)
        return self._measure(now)

    def add(self, vectors: DataFrame, source: str | None = None) -> dict:
        """Puts more vectors into the cells that are there; cells that have become too large are split."""
        now = self.state()
        cells, centres, _ = self._centres(now)
        placed = vector.units(vectors).mapInArrow(vector._cells(centres, 1), _VECTORS)
        placed = placed.withColumn("cell", F.element_at(F.array(*map(F.lit, cells.tolist())), F.col("cell") + 1)) if cells.tolist() != list(range(len(cells))) else placed
        self._append(placed, vectors.count(), now["vectors"])
        now = self._save(now | {"source": source}, dict(zip(cells.tolist(), centres.tolist(), strict=True)))
        return self._split(now)

    def _split(self, now: dict) -> dict:
        """Gives cells of more than MAX_CELL_ROWS several centres instead of one, until no cell can be split."""
        whole: set[int] = set()  # cells whose vectors are all alike
        while True:
            cells, centres, sizes = self._centres(now)
            large = [int(c) for c, n in zip(cells, sizes, strict=True) if n > MAX_CELL_ROWS and int(c) not in whole]
            if not large or len(cells) >= MAX_CELLS:
                return now
            kept = dict(zip(cells.tolist(), centres.tolist(), strict=True))
            table = self._table(now).filter(F.col("cell").isin(large))
            sample = top_k(table, ["cell"], [F.xxhash64("id"), "id"], SPLIT_SAMPLE).select("cell", "v").toArrow()
            new, at = {}, int(cells.max()) + 1
            of_cell, points = sample["cell"].to_numpy(), np.array(sample["v"].combine_chunks().flatten()).reshape(sample.num_rows, -1)
            for cell in large:
                wanted = int(min(64, -(-2 * sizes[list(cells).index(cell)] // MAX_CELL_ROWS)))
                own = np.unique(vector.k_means(points[of_cell == cell], wanted).round(9), axis=0)
                if len(own) < 2:
                    whole.add(cell)
                    continue
                new[cell] = (at, own)
                at += len(own)
            if not new:
                return now

            def moved(batches, new=new):
                import pyarrow as pa

                for batch in batches:
                    if batch.num_rows:
                        points = np.array(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                        old = batch.column(2).to_numpy()
                        cell = np.empty(len(old), np.int32)
                        for c in np.unique(old):
                            first, own = new[int(c)]
                            cell[old == c] = first + (points[old == c] @ own.T).argmax(1)
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell)], names=["id", "v", "cell"])

            rows = int(sum(n for c, n in zip(cells, sizes, strict=True) if int(c) in new))
            # The split cells' own partitions stay for readers that have begun; no centre names them any longer.
            self._append(table.filter(F.col("cell").isin(list(new))).mapInArrow(moved, _VECTORS), rows, now["vectors"])
            for cell, (first, own) in new.items():
                del kept[cell]
                kept |= {first + k: centre for k, centre in enumerate(own.tolist())}
            now = self._save(now, kept)

    def _measure(self, now: dict) -> dict:
        """Chooses the least number of probes that finds WANTED_RECALL of the exact neighbours of some stored vectors."""
        cells, centres, sizes = self._centres(now)
        table = self._table(now).filter(F.col("cell").isin(cells.tolist()))
        asked = table.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(MEASURED_QUERIES)
        exact = vector.exact_top_k(table.select("id", F.col("v").alias("embedding")), asked.select("id", F.col("v").alias("embedding")), MEASURED_K)
        at = exact.join(table.select(F.col("id").alias("vec_id"), "cell"), "vec_id").select("query_id", "cell").collect()
        points = {r["id"]: np.array(r["v"]) for r in asked.collect()}
        if not at:
            self.pointer.put(now | {"probes": len(cells), "recall": 1.0, "share": 1.0})
            return self.state()
        order = {q: np.argsort(-(centres @ v), kind="stable") for q, v in points.items()}
        place = {q: {int(cells[c]): k + 1 for k, c in enumerate(near)} for q, near in order.items()}
        needed = np.sort([place[r["query_id"]][r["cell"]] for r in at])
        probes = int(needed[int(np.ceil(WANTED_RECALL * len(needed))) - 1])
        share = float(np.mean([sizes[near[:probes]].sum() for near in order.values()]) / max(1, sizes.sum()))
        now = now | {"probes": probes, "recall": round(float((needed <= probes).mean()), 4), "share": round(share, 4), "measured": len(points)}
        self.pointer.put(now)
        return now

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exclude_own: bool = True) -> DataFrame:
        """query_id, rank, vec_id, score of the k nearest vectors in each query's nearest cells. queries: id, embedding."""
        now = self.state()
        cells, centres, sizes = self._centres(now)
        asked = vector.units(queries).mapInArrow(vector._cells(centres, min(len(cells), probes or now["probes"])), _VECTORS)
        # Cells that are asked for, and how often: MAX_CELLS rows at most.
        often = {int(r["cell"]): r["n"] for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        plan = [(at, int(cells[at]), -(-int(sizes[at]) // SHARD_ROWS) or 1, -(-n // vector.BLOCK_QUERIES)) for at, n in sorted(often.items())]
        told = F.broadcast(self.spark.createDataFrame(plan, "at int, cell int, shards int, blocks int"))
        points = self._table(now).filter(F.col("cell").isin([cell for _, cell, _, _ in plan])).join(told.drop("at"), "cell")
        points = points.withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asked = asked.withColumnRenamed("cell", "at").join(told, "at")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        return vector._searched(points, asked, k, ["cell", "shard", "block"], exclude_own)
