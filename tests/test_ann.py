"""The kept index of cells against exact search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import ann, vector

SCHEMA = "id long, embedding array<double>"


def clustered(n, seed, dims=12, first=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(15)]
    return [(first + i, [x + rng.gauss(0, 0.3) for x in centres[i % 15]]) for i in range(n)]


def test_index(spark, tmp_path, monkeypatch):
    odd = [(90_001, None), (90_002, [0.0] * 12), (90_003, [float("nan")] * 12)]
    table = spark.createDataFrame(clustered(1500, 1) + odd, SCHEMA)
    index = ann.CellIndex(spark, f"file://{tmp_path}/cells")
    with pytest.raises(FileNotFoundError):
        index.state()
    now = index.build(table, source="one")
    assert now["rows"] == 1500 and now["recall"] >= 0.93 and now["share"] < 0.2 and index.current("one") and not index.current("two")
    monkeypatch.setattr(vector, "fit_cells", lambda *a: pytest.fail("a search fits nothing"))
    asked = table.filter("id % 20 = 0")
    found = index.search(asked, 10)
    assert vector.recall(found, vector.exact_top_k(table, asked, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    everything = index.search(asked, 10, probes=10**6)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, vector.exact_top_k(table, asked, 10).collect()))
    # Few queries read the partitions of their cells alone.
    few = index.search(table.filter("id = 40"), 5)
    read = spark._jvm.PythonSQLUtils.explainString(few._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*cell", read) and len(few.collect()) == 5


def test_more_rows_and_large_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "MAX_CELL_ROWS", 60)
    monkeypatch.setattr(ann, "SHARD_ROWS", 40)
    monkeypatch.setattr(vector, "BLOCK_QUERIES", 7)
    same = [(50_000 + k, [1.0] * 12) for k in range(150)]  # alike: can't be split, and are dealt to shards
    first, more = clustered(400, 2), clustered(300, 3, first=1000)
    index = ann.CellIndex(spark, f"file://{tmp_path}/cells")
    index.build(spark.createDataFrame(first + same, SCHEMA), n_cells=3)
    cells, _, sizes = index._centres(index.state())
    assert sum(sizes) == 550 and len(cells) > 8 and sorted(sizes)[-1] >= 150 and all(n <= 60 or n >= 150 for n in sizes)
    now = index.add(spark.createDataFrame(more, SCHEMA), "more")
    assert now["rows"] == 850 and index.current("more")
    table = spark.createDataFrame(first + same + more, SCHEMA)
    asked = table.filter("id % 10 = 0")
    everything, exact = index.search(asked, 8, probes=10**6), vector.exact_top_k(table, asked, 8, shard_rows=100)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))


def test_empty(spark, tmp_path):
    table = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    index = ann.CellIndex(spark, f"file://{tmp_path}/cells")
    assert index.build(table)["rows"] == 1
    assert index.search(table, 3, exclude_own=False).count() == 1 and index.search(table.filter("1 = 0"), 3).count() == 0
