"""Connected components of an edge table, by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import drop_path, fresh_path


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node, root (the component's smallest node) of every node with an edge.

    Large-star, then small-star, until nothing moves: about log(n) rounds, each of which
    joins an edge to its node's smallest neighbour and never expands a pair. A round's edges go to the
    shared folder, so lineage stays short; the former round's files are removed."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u <> v")
    path, before = None, None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small-star: a node's smaller neighbours, and the node, point to the smallest of them.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        made = fresh_path(spark, "components")
        small.write.parquet(made)
        pairs = spark.read.parquet(made)
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if path:
            drop_path(spark, path)
        path = made
        if before == now:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now
