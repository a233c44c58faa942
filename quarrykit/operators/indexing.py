"""Incremental index: what changed, whether an update is sound, and applying it."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprint(settings: dict) -> str:
    """SHA-256 of the settings as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def manifest(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """relative_path, content_hash, chunk_count; a file without chunks has none."""
    counts = chunks.groupBy("relative_path").agg(F.count(F.lit(1)).alias("chunk_count"))
    return files.select("relative_path", "content_hash").join(counts, "relative_path", "left").na.fill(0, ["chunk_count"])


def classified(current: DataFrame, before: DataFrame) -> DataFrame:
    """relative_path, change: added, changed, unchanged or deleted. Both: relative_path, content_hash."""
    a, b = current.select("relative_path", F.col("content_hash").alias("new")), before.select("relative_path", F.col("content_hash").alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, "relative_path", "full").select("relative_path", change.alias("change"))


def update_violations(
    upserted: DataFrame, deleted: DataFrame, chunks: DataFrame, current: DataFrame, persisted: DataFrame | None = None, full_rebuild: bool = False, compatible: bool = True
) -> DataFrame:
    """relative_path, problem: why an update would not be applied. current and persisted: relative_path, content_hash of the snapshot and of
    what is indexed (None: not looked at); compatible: whether what is indexed has the update's fingerprint. A rebuild drops all that is indexed,
    so it must upsert the whole snapshot; any other update must account for each path of both."""
    path = "relative_path"
    new, old = upserted.select(path).distinct(), deleted.select(path).distinct()
    twice = lambda df: df.groupBy(path).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    counted = chunks.groupBy(path).agg(F.min("chunk_index").alias("low"), F.max("chunk_index").alias("high"), F.countDistinct("chunk_index").alias("n"))
    found = {
        "upserted twice": twice(upserted), "deleted twice": twice(deleted), "upserted and deleted": new.join(old, path, "left_semi"), "upserted but not current": new.join(current, path, "left_anti"),
        "chunk of a file not upserted": chunks.select(path).distinct().join(new, path, "left_anti"),
        "repeated chunk": chunks.groupBy(path, "chunk_index").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "chunk indexes not 0..n": counted.filter("low <> 0 or high + 1 <> n"),
    }
    if full_rebuild:
        found["rebuild omits it"] = current.join(new, path, "left_anti")
    else:
        found["deleted but current"] = old.join(current, path, "left_semi")
        if not compatible:
            found["no matching fingerprint: rebuild"] = current.sparkSession.createDataFrame([("",)], f"{path} string")
        if persisted is not None:
            reused = current.select(path, F.col("content_hash").alias("now")).join(new, path, "left_anti").join(persisted.select(path, F.col("content_hash").alias("then")), path, "left")
            left = persisted.join(current, path, "left_anti")
            found["deleted but not indexed"] = old.join(current, path, "left_anti").join(persisted, path, "left_anti")
            found["left the snapshot but not deleted"] = left.join(old, path, "left_anti")
            found["new but not upserted"] = reused.filter("then is null")
            found["changed but not upserted"] = reused.filter("then <> now")
    out = None
    for problem, rows in found.items():
        rows = rows.select(path, F.lit(problem).alias("problem")).distinct()
        out = rows if out is None else out.unionByName(rows)
    return out


def applied(existing: DataFrame, upserted: DataFrame, touched: DataFrame) -> DataFrame:
    """existing without the touched paths, and upserted: one anti join, nothing is rewritten in place."""
    return existing.join(touched.select("relative_path").distinct(), "relative_path", "left_anti").unionByName(upserted)


def summary(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("relative_path").alias("files"), F.count(F.lit(1)).alias("chunks"), F.min("model").alias("model"))


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """relative_path, chunk_index, problem for rows that a chunk table may not hold."""
    pair = F.col("fragment_index").isNotNull() == F.col("fragment_count").isNotNull()
    rules = {
        "line range": (F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), "chunk index": F.col("chunk_index") < 0,
        "fragment pair": ~pair | (F.col("fragment_index") > F.col("fragment_count")),
        "fragment kind": (F.col("chunk_kind") == "structural_fragment") != F.col("fragment_index").isNotNull(),
    }
    problems = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return chunks.select("relative_path", "chunk_index", F.explode(problems).alias("problem"))
