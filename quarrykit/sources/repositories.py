"""What a version control tool prints, archives and directories, as rows."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions.text import IGNORED_DIRECTORIES, casefold
from quarrykit.operators.ranking import with_truncation

MAX_STATUS, MAX_ENTRIES = 500, 500


def parse_status(output: str, cut: bool = False, most: int = MAX_STATUS) -> tuple[str | None, list[tuple[str, str]], bool]:
    """(branch, [(status, path)], truncated) of NUL-separated porcelain output; a rename's second record is its old path. Of cut
    output the last record may be half a path, so it goes."""
    records = output.split("\0")
    if cut:
        records.pop()
    branch = None
    if records and records[0].startswith("## "):
        head = records.pop(0)[3:]
        fresh = head.removeprefix("No commits yet on ")
        branch = None if head.startswith("HEAD (no branch)") else (fresh if fresh != head else head.split("...")[0]) or None
    found: list[tuple[str, str]] = []
    waiting = iter(r for r in records if r)
    for record in waiting:
        if len(found) == most:
            cut = True
            break
        found.append((record[:2], record[3:]))
        if set("RC") & set(record[:2]):
            next(waiting, None)
    return branch, sorted(found, key=lambda f: (f[1].casefold(), f[1])), cut


def status_rows(outputs: DataFrame) -> DataFrame:
    """id, branch, clean, truncated, status, path of each changed file (one row with null path where there is none). outputs: id, output, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, output, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                branch, changed, truncated = parse_status(output or "", bool(cut))
                clean = not changed and not truncated
                rows += [(key, branch, clean, truncated, s, p) for s, p in changed or [(None, None)]]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["id", "branch", "clean", "truncated", "status", "path"])

    return outputs.select("id", "output", "cut").mapInArrow(run, "id long, branch string, clean boolean, truncated boolean, status string, path string")


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """relative_path, size_bytes, content of the regular files in tar archives under path; an archive is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                with tarfile.open(fileobj=io.BytesIO(data)) as archive:
                    for member in archive:
                        if member.isfile():
                            content = archive.extractfile(member).read()
                            yield pa.RecordBatch.from_arrays([pa.array([member.name]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["relative_path", "size_bytes", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "relative_path string, size_bytes long, content binary")


def directory(files: DataFrame, folder: str = "", recursive: bool = False) -> DataFrame:
    """path, kind (file or directory), size of what lies in folder; recursive ones leave ignored directories out. files: relative_path, size_bytes."""
    prefix = f"{folder.strip('/')}/" if folder.strip("/") else ""
    rest = F.substring("relative_path", len(prefix) + 1, 1 << 30)
    rows = files.filter(F.startswith("relative_path", F.lit(prefix))).select(rest.alias("rest"), "size_bytes").withColumn("steps", F.split("rest", "/")).filter(F.element_at("steps", 1) != ".git")
    if recursive:
        rows = rows.filter(~F.exists(F.slice("steps", 1, F.size("steps") - 1), lambda s: casefold(s).isin(*IGNORED_DIRECTORIES)))
    depth = F.size("steps") if recursive else F.lit(1)
    parts = rows.select("steps", "size_bytes", F.explode(F.sequence(F.lit(1), depth)).alias("d"))
    last = F.col("d") == F.size("steps")
    named = parts.select(F.concat(F.lit(prefix), F.array_join(F.slice("steps", F.lit(1), F.col("d")), "/")).alias("path"), F.when(last, "file").otherwise("directory").alias("kind"), F.when(last, F.col("size_bytes")).alias("size"))
    return named.distinct()


def directory_listing(files: DataFrame, folder: str = "", recursive: bool = False, most: int = MAX_ENTRIES) -> tuple[DataFrame, bool]:
    """(the first entries of a folder by path, letters of either case alike, at most `most`; whether there are more)."""
    if most < 1:
        raise ValueError("a listing needs room for an entry")
    return with_truncation(directory(files, folder, recursive), [casefold(F.col("path")), "path"], most)
