"""Source files as rows: one binary scan, a reason for what is left out, and what stays decoded."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrykit.functions.text import in_ignored_directory, is_safe_path, language_of, line_count, matches_glob

MAX_FILE_BYTES = 1_048_576


@F.udf(StringType(), useArrow=True)
def _fallback(content: bytes | None) -> str | None:
    """cp1252, which Java decodes with replacements where Python refuses."""
    try:
        return None if content is None else content.decode("cp1252")
    except UnicodeDecodeError:
        return None


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, else cp1252, else null. Only what isn't UTF-8 goes through Python."""
    plain = F.when(F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf"), F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content).cast("string")
    return F.when(F.is_valid_utf8(plain), plain).otherwise(_fallback(F.when(~F.is_valid_utf8(plain), content)))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, size_bytes, content of each file under root, through Spark's own reader."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    tail = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", base))
    return rows.select(F.regexp_replace("path", rf"^.*?{tail}/", "").alias("relative_path"), F.col("length").alias("size_bytes"), "content")


def reject_reason(ignored_patterns: tuple[str, ...] = (), max_bytes: int = MAX_FILE_BYTES) -> Column:
    """Why a file of relative_path, size_bytes, content isn't a source, the first reason that holds; null if it is one."""
    path = F.col("relative_path")
    return (
        F.when(~is_safe_path(path), "outside root").when(in_ignored_directory(path), "ignored directory").when(language_of(path).isNull(), "unsupported")
        .when(matches_glob(path, ignored_patterns), "ignored pattern").when(F.col("size_bytes") > max_bytes, "too large").when(F.position(F.lit(b"\x00"), F.col("content")) > 0, "binary")
        .when(decoded(F.col("content")).isNull(), "undecodable")
    )


def ingest(files: DataFrame, ignored_patterns: tuple[str, ...] = (), max_bytes: int = MAX_FILE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(sources, skipped): relative_path, language, content, content_hash, size_bytes, line_count; relative_path, reason."""
    rows = files.withColumn("reason", reject_reason(ignored_patterns, max_bytes))
    text = rows.filter("reason is null").withColumn("text", decoded(F.col("content")))
    sources = text.select("relative_path", language_of(F.col("relative_path")).alias("language"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), "size_bytes", line_count(F.col("text")).alias("line_count"))
    return sources, rows.filter("reason is not null").select("relative_path", "reason")


def snapshot(sources: DataFrame) -> DataFrame:
    """One row: file_count, total_size_bytes, languages (a map, null as unknown)."""
    each = sources.groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
    languages = F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "n"))))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_size_bytes"), languages.alias("languages"))


def read_lines(sources: DataFrame, path: str, start: int = 1, end: int | None = None) -> DataFrame:
    """Lines start..end of one file with its hash; a start past the end gives no row."""
    from quarrykit.functions.text import lines_kept

    rows = sources.filter(F.col("relative_path") == path).select("relative_path", "content_hash", lines_kept(F.col("content")).alias("lines"))
    last = F.size("lines") if end is None else F.least(F.lit(end), F.size("lines"))
    piece = F.array_join(F.slice("lines", F.lit(start), last - start + 1), "")
    return rows.filter(F.size("lines") >= start).select("relative_path", "content_hash", F.lit(start).alias("start_line"), last.alias("end_line"), piece.alias("content"))
