"""Literal and declaration search over lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import casefold, lines_kept
from quarrykit.operators.ranking import with_truncation

LINE_CHARS = 500


def source_lines(files: DataFrame) -> DataFrame:
    """path, line_number, line (without its end) of each line of path, content."""
    rows = files.select("path", F.posexplode(lines_kept(F.col("content"))).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).alias("line_number"), F.regexp_replace("line", r"[\r\n]+$", "").alias("line"))


def bounded(line: Column, found: Column) -> Column:
    """At most LINE_CHARS of a line around position found (from 0)."""
    start = F.least(F.greatest(F.lit(0), found - LINE_CHARS // 4), F.char_length(line) - LINE_CHARS)
    return F.when(F.char_length(line) <= LINE_CHARS, line).otherwise(F.substring(line, start + 1, F.lit(LINE_CHARS)))


def search(files: DataFrame, needle: str, case_sensitive: bool = False) -> DataFrame:
    """path, line_number, line of the lines that hold needle. Files without it aren't split."""
    fold = (lambda c: c) if case_sensitive else casefold
    wanted = fold(F.lit(needle))
    lines = source_lines(files.filter(F.contains(fold(F.col("content")), wanted)))
    found = F.instr(fold(F.col("line")), wanted) - 1
    return lines.withColumn("found", found).filter("found >= 0").select("path", "line_number", bounded(F.col("line"), F.col("found")).alias("line"))


#: Matches that a search returns at most.
MAX_RESULTS = 50


def search_limited(files: DataFrame, needle: str, max_results: int = MAX_RESULTS, case_sensitive: bool = False, under: str | None = None) -> tuple[DataFrame, bool]:
    """(the first matches by path and line, whether there are more). under: a folder or file that paths must lie in."""
    if not needle or not 1 <= max_results <= 1000:
        raise ValueError("a search needs a needle, and 1 to 1000 results")
    if under is not None:
        files = files.filter((F.col("path") == under) | F.col("path").startswith(under.rstrip("/") + "/"))
    return with_truncation(search(files, needle, case_sensitive), ["path", "line_number"], max_results)


#: Words of which each declaration holds one.
DECLARING = ("def", "function", "class", "const", "let")


def declaration_kind(line: Column, symbol: str) -> Column:
    """function, class or variable if the line declares symbol, else null; the first pattern that fits decides."""
    name = re.escape(symbol) + r"(?![A-Za-z0-9_$])"
    # Declarations by language.
    patterns = (
        ("function", rf"^\s*(?:async\s+)?def\s+{name}\s*\("),
        ("function", rf"^\s*(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s+{name}\s*\("),
        ("class", rf"^\s*(?:export\s+(?:default\s+)?)?class\s+{name}(?:\s*[(:]|\s*$)"),
        ("variable", rf"^\s*(?:export\s+)?(?:const|let)\s+{name}\s*="),
    )
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(patterns):
        out = F.when(line.rlike(pattern), kind).otherwise(out)
    return out


def find_declarations(files: DataFrame, symbol: str) -> DataFrame:
    lines = source_lines(files.filter(F.contains("content", F.lit(symbol))))
    return lines.withColumn("kind", declaration_kind(F.col("line"), symbol)).filter("kind is not null").select("path", "line_number", "kind", bounded(F.col("line"), F.lit(0)).alias("line"))
