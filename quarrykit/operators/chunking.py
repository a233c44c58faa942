"""Chunkers: line windows, as a SQL expression where no cap cuts a window, and in full; and Python's syntax tree."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.steps import steps
from quarrykit.functions.text import lines_kept

#: Bytes of files that are cut together: their lines, trees and chunks are in a task's memory at once.
CUT_BYTES = 1 << 18
MAX_LINES, OVERLAP, MAX_CHARS = 120, 20, 12_000
CHUNKS = "path string, chunk_index int, start_line int, end_line int, kind string, symbol string, qualified string, parent string, fragment_index int, fragment_count int, content string"


def line_windows(files: DataFrame, max_lines: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """path, chunk_index, start_line, end_line, content: windows of max_lines that share overlap lines, where characters don't matter."""
    step = max_lines - overlap
    rows = files.select("path", lines_kept(F.col("content")).alias("lines")).withColumn("n", F.size("lines")).filter("n > 0")
    windows = F.when(F.col("n") <= max_lines, F.lit(1)).otherwise(F.ceil((F.col("n") - max_lines) / step).cast("int") + 1)
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), windows - 1)))
    start = F.col("chunk_index") * step
    piece = F.array_join(F.slice("lines", start + 1, F.lit(max_lines)), "")
    return rows.select("path", "chunk_index", (start + 1).alias("start_line"), F.least(start + max_lines, F.col("n")).alias("end_line"), piece.alias("content"))


def split_lines(text: str) -> list[str]:
    """Lines with their ends; only CR LF, CR and LF end one."""
    out, at, n = [], 0, len(text)
    while at < n:
        cr, lf = text.find("\r", at), text.find("\n", at)
        ends = [e for e in (cr, lf) if e >= 0]
        end = min(ends) + 1 if ends else n
        if end < n and text[end - 1] == "\r" and text[end] == "\n":
            end += 1
        out.append(text[at:end])
        at = end
    return out


def near_equal(line: str, most: int) -> list[str]:
    """A line in the fewest pieces of at most most characters, larger ones first."""
    k = -(-len(line) // most)
    base, more = divmod(len(line), k)
    cuts = [i * base + min(i, more) for i in range(k + 1)]
    return [line[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def windows_of(text: str, max_lines: int = MAX_LINES, overlap: int = OVERLAP, max_chars: int = MAX_CHARS) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, content) of each window. One that characters cut short shares lines in proportion, and only as
    many as leave room for its next line; a line over max_chars is a window in pieces."""
    lines = split_lines(text)
    sizes = [len(line) for line in lines]
    at = 0
    while at < len(lines):
        end = at
        room = max_chars
        while end < len(lines) and end - at < max_lines and sizes[end] <= room:
            room -= sizes[end]
            end += 1
        if end == at:
            for piece in near_equal(lines[at], max_chars):
                yield at + 1, at + 1, piece
            at += 1
            continue
        yield at + 1, end, "".join(lines[at:end])
        if end == len(lines):
            return
        shared = (end - at) * overlap // max_lines
        while shared and sum(sizes[end - shared : end + 1]) > max_chars:
            shared -= 1
        at = end - shared


_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


class Unit(NamedTuple):
    """A part of a module: its lines, what it is, whose it is, and the lines where a break is welcome."""

    first: int
    last: int
    kind: str
    qualified: str | None = None
    parent: str | None = None
    breaks: frozenset[int] = frozenset()


def _head(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def _within(body: list[ast.stmt]) -> list[ast.stmt]:
    """The definitions in body, however deep in other statements, but not those of other definitions."""
    found: list[ast.stmt] = []
    waiting: list[ast.AST] = list(body)
    while waiting:
        node = waiting.pop()
        if isinstance(node, _DEFINITIONS):
            found.append(node)
        else:
            waiting += ast.iter_child_nodes(node)
    return sorted(found, key=lambda n: (_head(n), n.end_lineno or n.lineno))


def python_units(text: str) -> Iterator[Unit]:
    """A module's parts in order: functions, methods, classes, what lies between definitions, and behind a function the definitions
    within it. Raises SyntaxError (or ValueError) where the text doesn't parse."""

    def told(node: ast.stmt, parent: str | None, kind: str) -> Iterator[Unit]:
        name, last = f"{parent}.{node.name}" if parent else node.name, node.end_lineno or node.lineno
        ends = frozenset(s.end_lineno or s.lineno for s in node.body)
        if isinstance(node, ast.ClassDef):
            yield from spread(node.body, Unit(_head(node), last, "class", name, parent, ends), "method")
            return
        yield Unit(_head(node), last, kind, name, parent, ends)
        for deeper in _within(node.body):
            yield from told(deeper, name, "function")

    def spread(body: list[ast.stmt], whole: Unit, kind: str) -> Iterator[Unit]:
        """The definitions of body, and the rest of whole as gaps; whole itself where there are none."""
        own, at = [s for s in body if isinstance(s, _DEFINITIONS)], whole.first
        for node in own:
            if at < _head(node):
                yield whole._replace(first=at, last=_head(node) - 1, breaks=frozenset())
            yield from told(node, whole.qualified, kind)
            at = (node.end_lineno or node.lineno) + 1
        if at <= whole.last:
            yield whole._replace(first=at, breaks=frozenset() if own else whole.breaks)

    yield from spread(ast.parse(text).body, Unit(1, len(split_lines(text)), "module"), "function")


def unit_parts(lines: list[str], unit: Unit, max_lines: int, max_chars: int) -> list[tuple[int, int, str]]:
    """(first line, last line, content): the unit in parts of at most max_lines lines and max_chars characters. A part that can't hold the
    rest ends behind its last statement, if one ends in it; a line over max_chars is cut into near equal pieces."""
    pieces = [(n, piece) for n in range(unit.first, unit.last + 1) for piece in (near_equal(lines[n - 1], max_chars) if len(lines[n - 1]) > max_chars else [lines[n - 1]])]
    parts, at = [], 0
    while at < len(pieces):
        end, room, good = at, max_chars, 0
        while end < len(pieces) and len(pieces[end][1]) <= room and pieces[end][0] - pieces[at][0] < max_lines:
            line, piece = pieces[end]
            room, end = room - len(piece), end + 1
            if line in unit.breaks and (end == len(pieces) or pieces[end][0] > line):
                good = end
        if good and end < len(pieces):
            end = good
        parts.append((pieces[at][0], pieces[end - 1][0], "".join(piece for _, piece in pieces[at:end])))
        at = end
    return parts


_Chunk = tuple[int, int, str, str | None, str | None, int | None, int | None, str]


def structural(text: str, is_python: bool, max_lines: int, overlap: int, max_chars: int) -> Iterator[_Chunk]:
    """(first line, last line, kind, qualified name, parent, fragment, fragments, content) by structure; by lines where there is none or it
    doesn't parse."""
    try:
        units = list(python_units(text)) if is_python else None
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        units = None
    if units is None:
        for a, b, content in windows_of(text, max_lines, overlap, max_chars):
            yield a, b, "line_fallback", None, None, None, None, content
        return
    lines = split_lines(text)
    for unit in units:
        parts = unit_parts(lines, unit, max_lines, max_chars)
        if not any(content.strip() for *_, content in parts):
            continue
        for k, (a, b, content) in enumerate(parts, 1):
            alone = len(parts) == 1
            yield a, b, unit.kind if alone else "structural_fragment", unit.qualified, unit.parent, None if alone else k, None if alone else len(parts), content


def chunks(files: DataFrame, strategy: str = "line_v1", max_lines: int = MAX_LINES, overlap: int = OVERLAP, max_chars: int = MAX_CHARS) -> DataFrame:
    """CHUNKS of each file (path, language, content), numbered from 0 in each. One file is one row, so a map does it."""
    if not 0 <= overlap < max_lines or max_chars < 1 or strategy not in ("line_v1", "python_ast_v1"):
        raise ValueError("overlap must be less than max_lines, max_chars positive and the strategy known")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "chunk_index", "start_line", "end_line", "kind", "symbol", "qualified", "parent", "fragment_index", "fragment_count", "content"]
        types = [pa.string(), *[pa.int32()] * 3, *[pa.string()] * 4, *[pa.int32()] * 2, pa.string()]
        parts = (b.slice(begin, end - begin) for b in batches for begin, end in steps(pc.fill_null(pc.binary_length(b.column("content")), 0).to_numpy(zero_copy_only=False).astype(np.int64), CUT_BYTES))
        for batch in parts:
            rows = []
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if strategy == "line_v1":
                    made = ((a, b, "line", None, None, None, None, content) for a, b, content in windows_of(text or "", max_lines, overlap, max_chars))
                else:
                    made = structural(text or "", language == "python", max_lines, overlap, max_chars)
                rows += [(path, i, a, b, kind, name.rpartition(".")[2] if name else None, name, *rest) for i, (a, b, kind, name, *rest) in enumerate(made)]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return files.select("path", "language", "content").mapInArrow(cut, CHUNKS)
