"""Context: neighbours of seeds, their order, and packing into a budget."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import CHARS_PER_TOKEN, CONTENT_OPEN, CONTEXT_CLOSE, CONTEXT_OPEN, CUT_CONTENT_OPEN, source_block
from quarrykit.operators.chunking import split_lines
from quarrykit.operators.ranking import keep_first, within

CONTEXT_CHARS, CONTEXT_TOKENS, RADIUS = 20_000, 4_000, 1


def neighbours(seeds: DataFrame, chunks: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Chunks near a seed in its file: query_id, path, chunk_index, seed_rank, distance, origin (1: a fragment of the seed's
    symbol, 2: another chunk; symbol is a structural fragment's qualified name, else null); each once, by its best seed; seeds aren't among them. seeds: query_id, path, chunk_index, rank, strategy, symbol."""
    steps = F.array(*(F.lit(o) for o in sorted((o for o in range(-radius, radius + 1) if o), key=lambda o: (abs(o), o))))
    near = seeds.select("query_id", "path", F.col("rank").alias("seed_rank"), "strategy", F.col("symbol").alias("seed_symbol"), F.col("chunk_index").alias("seed_index"), F.explode(steps).alias("offset"))
    near = near.withColumn("chunk_index", F.col("seed_index") + F.col("offset")).withColumn("distance", F.abs("offset"))
    found = near.join(chunks, ["path", "chunk_index", "strategy"])
    origin = F.when(F.col("symbol").isNotNull() & (F.col("symbol") == F.col("seed_symbol")), 1).otherwise(2)
    found = found.withColumn("origin", origin).join(seeds.select("query_id", "path", "chunk_index"), ["query_id", "path", "chunk_index"], "left_anti")
    return keep_first(found, ["query_id", "path", "chunk_index"], ["origin", "seed_rank", "distance"])


def candidates(seeds: DataFrame, near: DataFrame) -> DataFrame:
    """Seeds (origin 0), then neighbours in order: query_id, path, chunk_index, origin, seed_rank, distance, start_line, end_line, content."""
    columns = ["query_id", "path", "chunk_index", "origin", "seed_rank", "distance", "start_line", "end_line", "content"]
    own = seeds.withColumn("origin", F.lit(0)).withColumn("seed_rank", F.col("rank")).withColumn("distance", F.lit(0))
    return own.select(*columns).unionByName(near.select(*columns))


def _escaped(text: str) -> int:
    return len(text) + 4 * text.count("&") + 3 * (text.count("<") + text.count(">"))


def cut_to(content: str, room: int) -> str:
    """The longest beginning, in whole lines if there is one, whose escaped form fits room; a character at least."""
    used = keep = 0
    for keep, char in enumerate(content, 1):
        used += {"&": 5, "<": 4, ">": 4}.get(char, 1)
        if used > room:
            keep -= 1
            break
    kept = content[: max(1, keep)]
    ends = max(kept.rfind("\n"), kept.rfind("\r"))
    return kept[: ends + 1] if 0 <= ends < len(kept) - 1 else kept


def default_markup(row, number: int, cut: bool = False) -> int:
    """Characters of a source block around its content."""
    language = getattr(row, "language", None)
    opening = CUT_CONTENT_OPEN if cut else CONTENT_OPEN
    return len(f'<source id="S{number}">\n<path></path>\n<lines>{row.start_line}-{row.end_line}</lines>\n{opening}</content>\n</source>') + _escaped(row.path) + (0 if language is None else len("<language></language>\n") + _escaped(language))


def _packed(budget: int, markup: Callable):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["origin", "seed_rank", "distance", "path", "chunk_index"])
        out, total = [], 0
        for row in rows.itertuples():
            if row.origin and any(p["path"] == row.path and p["start_line"] <= row.start_line and row.end_line <= p["end_line"] for p in out):
                continue
            content, end = row.content, row.end_line
            tokens = -(-(markup(row, len(out) + 1) + _escaped(content)) // CHARS_PER_TOKEN)
            short = total + tokens > budget
            if short:
                if out:
                    continue
                around = markup(row, 1, True)
                content = cut_to(content, CHARS_PER_TOKEN * budget - around)
                end = min(end, row.start_line + max(0, len(split_lines(content)) - 1))
                tokens = -(-(around + _escaped(content)) // CHARS_PER_TOKEN)
            total += tokens
            out.append({"query_id": row.query_id, "source_no": len(out) + 1, "path": row.path, "chunk_index": row.chunk_index, "start_line": row.start_line, "end_line": end, "origin": row.origin, "tokens": tokens, "truncated": short})
        return pd.DataFrame(out, columns=["query_id", "source_no", "path", "chunk_index", "start_line", "end_line", "origin", "tokens", "truncated"])

    return pack


def pack_greedy(rows: DataFrame, budget_tokens: int = CONTEXT_TOKENS, markup: Callable = default_markup) -> DataFrame:
    """Candidates packed one by one: what doesn't fit is passed over, what packed ones contain is left out, the first is cut
    to fit. A group is one query's seeds and neighbours, a bounded number."""
    schema = "query_id long, source_no long, path string, chunk_index long, start_line long, end_line long, origin long, tokens long, truncated boolean"
    return rows.groupBy("query_id").applyInPandas(_packed(budget_tokens, markup), schema)


#: Characters around the blocks of a context.
FRAME_CHARS = len(CONTEXT_OPEN) + 1 + len(CONTEXT_CLOSE)


def pack_until_full(ranked: DataFrame, block_chars: str, max_chars: int = CONTEXT_CHARS, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """Ranked rows whose blocks, two characters apart, fit max_chars with their frame; stops at the first that doesn't. The
    first stays (and is to be cut to max_chars less the frame)."""
    return within(ranked, ["query_id"], ["rank"], F.col(block_chars) + 2, max_chars - frame_chars + 2)


def block_chars(rows: DataFrame) -> Column:
    """Characters of each ranked row's source block."""
    language = F.col("language") if "language" in rows.columns else F.lit(None).cast("string")
    return F.char_length(source_block(F.concat(F.lit("S"), F.col("rank").cast("string")), F.col("path"), F.col("start_line"), F.col("end_line"), language, F.col("content")))
