"""Packing documents into token windows.

Tokens: one map over the documents. The ids are those that the tokenizers library gives for
byte_bpe_50k.json; the tiktoken library, which has the same vocabulary as ranks, gives the same ones
six times as fast (a test holds them against each other). Added tokens of that file (<|endoftext|>) are one id where
a text holds them, as in that library. A document longer than a window is cut into whole windows and a rest. Plan: the
lengths' histogram, of one entry a length, goes to the driver; its size is the window's,
whatever the input's. There, combinations of two or three lengths that fill a window
are enumerated; non-negative least squares gives how often each is repeated; rounded
down they never use more pieces than there are, and what is left is packed greedily,
longest first, each time with the longest piece that still fits. Assignment: pieces are
numbered within their length and joined to the plan's ranges of numbers.

A length that very many pieces share is numbered in shares (a hash of the piece; as many as keep a share bounded), each
share starting where the counts of the former end, so no task holds a whole length. Whole windows aren't dealt at all.

Defined cases: a null text is empty and gives the end id alone; repeated rows are each
packed; a null doc_id stays null; other columns aren't read; an empty table gives no
rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import bounded_batches, stored, trimmed
from quarrykit.llm.tokens import TIKTOKEN_FILE, TOKENIZERS_FILE, text_encoder

WINDOW = 2048
END_ID = 1
#: Rows that one share of a length holds, on average, if all rows have one length.
SHARE_ROWS = 500_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, vocabulary: str = TIKTOKEN_FILE, window: int = WINDOW, with_ids: bool = False, added: str = TOKENIZERS_FILE) -> DataFrame:
    """Each document's ids cut into whole windows and a rest, one row a piece."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(vocabulary, added)
        names, types = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids], [pa.int64()] * 5 + [pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(encode(text.as_py() or "") + [END_ID], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(ids), piece if with_ids else None))
            columns = list(zip(*rows, strict=True))[: 5 + with_ids] or [[]] * (5 + with_ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(trimmed(tokenise), PIECES + ", ids array<long>" * with_ids)


def combinations(present: list[int], window: int = WINDOW, per_length: int = 24) -> list[tuple[int, ...]]:
    """Two lengths that fill the window; and three, with a bounded number of middle lengths for each longest one."""
    have, found = set(present), []
    for a in reversed(present):
        room = window - a
        if room <= a and room in have:
            found.append((a, room))
    for a in reversed(present):
        room = window - a
        middle = present[bisect_right(present, (room - 1) // 2) : bisect_right(present, min(a, room - 1))] if room > 1 else []
        for b in middle[:: max(1, len(middle) // per_length)]:
            c = room - b
            if 0 < c <= b and c in have:
                found.append((a, b, c))
    return found


def repeats(histogram: np.ndarray, columns: list[tuple[int, ...]], sweeps: int = 40) -> np.ndarray:
    """Non-negative least squares, min |Ax - histogram| with a column a combination, by
    cyclic coordinate descent; a column has at most three entries."""
    rest, x = histogram.astype(float).tolist(), [0.0] * len(columns)
    uses = [tuple((length, column.count(length)) for length in set(column)) for column in columns]
    norms = [sum(n * n for _, n in of) for of in uses]
    for _ in range(sweeps):
        moved = 0.0
        for j, of in enumerate(uses):
            step = sum(rest[length] * n for length, n in of) / norms[j]
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for length, n in of:
                    rest[length] -= n * step
        if moved < 0.5:
            break
    return np.array(x)


def plan(histogram: np.ndarray, window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences); uses up the histogram (index: length)."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        out.append(((window,), int(left[window])))
        left[window] = 0
    present = [int(x) for x in np.flatnonzero(left)]
    columns = combinations(present, window)
    for column, wish in zip(columns, repeats(left, columns), strict=True):
        n = min([int(wish), *(int(left[length]) // column.count(length) for length in column)])
        if n > 0:
            out.append((column, n))
            for length in column:
                left[length] -= n
    counts = {int(k): int(left[k]) for k in np.flatnonzero(left)}
    lengths = sorted(counts)
    while lengths:
        uses: dict[int, int] = {}
        sequence, room = [], window
        while room > 0 and (at := bisect_right(lengths, room) - 1) >= 0:
            while at >= 0 and uses.get(lengths[at], 0) >= counts[lengths[at]]:
                at -= 1
            if at < 0:
                break
            length = lengths[at]
            uses[length] = uses.get(length, 0) + 1
            sequence.append(length)
            room -= length
        n = min(counts[length] // k for length, k in uses.items())
        out.append((tuple(sequence), n))
        for length, k in uses.items():
            counts[length] -= n * k
            if not counts[length]:
                lengths.remove(length)
    return out


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (see token_pieces) with sequence_id and offset. pieces is read twice: pass a stored table."""
    spark = pieces.sparkSession
    shares = max(8, pieces.count() // SHARE_ROWS)
    share = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(shares)).cast("int")
    # A whole window is a sequence by itself: its number is any that no other has.
    whole, dealt = pieces.filter(F.col("length") == window), pieces.filter(F.col("length") < window).withColumn("share", share)
    counts = stored(dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        histogram[r["length"]] = r["n"]
    ranges, used, first = [], np.zeros(window + 1, np.int64), 0
    for sequence, n in plan(histogram, window):
        offset = 0
        for length in sequence:
            ranges.append((length, int(used[length]), int(used[length]) + n, first, offset))
            used[length] += n
            offset += length
        first += n
    numbered = Window.partitionBy("length", "share").orderBy("doc_id", "start", "ids_crc32")
    former = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    befores = counts.select("length", "share", F.coalesce(F.sum("n").over(former), F.lit(0)).alias("before"))
    slots = spark.createDataFrame(ranges, "length long, low long, high long, first long, offset long")
    dealt = dealt.withColumn("n", F.row_number().over(numbered) - 1).join(befores, ["length", "share"]).withColumn("n", F.col("n") + F.col("before"))
    # The plan's size depends on the window alone.
    placed = dealt.join(F.broadcast(slots), (dealt["length"] == slots["length"]) & (dealt["n"] >= slots["low"]) & (dealt["n"] < slots["high"])).select(
        *(dealt[c] for c in pieces.columns), (slots["first"] + dealt["n"] - slots["low"]).alias("sequence_id"), slots["offset"]
    )
    return placed.unionByName(whole.withColumns({"sequence_id": F.lit(first) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")}))


def pack_documents(docs: DataFrame, vocabulary: str = TIKTOKEN_FILE, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most window ids."""
    return pack(stored(token_pieces(docs, vocabulary, window, with_ids), "pieces"), window)
