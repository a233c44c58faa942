"""A kept index of byte trigrams for literal and declaration search: only files that can hold a needle are read.

Texts are folded as searches fold them, so one index serves searches with and without case. A posting is a trigram of a file with a mask of 64 bits:
bit p is set where the trigram begins at some byte whose place is p modulo 64. A needle's trigrams must all be there, and at places that fit one another: each mask,
turned back by its trigram's offset in the needle, has a bit in common with all others. What passes is a candidate, which the search itself then verifies on
its whole text.

Every byte begins a trigram (texts are padded by two line ends), so needles of one or two bytes are answered by a range of trigrams; an empty needle is an error.
Postings are made where the texts lie: a row is a trigram with its files of some STEP bytes of texts, sorted by trigram within a task. Nothing is shuffled for them, a common
trigram is many rows and no hot key, and a search reads the row groups that can hold its trigrams. Texts lie in slices by a hash of their path;
a search reads the slices of its candidates. The driver sees slices' numbers, never files.

A text of more than STEP bytes is split piece by piece, so a text of any length is worked on in bounded memory; it must be a row, as everywhere. Null texts
have no trigrams; of files that repeat a path each is a file of its own; an empty table gives an empty index.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions.steps import steps
from quarrykit.functions.text import casefold
from quarrykit.operators import searching
from quarrykit.sources.tables import Pointer

#: Bytes of texts that are split together (a multiple of 64), and of texts in a slice.
STEP, SLICE_BYTES = 1 << 20, 1 << 30
#: Trigrams of a needle that are looked up at most.
MOST_GRAMS = 32
#: Part of what the index was made from: another layout isn't read as this one.
LAYOUT = "trigrams-2"


def _folded(text: Column) -> Column:
    """As searches fold it; a sigma at a word's end as any other, so that a part of a text folds to a part of the folded text."""
    return F.replace(casefold(text), F.lit("ς"), F.lit("σ"))


def _split(data: np.ndarray, ends: np.ndarray, first: int, held: tuple[pa.Array, pa.Array]) -> pa.RecordBatch | None:
    """The postings of texts that end at ends in data. first: the place of the first text's first byte in the whole text; held: the texts' slices and ids."""
    begins = np.concatenate([[0], ends[:-1]])
    text = np.repeat(np.arange(len(ends)), ends - begins)[:-2]
    place = np.arange(len(data) - 2) - begins[text]
    inside = place < (ends - begins)[text] - 2
    wide = data.astype(np.int64)
    key = ((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) << 24 | text)[inside]
    if not len(key):
        return None
    order = np.argsort(key)
    key, bit = key[order], np.left_shift(np.uint64(1), ((place[inside] + first) % 64).astype(np.uint64))[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    mask, key = np.bitwise_or.reduceat(bit, starts).view(np.int64), key[starts]
    gram, at = key >> 24, pa.array(key & 0xFFFFFF)
    rows = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    octets = np.stack([gram[rows] >> 16, gram[rows] >> 8 & 255, gram[rows] & 255], axis=1).astype(np.uint8).tobytes()
    grams = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * 3), pa.py_buffer(octets)])
    files = pa.StructArray.from_arrays([held[0].take(at), held[1].take(at), pa.array(mask)], names=["slice", "file_id", "mask"])
    return pa.RecordBatch.from_arrays([grams, pa.ListArray.from_arrays(pa.array(np.append(rows, len(key)).astype(np.int32)), files)], names=["gram", "files"])


def _split_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("data")
        _, offsets, values = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
        for begin, end in steps(np.diff(ends), STEP):
            held, last = tuple(batch.column(c).slice(begin, end - begin) for c in ("slice", "file_id")), ends[end]
            # Several texts are one piece; a long one is pieces that share two bytes.
            for at in range(ends[begin], max(last - 2, ends[begin] + 1), STEP):
                piece = data[at : min(at + STEP + 2, last)] if end - begin == 1 else data[ends[begin] : last]
                inner = np.array([len(piece)]) if end - begin == 1 else ends[begin + 1 : end + 1] - ends[begin]
                made = _split(piece, inner, at - ends[begin], held)
                if made is not None:
                    yield made


def _postings(files: DataFrame) -> DataFrame:
    """gram, files (slice, file_id, mask) of slice, file_id, content. A trigram of a file is there once for each step or piece that holds it."""
    data = F.concat(_folded(F.col("content")), F.lit("\n\n")).cast("binary")
    rows = files.filter("content is not null").select("slice", "file_id", data.alias("data"))
    return rows.mapInArrow(_split_all, "gram binary, files array<struct<slice: int, file_id: long, mask: long>>")


class TrigramIndex:
    """An index in a folder of the shared file system. One writer; a reader keeps the version it began with."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.pointer = spark, folder.rstrip("/"), Pointer(spark, folder)

    def update(self, files: DataFrame, source: str | None = None, slice_bytes: int = SLICE_BYTES) -> bool:
        """The index becomes that of files (path, content), unless it was made of the very source already; returns whether it was made."""
        now = self.pointer.get()
        if now is not None and source is not None and now["source"] == source and now["layout"] == LAYOUT:
            return False
        total = files.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        slices, at = max(1, -(-total // slice_bytes)), f"{self.folder}/v-{uuid.uuid4().hex}"
        slice_ = F.pmod(F.xxhash64("path"), F.lit(slices)).cast("int")
        # Ids are given once, before the texts are written: rows are read from there afterwards. A slice is written by as many tasks as it has bytes for.
        rows = files.select("path", "content", slice_.alias("slice")).hint("rebalance", "slice").withColumn("file_id", F.monotonically_increasing_id())
        rows.write.partitionBy("slice").parquet(f"{at}/texts")
        kept = self.spark.read.schema("path string, content string, file_id long, slice int").parquet(f"{at}/texts")
        _postings(kept).sortWithinPartitions("gram").write.parquet(f"{at}/postings")
        self.pointer.put({"layout": LAYOUT, "source": source, "version": at.rpartition("/")[2]})
        return True

    def _at(self) -> str:
        now = self.pointer.get()
        if now is None or now["layout"] != LAYOUT:
            raise FileNotFoundError(f"{self.folder} holds no index of this layout")
        return f"{self.folder}/{now['version']}"

    def _holding(self, at: str, needle: str) -> DataFrame:
        """slice, file_id of files that may hold needle."""
        if not needle:
            raise ValueError("a search needs a needle")
        data = self.spark.sql("SELECT 1").select(_folded(F.lit(needle))).first()[0].encode()
        postings = self.spark.read.schema("gram binary, files array<struct<slice: int, file_id: long, mask: long>>").parquet(f"{at}/postings")
        of_files = lambda rows: rows.select("gram", F.explode("files").alias("f")).select("gram", "f.*")
        if len(data) < 3:
            low, high = F.lit(bytearray(data)), F.lit(bytearray(data + b"\xff" * (3 - len(data))))
            return of_files(postings.filter((F.col("gram") >= low) & (F.col("gram") <= high))).select("slice", "file_id").distinct()
        offsets: dict[bytes, set[int]] = {}
        for i in range(len(data) - 2):
            offsets.setdefault(data[i : i + 3], set()).add(i % 64)
        # Of a long needle's some, from all over it: those that are left out could only spare more.
        asked = list(offsets.items())[:: -(-len(offsets) // MOST_GRAMS)]
        found = of_files(postings.filter(F.col("gram").isin([bytearray(g) for g, _ in asked])))
        masks = [F.bit_or(F.when(F.col("gram") == F.lit(bytearray(gram)), F.col("mask"))).alias(f"mask_{i}") for i, (gram, _) in enumerate(asked)]
        met = found.groupBy("slice", "file_id").agg(*masks)
        # Null where a trigram isn't there, so that nothing is met.
        fits = reduce(Column.bitwiseAND, (_meeting(F.col(f"mask_{i}"), sorted(places)) for i, (_, places) in enumerate(asked)))
        return met.filter(fits != 0).select("slice", "file_id")

    def candidates(self, all_of: list[str], any_of: list[str] | None = None) -> DataFrame:
        """path, content of the files that may hold each of all_of and, if there are some, one of any_of."""
        at = self._at()
        found = self._holding(at, all_of[0])
        for needle in all_of[1:]:
            found = found.join(self._holding(at, needle), ["slice", "file_id"], "left_semi")
        if any_of:
            some = self._holding(at, any_of[0])
            for needle in any_of[1:]:
                some = some.unionByName(self._holding(at, needle))
            found = found.join(some, ["slice", "file_id"], "left_semi")
        # As many numbers as the index has slices at most.
        slices = [r.slice for r in found.select("slice").distinct().collect()]
        texts = self.spark.read.schema("path string, content string, file_id long, slice int").parquet(f"{at}/texts")
        return texts.filter(F.col("slice").isin(slices)).join(found, ["slice", "file_id"], "left_semi").select("path", "content")

    def search(self, needle: str, case_sensitive: bool = False) -> DataFrame:
        """As searching.search gives it."""
        return searching.search(self.candidates([needle]), needle, case_sensitive)

    def find_declarations(self, symbol: str) -> DataFrame:
        """As searching.find_declarations gives it."""
        return searching.find_declarations(self.candidates([symbol], list(searching.DECLARING)), symbol)


def _meeting(mask: Column, places: list[int]) -> Column:
    """A mask's bits, turned back by each of the places; those that all have."""
    met = None
    for p in places:
        turned = mask if p == 0 else F.shiftrightunsigned(mask, p).bitwiseOR(F.shiftleft(mask, 64 - p))
        met = turned if met is None else met.bitwiseAND(turned)
    return met
