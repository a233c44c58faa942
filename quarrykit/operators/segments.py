"""A BM25 index of immutable segments: updated by what has changed, searched with score bounds.

A segment holds its chunks, each a row with its counted terms, and headers: of each slice of its chunks (chunks of one folder and of about one length, of bounded
number and size) the terms with the number of chunks that hold them, greatest frequency and least length, which bound the score that any of its chunks can have.
A slice is made in one task, so no row a posting is shuffled; a folder and length that many chunks share are many slices, one that few share is one.

Updates: chunks whose digest is new or changed are split into tokens and make a new segment; those that are gone or changed
are listed as dead in their old one. Counts are sums over segments less what is dead, so scores are those of an index made
afresh. Small segments are merged. A pointer file, written last, names segments, lists of the dead, counts, and the state of the source
that the index was made from.

Searches (pruned_top_k): the k-th best score in the slices of the greatest bounds is a lower bound of a query's true one. A slice whose bounds
over all terms stay under it holds no result, and isn't scored at all.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.operators import lexical
from quarrykit.operators.lexical import BM25
from quarrykit.operators.ranking import top_k
from quarrykit.sources.shared import stored
from quarrykit.sources.tables import Pointer

#: Chunks and tokens of a slice, about, and segments from which they are merged.
SLICE_CHUNKS, SLICE_TOKENS, MAX_SEGMENTS = 4096, 1 << 20, 6
#: Slices of the greatest bounds that give a query's first floor, the postings from which no more are taken, and what rounding may cost a bound.
SEED_SLICES, SEED_POSTINGS, SLACK = 24, 4096, 2e-6
#: Headers' terms that a task compares with queries together.
HEADER_TERMS = 1 << 20
#: Part of the source's state: another layout isn't read as this one.
LAYOUT = "rows-2"

DOCS = f"{lexical.ROWS}, digest string, home long, band long, segment string"
HEADERS = "segment string, slice long, terms array<string>, n array<int>, max_tf array<int>, min_len array<int>, total array<long>"
TERMS = "term string, df long, total long, most long"


def _home(path: Column) -> Column:
    """Chunks of a folder are alike, so they are kept together."""
    return F.xxhash64(F.regexp_replace(path, r"[^/]*$", ""))


def _band(doc_len: Column) -> Column:
    return F.floor(2 * F.log2(doc_len + F.lit(1.0)))


def _header(key: tuple, rows: pa.Table) -> pa.Table:
    """The header of one slice: of each of its terms how many chunks hold it, how often at most and in all, and the least length of those."""
    terms, tfs = (rows[c].combine_chunks() for c in ("terms", "tfs"))
    lengths = np.repeat(rows["doc_len"].to_numpy(), terms.value_lengths().to_numpy(zero_copy_only=False))
    coded = terms.flatten().dictionary_encode()
    code, tf, size = coded.indices.to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False), len(coded.dictionary)
    most, least = np.zeros(size, np.int32), np.full(size, np.iinfo(np.int32).max, np.int32)
    np.maximum.at(most, code, tf)
    np.minimum.at(least, code, lengths)
    columns = [coded.dictionary, np.bincount(code, minlength=size).astype(np.int32), most, least, np.bincount(code, tf, size).astype(np.int64)]
    ends = pa.array([0, size], pa.int32())
    return pa.table([rows["segment"][:1], pa.array([key[1].as_py()], pa.int64()), *(pa.ListArray.from_arrays(ends, c if isinstance(c, pa.Array) else pa.array(c)) for c in columns)], names=["segment", "slice", "terms", "n", "max_tf", "min_len", "total"])


def _block_bounds(avg_len: float, config: BM25):
    """Of headers and queries: the greatest score that a chunk of a slice can have for a query, and how many postings the query's terms have there."""

    def bound(key: tuple, headers: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list[pa.Array]] = []
        if headers.num_rows and queries.num_rows:
            asked = lexical.Asked(queries)
            terms, n, most, least = (headers[c].combine_chunks() for c in ("terms", "n", "max_tf", "min_len"))
            parts = lexical.saturated(most.flatten().to_numpy().astype(float), least.flatten().to_numpy(), avg_len, config)
            for first, _, (here, postings) in asked.sums(terms, parts, n.flatten().to_numpy()):
                row, query = np.nonzero(postings)
                at = pa.array(first + row)
                found.append([queries["query_id"].combine_chunks().take(pa.array(query)), *(headers[c].combine_chunks().take(at) for c in ("segment", "slice")), pa.array(here[row, query]), pa.array(postings[row, query].astype(np.int64))])
        names = ["query_id", "segment", "slice", "here", "n"]
        if not found:
            return pa.table([queries["query_id"][:0], pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.int64())], names=names)
        return pa.table([pa.concat_arrays(c) for c in zip(*found, strict=True)], names=names)

    return bound


@dataclass(frozen=True)
class Counts:
    n_docs: int
    total_len: int

    @property
    def avg_len(self) -> float:
        return self.total_len / self.n_docs if self.n_docs else 0.0


class SegmentedIndex:
    """An index in a folder of the shared file system. One writer; readers keep the version they began with. bounds: whether slices get headers, which
    pruned_top_k needs and nothing else; without them no chunk is moved when the index is made."""

    def __init__(self, spark: SparkSession, folder: str, config: BM25 = BM25(), bounds: bool = True) -> None:
        self.spark, self.folder, self.config, self.bounds, self.pointer = spark, folder.rstrip("/"), config, bounds, Pointer(spark, folder)

    def state(self) -> dict | None:
        now = self.pointer.get()
        if now is not None and (now["layout"] != LAYOUT or now["config"] != repr(self.config) or now["bounds"] != self.bounds):
            raise ValueError(f"{self.folder} holds an index of another layout or configuration")
        return now

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{kind}/{name}" for name in names)) if names else self.spark.createDataFrame([], schema)

    def docs(self, now: dict, names: list[str] | None = None) -> DataFrame:
        """DOCS of the chunks that count, of all segments or of some."""
        rows = self._read("docs", [s["name"] for s in now["segments"]] if names is None else names, DOCS)
        return rows.join(self.dead(now).select("segment", "chunk_id"), ["segment", "chunk_id"], "left_anti") if now["dead"] else rows

    def headers(self, now: dict) -> DataFrame:
        return self._read("headers", [s["name"] for s in now["segments"]], HEADERS)

    def _sliced(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """DOCS with slice. bands: how many slices the chunks of a folder and a band of lengths are dealt to."""
        bands = self._read("bands", names, "segment string, home long, band long, slices long")
        dealt = F.xxhash64("home", "band", F.pmod(F.xxhash64("chunk_id"), F.col("slices")))
        return rows.join(bands, ["segment", "home", "band"]).withColumn("slice", dealt)

    def dead(self, now: dict) -> DataFrame:
        rows = self._read("dead", now["dead"], "chunk_id long, doc_len int, segment string")
        return rows.filter(F.col("segment").isin([s["name"] for s in now["segments"]]))

    def update(self, chunks: DataFrame, source: str | None = None) -> int:
        """The index becomes that of chunks (chunk_id, path, symbol, content); returns how many were split into tokens. With the
        state of a source that the index was made from, nothing is done."""
        now = self.state()
        if now is not None and source is not None and now["source"] == source:
            return 0
        digest = F.sha2(F.to_json(F.struct("path", "symbol", "content")), 256)
        changed, dead_at, gone = chunks.withColumn("digest", digest), [], Counts(0, 0)
        now = now or {"segments": [], "dead": [], "n_docs": 0, "total_len": 0}
        if now["segments"]:
            told = stored(changed.select("chunk_id", "digest"), "digests")
            old = self.docs(now)
            fresh = told.join(old.select("chunk_id", "digest"), ["chunk_id", "digest"], "left_anti").select("chunk_id")
            changed = changed.join(fresh, "chunk_id", "left_semi")
            name = f"d-{uuid.uuid4().hex}"
            old.join(told, ["chunk_id", "digest"], "left_anti").select("chunk_id", "doc_len", "segment").write.parquet(f"{self.folder}/dead/{name}")
            gone = Counts(*self._read("dead", [name], "doc_len int").agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first())
            dead_at = [name] if gone.n_docs else []
        n_changed = changed.count()
        segments, added = list(now["segments"]), Counts(0, 0)
        if n_changed:
            made = self._write(changed)
            segments.append(made)
            added = Counts(made["n_docs"], made["total_len"])
        self.pointer.put({
            "layout": LAYOUT, "config": repr(self.config), "bounds": self.bounds, "source": source, "segments": segments, "dead": now["dead"] + dead_at,
            "n_docs": now["n_docs"] - gone.n_docs + added.n_docs, "total_len": now["total_len"] - gone.total_len + added.total_len,
        })
        if len(segments) > MAX_SEGMENTS:
            self.merge()
        return n_changed

    def _write(self, chunks: DataFrame) -> dict:
        rows = lexical.counted(lexical.tokenised(chunks.withColumn("home", _home(F.col("path"))), self.config, keep=("digest", "home")))
        return self._put(f"s-{uuid.uuid4().hex}", rows)

    def _put(self, name: str, rows: DataFrame) -> dict:
        """The rows (ROWS, digest, home) as a segment."""
        rows = rows.withColumns({"band": _band(F.col("doc_len")), "segment": F.lit(name)})
        rows.select("chunk_id", "is_test", "doc_len", "terms", "tfs", "digest", "home", "band", "segment").write.parquet(f"{self.folder}/docs/{name}")
        docs = self._read("docs", [name], DOCS)
        if self.bounds:
            self._slice(name, docs)
            held = self._read("headers", [name], HEADERS).select(F.explode(F.arrays_zip("terms", "n", "total", "max_tf")).alias("p"))
            held = held.select(F.col("p.terms").alias("term"), F.col("p.n").alias("n"), F.col("p.total").alias("total"), F.col("p.max_tf").alias("most"))
        else:
            held = lexical.posted(docs).select("term", F.lit(1).alias("n"), F.col("tf").alias("total"), F.col("tf").alias("most"))
        told = held.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("total"), F.max("most").cast("long").alias("most"))
        told.write.parquet(f"{self.folder}/terms/{name}")
        n_docs, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        return {"name": name, "n_docs": n_docs, "total_len": total}

    def _slice(self, name: str, docs: DataFrame) -> None:
        many = F.greatest(F.ceil(F.count(F.lit(1)) / SLICE_CHUNKS), F.ceil(F.sum("doc_len") / SLICE_TOKENS))
        docs.groupBy("segment", "home", "band").agg(many.cast("long").alias("slices")).write.parquet(f"{self.folder}/bands/{name}")
        # A slice's chunks meet in one task: each chunk is moved once, with its terms.
        sliced = self._sliced(docs, [name]).select("segment", "slice", "doc_len", "terms", "tfs")
        sliced.groupBy("segment", "slice").applyInArrow(_header, HEADERS).write.parquet(f"{self.folder}/headers/{name}")

    def merge(self, keep: int | None = None) -> None:
        """The smallest segments become one, without what is dead; the `keep` largest stay, by default half of what an index may have."""
        now, keep = self.state(), MAX_SEGMENTS // 2 if keep is None else keep
        ordered = sorted(now["segments"], key=lambda s: (-s["n_docs"], s["name"]))
        small = ordered[keep:]
        if len(small) < 2:
            return
        rows = self.docs(now, [s["name"] for s in small]).drop("segment", "band")
        self.pointer.put(now | {"segments": [*ordered[:keep], self._put(f"s-{uuid.uuid4().hex}", rows)]})

    def counts(self) -> Counts:
        now = self.state()
        return Counts(now["n_docs"], now["total_len"])

    def read(self) -> lexical.Index:
        """The whole index as chunks with their terms, statistics and frequencies."""
        now, counts = self.state(), self.counts()
        stats = self.spark.createDataFrame([(counts.n_docs, counts.avg_len)], "n_docs long, avg_len double")
        rows = self.docs(now).select("chunk_id", "is_test", "doc_len", "terms", "tfs")
        return lexical.Index(rows, stats, self.config, self.document_frequencies(now))

    def term_stats(self) -> DataFrame:
        """term, df, total, most: how many chunks hold a term, how often in all, and how often one at most. Without dead chunks the segments' sums tell."""
        now = self.state()
        if now["dead"]:
            postings = lexical.posted(self.docs(now))
            return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"), F.max("tf").alias("most"))
        rows = self._read("terms", [s["name"] for s in now["segments"]], TERMS)
        return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"), F.max("most").alias("most"))

    def document_frequencies(self, now: dict) -> DataFrame:
        """term, df."""
        held = self._read("terms", [s["name"] for s in now["segments"]], TERMS).select("term", F.col("df").alias("n"))
        if now["dead"]:
            names = [s["name"] for s in now["segments"]]
            gone = self._read("docs", names, DOCS).join(self.dead(now).select("segment", "chunk_id"), ["segment", "chunk_id"], "left_semi")
            held = held.unionByName(gone.select(F.explode("terms").alias("term"), F.lit(-1).cast("long").alias("n")))
        return held.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")

    def pruned_top_k(self, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
        """(query_id, rank, chunk_id, score, as lexical.bm25_top_k gives them; query_id, postings, scored: how many postings its terms have and how
        many of them were scored). terms: query_id, term, qf, about_tests."""
        if not self.bounds:
            raise ValueError(f"{self.folder} holds an index without bounds")
        now, counts, c = self.state(), self.counts(), self.config
        names = [s["name"] for s in now["segments"]]
        asked_for = self.document_frequencies(now).join(terms.select("term").distinct(), "term", "left_semi")
        asked = stored(lexical.weighted(terms, asked_for, counts.n_docs, c), "query-terms")
        sent = lexical.few_enough(asked)
        of_slices = stored(self._bounds(now, asked, counts, sent), "slice-bounds")
        rows = self._sliced(self.docs(now), names)

        def scored(wanted: DataFrame) -> DataFrame:
            """Each query's k best of the slices that it wants (query_id, segment, slice; a stored table)."""
            places = wanted.select("segment", "slice").distinct()
            if sent is not None and places.count() * sent.num_rows <= lexical.SENT_PAIRS:
                told = wanted.select("query_id", "segment", "slice").toArrow()
                row = {query: i for i, query in enumerate(sent["query_id"].to_pylist())}
                at: dict[tuple[str, int], int] = {}
                pairs = [(at.setdefault((segment, place), len(at)), row[query]) for query, segment, place in zip(*(c.to_pylist() for c in told.columns), strict=True)]
                open_to = np.zeros((len(at), sent.num_rows), bool)
                open_to[tuple(np.array(pairs, np.int64).reshape(-1, 2).T)] = True
                return lexical.sent_top_k(rows.join(F.broadcast(places), ["segment", "slice"], "left_semi"), sent, k, counts.avg_len, c, (at, open_to))
            # Slices that no query wants aren't moved.
            used = rows.join(places, ["segment", "slice"], "left_semi")
            return lexical.sharded_top_k(used, wanted.join(asked, "query_id"), k, ["segment", "slice"], counts.avg_len, c)

        first = top_k(of_slices, ["query_id"], [F.desc("here"), "segment", "slice"], SEED_SLICES)
        before = F.sum("n").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
        seeds = stored(first.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < SEED_POSTINGS).select("query_id", "segment", "slice"), "seed-slices")
        least = scored(seeds).filter(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least"))
        judged = of_slices.join(least, "query_id", "left").join(seeds.withColumn("seed", F.lit(True)), ["query_id", "segment", "slice"], "left")
        judged = stored(judged.select("query_id", "segment", "slice", "n", F.col("seed").isNotNull().alias("seed"), (F.col("here") >= F.coalesce("least", F.lit(0.0))).alias("open")), "judged-slices")
        work = judged.groupBy("query_id").agg(F.sum("n").alias("postings"), F.sum(F.when(F.col("seed") | F.col("open"), F.col("n")).otherwise(0)).alias("scored"))
        return scored(judged.filter("open").select("query_id", "segment", "slice")), work

    def _bounds(self, now: dict, asked: DataFrame, counts: Counts, sent: pa.Table | None) -> DataFrame:
        """query_id, segment, slice, here (the bound), n (postings) of the slices that hold a query's terms."""
        headers, bound = self.headers(now), _block_bounds(counts.avg_len, self.config)
        schema = f"query_id {dict(asked.dtypes)['query_id']}, segment string, slice long, here double, n long"
        if sent is not None:

            def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for begin in range(0, sent.num_rows, lexical.BLOCK_QUERIES):
                        yield from bound((), pa.Table.from_batches([batch]), sent.slice(begin, lexical.BLOCK_QUERIES)).combine_chunks().to_batches()

            return headers.select("segment", "slice", "terms", "n", "max_tf", "min_len").mapInArrow(compare, schema)
        held = headers.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        shards, blocks = max(1, -(-held // HEADER_TERMS)), max(1, -(-asked.count() // lexical.BLOCK_QUERIES))
        headers = headers.withColumn("shard", F.pmod(F.xxhash64("segment", "slice"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        keys = ["shard", "block"]
        asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in keys), "query_id", "about_tests", "asked")
        grouped = headers.select(*keys, "segment", "slice", "terms", "n", "max_tf", "min_len").groupBy(*keys).cogroup(asked.groupBy("q_shard", "q_block"))
        return grouped.applyInArrow(bound, schema)
