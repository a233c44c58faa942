"""Word-shingle Jaccard join by a grouped prefix filter, and the components of its links.

Documents with the same set of shingles form a class. A set's shingles have one order
everywhere: common ones last, by the counts of a bounded table, and by hash among equals; any
order gives the same links, a good one fewer candidates. Two sets that link share a
shingle among the first of that order (a prefix whose length follows from the threshold;
the smaller set needs but half of it). Classes with the same prefix and size form a
group; a prefix shingle's groups are its bucket.

A small bucket gives its pairs of groups whose sizes fit, expanded to members and
deduplicated; those stay whose sketches, which bound the overlap from above, allow the
threshold. A large bucket is cut into blocks of bounded size; a task has two blocks' sketches
and returns a spanning forest of the pairs that these allow. The components of both kinds
of pairs are clusters: sets of different clusters don't link. A cluster's whole sets meet in one task, or
two blocks of them if it is large; there all pairs that the sketches allow and that
aren't connected yet are verified, and connecting links are returned. So no link between
components is lost, a set moves once for each of its cluster's blocks, and what is written
grows with members, not with their pairs. Shingles that the table knows as common are
dealt with a salt.

Defined cases: a text without words, or a null one, has no shingles and links with nothing
(its component is its own doc_id); repeated rows are one class; the smallest doc_id
ignores nulls, and a component whose ids are all null has none; other columns
aren't read. Shingles and sets are compared by 64-bit hashes; a class is told by
its hash and its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import bounded_batches, drop_stored, if_small, stored, trimmed
from quarrykit.llm.components import components

WORDS, PERCENT = 3, 90
#: Entries of the table of common shingles; per task, the count from which one is reported; overall, from which it is common.
COMMON_ENTRIES, COMMON_IN_TASK, COMMON_OVERALL = 200_000, 4, 40
#: Groups of a small bucket; members of a block.
SMALL_BUCKET, BLOCK_MEMBERS = 40, 1500
#: Bins of a sketch: a power of two near an eighth of the set's size, between these. Unlike sets then differ by more than chance
#: hides, at 0.8 and above.
LEAST_BINS, MOST_BINS = 64, 4096
SALTS = 64
_FLUSH = 2_500_000
_KEPT_WORDS = 250_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def shingle_set(text: str | None, hashes: dict[bytes, int], width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of width words; of fewer words, of them all."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
    return np.unique(_mixed(out))


def class_id(own: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), seed=len(own)))))


def bins_of(n: int) -> int:
    return min(MOST_BINS, max(LEAST_BINS, 1 << (n // 8 - 1).bit_length() if n > 8 else 0))


def sketch(own: np.ndarray) -> np.ndarray:
    """Shingles by the first bits of their hash, at most 255 each."""
    bins = bins_of(len(own))
    return np.minimum(np.bincount((own >> np.uint64(65 - bins.bit_length())).astype(np.int64), minlength=bins), 255).astype(np.uint8)


def folded(rows: np.ndarray, bins: int) -> np.ndarray:
    """Sketches, a row each, in fewer bins."""
    return rows.reshape(len(rows), bins, -1).sum(2, dtype=np.int32)


def _sets(batches: Iterator[pa.RecordBatch], width: int, keys: list[bytes] | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each row's doc_id and set; its text's key is put into keys before."""
    hashes = _Words()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if len(hashes) > _KEPT_WORDS:
                hashes.clear()
            text = text.as_py()
            if keys is not None:
                keys.append(_key(text))
            yield doc_id, shingle_set(text, hashes, width)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_FIRST = "doc_id long, n long, gid long, sketch binary, token long, count long"


def _key(text: str | None) -> bytes:
    """What tells texts of one class apart: the MD5 of the bytes; a null text is empty."""
    return hashlib.md5((text or "").encode(), usedforsecurity=False).digest()


def _first_pass(width: int, keyed: bool = False):
    """Each document's class (and, if keyed, its text's key), and the shingles that are common in this task's documents."""
    names, types = ["doc_id", "n", "gid", "sketch", "token", "count", "key"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    names, types = names[: 6 + keyed], types[: 6 + keyed]

    def common(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        kept = counts >= COMMON_IN_TASK
        nothing = [None] * int(kept.sum())
        yield pa.RecordBatch.from_arrays([pa.array(nothing, t) for t in types[:4]] + [pa.array(tokens[kept].view(np.int64)), pa.array(counts[kept].astype(np.int64))] + [pa.array(nothing, t) for t in types[6:]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, n_held, seen = [], [], 0, set()
        keys: list[bytes] = []
        for doc_id, own in _sets(batches, width, keys if keyed else None):
            gid = class_id(own) if len(own) else None
            rows.append((doc_id, len(own), gid, sketch(own).tobytes() if len(own) else None, None, None, *([keys.pop()] if keyed else [])))
            if gid is not None and gid not in seen:
                seen.add(gid)
                held.append(own)
                n_held += len(own)
            if len(rows) >= 5000:
                yield _batch(rows, names, types)
                rows = []
            if n_held >= _FLUSH:
                yield from common(held)
                held, n_held = [], 0
        yield _batch(rows, names, types)
        if held:
            yield from common(held)

    return run


def prefix_lengths(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Of a set of n: shingles that any partner must meet, and that one of no smaller size must."""
    return n - -(-n * percent // 100) + 1, n - -(-2 * n * percent // (100 + percent)) + 1


_PREFIX = "token long, salt int, prefix long, gid long, n long, short boolean"


def _prefixes(common, width: int, percent: int):
    """(token, salt, prefix id, class, size, short) of each class's prefix shingles, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = common.value
        seen: set[int] = set()
        held: list[list[np.ndarray]] = [[] for _ in range(6)]
        n_held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in held], names=["token", "salt", "prefix", "gid", "n", "short"])

        for _, own in _sets(batches, width):
            if not len(own):
                continue
            gid = class_id(own)
            if gid in seen:
                continue
            seen.add(gid)
            n = len(own)
            length, short = prefix_lengths(n, percent)
            if len(tokens):
                at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
                often = np.where(tokens[at] == own, counts[at], 0)
                order = np.argsort(often, kind="stable")[:length]
            else:
                often, order = np.zeros(n, np.int64), np.arange(length)
            first = own[order]
            k = len(first)
            columns = (first.view(np.int64), np.where(often[order] > 0, 1 + gid % SALTS, 0).astype(np.int32), np.full(k, class_id(first)), np.full(k, gid), np.full(k, n), np.arange(k) < short)
            for column, part in zip(held, columns, strict=True):
                column.append(part)
            n_held += k
            if n_held >= 200_000:
                yield out()
                held, n_held = [[] for _ in range(6)], 0
        if n_held:
            yield out()

    return run


_CANDIDATES = "a long, b long, token long"


def _group_pairs(percent: int):
    """Of rows sorted by token, salt, prefix, n and gid: a pair (a, b) of members of fitting groups of small
    buckets; (a, null, token) of each member of large ones."""

    def pairs_of(tokens: list[tuple]) -> Iterator[tuple[int, int]]:
        groups: dict[tuple[int, int], tuple[bool, list[int]]] = {}
        for _, _, prefix, gid, n, short in tokens:
            groups.setdefault((n, prefix), (short, []))[1].append(gid)
        ordered = sorted(groups.items())
        for i, ((n, _), (short, members)) in enumerate(ordered):
            if short:
                for k, a in enumerate(members):
                    for b in members[k + 1 :]:
                        yield a, b
                for (m, _), (other_short, others) in ordered[i + 1 :]:
                    if 100 * n < percent * m:
                        break
                    if m > n or other_short:
                        for a in members:
                            for b in others:
                                yield a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["a", "b", "token"], [pa.int64()] * 3
        key, bucket, large, rows = None, [], False, []

        def closed() -> list[tuple]:
            if large or len(bucket) < 2:
                return []
            return [(min(p), max(p), None) for p in pairs_of(bucket)]

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:2] != key:
                    rows += closed()
                    key, bucket, large, last = row[:2], [], False, None
                if row[3] == last:
                    continue  # a class that several tasks have sent
                last = row[3]
                bucket.append(row)
                # A salted part of a bucket can't tell how large the whole is.
                if not large and (len(bucket) > SMALL_BUCKET or row[1]):
                    large = True
                    rows += [(r[3], None, r[0]) for r in bucket]
                elif large:
                    rows.append((row[3], None, row[0]))
                    bucket = []
                if len(rows) >= 50_000:
                    yield _batch(rows, names, types)
                    rows = []
        rows += closed()
        yield _batch(rows, names, types)

    return run


class Sketches:
    """Sketches of one or more numbers of bins. Two are compared in the fewer bins of both, which bounds |A xor B| from below."""

    def __init__(self, raw: list[bytes], sizes: np.ndarray, percent: int) -> None:
        self.bins, self.sizes, self.percent = np.array([len(r) for r in raw]), sizes, percent
        self.tables: dict[int, np.ndarray] = {}
        present = sorted(set(self.bins.tolist()))
        for bins in present:
            fine = np.flatnonzero(self.bins >= bins)
            table = np.zeros((len(raw), bins), np.int32)
            for own in present:
                at = fine[self.bins[fine] == own]
                if len(at):
                    table[at] = folded(np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), own), bins)
            self.tables[bins] = table

    def apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out, fewer = np.zeros(len(one), np.int64), np.minimum(self.bins[one], self.bins[two])
        for bins, table in self.tables.items():
            at = np.flatnonzero(fewer == bins)
            for a in range(0, len(at), 4096):
                part = at[a : a + 4096]
                out[part] = np.abs(table[one[part]] - table[two[part]]).sum(1)
        return out

    def fit(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether pairs may reach the threshold, and how far apart they are: |A xor B| <= (1 - t) / (1 + t) (|A| + |B|) if they do."""
        far = self.apart(one, two)
        return far * (100 + self.percent) <= (100 - self.percent) * (self.sizes[one] + self.sizes[two]), far


def _sketch_fits(percent: int):
    """Of pairs with sketches and sizes: those whose sketches allow the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                both = Sketches(batch.column(2).to_pylist() + batch.column(3).to_pylist(), np.concatenate([batch.column(4).to_numpy(), batch.column(5).to_numpy()]), percent)
                keep = pa.array(both.fit(np.arange(n), np.arange(n, 2 * n))[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return run


def links(one: np.ndarray, two: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(two) - shared)


def _connecting(n: int, sides: np.ndarray, allowed, proves) -> list[tuple[int, int]]:
    """Pairs of 0..n-1 that connect what the pairs that hold connect. allowed(i): the later ones that may pair with i, and how far they are;
    proves(i, j) decides. Of two sides, only pairs across count."""
    label, found = np.arange(n), []
    across = len(np.unique(sides)) > 1
    for i in range(n - 1):
        fit, far = allowed(i)
        fit &= label[i + 1 :] != label[i]
        if across:
            fit &= sides[i + 1 :] != sides[i]
        at = np.flatnonzero(fit)
        for j in (at[np.argsort(far[at], kind="stable")] + i + 1).tolist():
            if label[j] != label[i] and proves(i, j):
                label[label == label[j]] = label[i]
                found.append((i, j))
    return found


def _pairs_table(gids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([int(gids[f[k]]) for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _by_sketch(raw: list[bytes], sizes: np.ndarray, percent: int):
    sketches, n = Sketches(raw, sizes, percent), len(raw)
    return lambda i: sketches.fit(np.full(n - i - 1, i), np.arange(i + 1, n))


def _sketch_forest(percent: int):
    """Of a bucket's block, or two: pairs that connect what the sketches allow."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        allowed = _by_sketch(table["sketch"].to_pylist(), table["n"].to_numpy(), percent)
        found = _connecting(table.num_rows, table["side"].to_numpy(), allowed, lambda i, j: True)
        return _pairs_table(table["gid"].to_numpy(), found)

    return run


def _block_links(percent: int):
    """Of a cluster's block, or two: links that connect what links."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # A class may come from several documents.
        table = table.take(np.unique(table["gid"].to_numpy(), return_index=True)[1])
        sets = [np.array(s.values) for s in table["own"]]
        allowed = _by_sketch([sketch(s.view(np.uint64)).tobytes() for s in sets], np.array([len(s) for s in sets]), percent)
        found = _connecting(len(sets), table["side"].to_numpy(), allowed, lambda i, j: links(sets[i], sets[j], percent))
        return _pairs_table(table["gid"].to_numpy(), found)

    return run


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, gid) of more than one a key, dealt to pairs of blocks: key, i, j, side, gid."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    dealt = rows.join(sizes, key).withColumn("blocks", F.ceil(F.col("m") / BLOCK_MEMBERS).cast("int")).withColumn("side", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(key, F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "gid")


def _class_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        seen: set[int] = set()
        for _, own in _sets(batches, width):
            gid = class_id(own)
            if gid in seen:
                continue
            seen.add(gid)
            rows.append((gid, own.view(np.int64)))
            if len(rows) >= 500:
                yield _batch(rows, ["gid", "own"], [pa.int64(), pa.list_(pa.int64())])
                rows = []
        yield _batch(rows, ["gid", "own"], [pa.int64(), pa.list_(pa.int64())])

    return run


def _placed(docs: DataFrame, width: int, percent: int, keyed: bool = False) -> DataFrame:
    """doc_id, n, gid (the class; null without shingles), root (the component's class of smallest gid), component_id and, if
    keyed, key (see _key) of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("doc_id", "text")
    first = stored(texts.mapInArrow(trimmed(_first_pass(width, keyed)), _FIRST + ", key binary" * keyed), "shingle-classes")
    documents = first.filter("token is null").select("doc_id", "n", "gid", "sketch", *["key"] * keyed)
    classes = stored(documents.filter("gid is not null").groupBy("gid", "n").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")), "classes")

    # At most COMMON_ENTRIES rows.
    often = first.filter("token is not null").groupBy("token").agg(F.sum("count").alias("n")).filter(F.col("n") >= COMMON_OVERALL).orderBy(F.desc("n"), "token").limit(COMMON_ENTRIES).toArrow()
    tokens, counts = often["token"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(tokens)
    common = spark.sparkContext.broadcast((tokens[order], counts[order]))
    dealt = texts.mapInArrow(trimmed(_prefixes(common, width, percent)), _PREFIX).repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "prefix", "gid")
    candidates = stored(dealt.mapInArrow(trimmed(_group_pairs(percent)), _CANDIDATES), "candidates")

    sketches = classes.select("gid", "sketch", "n")
    one, two = (sketches.select(F.col("gid").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in "ab")
    pairs = candidates.filter("b is not null").select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "sa", "sb", "na", "nb")
    pairs = pairs.mapInArrow(_sketch_fits(percent), "a long, b long")
    large = _in_blocks(candidates.filter("b is null").select("token", F.col("a").alias("gid")), "token").join(sketches, "gid")
    forest = large.groupBy("token", "i", "j").applyInArrow(_sketch_forest(percent), "a long, b long")
    near = stored(pairs.unionByName(forest).distinct(), "pairs")
    clusters = stored(components(near, "a", "b").select(F.col("node").alias("gid"), F.col("root").alias("cluster")), "clusters")
    drop_stored(candidates, near)

    # Each clustered class with its blocks, and where its text is. Both are a few numbers a class, so that no text moves while they are few.
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("blocks"))
    members = clusters.join(sizes, "cluster").withColumn("side", F.pmod(F.xxhash64("gid"), F.col("blocks")).cast("int"))
    members = stored(members.join(classes.select("gid", F.coalesce("least", F.lit(-1)).alias("key")), "gid"), "members")
    own = texts.withColumn("key", F.coalesce("doc_id", F.lit(-1))).join(if_small(members.select("key").distinct()), "key").select("doc_id", "text")
    sets = own.mapInArrow(trimmed(_class_sets(width)), "gid long, own array<long>").join(if_small(members.drop("key")), "gid")
    blocks = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "gid", "own")
    edges = stored(blocks.groupBy("cluster", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct(), "links")
    drop_stored(clusters, members)

    roots = components(edges, "a", "b")
    named = roots.join(classes, roots["node"] == classes["gid"]).groupBy("root").agg(F.min("least").alias("component_id")).join(roots, "root").select(F.col("node").alias("gid"), "root", "component_id")
    placed = classes.select("gid", "n", "least").join(named, "gid", "left").select("gid", "n", F.coalesce("root", "gid").alias("root"), F.coalesce("component_id", "least").alias("component_id"))
    component_id = F.when(F.col("gid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return documents.join(placed, ["gid", "n"], "left").select("doc_id", "n", "gid", "root", component_id.alias("component_id"), *["key"] * keyed)


def jaccard_components(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, gid (the class; null without shingles) of each document."""
    return _placed(docs, width, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "gid")


def one_of_each(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component (documents that link, directly or over others): that of the smallest doc_id, of
    equal ids that of the smallest key of its text, and of rows equal in both any one. A null doc_id comes after all others.
    Rows are told by id and text, so another text of the same id has its own component. Texts without shingles link with
    nothing: all their rows stay."""
    rows = _placed(docs, width, percent, keyed=True).filter("root is not null").groupBy("doc_id", "key").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("n"))
    rows = stored(rows, "placed-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    kept = rows.groupBy("root").agg(F.min(order).alias("kept"))
    rows = rows.join(kept, "root").select("doc_id", "key", (order == F.col("kept")).alias("stays"), "n")
    # One row of a component alone: most rows. So what goes, or repeats, is joined.
    other = stored(rows.filter("not stays or n > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__other"), "stays"), "other-rows")
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    same = lambda there: keyed["doc_id"].eqNullSafe(there["__id"]) & (keyed["__key"] == there["__other"])
    left = keyed.join(if_small(other), same(other), "left_anti")
    repeated = other.filter("stays")
    if not repeated.isEmpty():
        left = left.unionByName(keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["doc_id", "__key"]))
    return left.select(*docs.columns)
