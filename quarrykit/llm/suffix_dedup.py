"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every string of a length (a window) holds the piece of least hash among its
own, its anchor, so equal windows have equal anchors at equal places. Anchors are a few in a window;
those that occur once are dropped before any text moves. Of each other anchor, the bytes
under its windows (a fragment, less than twice the length) go to the anchor's shard, where fragments are put
together, their suffix array is built by induced sorting, and common prefixes of neighbours tell which
windows begin elsewhere too. Results are runs of window starts, gathered by text.

Equal texts are one text with a number of copies: with two or more, all its windows are
repeated. Fragments that a task has several times are known to be repeated there: the task gives their runs,
and one copy goes on, so a passage that a third of the documents hold moves once a task. A shard takes whole anchors,
up to a bounded number of bytes at a time. An anchor in very many
texts is split by what its windows hold: sixteen neighbouring windows share a core of bytes,
and the core's hash is part of the shard's key, so equal windows still meet. Counts are joined to anchors
in two ways: those of the commonest HOT_ANCHORS are broadcast, and any other has less than one part
in HOT_ANCHORS of all places.

repeated_bytes takes all strings of LENGTH bytes. without_repeats is for texts that stay in use: it finds strings of
PASSAGE_BYTES and cuts those runs that hold more than PASSAGE_WORDS whole words, or LENGTH bytes.

Defined cases: a null text is empty; texts under the length lose nothing; repeated rows are copies, so
all of them lose what the text has of the length or more; a null doc_id stays null; other
columns aren't read. Texts are told apart by their MD5.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import bounded_batches, drop_stored, if_small, stored, trimmed
from quarrykit.llm.suffix_arrays import repeated_starts, words_at

LENGTH = 400
#: What without_repeats cuts: runs of strings of so many bytes that hold more than so many words. Of 51 neighbouring words of the
#: test tables' English, the language with the shortest, 99 in 100 have 203 bytes or more.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50
#: Bytes of texts handled in one array, and of fragments in one suffix array.
TOGETHER, SHARD_BYTES = 1_000_000, 1_000_000
#: Places of an anchor above which it is split by its windows' cores, of CORE windows each.
HOT_PLACES, CORE = 20_000, 16
#: Anchors whose counts are broadcast, those of most places.
HOT_ANCHORS = 4096
_SEPARATOR = b"\xff"  # no byte of UTF-8


Wanted = Callable[[bytes, int, int], bool]


def any_run(data: bytes, start: int, end: int) -> bool:
    return True


def of_words(data: bytes, start: int, end: int) -> bool:
    """Whether data[start:end] holds LENGTH bytes, or more than PASSAGE_WORDS words that don't go on outside."""
    if end - start >= LENGTH:
        return True
    words = [m.span() for m in re.finditer(rb"\S+", data[start:end])]
    if words and words[0][0] == 0 and start and not data[start - 1 : start].isspace():
        del words[0]
    if words and words[-1][1] == end - start and end < len(data) and not data[end : end + 1].isspace():
        del words[-1]
    return len(words) > PASSAGE_WORDS


def _piece(length: int) -> int:
    """Bytes of the pieces that anchors are chosen from."""
    return 64 if length >= 300 else 32


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of values[i : i + width], for each i that has so many."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: hash, first window, number of windows, anchor's place. data holds texts end to
    end, bounds where each begins (and the end); windows don't cross bounds. The least hash that is leftmost is the anchor."""
    piece = _piece(length)
    width = length - piece + 1
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    h = words_at(data)
    for reach in (8, 16, 32)[: 3 if piece == 64 else 2]:  # hashes of twice as many bytes
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h[:-reach] += h[reach:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least = _sliding_min(h[: len(data) - piece + 1], width)
    n = len(least)
    inside = np.zeros(n + 1, np.int8)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= length:
            inside[a] += 1
            inside[min(b - length + 1, n)] -= 1
    inside = np.cumsum(inside[:n], dtype=np.int8) > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    new[bounds[:-1][bounds[:-1] < n]] = True
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none
    stop = np.append(first[1:], n)
    gap = np.flatnonzero(~inside)
    if len(gap):
        nearest = np.searchsorted(gap, first)
        ok = nearest < len(gap)
        stop[ok] = np.minimum(stop[ok], gap[nearest[ok]])
    # The anchor's place: the first one at or after the run's start with the run's hash. Where equal
    # pieces stand in one run, it ends at its anchor and a new run begins behind.
    values = np.unique(least[first])
    own = np.flatnonzero(np.isin(h[: len(data) - piece + 1], values))
    number = np.searchsorted(values, h[own])
    order = np.lexsort((own, number))
    key = number[order] * np.int64(len(data) + 1) + own[order]
    found: list[tuple[np.ndarray, ...]] = []
    while len(first):
        value = np.searchsorted(values, least[first])
        at = own[order[np.searchsorted(key, value * np.int64(len(data) + 1) + first)]]
        end = np.minimum(stop, at + 1)
        found.append((least[first].view(np.int64), first, end - first, at))
        more = end < stop
        first, stop = end[more], stop[more]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


_FIRST = "doc_id long, key binary, n_bytes long, sha256 string, wanted boolean, spots array<struct<h:long,first:int,n:int,at:int>>"
_SPOT = pa.struct([("h", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("at", pa.int32())])


def _first_pass(length: int, wanted: Wanted):
    """Each document's key, size and hash, whether the whole text would be cut if it were repeated, and the anchors of a text that
    the task sees for the first time."""

    def told(rows: list[tuple], coded: list[bytes | None]) -> pa.RecordBatch:
        kept = [i for i, c in enumerate(coded) if c is not None]
        bounds = np.cumsum([0, *(len(coded[i]) for i in kept)])
        h, first, n, at = anchors(np.frombuffer(b"".join(coded[i] for i in kept), np.uint8), bounds, length)
        order = np.argsort(first)
        h, first, n, at = h[order], first[order], n[order], at[order]
        owner = np.searchsorted(bounds, first, side="right") - 1
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.add.at(offsets, np.array(kept, np.int64)[owner] + 1 if len(kept) else [], 1)
        base = bounds[owner] if len(kept) else first
        spots = pa.StructArray.from_arrays([pa.array(h, pa.int64()), *(pa.array(x, pa.int32()) for x in (first - base, n, at - base))], fields=list(_SPOT))
        columns = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
        made = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        return pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array(np.cumsum(offsets), pa.int32()), spots)], names=["doc_id", "key", "n_bytes", "sha256", "wanted", "spots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        rows, coded, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = (text.as_py() or "").encode()
                key = hashlib.md5(data).digest()
                rows.append((doc_id, key, len(data), hashlib.sha256(data).hexdigest(), len(data) >= length and wanted(data, 0, len(data))))
                coded.append(data if key not in seen and len(data) >= length else None)
                seen.add(key)
                held += len(data)
                if held >= TOGETHER or len(rows) >= 5000:
                    yield told(rows, coded)
                    rows, coded, held = [], [], 0
        if rows:
            yield told(rows, coded)

    return run


_FRAGMENT = "h long, salt long, key binary, first int, stop int, reach int, fragment binary"
#: Bytes of fragments that a task compares before it sends them.
COMPARED_BYTES = 8_000_000


def _pieces_of(spot: dict, data: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(salt, first window, end) of a spot; a hot one's by cores: windows whose distance to the anchor has one quotient by CORE."""
    first, end, at = spot["first"], spot["first"] + spot["n"], spot["at"]
    if not spot["hot"]:
        yield 0, first, end
        return
    while first < end:
        quotient = (at - first) // CORE
        last = at - quotient * CORE
        core = data[last : last - CORE + 1 + length]
        to = min(end, last + 1)
        yield int(np.int64(np.uint64(xxhash.xxh64_intdigest(core, seed=quotient) | 1))), first, to
        first = to


def _fragments(length: int):
    """From (key, text, spots with hot): a row a fragment. Of equal ones in a task each gives its run (without a fragment, dealt by the
    text), and a fragment without a key goes on for all of them. reach is how far before its anchor a fragment begins."""
    names, types = ["h", "salt", "key", "first", "stop", "reach", "fragment"], [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        places: dict[tuple[int, int, int, bytes], tuple[bytes, int, int] | None] = {}
        known: list[tuple] = []
        held = 0

        def told(key: bytes, first: int, stop: int) -> tuple:
            return int.from_bytes(key[:8], "little", signed=True), 0, key, first, stop, None, None

        def out() -> Iterator[pa.RecordBatch]:
            rows = known + [(h, salt, *(place or (None, None, None)), reach, fragment) for (h, salt, reach, fragment), place in places.items()]
            for a in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 5000], strict=True), types, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                if key in seen:
                    continue
                seen.add(key)
                data = batch.column(1)[i].as_py().encode()
                for spot in batch.column(2)[i].as_py():
                    for salt, first, stop in _pieces_of(spot, data, length):
                        fragment = data[first : stop - 1 + length]
                        at = (spot["h"], salt, spot["at"] - first, fragment)
                        if at not in places:
                            places[at] = (key, first, stop)
                            held += len(fragment) + 200
                            continue
                        known.append(told(key, first, stop))
                        held += 100
                        if places[at]:
                            known.append(told(*places[at]))
                            places[at] = None
                if held >= COMPARED_BYTES:
                    yield from out()
                    places, known, held = {}, [], 0
        yield from out()

    return run


_RUN = "key binary, first int, stop int"


def _runs(starts: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) > 1)
        for a, b in zip(np.append(starts[0], starts[cut + 1]).tolist(), np.append(starts[cut], starts[-1]).tolist(), strict=True):
            yield base + a, base + b + 1


def _may_share(group: dict[tuple[int, bytes], set], length: int) -> list[tuple[tuple[int, bytes], set]]:
    """The fragments of an anchor that may share a window with one that has a single place. Equal windows lie alike to their anchors, and CORE
    neighbouring ones have a core of bytes in common."""
    if len(group) == 1 or all(len(where) > 1 for where in group.values()):
        return []
    cores: dict[tuple[int, bytes], list[tuple[int, bytes]]] = {}
    for reach, fragment in group:
        for quotient in range((reach - len(fragment) + length) // CORE, reach // CORE + 1):
            start = reach - quotient * CORE
            cores.setdefault((quotient, fragment[start : start - CORE + 1 + length]), []).append((reach, fragment))
    held = {of for alike in cores.values() if len(alike) > 1 and any(len(group[of]) == 1 for of in alike) for of in alike}
    return [(of, where) for of, where in group.items() if of in held]


def _shard_runs(groups: list[dict[tuple[int, bytes], set]], length: int) -> list[tuple[bytes, int, int]]:
    """Runs of repeated windows in groups, a dict each: (reach, fragment): the places (key, first) it has; None among them
    stands for places whose runs are known."""
    out, alone = [], []
    for group in groups:
        for (_, fragment), where in group.items():
            if len(where) > 1:
                out += [(*place, place[1] + len(fragment) - length + 1) for place in where if place]
        alone += [(fragment, where) for (_, fragment), where in _may_share(group, length)]
    if alone:
        data = np.frombuffer(_SEPARATOR.join(f for f, _ in alone) + _SEPARATOR, np.uint8)
        sizes = np.array([len(f) + 1 for f, _ in alone])
        breaks = np.cumsum(sizes) - sizes
        n = sizes - length
        ends = np.cumsum(n)
        starts = np.arange(ends[-1]) + np.repeat(breaks - (ends - n), n)
        found = repeated_starts(data, starts, length, breaks)
        for (_, where), a, b in zip(alone, (ends - n).tolist(), ends.tolist(), strict=True):
            if len(where) == 1 and (place := next(iter(where))):
                (key, first), own = place, np.flatnonzero(found[a:b])
                out += [(key, x, y) for x, y in _runs(own, first)]
    return out


def _shards(length: int, shard_bytes: int):
    """Of fragments sorted by anchor: runs of repeated windows, from as many whole anchors at a time as shard_bytes allow."""
    names, types = ["key", "first", "stop"], [pa.binary(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict[tuple[int, bytes], set]] = []
        known: list[tuple[bytes, int, int]] = []
        last, held = None, 0

        def made() -> pa.RecordBatch:
            rows = known + _shard_runs(groups, length)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            for h, salt, key, first, stop, reach, fragment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fragment is None:
                    known.append((key, first, stop))
                    continue
                if (h, salt) != last:
                    if held >= shard_bytes or len(known) >= 100_000:
                        yield made()
                        groups, known, held = [], [], 0
                    if groups and len(groups[-1]) == 1 and len(next(iter(groups[-1].values()))) == 1:
                        groups.pop()  # an anchor with one place after all
                    groups.append({})
                    last = (h, salt)
                group = groups[-1]
                if (reach, fragment) not in group:
                    group[reach, fragment] = set()
                    held += len(fragment)
                group[reach, fragment].add(key and (key, first))
        yield made()

    return run


def _kept(data: bytes, runs: list[dict], length: int, wanted: Wanted) -> tuple[bytes, int]:
    """What is left of data without the wanted ones of the bytes under its runs, and how many such there are."""
    spans: list[list[int]] = []
    for first, stop in sorted((r["first"], r["stop"]) for r in runs):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop - 1 + length)
        else:
            spans.append([first, stop - 1 + length])
    cut = [(a, b) for a, b in spans if wanted(data, a, b)]
    return b"".join(data[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(data)], strict=True)), len(cut)


def _cut(length: int, wanted: Wanted):
    """From (key, text, runs): how much a text loses, and what is left; copies in one task count once."""
    names, types = ["key", "n_removed", "n_spans", "kept_sha256"], [pa.binary(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if key in seen:
                    continue
                seen.add(key)
                data = text.as_py().encode()
                left, spans = _kept(data, runs.as_py(), length, wanted)
                rows.append((key, len(data) - len(left), spans, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def _scrub(at: int, n_columns: int, length: int, wanted: Wanted):
    """From rows of documents and, behind them, runs and gone: the documents, with their text (column at) cut. A character that a cut goes
    through is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, runs, gone in zip(batch.column(at), batch.column(n_columns), batch.column(n_columns + 1), strict=True):
                text = text.as_py()
                if text is not None and gone.as_py():
                    text = ""
                elif text is not None and runs.is_valid:
                    text = _kept(text.encode(), runs.as_py(), length, wanted)[0].decode(errors="ignore")
                texts.append(text)
            columns = batch.columns[:n_columns]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:n_columns])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and key."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))


def _alone(texts: DataFrame, chosen: DataFrame) -> DataFrame:
    """One document's text of each of chosen, a stored table (key, least): rows are dealt by id and key, so that copies don't meet. Other
    texts don't move while the chosen are few."""
    chosen, few = chosen.withColumnRenamed("key", "own"), if_small(chosen.select("key", "least"))
    texts = texts.join(few.withColumnsRenamed({"key": "own"}), (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    return texts.join(chosen, (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("least"))).drop("own", "least", "doc_id")


def _repeats(docs: DataFrame, length: int, wanted: Wanted) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, key, n_bytes, sha256); their distinct texts (key, least, copies, gone); the runs of repeated windows by text (key, runs)."""
    bounded_batches(docs.sparkSession)
    texts = _keyed(docs)
    first = stored(texts.select("doc_id", "text").mapInArrow(trimmed(_first_pass(length, wanted)), _FIRST), "anchors")
    gone = (F.count(F.lit(1)) > 1) & F.first("wanted")
    distinct = stored(first.groupBy("key").agg(F.min("doc_id").alias("least"), gone.alias("gone"), F.max_by("spots", F.size("spots")).alias("spots")), "distinct-texts")
    spots = distinct.select("key", "least", F.inline("spots"))
    places = stored(spots.groupBy("h").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("h", "places", (F.col("places") > HOT_PLACES).alias("hot")), "anchors-repeated")
    often = places.orderBy(F.desc("places"), "h").limit(HOT_ANCHORS).select("h", "hot")
    rest = places.select("h", "hot").join(F.broadcast(often.select("h")), "h", "left_anti")
    repeated = spots.join(F.broadcast(often), "h").unionByName(spots.join(F.broadcast(often.select("h")), "h", "left_anti").join(rest, "h"))
    moved = stored(repeated.groupBy("key", "least").agg(F.collect_list(F.struct("h", "first", "n", "at", "hot")).alias("spots")), "spots-repeated")
    fragments = _alone(texts, moved).select("key", "text", "spots").mapInArrow(trimmed(_fragments(length)), _FRAGMENT)
    fragments = fragments.repartition("h", "salt").sortWithinPartitions("h", "salt")
    runs = fragments.mapInArrow(trimmed(_shards(length, SHARD_BYTES)), _RUN).distinct().groupBy("key").agg(F.collect_list(F.struct("first", "stop")).alias("runs"))
    runs = stored(runs, "runs")
    drop_stored(places, moved)
    return first.select("doc_id", "key", "n_bytes", "sha256"), distinct.select("key", "least", "gone"), runs


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document."""
    documents, distinct, runs = _repeats(docs, length, any_run)
    some = stored(distinct.filter("not gone").join(runs, "key").select("key", "least", "runs"), "runs-to-cut")
    cut = _alone(_keyed(docs), some).select("key", "text", "runs").mapInArrow(trimmed(_cut(length, any_run)), "key binary, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["key"])
    changed = distinct.select("key", "gone").join(cut, "key", "left").filter("gone or n_spans is not null")
    empty, nothing = F.lit(hashlib.sha256(b"").hexdigest()), F.lit(0).cast("long")
    return documents.join(changed, "key", "left").select(
        "doc_id", "n_bytes", F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", nothing)).alias("n_removed"),
        F.when(F.col("gone"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", nothing)).alias("n_spans"), F.when(F.col("gone"), empty).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = PASSAGE_BYTES, wanted: Wanted = of_words) -> DataFrame:
    """docs without the wanted ones of the repeated strings; a character that a cut goes through is dropped. Null texts stay."""
    _, distinct, runs = _repeats(docs, length, wanted)
    changed = distinct.select("key", "gone").join(runs, "key", "left").filter("gone or runs is not null")
    changed = stored(changed.select(F.col("key").alias("__changed"), F.col("runs").alias("__runs"), F.col("gone").alias("__gone")), "texts-to-cut")
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    keys, same = if_small(changed.select("__changed")), F.col("__key") == F.col("__changed")
    joined = keyed.join(keys, same, "left_semi").join(changed, same).select(*docs.columns, "__runs", "__gone")
    cut = joined.mapInArrow(trimmed(_scrub(docs.columns.index("text"), len(docs.columns), length, wanted)), docs.schema)
    return cut.unionByName(keyed.join(keys, same, "left_anti").select(*docs.columns))
