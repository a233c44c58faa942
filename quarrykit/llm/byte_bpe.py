"""Byte-level BPE: encoding and decoding without a shuffle.

A task gathers documents into blocks of bounded text. A block lists the distinct
words (matches of the vocabulary's pattern) that the task hasn't listed before; Spark's
higher-order functions fold the ranked merges over each such word's bytes; a last map
keeps the task's words with their ids, writes the ids back in document order and decodes
them. After a bounded number of words the task starts over.

Common words would be folded in every task. So the commonest of a sample, a bounded number,
are folded first, and go out as one broadcast of bounded size; tasks fold the others. What
the sample holds changes the work alone, not the ids.

The fold holds a word as an array of longs, one a piece (at first, a byte): what the piece and its
right neighbour would merge to, the piece's place in the word, and the piece. So the
least element is the pair of least rank, leftmost first. A step merges it and looks up the
two pairs that are new. Ranks come from a literal: a hash table in an array of longs,
two possible slots a key, each with the pair and what it merges to. Words that are in the
vocabulary as they stand need no fold.

A step copies the word's array, so the fold of a word takes the square of its length. Words over WHOLE_CHARS
characters are therefore cut beforehand where no piece of the vocabulary lies across, so that no merge can; what is left in
one part of over FOLDED_BYTES bytes is merged by a heap of its pairs, in the map, and goes on as its pieces.

Defined cases: a null text is empty and gives no ids; repeated rows each give
a row; a null doc_id stays null; of other columns nothing is read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quarrykit.llm.common import bounded_batches, trimmed
from quarrykit.llm.tokens import TIKTOKEN_FILE, has_adjacent_space, ranks, split_text, words_pattern

#: Characters of text in a block, and words that a task keeps before it starts over.
BLOCK_CHARS, KEPT_WORDS = 500_000, 300_000

#: Words that are folded once for all tasks, and the tasks and characters a task of the sample that they are chosen from.
COMMON_WORDS, SAMPLE_TASKS, SAMPLE_CHARS = 600_000, 64, 1_500_000

#: Characters of a word, and bytes of one of its parts, up to which it is folded whole.
WHOLE_CHARS, FOLDED_BYTES = 64, 512

_BLOCK = "fresh boolean, doc_ids array<bigint>, doc_parts array<binary>, part_words binary, part_sizes binary, known binary, todo array<array<bigint>>"


#: Of a pair that merges to nothing; greater than any rank.
_NONE = 1 << 16
#: Fixed odd multipliers of the two slots of a pair; products stay in 64 bits.
_ONE, _TWO = 0x5E3779B1, 0x45EBCA77


def pair_table(vocabulary: dict[bytes, int]) -> tuple[list[int], int]:
    """The merges as a hash table (entries, slots less one). An entry is the left piece, the right
    piece and what they merge to, 16 bits each (so a vocabulary has at most 65,536 pieces). Pieces of one byte are named by that byte, others by
    their rank."""
    name = {piece: piece[0] if len(piece) == 1 else rank for piece, rank in vocabulary.items()}
    merges = []
    for piece, rank in vocabulary.items():
        for cut in range(1, len(piece)):
            left, right = name.get(piece[:cut]), name.get(piece[cut:])
            if left is not None and right is not None:
                merges.append((left << 32) | (right << 16) | rank)
    bits = max(4, (2 * len(merges)).bit_length())
    while True:
        slots = [-1] * (1 << bits)
        if all(_placed(slots, entry) for entry in merges):
            return slots, len(slots) - 1
        bits += 1


def _slots_of(pair: int, mask: int) -> tuple[int, int]:
    return ((pair * _ONE) >> 16) & mask, ((pair * _TWO) >> 16) & mask


def _placed(slots: list[int], entry: int) -> bool:
    at = _slots_of(entry >> 16, len(slots) - 1)[0]
    for _ in range(500):
        slots[at], entry = entry, slots[at]
        if entry < 0:
            return True
        one, two = _slots_of(entry >> 16, len(slots) - 1)
        at = two if at == one else one
    return False


def _bound(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rank(pair: Column, merges: Column, mask: int) -> Column:
    """What a pair (left << 16 | right) merges to, or _NONE."""

    def entry(multiplier: int) -> Column:
        return F.get(merges, F.shiftright(pair * F.lit(multiplier), 16).bitwiseAND(F.lit(mask)).cast("int"))

    # An entry is looked up again where it is the pair's; that is cheaper than to bind it.
    out = F.lit(_NONE)
    for multiplier in (_TWO, _ONE):
        out = F.when(F.shiftright(entry(multiplier), 16) == pair, entry(multiplier).bitwiseAND(F.lit(0xFFFF)).cast("int")).otherwise(out)
    return out


#: An element of a word's array: rank, place and piece, in these bits. Ranks and pieces have 16 bits, _NONE one more.
_RANK_AT, _PLACE_AT = 46, 16
_PIECE, _PLACED = (1 << _PLACE_AT) - 1, (1 << _RANK_AT) - 1


def byte_ranks(vocabulary: dict[bytes, int]) -> np.ndarray:
    """What two bytes merge to, or _NONE, by 256 times the first plus the second."""
    out = np.full(1 << 16, _NONE, np.int64)
    for piece, rank in vocabulary.items():
        if len(piece) == 2:
            out[256 * piece[0] + piece[1]] = rank
    return out


def word_arrays(words: list[bytes], of_bytes: np.ndarray) -> pa.Array:
    """The arrays that the fold begins with: a word's bytes, each with its place and what it merges to with the next."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    ranked = np.full(len(data), _NONE, np.int64)
    if len(data):
        ranked[:-1] = of_bytes[256 * data[:-1] + data[1:]]
        ranked[ends - 1] = _NONE
    place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
    states = (ranked << _RANK_AT) | (place << _PLACE_AT) | data
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(states))


def folded(word: Column, merges: Column, mask: int) -> Column:
    """The pieces (array<int>) of a word in the form of word_arrays."""

    def piece(element: Column) -> Column:
        return element.bitwiseAND(F.lit(_PIECE))

    def element(left: Column, right: Column, placed: Column) -> Column:
        """placed, a place and its piece (left), with what left and right merge to."""
        rank = _bound(F.shiftleft(left, 16).bitwiseOR(right), lambda pair: _rank(pair, merges, mask))
        return F.shiftleft(rank.cast("long"), _RANK_AT).bitwiseOR(placed)

    def merged(state: Column, least: Column) -> Column:
        new = F.shiftright(least, _RANK_AT)
        own = least.bitwiseAND(F.lit(_PLACED - _PIECE)).bitwiseOR(new)

        def at(p: Column) -> Column:
            before = F.get(state, p - 2)
            left = F.when(p > 1, F.array(element(piece(before), new, before.bitwiseAND(F.lit(_PLACED))))).otherwise(F.slice(state, 1, 0))
            return F.concat(F.slice(state, F.lit(1), F.greatest(p - 2, F.lit(0))), left, F.array(element(new, piece(F.get(state, p + 1)), own)), F.slice(state, p + 2, F.size(state)))

        return _bound(F.array_position(state, least).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return _bound(F.array_min(state), lambda least: F.when(least >= F.lit(_NONE << _RANK_AT), state).otherwise(merged(state, least)))

    return F.aggregate(F.sequence(F.lit(2), F.size(word)), word, step, lambda state: F.transform(state, lambda e: piece(e).cast("int")))


class Cutter:
    """Cuts long words into parts that merge by themselves."""

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        self.ranks = vocabulary
        #: Beginnings of pieces, each with whether it is one.
        self.begins: dict[bytes, bool] = {}
        for piece in vocabulary:
            for n in range(2, len(piece)):
                self.begins.setdefault(piece[:n], False)
            self.begins[piece] = True

    def parts(self, word: bytes) -> list[bytes]:
        """The word in parts of at most FOLDED_BYTES, or single pieces: no merge goes from one to another."""
        begins, cuts, reached = self.begins, [], 1
        for at in range(len(word)):
            if at >= reached:
                cuts.append(at)
            n = 2
            while at + n <= len(word) and (whole := begins.get(word[at : at + n])) is not None:
                if whole:
                    reached = max(reached, at + n)
                n += 1
            reached = max(reached, at + 1)
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True):
            out += [word[a:b]] if b - a <= FOLDED_BYTES else self.merged(word[a:b])
        return out

    def merged(self, word: bytes) -> list[bytes]:
        """The word's pieces: the pair of least rank, leftmost first, merges until none does."""
        ranks, n = self.ranks, len(word)
        after, before, stop = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))
        # A pair is (rank, where it begins, where it ends); it is current while its left piece's neighbour still ends there.
        heap = [(rank, at, at + 2) for at in range(n - 1) if (rank := ranks.get(word[at : at + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            right = after[at]
            if stop[at] < 0 or right >= n or stop[right] != end:
                continue
            stop[at], stop[right], after[at] = end, -1, after[right]
            before[after[right]] = at
            for left in (at, before[at]):
                if left >= 0 and (other := after[left]) < n and (rank := ranks.get(word[left : stop[other]])) is not None:
                    heapq.heappush(heap, (rank, left, stop[other]))
        return [word[at : stop[at]] for at in range(n) if stop[at] > 0]


@dataclass
class Common:
    """Words folded beforehand, by hash: two hashes of each, its pieces end to end, and how many it has. About 40 bytes a word."""

    hashes: np.ndarray
    checks: np.ndarray
    pieces: np.ndarray
    sizes: np.ndarray

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1."""
        if not len(self.hashes):
            return np.full(len(words), -1)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        checks = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where((self.hashes[at] == hashes) & (self.checks[at] == checks), at, -1)


def common_words(docs: DataFrame, vocabulary: str, merges: list[int], mask: int) -> Common:
    """The commonest words of a sample: the first characters of the first tasks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        direct, pattern, left = ranks(vocabulary), words_pattern(), SAMPLE_CHARS
        for batch in batches if TaskContext.get().partitionId() < SAMPLE_TASKS else ():
            for text in batch.column(0).to_pylist():
                counts.update(pattern.findall((text or "")[:left]))
                left -= len(text or "")
                if left <= 0:
                    break
            if left <= 0:
                break
        kept = [(w, n) for w, n in counts.items() if 1 < len(w) <= 64 and w.encode() not in direct]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bytes = byte_ranks(ranks(vocabulary))
        for batch in batches:
            words = [w.encode() for w in batch.column(0).to_pylist()]
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(map(zlib.crc32, words), pa.int64()), word_arrays(words, of_bytes)], names=["hash", "crc", "state"])

    chosen = docs.select("text").mapInArrow(trimmed(counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    # The limit leaves one task; the fold wants all.
    spread = chosen.select("word").repartition(max(2, 4 * docs.sparkSession.sparkContext.defaultParallelism))
    folds = spread.mapInArrow(arrays, "hash long, crc long, state array<bigint>").select("hash", "crc", _bound(_literal(merges), lambda m: folded(F.col("state"), m, mask)).alias("pieces"))
    made = folds.toArrow().combine_chunks()
    hashes, crcs = made["hash"].to_numpy().view(np.uint64), made["crc"].to_numpy().astype(np.uint32)
    pieces = made["pieces"].combine_chunks() if made.num_rows else pa.array([], pa.list_(pa.int32()))
    order = np.argsort(hashes, kind="stable")
    sizes = list_sizes(pieces)
    flat = pieces.flatten().to_numpy()[ragged((np.cumsum(sizes) - sizes)[order], sizes[order])]
    return Common(hashes[order], crcs[order], flat.astype(np.uint16), sizes[order].astype(np.uint16))


def _blocks(vocabulary: str, block_chars: int, common):
    names = ["fresh", "doc_ids", "doc_parts", "part_words", "part_sizes", "known", "todo"]
    types = [pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary()]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        direct, pattern = ranks(vocabulary), words_pattern()
        of_bytes, cutter = byte_ranks(direct), None  # made for the first long word
        before = common.value
        parts, word_of, fresh = _Parts(), _Numbered(), True
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def parts_of(word: bytes) -> list[bytes]:
            nonlocal cutter
            cutter = cutter or Cutter(direct)
            return cutter.parts(word)

        def block() -> pa.RecordBatch:
            flat, sizes = array("i"), array("i")
            for part in parts.taken():
                if len(part) <= WHOLE_CHARS:
                    refs = [word_of[w] for w in pattern.findall(part)]
                else:
                    words = (w.encode() for w in pattern.findall(part))
                    refs = [word_of[p] for w in words for p in ([w] if len(w) <= WHOLE_CHARS or w in direct else parts_of(w))]
                flat.extend(refs)
                sizes.append(len(refs))
            words = [w if isinstance(w, bytes) else w.encode() for w in word_of.taken()]
            # A rank; or, below -1, a common word; or -1, a word to fold.
            known = np.fromiter((direct.get(w, -1) for w in words), np.int32, len(words))
            other = np.flatnonzero(known < 0)
            number = before.find([words[i] for i in other])
            known[other[number >= 0]] = -2 - number[number >= 0]
            todo = word_arrays([words[i] for i in other[number < 0]], of_bytes)
            row = [fresh, ids, texts, flat.tobytes(), sizes.tobytes(), known.tobytes()]
            made = [pa.array([x], t) for x, t in zip(row, types, strict=True)]
            return pa.RecordBatch.from_arrays([*made, pa.ListArray.from_arrays(pa.array([0, len(todo)], pa.int32()), todo)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids.append(doc_id)
                texts.append(parts.of(text).tobytes())
                held += len(text) + 100
                if held >= block_chars:
                    yield block()
                    ids, texts, held, fresh = [], [], 0, False
                    if len(parts) > KEPT_WORDS:
                        parts, word_of, fresh = _Parts(), _Numbered(), True
        if ids:
            yield block()

    return gather


class _Numbered(dict):
    """Numbers its keys, words or parts of words, in the order of their first lookup."""

    def __init__(self) -> None:
        super().__init__()
        self._new: list[str | bytes] = []

    def __missing__(self, key: str | bytes) -> int:
        self[key] = at = len(self)
        self._new.append(key)
        return at

    def taken(self) -> list[str | bytes]:
        """The keys that are new since the last call."""
        new, self._new = self._new, []
        return new


class _Parts:
    """Numbers the parts that split_text cuts a text into. Those that begin with a space are looked up without it."""

    def __init__(self) -> None:
        self._new: list[str] = []
        self._n = 0
        self._spaced, self._plain = _Shared(self, " "), _Shared(self, "")

    def __len__(self) -> int:
        return self._n

    def added(self, part: str) -> int:
        self._new.append(part)
        self._n += 1
        return self._n - 1

    def of(self, text: str) -> array:
        if has_adjacent_space(text):
            return array("i", map(self._plain.__getitem__, split_text(text)))
        first, *rest = text.split(" ")
        head = [self._plain[first]] if first else []
        return array("i", head + list(map(self._spaced.__getitem__, rest)))

    def taken(self) -> list[str]:
        new, self._new = self._new, []
        return new


class _Shared(dict):
    def __init__(self, parts: _Parts, before: str) -> None:
        super().__init__()
        self._parts, self._before = parts, before

    def __missing__(self, key: str) -> int:
        self[key] = at = self._parts.added(self._before + key)
        return at


def list_sizes(lists: pa.Array) -> np.ndarray:
    """How many elements each list has; none is null."""
    return np.diff(lists.offsets.to_numpy()).astype(np.int64)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + sizes[i] - 1 of all i in turn."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class _Groups:
    """Groups laid end to end in values."""

    def __init__(self) -> None:
        self.values, self.sizes, self.starts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
        self.values, self.sizes = np.concatenate([self.values, values]), np.concatenate([self.sizes, sizes])

    def of(self, picks: np.ndarray) -> np.ndarray:
        """Those picked, in that order, end to end."""
        return self.values[ragged(self.starts[picks], self.sizes[picks])]


def _documents(vocabulary: str, with_ids: bool, common):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(vocabulary)
        written = _Written(table)
        rank_of_byte = np.arange(1 << 16, dtype=np.int32)
        rank_of_byte[:256] = [table[bytes([b])] for b in range(256)]
        before = common.value
        before_sizes = before.sizes.astype(np.int32)
        before_starts = np.cumsum(before_sizes, dtype=np.int32) - before_sizes
        by_word, by_part = _Groups(), _Groups()
        for batch in batches:
            for at in range(batch.num_rows):
                row = dict(zip(batch.schema.names, (c[at] for c in batch.columns), strict=True))
                if row["fresh"].as_py():
                    by_word, by_part = _Groups(), _Groups()
                numbers = {name: np.frombuffer(row[name].as_py(), "<i4") for name in ("part_words", "part_sizes", "known")}
                known, encoded = numbers["known"], row["encoded"].values
                fold, often = known == -1, known < -1
                sizes = np.ones(len(known), np.int64)
                sizes[fold] = list_sizes(encoded)
                sizes[often] = before_sizes[-2 - known[often]]
                word_ids = np.empty(int(sizes.sum()), np.int32)
                starts = np.cumsum(sizes) - sizes
                word_ids[starts[known >= 0]] = known[known >= 0]
                word_ids[ragged(starts[fold], sizes[fold])] = rank_of_byte[encoded.flatten().to_numpy(zero_copy_only=False)] if len(encoded) else []
                word_ids[ragged(starts[often], sizes[often])] = rank_of_byte[before.pieces[ragged(before_starts[-2 - known[often]], sizes[often])]]
                by_word.add(word_ids, sizes)
                ends = np.concatenate([[0], np.cumsum(by_word.sizes[numbers["part_words"]])])
                bounds = np.concatenate([[0], np.cumsum(numbers["part_sizes"])])
                by_part.add(by_word.of(numbers["part_words"]), ends[bounds[1:]] - ends[bounds[:-1]])
                lists = [np.frombuffer(parts.as_buffer(), "<i4") for parts in row["doc_parts"].values]
                picks = np.concatenate(lists)
                ids = by_part.of(picks)
                ends = np.concatenate([[0], np.cumsum(by_part.sizes[picks])])[np.cumsum([0, *map(len, lists)])]
                digests = written.digests(ids, ends)
                made = [row["doc_ids"].values, pa.array(np.diff(ends)), *(pa.array(c, pa.string()) for c in zip(*digests, strict=True))]
                if with_ids:
                    made.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(made, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + with_ids])

    return write


class _Written:
    """Ids as they are written: decimal and a space after each, and the vocabulary's pieces, end to end in two arrays of bytes."""

    #: Ids written at a time, as long as documents end; so few that the arrays of their bytes stay in the cache.
    TOGETHER = 8_000

    def __init__(self, vocabulary: dict[bytes, int]) -> None:
        pieces = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, rank in vocabulary.items():
            pieces[rank] = piece
        self._tables = [self._table([b"%d " % rank for rank in range(len(pieces))]), self._table(pieces)]

    @staticmethod
    def _table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        return np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes

    def _bytes(self, which: int, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids' bytes, and where each id's end."""
        data, starts, sizes = self._tables[which]
        own = sizes[ids]
        return memoryview(data[ragged(starts[ids], own)]), np.cumsum(own)

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> list[tuple[str, str]]:
        """SHA-256 of the decimal ids, joined by a space, and of the pieces, of each document (its ids are between two of ends)."""
        out: list[tuple[str, str]] = []
        at, n = 0, len(ends) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + self.TOGETHER, side="right")) - 1)
            hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in range(at, to)]
            # More than one pass only for a single document that is longer.
            for a in range(int(ends[at]), int(ends[to]), self.TOGETHER):
                part = ids[a : min(a + self.TOGETHER, ends[to])]
                for which in (0, 1):
                    data, stops = self._bytes(which, part)
                    places = np.concatenate([[0], stops])[np.clip(ends[at : to + 1] - a, 0, len(part))].tolist()
                    for k, own in enumerate(hashes):
                        # No space after a document's last id.
                        last = which == 0 and a + len(part) >= ends[at + k + 1] and places[k + 1] > places[k]
                        own[which].update(data[places[k] : places[k + 1] - last])
            out += [(one.hexdigest(), two.hexdigest()) for one, two in hashes]
            at = to
        return out


def _literal(entries: list[int]) -> Column:
    """An array<long> literal: the optimizer folds from_json of a literal."""
    return F.from_json(F.lit(json.dumps(entries, separators=(",", ":"))), "array<bigint>")


def encode_documents(docs: DataFrame, vocabulary: str = TIKTOKEN_FILE, with_ids: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; with_ids adds the ids."""
    bounded_batches(docs.sparkSession)
    merges, mask = pair_table(ranks(vocabulary))
    common = docs.sparkSession.sparkContext.broadcast(common_words(docs, vocabulary, merges, mask))
    blocks = docs.select("doc_id", "text").mapInArrow(trimmed(_blocks(vocabulary, block_chars, common)), _BLOCK)
    encoded = _bound(_literal(merges), lambda m: F.transform("todo", lambda w: folded(w, m, mask)))
    blocks = blocks.select("fresh", "doc_ids", "doc_parts", "part_words", "part_sizes", "known", encoded.alias("encoded"))
    return blocks.mapInArrow(trimmed(_documents(vocabulary, with_ids, common)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(df: DataFrame, ids: str = "ids", vocabulary: str = TIKTOKEN_FILE) -> DataFrame:
    """df with column decoded: the binary pieces of its ids, concatenated (null where ids is null)."""
    schema = StructType([*df.schema.fields, StructField("decoded", BinaryType())])
    at = df.columns.index(ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {rank: piece for piece, rank in ranks(vocabulary).items()}
        for batch in batches:
            decoded = [None if of is None else b"".join(map(pieces.__getitem__, of)) for of in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(decode, schema)
