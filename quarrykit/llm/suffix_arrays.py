"""Suffix arrays by induced sorting, with NumPy.

Suffixes are of type S or L (smaller or larger than the next one). The leftmost S ones (LMS) are
sorted first: their substrings by one induction from unsorted ones, then, by these
substrings' names, the LMS suffixes by recursion. A second induction from the sorted LMS
suffixes gives all. An induction goes bucket by bucket; a bucket's entries are handled in waves,
each wave whole: its predecessors of the right type are dealt to their buckets in
order, which a stable sort of their first symbols does. The work is linear.

The recursion is the same procedure at every depth; names are symbols of their own, at most half as
many as the string above has. Where buckets are small (names have many), an induction handles entry by entry
instead of wave by wave.
"""

from __future__ import annotations

import numpy as np

#: Symbols a bucket on average from which waves pay.
BUCKET_FOR_WAVES = 200


def words_at(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as one little-endian number; past the end, zeros."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        m = -(-(n - k) // 8)
        out[k::8] = padded[k : k + 8 * m].view("<u8")
    return out


def common_prefixes(wide: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Bytes that the suffixes at a and b have in common, most at most. wide: words_at(data)."""
    n = len(wide)
    limit = np.minimum(np.minimum(n - a, n - b), most).astype(np.int64)
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        x = wide[a[live] + out[live]] ^ wide[b[live] + out[live]]
        same = x == 0
        differ = live[~same]
        low = x[~same] & (~x[~same] + np.uint64(1))  # the lowest set bit; its exponent over 8 is the first byte that differs
        out[differ] += (np.log2(low.astype(np.float64)) // 8).astype(np.int64)
        live = live[same]
        out[live] += 8
        live = live[out[live] < limit[live]]
    return np.minimum(out, limit)


def _larger(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type L; the end is smaller than any symbol."""
    n = len(text)
    differs = np.append(text[1:] != text[:-1], True)
    at = np.where(differs, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    falls = np.append(text[1:] < text[:-1], True)
    return falls[at]


def _induce(text: np.ndarray, larger: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that follows from lms, the LMS positions in order (or, for their substrings'
    order, in any order). Symbols are below symbols."""
    ends = np.cumsum(np.bincount(text, minlength=symbols))
    if len(text) < BUCKET_FOR_WAVES * symbols:
        return _by_entries(text.tolist(), larger.tolist(), lms.tolist(), ends.tolist())
    return _by_waves(text, larger, lms, ends)


def _by_entries(text: list[int], larger: list[bool], lms: list[int], ends: list[int]) -> np.ndarray:
    n, tail, head = len(text), ends.copy(), [0, *ends[:-1]]
    out = [0] * n  # a place that nothing has come to yet leads to nothing, as position 0 does
    for j in reversed(lms):
        tail[text[j]] -= 1
        out[tail[text[j]]] = j
    last = text[-1]
    out[head[last]] = n - 1  # the end's predecessor
    head[last] += 1
    for j in out:  # grows ahead of the loop
        if j and larger[j - 1]:
            c = text[j - 1]
            out[head[c]] = j - 1
            head[c] += 1
    tail = ends
    for at in range(n - 1, -1, -1):
        j = out[at]
        if j and not larger[j - 1]:
            c = text[j - 1]
            tail[c] -= 1
            out[tail[c]] = j - 1
    return np.array(out, np.int64)


def _by_waves(text: np.ndarray, larger: np.ndarray, lms: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, symbols = len(text), len(ends)
    starts = np.append(0, ends[:-1])
    out = np.full(n, -1, np.int64)
    first = text[lms]
    order = np.argsort(first, kind="stable")
    lms, first = lms[order], first[order]
    n_lms = np.bincount(first, minlength=symbols)
    out[(ends - np.cumsum(n_lms))[first] + np.arange(len(lms))] = lms
    present = np.flatnonzero(ends > starts).tolist()

    def dealt(wave: np.ndarray, of_larger: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        before = wave[wave > 0] - 1
        before = before[larger[before] == of_larger]
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        symbol = symbol[order]
        n_each = np.bincount(symbol, minlength=symbols)
        return before[order], symbol, np.arange(len(symbol)) - (np.cumsum(n_each) - n_each)[symbol], n_each

    head = starts.copy()
    out[head[text[-1]]] = n - 1  # the end's predecessor
    head[text[-1]] += 1

    def forward(wave: np.ndarray) -> None:
        before, symbol, rank, n_each = dealt(wave, True)
        out[head[symbol] + rank] = before
        np.add(head, n_each, out=head)

    for c in present:
        done = starts[c]
        while done < head[c]:
            wave, done = out[done : head[c]], head[c]
            forward(wave)
        if n_lms[c]:
            forward(out[ends[c] - n_lms[c] : ends[c]].copy())
    tail = ends.copy()

    def backward(wave: np.ndarray) -> None:
        before, symbol, rank, n_each = dealt(wave, False)
        out[tail[symbol] - 1 - rank] = before
        np.subtract(tail, n_each, out=tail)

    for c in reversed(present):
        done = ends[c]
        while tail[c] < done:
            wave, done = out[tail[c] : done][::-1], tail[c]
            backward(wave)
        if head[c] > starts[c]:
            backward(out[starts[c] : head[c]][::-1])
    return out


def _sorted(text: np.ndarray, symbols: int) -> np.ndarray:
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    larger = _larger(text)
    lms = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    if not len(lms):
        return _induce(text, larger, lms, symbols)
    rough = _induce(text, larger, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms) + 1, n + 1)  # the last one ends with the text, so no other equals it
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    a, b = a[same], b[same]
    size = text.dtype.itemsize
    same[same] = common_prefixes(words_at(text.view(np.uint8)), size * a, size * b, size * length[a]) == size * length[a]
    name = np.empty(n, np.int64)
    name[ordered] = np.append(0, np.cumsum(~same))
    names = name[lms]
    count = int(names.max()) + 1
    return _induce(text, larger, ordered if count == len(lms) else lms[_sorted(names, count)], symbols)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of text (bytes) in order."""
    return _sorted(text, 256)


def permuted_common_prefixes(text: np.ndarray, suffixes: np.ndarray, most: int, breaks: np.ndarray | None = None) -> np.ndarray:
    """For each position, the bytes its suffix has in common with the one before it in order. Counted
    up to most bytes from positions whose predecessor isn't that of the position before, moved by one, and from breaks;
    from there on each position has one byte less."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)
    has = np.flatnonzero(before[:-1] >= 0)
    follows[1:][has] &= text[has] == text[before[has]]
    if breaks is not None:
        follows[breaks] = False
    own = np.flatnonzero(~follows & (before >= 0))
    out = np.zeros(n, np.int64)
    out[own] = common_prefixes(words_at(text), own, before[own], most)
    source = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    return np.maximum(out[source] - (np.arange(n) - source), 0)


def repeated_starts(text: np.ndarray, starts: np.ndarray, length: int, breaks: np.ndarray) -> np.ndarray:
    """For each of starts (positions with length bytes of one piece after them; breaks: where pieces begin),
    whether its length bytes also begin at another of them."""
    order = suffix_array(text)
    valid = np.zeros(len(text), bool)
    valid[starts] = True
    # Positions follow their source by less than a piece's starts; so much is counted beyond length.
    reach = length + int(np.diff(np.append(breaks, len(text))).max())
    shared = permuted_common_prefixes(text, order, reach, breaks)[order]
    ranks = np.flatnonzero(valid[order])
    found = np.zeros(len(text), bool)
    if len(ranks) > 1:
        # The least of the common prefixes between two valid suffixes is their own.
        least = np.minimum.reduceat(shared, ranks[:-1] + 1)
        last = ranks[-1] + 1
        if last < len(shared):
            least[-1] = shared[ranks[-2] + 1 : last].min()
        hit = least >= length
        found[order[ranks[:-1][hit]]] = True
        found[order[ranks[1:][hit]]] = True
    return found[starts]
