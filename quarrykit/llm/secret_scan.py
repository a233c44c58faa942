"""Secret scan: fixed patterns, and strings that a token vocabulary compresses badly.

Text made of words takes few tokens: three or more characters each. A random
string takes one token for one or two characters. Runs of key characters whose ratio of
characters to tokens is below a threshold are therefore reported, after known
digests (hexadecimal of a usual length, UUIDs) and identifiers (numbers, words of
fewer than 20 letters, alone, in camel case or joined by dashes, underscores or slashes) are set aside.

Defined cases: a null text counts as empty and gives zero counts and empty span
lists; repeated rows each give a row; a null doc_id stays null; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quarrykit.llm.common import bounded_batches, trimmed
from quarrykit.llm.tokens import TIKTOKEN_FILE, tiktoken_encoding

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run is maximal either way, so the least length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
# Letters of one case in a row are a word only up to this length; longer ones take the ratio test.
_WORD = r"(?:[A-Z]?[a-z]{1,19}|[A-Z]{1,19}|[0-9]+)"
_IDENTIFIER = re.compile(rf"[0-9]+|{_WORD}(?:[-_/=+]+{_WORD})*[-_/=+]*|[A-Z]?[a-z]{{2,19}}(?:[A-Z][a-z]{{2,19}})*[0-9]*")

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, taken: list[tuple[int, int, int]], n_tokens: Callable[[str], int], max_ratio: float) -> list[tuple[int, int, int]]:
    """(start, 3, end) of runs with fewer than max_ratio characters a token that no taken span (in order of their starts) touches."""
    found: list[tuple[int, int, int]] = []
    ahead, reached = 0, 0
    for m in _RUN.finditer(text):
        run = m.group()
        while ahead < len(taken) and taken[ahead][0] < m.end():
            reached = max(reached, taken[ahead][2])
            ahead += 1
        if m.start() < reached:
            continue
        if _DIGEST.fullmatch(run) or _UUID.fullmatch(run) or _IDENTIFIER.fullmatch(run):
            continue
        if len(run) < max_ratio * n_tokens(run):
            found.append((m.start(), 3, m.end()))
    return found


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_spans(docs: DataFrame, vocabulary: str = TIKTOKEN_FILE, max_ratio: float = 2.0) -> DataFrame:
    """One row a document, by a map over Arrow batches: no shuffle, one pass."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken_encoding(vocabulary)
        n_tokens = lru_cache(4096)(lambda run: len(encoding.encode_ordinary(run)))
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                more = random_spans(text, base, n_tokens, max_ratio)
                kinds = [kind for _, kind, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_told(base).encode()).hexdigest(), _told(sorted(base + more)), len(more)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(trimmed(scan), SCHEMA)


def mask_secrets(docs: DataFrame, mask: str = "[SECRET]", vocabulary: str = TIKTOKEN_FILE, max_ratio: float = 2.0) -> DataFrame:
    """docs with every span's text replaced by mask; other columns, their order and null texts stay."""
    at, schema = docs.columns.index("text"), docs.schema

    def scrub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken_encoding(vocabulary)
        n_tokens = lru_cache(4096)(lambda run: len(encoding.encode_ordinary(run)))
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    spans, done, out = sorted(base + random_spans(text, base, n_tokens, max_ratio)), 0, []
                    for start, _, end in spans:
                        if end <= done:
                            continue
                        if start >= done:
                            out += [text[done:start], mask]
                        done = end
                    text = "".join(out) + text[done:] if spans else text
                texts.append(text)
            columns = batch.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(trimmed(scrub), schema)
