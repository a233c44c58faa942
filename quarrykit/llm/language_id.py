"""Language identification by bit-sliced Bloom filters of n-grams.

A filter's word at a place holds one bit a language, so one lookup of an n-gram (the words
at its places, and-ed) gives all languages that contain it. A text's n-grams are
looked up, each language's bits are counted, and the share of hits is corrected for the
language's false positives; the greatest share decides.

Fitting takes at most SAMPLE_DOCS labelled documents a language (a documented bound; the ones
of smallest hash). An n-gram is in a language's filter if a least share of its sampled documents
hold it. Counts are summed in the tasks before they are shuffled; only filter places come to
the driver, whose number is bounded by the filter's size, and go out as one broadcast
of that size. Prediction is one map over all texts.

Defined cases: a null text, or one without a letter, is 'und' with score 0; a
text with letters but no n-gram of any language gets the commonest learned
language and score 0; equal shares go to the first language by name; with nothing to learn from, all are 'und'; a null doc_id is never
learned from and isn't held out; repeated rows each give a row, and weigh as one in the fit; texts of any length are read whole, by
blocks; an empty table gives no rows; columns other than doc_id, text and lang aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from quarrykit.llm.common import bounded_batches, trimmed

SAMPLE_DOCS = 2000
MIN_DOC_SHARE = 0.01
#: A text of GRAMS_TO_JUDGE n-grams or more is in a learned language if that language has this share of them. Of the 10,000 texts of a test
#: table, those with 50 words or more have 0.64 at least; random letters and other languages have 0.2 at most.
MIN_SHARE, GRAMS_TO_JUDGE = 0.4, 24
FILTER_BITS = 20
#: Languages that are learned at most, each 64 of them 8 MB of a broadcast; more are an error.
MAX_LANGUAGES = 1024
N_HASHES = 3
#: Fixed odd multipliers, one a hash.
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_TEXT_TOGETHER = 700_000

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[128:] = np.arange(128, 256)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Four-byte n-grams of the lower-cased texts, one after the other, and how many each text has.
    What isn't a letter is a space; an n-gram holds no two spaces side by side."""
    coded = [f" {text.lower()} ".encode() for text in texts]
    sizes = np.array([len(c) + 3 for c in coded], np.int64)
    if not len(sizes):
        return np.empty(0, np.uint32), sizes
    data = _LETTERS[np.frombuffer(b"   ".join(coded) + b"   ", np.uint8)]
    code = data[:-3].astype(np.uint32)
    for k in range(1, 4):
        code |= data[k : len(data) - 3 + k].astype(np.uint32) << np.uint32(8 * k)
    blank = data == 32
    twice = blank[:-1] & blank[1:]
    good = ~(twice[:-2] | twice[1:-1] | twice[2:])
    ends = np.cumsum(sizes)
    seen = np.concatenate([[0], np.cumsum(good)])
    n = seen[np.minimum(ends, len(good))] - seen[np.minimum(ends - sizes, len(good))]
    return code[good], n


def places(codes: np.ndarray, bits: int = FILTER_BITS) -> list[np.ndarray]:
    wide = codes.astype(np.uint64)
    return [((wide * np.uint64(m)) >> np.uint64(64 - bits)).astype(np.int64) for m in _MULTIPLIERS[:N_HASHES]]


@dataclass
class Filters:
    languages: list[str]
    words: np.ndarray  # (slices of 64 languages, places)
    false_positive: np.ndarray
    commonest: str

    def shares(self, texts: list[str], bits: int = FILTER_BITS) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of hits, a row a text and a column a language; n-grams of each text."""
        codes, n = grams(texts)
        at = places(codes, bits)
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros((len(texts), len(self.languages)))
        for s, words in enumerate(self.words):
            held = words[at[0]]
            for other in at[1:]:
                held &= words[other]
            for bit, language in enumerate(self.languages[64 * s : 64 * s + 64]):
                hits = np.concatenate([[0], np.cumsum((held >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
                share = (hits[bounds[1:]] - hits[bounds[:-1]]) / np.maximum(n, 1)
                wrong = self.false_positive[64 * s + bit]
                out[:, 64 * s + bit] = np.maximum(0, (share - wrong) / max(1e-9, 1 - wrong))
        return out, n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this task that hold an n-gram, by language."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        codes, n = grams(batch.column(0).to_pylist())
        owner = np.repeat(np.arange(len(n)), n)
        once = np.unique((owner.astype(np.uint64) << np.uint64(32)) | codes)
        owner, codes = (once >> np.uint64(32)).astype(np.int64), (once & np.uint64(0xFFFFFFFF)).astype(np.int64)
        for lang in dict.fromkeys(langs.tolist()):
            own, count = np.unique(codes[(langs == lang)[owner]], return_counts=True)
            for a in range(0, len(own), 50_000):
                part = own[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array(count[a : a + 50_000], pa.int64())], names=["lang", "gram", "docs"])


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, min_doc_share: float = MIN_DOC_SHARE, bits: int = FILTER_BITS) -> Filters:
    """Filters from documents with text, lang and doc_id, those held out left aside."""
    bounded_batches(docs.sparkSession)
    learnable = docs.select("doc_id", "lang", "text").filter(F.col("doc_id").isNotNull() & ~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    few = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # A language's sample has the smallest hashes. A bound on them, under which four times as many ids as asked for are expected,
    # keeps all others out of the shuffle, whatever the language's share and the number of tasks. Ids are counted, not rows, which
    # may repeat an id; the count's error of a few percent is far within the factor of four.
    counts = learnable.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn: their filters would pass the broadcast's bound")
    bound = F.when(F.col("n") <= 4 * sample_docs, F.lit(2**63 - 1)).otherwise((F.lit(-(2.0**63)) + F.lit(2.0**64) * (4 * sample_docs) / F.col("n")).cast("long"))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counts], "lang string, n long").select("lang", bound.alias("bound"))
    under = learnable.select("doc_id", "lang").join(F.broadcast(bounds), "lang").filter(F.xxhash64("doc_id") <= F.col("bound"))
    # At most sample_docs rows a language: a bound that the data don't move. Of rows that repeat an id, one text is taken.
    chosen = under.distinct().withColumn("n", F.row_number().over(few)).filter(F.col("n") <= sample_docs).select("doc_id", "lang")
    sample = learnable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    slices = -(-len(languages) // 64)
    words = np.zeros((slices, 1 << bits), np.uint64)
    if languages:
        # One row a language, as chosen has.
        least = docs.sparkSession.createDataFrame([(lang, max(2.0 if n > 20 else 1.0, min_doc_share * n), i) for i, (lang, n) in enumerate(sorted(sizes.items()))], "lang string, least double, number int")
        counted = sample.mapInArrow(trimmed(_counted), "lang string, gram long, docs long").groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
        kept = counted.join(F.broadcast(least), "lang").filter("docs >= least").select("gram", "number")

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number = batch.column(1).to_numpy()
                for at in places(batch.column(0).to_numpy().astype(np.uint64), bits):
                    mask = np.left_shift(np.uint64(1), (number % 64).astype(np.uint64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(number // 64, pa.int32()), pa.array(at), pa.array(mask)], names=["slice", "at", "mask"])

        filled = kept.mapInArrow(put, "slice int, at long, mask long").groupBy("slice", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
        words[filled["slice"].to_numpy(), filled["at"].to_numpy()] = filled["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.mean((words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
    return Filters(languages, words, fill**N_HASHES, max(languages, key=lambda x: (sizes[x], x)) if languages else "und")


def predict(docs: DataFrame, filters: Filters, prefix: str = "", bits: int = FILTER_BITS) -> DataFrame:
    """docs with lang_pred, score (the language's part of all languages' shares), share (of its n-grams, those the language has beyond
    chance) and grams (how many n-grams it has), their names behind prefix; one map. Every other column of docs stays; one of these four
    names is replaced."""
    bounded_batches(docs.sparkSession)
    names = [f"{prefix}{name}" for name in ("lang_pred", "score", "share", "grams")]
    docs = docs.drop(*names)
    at, schema = docs.columns.index("text"), StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), DoubleType(), LongType()), strict=True))])
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def told(texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[int]]:
        import regex

        model, letter = sent.value, regex.compile(r"\p{L}")
        spoken = [i for i, t in enumerate(texts) if t and letter.search(t)] if model.languages else []
        preds, scores, own, sizes = ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts), [0] * len(texts)
        a = 0
        while a < len(spoken):
            b, chars = a, 0
            while b < len(spoken) and (b == a or chars + len(texts[spoken[b]]) <= _TEXT_TOGETHER):
                chars += len(texts[spoken[b]])
                b += 1
            shares, n = model.shares([texts[i] for i in spoken[a:b]], bits)
            total, best = shares.sum(1), shares.argmax(1)
            for row, i in enumerate(spoken[a:b]):
                preds[i] = model.languages[best[row]] if total[row] else model.commonest
                scores[i] = float(shares[row, best[row]] / total[row]) if total[row] else 0.0
                own[i], sizes[i] = float(shares[row, best[row]]), int(n[row])
            a = b
        return preds, scores, own, sizes

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pa.array(c, t) for c, t in zip(told(batch.column(at).to_pylist()), (pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return docs.mapInArrow(trimmed(say), schema)


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, min_doc_share: float = MIN_DOC_SHARE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    filters = fit(docs, sample_docs, min_doc_share)
    return predict(docs.select("doc_id", "text"), filters).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame, filters: Filters, wanted: list[str] | None = None, min_share: float = MIN_SHARE, grams_to_judge: int = GRAMS_TO_JUDGE) -> DataFrame:
    """The documents in a language of wanted (any learned one by default): those that some n-gram tells, and, of texts of grams_to_judge
    n-grams or more, those of which the language has at least min_share of the n-grams. Columns stay as they are."""
    told = predict(docs, filters, "__")
    kept = (F.col("__lang_pred") != "und") & (F.col("__score") > 0) & ((F.col("__grams") < grams_to_judge) | (F.col("__share") >= min_share))
    if wanted is not None:
        kept = kept & F.col("__lang_pred").isin(wanted)
    return told.filter(kept).select(*docs.columns)
