"""Phrase collocation mining: level-wise counts of phrases of two to five words, scored by their lowest cut.

Words of a language are counted first. Level k then counts a phrase of k words only where its first k - 1 and its last k - 1
words are both frequent on their own, which loses no frequent phrase: a phrase occurs at most as often as its parts. So five
passes over the texts give tables of all frequent phrases, and scores come from these tables alone.

How it works at scale:

* A pass is one Arrow map. It splits a block of texts by array operations, numbers the block's distinct words, and sends on
  its distinct phrases with counts; Spark adds them up, before and after the shuffle. A hot word or language is a row a block.
* What a pass is told of the level below is a table of bits, TABLE_BITS of them whatever the data's size: a frequent phrase sets
  the bit of its hash. Two phrases of one bit only make a pass count more than it must; what is frequent is decided by
  exact counts of whole phrases. So nothing that grows is broadcast or collected.
* Level tables are written to the shared folder: a lost executor repeats its part of a pass.

Defined cases: a null or empty text has no words; a null language is `und`, as is that name itself; repeated rows count each time,
whatever their ids; texts and pieces of any length are taken whole (a task counts a long text in runs of BLOCK_BYTES that end where a piece does);
equal scores rank by count and phrase, equal cuts by the earlier one; an empty table gives no rows; other columns, whatever
their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrykit.llm.common import bounded_batches, stored, trimmed

MIN_COUNT, LONGEST, KEPT, SCALE = 100, 5, 2000, 1000
#: Bits of the table that tells a pass what is frequent one level below: 16 MB.
TABLE_BITS = 1 << 27
#: Bytes of text that a task counts at a time.
BLOCK_BYTES = 12 << 20
#: Rows that a task sends on at a time.
ROWS_SENT = 50_000

_BREAK, _SPACE = 0xFF, 0x20  # 0xFF is no byte of UTF-8
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"


def _bytes_map() -> bytes:
    made = bytearray(range(256))
    for upper in range(ord("A"), ord("Z") + 1):
        made[upper] = upper + 32
    for byte in _BREAKS:
        made[byte] = _BREAK
    made[0x09] = _SPACE
    return bytes(made)


def _segments(texts, block_bytes: int) -> Iterator:
    """The bytes of an Arrow array of texts, mapped, in runs of block_bytes that end at a break; a run without a break is taken whole."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts), pa.scalar("\n", texts.type))
    data = np.frombuffer(joined[0].as_buffer().to_pybytes().translate(_bytes_map()), np.uint8)
    begin = 0
    while begin < len(data):
        end = min(begin + block_bytes, len(data))
        if end < len(data):
            inside = np.flatnonzero(data[begin:end] == _BREAK)
            if len(inside):
                end = begin + int(inside[-1]) + 1
            else:
                behind = data[end:] == _BREAK
                end = end + int(behind.argmax()) + 1 if behind.any() else len(data)
        yield data[begin:end]
        begin = end


def _split(data):
    """(words as a binary array, number of each word's piece) of mapped bytes."""
    import numpy as np
    import pyarrow as pa

    breaks = data == _BREAK
    gaps = breaks | (data == _SPACE)
    edges = np.diff(np.concatenate(([True], gaps, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~gaps]))])
    return words, np.cumsum(breaks, dtype=np.int32)[starts]


def _mixed(left, right):
    """One hash of two, for arrays of 64 bits; the order counts."""
    import numpy as np

    made = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29)))
    made ^= made >> np.uint64(32)
    made *= np.uint64(0xD6E8FEB86659FD93)
    return made ^ (made >> np.uint64(32))


def _word_hashes(lang: str, words: list[bytes]):
    import numpy as np
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _blocks(batches, block_bytes: int) -> Iterator[tuple[str, object]]:
    """(language, its texts) of some block_bytes at a time."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def by_language(held):
        whole = pa.Table.from_batches(held)
        for lang in pc.unique(whole["lang"]).to_pylist():
            texts = whole.filter(pc.equal(whole["lang"], lang))["text"].combine_chunks()
            yield lang, texts.cast(pa.large_string())

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= block_bytes:
            yield from by_language(held)
            held, size = [], 0
    if held:
        yield from by_language(held)


def _count(width: int, flags, block_bytes: int):
    """A map from texts to phrases of `width` words and their numbers. flags: a broadcast table of bits of the level below. With one
    word, an empty phrase bears the number of all words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        table = None if flags is None else np.frombuffer(flags.value, np.uint8)

        def frequent(hashes):
            at = hashes & np.uint64(8 * len(table) - 1)
            return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

        for lang, data in ((lang, data) for lang, texts in _blocks(batches, block_bytes) for data in _segments(texts, block_bytes)):
            words, piece = _split(data)
            coded = words.dictionary_encode()
            ids, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            if width == 1:
                yield from _rows(lang, distinct, np.bincount(ids, minlength=len(distinct)))
                yield from _rows(lang, pa.array([b""], pa.large_binary()), np.array([len(ids)]))
                continue
            places = np.flatnonzero(piece[width - 1 :] == piece[: len(piece) - width + 1]) if len(ids) >= width else np.zeros(0, np.int64)
            hashes = _word_hashes(lang, distinct.to_pylist())[ids]
            head = hashes[places]
            for k in range(1, width - 1):
                head = _mixed(head, hashes[places + k])
            places = places[frequent(head)]
            tail = hashes[places + 1]
            for k in range(2, width):
                tail = _mixed(tail, hashes[places + k])
            places = places[frequent(tail)]
            # Each distinct phrase gets a number, word by word, so no product passes 64 bits.
            key = ids[places]
            for k in range(1, width):
                _, first, key, counts = np.unique(key * len(distinct) + ids[places + k], return_index=True, return_inverse=True, return_counts=True)
            if not len(places):
                continue
            at = places[first]
            columns = [distinct.take(pa.array(ids[at + k])) for k in range(width)]
            yield from _rows(lang, pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary())), counts)

    return run


def _rows(lang: str, phrases, counts) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    # One string takes less to shuffle than two. Phrases have no tab in them, so the last one ends the language.
    keys = pc.binary_join_element_wise(pa.scalar(lang.encode(), pa.large_binary()), phrases, pa.scalar(b"\t", pa.large_binary()))
    whole = pa.table({"key": keys.cast(pa.binary()).cast(pa.string()), "a": pa.array(counts, pa.int64())})
    yield from whole.to_batches(max_chunksize=ROWS_SENT)


def _set_bits(bits: int):
    """A map from a level's phrases to 64-bit words of a table of so many bits."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            langs, phrases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            hashes = np.zeros(len(phrases), np.uint64)
            for k, (lang, phrase) in enumerate(zip(langs, phrases, strict=True)):
                own = _word_hashes(lang, phrase.encode().split(b" "))
                head = own[:1]
                for word in range(1, len(own)):
                    head = _mixed(head, own[word : word + 1])
                hashes[k] = head[0]
            at = hashes & np.uint64(bits - 1)
            flags = np.left_shift(np.uint64(1), at & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(flags)], ["slot", "bits"])

    return run


def _flags(level: DataFrame) -> bytes:
    """The table of bits of a level's frequent phrases. Its words with a bit are collected: TABLE_BITS / 64 of them at most."""
    import numpy as np

    words = level.select("lang", "phrase").mapInArrow(_set_bits(TABLE_BITS), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(TABLE_BITS // 64, np.int64)
    table[words["slot"].to_numpy()] = words["bits"].to_numpy()
    return table.tobytes()


def phrase_counts(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, n: all words; lang, words: their number, phrase, a: its places, of every phrase of up to `longest` words that
    has min_count places or more)."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    levels, totals = [], None
    for width in range(1, longest + 1):
        flags = None if width == 1 else spark.sparkContext.broadcast(_flags(levels[-1]))
        counted = texts.mapInArrow(trimmed(_count(width, flags, BLOCK_BYTES)), "key string, a long").groupBy("key").agg(F.sum("a").alias("a"))
        phrase = F.substring_index("key", "\t", -1)
        lang = F.substr("key", F.lit(1), F.char_length("key") - F.char_length(phrase) - 1)
        level = counted.filter((F.col("a") >= min_count) | F.endswith(F.col("key"), F.lit("\t")))
        level = stored(level.select(lang.alias("lang"), F.lit(width).alias("words"), phrase.alias("phrase"), "a"), f"phrases-{width}")
        if flags is not None:
            flags.unpersist()
        if width == 1:
            totals = level.filter("phrase = ''").select("lang", F.col("a").alias("n"))
            level = level.filter("phrase <> ''")
        levels.append(level)
    whole = levels[0]
    for level in levels[1:]:
        whole = whole.unionByName(level)
    return totals, whole


def _part(words: Column, begin: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, begin, length), " ")


def _exact(column: str) -> Column:
    """A count as a decimal, whose products are exact."""
    return F.col(column).cast("decimal(18,0)")


def scored_phrases(totals: DataFrame, counted: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, a, l, r, n, score of candidates that no longer one of as many places holds. A phrase in a longer one of as many places is
    in one that is a word longer as well, since what lies between them is as frequent; so one step up decides."""
    longer = counted.filter(F.col("words") > 2).select("lang", F.split("phrase", " ").alias("w"), F.col("words").alias("size"), F.col("a").alias("above"))
    inner = longer.select("lang", F.explode(F.array(_part(F.col("w"), 1, F.col("size") - 1), _part(F.col("w"), 2, F.col("size") - 1))).alias("phrase"), "above")
    held = inner.groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    kept = counted.filter(F.col("words") > 1).join(held, ["lang", "phrase"], "left").filter(F.col("above").isNull() | (100 * F.col("above") < 100 * F.col("a")))
    words = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"), F.col("words"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(words, 1, F.col("cut")).alias("left"), _part(words, F.col("cut") + 1, F.col("words") - F.col("cut")).alias("right"))
    side = lambda part, count: counted.select("lang", F.col("phrase").alias(part), F.col("a").alias(count))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    # a is at most l and r: the first division leaves a number of 19 digits at most.
    upper = (_exact("a") * _exact("n")).cast("decimal(34,0)") * F.lit(SCALE).cast("decimal(4,0)")
    score = F.expr("upper div lower")
    cuts = cuts.withColumns({"upper": upper, "lower": (_exact("l") * _exact("r")).cast("decimal(36,0)")}).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, kept: int = KEPT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `kept` phrases."""
    totals, counted = phrase_counts(docs, longest, min_count)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored_phrases(totals, counted, longest).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= kept)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
s AS (SELECT lang, k, string_split(phrase, ' ') AS w, phrase, a FROM f WHERE k > 1),
h AS (SELECT lang, phrase, max(a) AS above FROM (SELECT lang, array_to_string(w[1:k - 1], ' ') AS phrase, a FROM s UNION ALL SELECT lang, array_to_string(w[2:k], ' '), a FROM s) GROUP BY ALL),
c AS (SELECT s.lang, k, w, s.phrase, a, unnest(range(1, k)) AS cut FROM s LEFT JOIN h ON s.lang = h.lang AND s.phrase = h.phrase WHERE above IS NULL OR 100 * above < 100 * a),
b AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, cut, CAST((1000 * CAST(c.a AS HUGEINT) * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:c.k], ' ') JOIN n ON n.lang = c.lang),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM b) WHERE o = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m) WHERE rank <= 2000
"""
