"""Quality rules of documents and of their hosts, in DataFrame functions only.

A document's counts come from its words and lines. A document fails for itself when it has too few
words or repeats itself. Beyond that, hosts are judged: failures are counted by host, the
rates' mean and variance over hosts give a beta prior by moments (worth a document at least), and each host's
posterior rate is its own rate shrunk towards the prior's mean. All documents of a host
whose posterior rate is above the limit go.

Counts by host are summed before the shuffle; their join back to the documents carries one
row a host. A hot host is one row there: the verdict's side is broadcast if small, by the
session's threshold, else Spark splits the skewed side.

Defined cases: a null text has no words (and fails); a null source is a host of its
own; repeated rows each count and each give a row; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.common import stored

SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: The posterior share of failing documents above which a host goes.
MAX_HOST_RATE = 0.6

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: tuple[str, ...] | str) -> Column:
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeat_words(words: Column, window: int = REPEAT_WINDOW) -> Column:
    def of_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - (window - 1)), lambda i: F.xxhash64(F.slice(hashes, i, window)))
        return _let(windows, of_windows)

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_let(_repeated_at(windows), covered))

    def covered(starts: Column) -> Column:
        # A window adds its words up to the next repeated window's start.
        gaps = F.zip_with(F.slice(starts, 2, F.size(starts)), F.slice(starts, 1, F.size(starts) - 1), lambda later, earlier: F.least(later - earlier, F.lit(window)))
        return F.aggregate(gaps, F.lit(window).cast("long"), lambda total, gap: total + gap)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(_let(hashes, of_hashes))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_at(windows: Column) -> Column:
    """Sorted positions of the values that occur more than once: neighbours in sorted order are compared."""
    numbered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def pick(ordered: Column) -> Column:
        n = F.size(ordered)
        kept = F.filter(ordered, lambda e, k: ((k > 0) & (F.get(ordered, k - 1)["w"] == e["w"])) | ((k < n - 1) & (F.get(ordered, k + 1)["w"] == e["w"])))
        return F.array_sort(F.transform(kept, lambda e: e["i"]))

    return _let(numbered, pick)


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and COUNTS of each document; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), repeat_words(words).alias("n_repeat_words"))

    rows = rows.withColumn("of_words", _let(_words(F.col("text")), of_words))
    dup_lines = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return rows.select(
        "doc_id", "source", F.col("of_words.n_words").alias("n_words"), F.char_length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"), dup_lines.alias("n_dup_lines"),
        F.col("of_words.n_repeat_words").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def host_verdicts(counted: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """source, host_rate (posterior), host_kept. counted: rows with source and base_failed."""
    hosts = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("base_failed").alias("failed"))
    rate = F.col("failed") / F.col("n")
    # One row: the beta prior whose mean and variance are those of the hosts' rates.
    prior = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("variance"))
    spread = F.col("mean") * (1 - F.col("mean"))
    strength = F.when(F.col("variance") > 0, F.greatest(F.lit(1.0), F.least(spread / F.col("variance") - 1, F.lit(1e6)))).otherwise(F.lit(1e6))
    prior = prior.select((F.col("mean") * strength).alias("a"), ((1 - F.col("mean")) * strength).alias("b"))
    a, b = (prior.select(c).scalar() for c in ("a", "b"))
    posterior = (F.col("failed") + a) / (F.col("n") + a + b)
    return hosts.select("source", posterior.alias("host_rate")).withColumn("host_kept", F.col("host_rate") <= max_rate)


def quality_verdicts(docs: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, host_rate of each document."""
    # Read three times: for the hosts, their prior, and the documents.
    counted = stored(rule_counts(docs).withColumn("base_failed", base_failed()), "rule-counts")
    hosts = host_verdicts(counted, max_rate).withColumnRenamed("source", "host")
    joined = counted.join(hosts, counted["source"].eqNullSafe(hosts["host"]), "left")
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return joined.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "host_rate")


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM d) GROUP BY r),
m AS (SELECT w.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN c ON w.r = c.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM f GROUP BY source),
p AS (SELECT avg(failed / n) AS mean, coalesce(var_samp(failed / n), 0.0) AS v FROM h),
s AS (SELECT mean, CASE WHEN v > 0 THEN greatest(1.0, least(mean * (1 - mean) / v - 1, 1e6)) ELSE 1e6 END AS strength FROM p),
v AS (SELECT source, (failed + mean * strength) / (n + mean * strength + (1 - mean) * strength) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_rate <= 0.6 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
