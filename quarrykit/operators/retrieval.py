"""Symbol lookup by tiers, rank fusion, rerank candidates and checks. Batches of queries: query_id everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.text import identifiers
from quarrykit.operators.ranking import keep_first, reranked, top_k, within

RRF_K, CANDIDATE_FACTOR, SYMBOL_LIMIT, RERANK_ROWS, RERANK_CHARS = 60, 4, 10, 20, 30_000


def query_identifiers(queries: DataFrame) -> DataFrame:
    """query_id, identifier, qualified, strong of each identifier in a query."""
    rows = queries.select("query_id", F.explode(identifiers(F.col("query"))).alias("i"))
    return rows.select("query_id", F.col("i.text").alias("identifier"), F.col("i.qualified").alias("qualified"), F.col("i.strong").alias("strong"))


def exact_identifier_queries(queries: DataFrame) -> DataFrame:
    """Queries that are one identifier and nothing else: they need no corroboration."""
    return queries.filter(F.exists(identifiers(F.col("query")), lambda i: i["text"] == F.trim("query")))


def symbol_search(chunks: DataFrame, wanted: DataFrame, limit: int = SYMBOL_LIMIT) -> DataFrame:
    """query_id, rank, tier, identifier, path, chunk_index, identity. Tier 0: a qualified name, 1: a simple one that looks like code, 2: a plain
    word. chunks: path, chunk_index, symbol, qualified. Of a symbol's fragments in a file the first counts, before the limit. A query takes an identifier at one tier, so
    none of its first `limit` places lies beyond the identifier's own first `limit`: only these meet the queries, whatever number of chunks bear a name."""
    names = chunks.select("path", "chunk_index", F.coalesce("qualified", "symbol").alias("identity"), F.explode(F.array(F.struct(F.col("qualified").alias("name"), F.lit(True).alias("q")), F.struct(F.col("symbol").alias("name"), F.lit(False).alias("q")))).alias("n"))
    names = names.select("path", "chunk_index", "identity", F.col("n.name").alias("identifier"), F.col("n.q").alias("qualified")).filter("identifier is not null")
    names = names.join(wanted.select("identifier", "qualified").distinct(), ["identifier", "qualified"], "left_semi")
    own = ["identifier", "qualified"]
    names = top_k(keep_first(names, [*own, "path", "identity"], ["chunk_index"]), own, ["path", "chunk_index", "identity"], limit).drop("rank")
    tier = F.when(F.col("qualified"), 0).when(F.col("strong"), 1).otherwise(2)
    found = wanted.join(names, ["identifier", "qualified"]).withColumn("tier", tier)
    best = keep_first(found, ["query_id", "path", "chunk_index"], ["tier", "identifier"])
    first = keep_first(best, ["query_id", "path", "identity"], ["tier", "chunk_index"])
    return top_k(first, ["query_id"], ["tier", "path", "chunk_index"], limit).select("query_id", "rank", "tier", "identifier", "path", "chunk_index", "identity")


def with_evidence(symbols: DataFrame, evidence: DataFrame) -> DataFrame:
    """symbols with the fragment that evidence (query_id, path, identity, chunk_index, rank) saw first, where it saw one."""
    first = keep_first(evidence, ["query_id", "path", "identity"], ["rank", "chunk_index"]).select("query_id", "path", "identity", F.col("chunk_index").alias("seen"))
    return symbols.join(first, ["query_id", "path", "identity"], "left").withColumn("chunk_index", F.coalesce("seen", "chunk_index")).drop("seen")


def corroborated(symbols: DataFrame, ranked: DataFrame, keys: list[str]) -> DataFrame:
    """symbols without the plain words' that ranked doesn't have; ranks are made contiguous."""
    weak = symbols.filter("tier = 2").join(ranked.select("query_id", *keys).distinct(), ["query_id", *keys], "left_semi")
    return reranked(symbols.filter("tier < 2").unionByName(weak), ["query_id"])


def fused(sources: dict[str, DataFrame], keys: list[str], k: int, rrf_k: int = RRF_K) -> DataFrame:
    """query_id, rank, keys, score, and each source's rank (null: not there). sources: query_id, keys, rank. Ties go to the least rank, then
    the keys. The sum has the sources' order, so it doesn't depend on the shuffle."""
    tagged = [df.select("query_id", *keys, F.lit(name).alias("source"), "rank") for name, df in sources.items()]
    ranks = [F.min(F.when(F.col("source") == name, F.col("rank"))).alias(f"{name}_rank") for name in sources]
    rows = reduce(DataFrame.unionByName, tagged).groupBy("query_id", *keys).agg(*ranks)
    score = reduce(lambda a, b: a + b, (F.coalesce(1 / (F.lit(rrf_k) + F.col(f"{name}_rank")), F.lit(0.0)) for name in sources))
    named = [F.col(f"{name}_rank") for name in sources]
    rows = rows.withColumn("score", score).withColumn("least", F.least(*named) if len(named) > 1 else named[0])
    return top_k(rows, ["query_id"], [F.desc("score"), "least", *keys], k).select("query_id", "rank", *keys, F.round("score", 9).alias("score"), *(f"{name}_rank" for name in sources))


def fusion_conflicts(sources: dict[str, DataFrame], keys: list[str], content: str) -> DataFrame:
    """Identities that a source has twice, or that sources hold with different content."""
    tagged = [df.select("query_id", *keys, F.lit(name).alias("source"), F.sha2(F.col(content), 256).alias("hash")) for name, df in sources.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    twice = rows.groupBy("query_id", *keys, "source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("query_id", *keys, F.lit("repeated").alias("problem"))
    differ = rows.groupBy("query_id", *keys).agg(F.countDistinct("hash").alias("n")).filter("n > 1").select("query_id", *keys, F.lit("content differs").alias("problem"))
    return twice.unionByName(differ).distinct()


def rerank_candidates(ranked: DataFrame, chars: str, rows: int = RERANK_ROWS, most_chars: int = RERANK_CHARS) -> DataFrame:
    """What a reranker is shown: the first rows up to both bounds; the first row always."""
    return within(ranked.filter(F.col("rank") <= rows), ["query_id"], ["rank"], F.col(chars), most_chars)


def rerank_violations(candidates: DataFrame, answer: DataFrame) -> DataFrame:
    """Ids that an answer lacks, has twice or doesn't know: query_id, chunk_id, problem."""
    keys = ["query_id", "chunk_id"]
    missing = candidates.join(answer, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    unknown = answer.join(candidates, keys, "left_anti").select(*keys, F.lit("unknown").alias("problem"))
    twice = answer.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*keys, F.lit("repeated").alias("problem"))
    return missing.unionByName(unknown).unionByName(twice)


def apply_rerank(candidates: DataFrame, answer: DataFrame, k: int) -> DataFrame:
    """Candidates in the answer's order (query_id, chunk_id, position): rank, original_rank."""
    joined = candidates.withColumnRenamed("rank", "original_rank").join(answer, ["query_id", "chunk_id"])
    return top_k(joined, ["query_id"], ["position", "chunk_id"], k)


def locations(ranked: DataFrame) -> DataFrame:
    """What navigation shows of a result: places and the sources that found them, no content."""
    names = [c.removesuffix("_rank") for c in ranked.columns if c.endswith("_rank")]
    labels = F.array_compact(F.array(*(F.when(F.col(f"{n}_rank").isNotNull(), F.lit(n)) for n in names)))
    return ranked.select("query_id", "rank", "path", "chunk_index", F.array_join(labels, ",").alias("found_by"))
