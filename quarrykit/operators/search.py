"""Searches composed of the single ones: a corpus is indexed once, a batch of queries is ranked by each source, and ranks are fused."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.operators import context, lexical, retrieval, vector
from quarrykit.operators.ranking import top_k
from quarrykit.sources.shared import stored

STRATEGIES = ("semantic", "lexical", "hybrid", "hybrid_symbol", "lexical_symbol")
CONTEXT_STRATEGIES = ("seeds_only", "expanded")


class SearchError(ValueError):
    """A search that can't be asked for."""


@dataclass(frozen=True)
class Corpus:
    """What searches read: chunks (chunk_id, path, chunk_index, symbol, qualified, ...), vectors (id: the chunk's, embedding), and a
    stored BM25 index."""

    chunks: DataFrame
    vectors: DataFrame
    index: lexical.Index


@dataclass(frozen=True)
class Depths:
    """How many results of each source are fused; by default a multiple of what is asked for."""

    semantic: int | None = None
    lexical: int | None = None
    symbols: int = retrieval.SYMBOL_LIMIT

    def of(self, source: str, k: int) -> int:
        depth = getattr(self, source)
        depth = retrieval.CANDIDATE_FACTOR * k if depth is None else depth
        if depth < 1:
            raise SearchError(f"the depth of {source} must be positive")
        return depth


def _asked(queries: DataFrame, k: int) -> None:
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise SearchError("k must be a positive integer")
    if queries.filter(F.col("query").isNull() | ~F.col("query").rlike(r"(?U)\S")).limit(1).count():
        raise SearchError("a query must hold more than white space")


def semantic(corpus: Corpus, query_vectors: DataFrame, k: int, mode: str = "exact") -> DataFrame:
    """query_id, rank, chunk_id, score. query_vectors: query_id, embedding."""
    asked = query_vectors.select(F.col("query_id").alias("id"), "embedding")
    return vector.search(corpus.vectors, asked, k, mode).withColumnRenamed("vec_id", "chunk_id")


def lexical_search(corpus: Corpus, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, score."""
    return corpus.index.top_k(lexical.query_terms(queries, corpus.index.config), k)


def _two(corpus: Corpus, queries: DataFrame, query_vectors: DataFrame, k: int, depths: Depths, mode: str) -> dict[str, DataFrame]:
    """Both sources, stored: what fuses them reads them more than once."""
    near = stored(semantic(corpus, query_vectors, depths.of("semantic", k), mode), "semantic-ranks")
    return {"semantic": near, "lexical": _lexical_ranks(corpus, queries, depths.of("lexical", k))}


def _lexical_ranks(corpus: Corpus, queries: DataFrame, depth: int) -> DataFrame:
    return stored(lexical_search(corpus, queries, depth), "lexical-ranks")


def hybrid_search(corpus: Corpus, queries: DataFrame, query_vectors: DataFrame, k: int, depths: Depths = Depths(), mode: str = "exact") -> DataFrame:
    """query_id, rank, chunk_id, score, semantic_rank, lexical_rank: vectors and BM25, fused by reciprocal ranks."""
    _asked(queries, k)
    return retrieval.fused(_two(corpus, queries, query_vectors, k, depths, mode), ["chunk_id"], k)


def hybrid_symbol_search(corpus: Corpus, queries: DataFrame, query_vectors: DataFrame, k: int, depths: Depths = Depths(), mode: str = "exact") -> DataFrame:
    """hybrid_search with a third source, the symbols that a query names (symbol_rank): see with_symbols."""
    _asked(queries, k)
    return _hybrid_symbol(corpus, queries, _two(corpus, queries, query_vectors, k, depths, mode), k, depths)


def _hybrid_symbol(corpus: Corpus, queries: DataFrame, two: dict[str, DataFrame], k: int, depths: Depths) -> DataFrame:
    return with_symbols(corpus, queries, two, k, depths.of("semantic", k) + depths.of("lexical", k), depths)


def lexical_symbol_search(corpus: Corpus, queries: DataFrame, k: int, depths: Depths = Depths(), corroborate_weak: bool = True) -> DataFrame:
    """query_id, rank, chunk_id, score, lexical_rank, symbol_rank: BM25 and symbols, without vectors."""
    _asked(queries, k)
    depth = depths.of("lexical", k)
    return with_symbols(corpus, queries, {"lexical": _lexical_ranks(corpus, queries, depth)}, k, depth, depths, corroborate_weak)


def with_symbols(corpus: Corpus, queries: DataFrame, sources: dict[str, DataFrame], k: int, evidence_depth: int, depths: Depths = Depths(), corroborate_weak: bool = True) -> DataFrame:
    """The sources fused with the symbols that a query names. A symbol's fragment is the one that the other sources saw, and a plain word counts
    only where they saw its chunk as well (unless that isn't asked for); a query that is one identifier and nothing else needs neither."""
    identity = F.coalesce("qualified", "symbol").alias("identity")
    places = corpus.chunks.select("chunk_id", "path", "chunk_index", identity)
    found = retrieval.symbol_search(corpus.chunks, retrieval.query_identifiers(queries), depths.of("symbols", k))
    evidence = retrieval.fused(sources, ["chunk_id"], evidence_depth)
    alone = retrieval.exact_identifier_queries(queries).select("query_id")
    named = found.join(alone, "query_id", "left_anti")
    seen = evidence.select("query_id", "rank", "chunk_id").join(places, "chunk_id")
    backed = retrieval.with_evidence(named, seen)
    if corroborate_weak:
        backed = retrieval.corroborated(backed, seen, ["path", "chunk_index"])
    symbols = found.join(alone, "query_id", "left_semi").select("query_id", "rank", "path", "chunk_index").unionByName(backed.select("query_id", "rank", "path", "chunk_index"))
    symbols = symbols.join(places.drop("identity"), ["path", "chunk_index"]).select("query_id", "rank", "chunk_id")
    return retrieval.fused({**sources, "symbol": symbols}, ["chunk_id"], k)


def hybrid_search_with_reranking(
    corpus: Corpus, queries: DataFrame, query_vectors: DataFrame, rerank: Callable[[DataFrame], DataFrame], retrieval_k: int = 20, k: int = 5, depths: Depths = Depths(), mode: str = "exact"
) -> DataFrame:
    """query_id, rank, chunk_id, original_rank: hybrid candidates (with content) in the order that rerank gives them (query_id, chunk_id,
    position). A reranker must name each candidate that it was shown once, and no other."""
    if isinstance(k, bool) or not isinstance(k, int) or k < 1:
        raise SearchError("k must be a positive integer")
    ranked = hybrid_search(corpus, queries, query_vectors, retrieval_k, depths, mode).join(corpus.chunks.select("chunk_id", "content"), "chunk_id")
    # The reranker, the checks of its answer and the answer itself all read what was shown: the searches are made once.
    shown = stored(retrieval.rerank_candidates(ranked.withColumn("chars", F.char_length("content")), "chars"), "shown-candidates")
    answer = rerank(shown)
    wrong = retrieval.rerank_violations(shown, answer).first()
    if wrong:
        raise SearchError(f"the reranker's answer to query {wrong['query_id']} isn't a permutation: {wrong['chunk_id']} is {wrong['problem']}")
    return retrieval.apply_rerank(shown, answer, k).select("query_id", "rank", "chunk_id", "original_rank")


def search(corpus: Corpus, queries: DataFrame, query_vectors: DataFrame | None, k: int, strategy: str = "hybrid_symbol", depths: Depths = Depths(), mode: str = "exact") -> DataFrame:
    """query_id, rank, chunk_id, score and the ranks of the sources that the strategy has."""
    if strategy not in STRATEGIES:
        raise SearchError(f"strategy must be one of {', '.join(STRATEGIES)}")
    if strategy == "lexical":
        _asked(queries, k)
        return lexical_search(corpus, queries, k)
    if strategy == "lexical_symbol":
        return lexical_symbol_search(corpus, queries, k, depths)
    if query_vectors is None:
        raise SearchError(f"{strategy} needs the queries' vectors")
    if strategy == "semantic":
        _asked(queries, k)
        return semantic(corpus, query_vectors, k, mode)
    of = {"hybrid": hybrid_search, "hybrid_symbol": hybrid_symbol_search}[strategy]
    return of(corpus, queries, query_vectors, k, depths, mode)


def every_strategy(corpus: Corpus, queries: DataFrame, query_vectors: DataFrame, k: int, depths: Depths = Depths()) -> DataFrame:
    """strategy, query_id, rank, chunk_id: what search() gives by each strategy, with exact vector search. The sources are searched once, as deep as any strategy reads."""
    _asked(queries, k)
    near, text = depths.of("semantic", k), depths.of("lexical", k)
    to = lambda rows, depth: rows.filter(F.col("rank") <= depth)
    semantic_ranks = stored(semantic(corpus, query_vectors, max(k, near)), "semantic-ranks")
    lexical_ranks = _lexical_ranks(corpus, queries, max(k, text))
    two = {"semantic": to(semantic_ranks, near), "lexical": to(lexical_ranks, text)}
    found = {
        "semantic": to(semantic_ranks, k), "lexical": to(lexical_ranks, k), "hybrid": retrieval.fused(two, ["chunk_id"], k), "hybrid_symbol": _hybrid_symbol(corpus, queries, two, k, depths),
        "lexical_symbol": with_symbols(corpus, queries, {"lexical": two["lexical"]}, k, text, depths),
    }
    return reduce(DataFrame.unionByName, (rows.select(F.lit(name).alias("strategy"), "query_id", "rank", "chunk_id") for name, rows in found.items()))


def rag_context(seeds: DataFrame, chunks: DataFrame, strategy: str = "expanded", budget_tokens: int = context.CONTEXT_TOKENS, max_chars: int = context.CONTEXT_CHARS, radius: int = context.RADIUS) -> DataFrame:
    """query_id, source_no, path, chunk_index, start_line, end_line: what a model is shown of a question's ranked seeds (query_id, rank,
    path, chunk_index, start_line, end_line, strategy, symbol, content). seeds_only: the seeds up to a number of characters; expanded: seeds and
    their neighbours packed into a budget of tokens."""
    if strategy not in CONTEXT_STRATEGIES:
        raise SearchError(f"strategy must be one of {', '.join(CONTEXT_STRATEGIES)}")
    columns = ["query_id", "source_no", "path", "chunk_index", "start_line", "end_line"]
    if strategy == "seeds_only":
        sized = seeds.withColumn("chars", context.block_chars(seeds))
        return top_k(context.pack_until_full(sized, "chars", max_chars), ["query_id"], ["rank"], 2**31 - 1, "source_no").select(*columns)
    near = context.neighbours(seeds, chunks, radius)
    return context.pack_greedy(context.candidates(seeds, near), budget_tokens).select(*columns)
