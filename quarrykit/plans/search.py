"""Queries by composed search: vectors, BM25 and symbols over one corpus, fused, reranked and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.operators import lexical, search, vector
from quarrykit.plans.documents import COMPOUND, FOLD, PATH, _bm25_sql, _seeds, bm25_index, files
from quarrykit.plans.registry import query, table
from quarrykit.sources.shared import exists, fingerprint, written

_LANG = "['en', 'de', 'fr', 'es'][item_id % 4 + 1]"
_VECTORS: dict[tuple[str, str], tuple[str, str]] = {}


def corpus_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a chunk; a third of them have a made name for a symbol, a third a word of theirs."""
    plain = F.nullif(F.regexp_extract("content", "[A-Za-z]{4,}", 0), F.lit(""))
    symbol = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("load_"), "lang")).when(F.col("doc_id") % 3 == 1, plain)
    rows = files(spark, sf_dir).withColumn("symbol", symbol).withColumn("qualified", F.concat("source", F.lit("."), "symbol"))
    return rows.select(F.col("doc_id").alias("chunk_id"), "path", F.lit(0).alias("chunk_index"), "symbol", "qualified", "content")


def corpus(spark: SparkSession, sf_dir: str) -> search.Corpus:
    """The corpus of a folder of tables. Its index and its vectors are shared by all queries as long as the files are the same."""
    chunks, key = corpus_chunks(spark, sf_dir), (spark.sparkContext.applicationId, sf_dir)
    index, state = bm25_index(spark, sf_dir, lexical.BM25(), chunks.withColumn("symbol", F.col("qualified")), "corpus", bounds=False), fingerprint(chunks)
    was, at = _VECTORS.get(key, ("", ""))
    if was != state or not exists(spark, at):
        at = written(vector.hashed_vectors(chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))), "corpus-vectors")
        _VECTORS[key] = (state, at)
    return search.Corpus(chunks, spark.read.parquet(at), index.read())


def asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries, their vectors): the benchmark's texts, each with two names of symbols."""
    lang = F.get(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("item_id") % 4).cast("int"))
    text = F.concat("text", F.lit(" load_"), lang, F.lit(" src"), (F.col("item_id") % 20).cast("string"), F.lit(".load_"), lang)
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), text.alias("query"))
    vectors = vector.hashed_vectors(queries.select(F.col("query_id").alias("id"), F.col("query").alias("text")))
    return queries, vectors.select(F.col("id").alias("query_id"), "embedding")


def _slots(rows: str, key: str) -> str:
    terms = f"(SELECT {key}, unnest(regexp_extract_all({FOLD.format('text')}, '{COMPOUND}')) AS term FROM {rows})"
    return f"(SELECT {key}, CAST('0x' || substr(sha256(term), 1, 4) AS INTEGER) % 64 AS slot, count(*) AS w FROM {terms} GROUP BY ALL)"


_QUALIFIED = "CASE WHEN doc_id % 3 = 0 THEN concat_ws('', 'load_', lang) WHEN doc_id % 3 = 1 THEN nullif(regexp_extract(text, '[A-Za-z]{4,}'), '') END"
_DOTTED = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+"


def _sources_sql(depth: int) -> str:
    """sem, lex (query_id, chunk_id, rank)."""
    lexical_sql = _bm25_sql(f"concat_ws(chr(10), {PATH}, source || '.' || ({_QUALIFIED}), text)", True, "1", depth).replace("FROM benchmark", "FROM bq").strip()
    return f"""
WITH bq AS (SELECT item_id, concat(text, ' load_', {_LANG}, ' src', item_id % 20, '.load_', {_LANG}) AS text FROM benchmark),
ds AS {_slots('documents', 'doc_id')}, qs AS {_slots('bq', 'item_id')},
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM ds GROUP BY doc_id), qn AS (SELECT item_id, sqrt(sum(w * w)) AS n FROM qs GROUP BY item_id),
dots AS (SELECT item_id, doc_id, sum(qs.w * ds.w) AS dot FROM qs JOIN ds ON qs.slot = ds.slot GROUP BY ALL),
sims AS (SELECT qn.item_id AS query_id, dn.doc_id AS chunk_id, coalesce(dot, 0) / (qn.n * dn.n) AS score FROM qn CROSS JOIN dn LEFT JOIN dots ON dots.item_id = qn.item_id AND dots.doc_id = dn.doc_id),
semr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sims),
sem AS (SELECT query_id, chunk_id, rank FROM semr WHERE rank <= {depth}),
lex AS (SELECT query_id, chunk_id, rank FROM ({lexical_sql}))"""


_TWO = """,
u2 AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS semantic_rank, b.rank AS lexical_rank FROM sem a FULL JOIN lex b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
s2 AS (SELECT *, coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + lexical_rank), 0) AS score FROM u2),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(semantic_rank, lexical_rank), chunk_id) AS rank FROM s2)"""

_THREE = _TWO + rf""",
ids AS (SELECT item_id, regexp_extract_all(text, '{_DOTTED}') AS q, regexp_replace(text, '{_DOTTED}', ' ', 'g') AS rest FROM bq),
w0 AS (SELECT DISTINCT item_id AS query_id, unnest(list_concat(q, list_filter(regexp_extract_all(rest, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) >= 2))) AS identifier FROM ids),
w AS (SELECT *, contains(identifier, '.') AS qualified, contains(identifier, '.') OR contains(identifier, '_') OR regexp_matches(identifier, '[a-z0-9][A-Z]') OR regexp_matches(identifier, '[A-Z][A-Z][a-z]{{2}}') AS strong FROM w0),
cs AS (SELECT doc_id, {PATH} AS path, source || '.' || ({_QUALIFIED}) AS identity, {_QUALIFIED} AS symbol FROM documents),
nm AS (SELECT doc_id, path, identity AS identifier, true AS q FROM cs WHERE identity IS NOT NULL UNION ALL SELECT doc_id, path, symbol, false FROM cs WHERE symbol IS NOT NULL),
fs AS (SELECT w.query_id, nm.doc_id, nm.path, CASE WHEN w.qualified THEN 0 WHEN w.strong THEN 1 ELSE 2 END AS tier FROM nm JOIN w ON nm.identifier = w.identifier AND nm.q = w.qualified),
bs AS (SELECT query_id, doc_id, path, min(tier) AS tier FROM fs GROUP BY ALL),
os AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, path) AS rank FROM bs),
ks AS (SELECT * FROM os WHERE rank <= 10 AND (tier < 2 OR EXISTS (SELECT 1 FROM r2 WHERE r2.query_id = os.query_id AND r2.chunk_id = os.doc_id))),
sym AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM ks),
u3 AS (SELECT coalesce(u2.query_id, sym.query_id) AS query_id, coalesce(u2.chunk_id, sym.chunk_id) AS chunk_id, semantic_rank, lexical_rank, sym.rank AS symbol_rank FROM u2 FULL JOIN sym ON u2.query_id = sym.query_id AND u2.chunk_id = sym.chunk_id),
s3 AS (SELECT *, coalesce(1 / (60 + semantic_rank), 0) + coalesce(1 / (60 + lexical_rank), 0) + coalesce(1 / (60 + symbol_rank), 0) AS score FROM u3),
r3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(semantic_rank, lexical_rank, symbol_rank), chunk_id) AS rank FROM s3)"""


_LEXICAL_SYMBOL = """,
lk AS (SELECT * FROM os WHERE rank <= 10 AND (tier < 2 OR EXISTS (SELECT 1 FROM lex WHERE lex.query_id = os.query_id AND lex.chunk_id = os.doc_id))),
ls AS (SELECT query_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lk),
lu AS (SELECT coalesce(lex.query_id, ls.query_id) AS query_id, coalesce(lex.chunk_id, ls.chunk_id) AS chunk_id, lex.rank AS lexical_rank, ls.rank AS symbol_rank FROM lex FULL JOIN ls ON lex.query_id = ls.query_id AND lex.chunk_id = ls.chunk_id),
lt AS (SELECT *, coalesce(1 / (60 + lexical_rank), 0) + coalesce(1 / (60 + symbol_rank), 0) AS score FROM lu),
lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(lexical_rank, symbol_rank), chunk_id) AS rank FROM lt)"""


@query(_sources_sql(40) + _TWO + " SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 9) AS score, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank FROM r2 WHERE rank <= 10")
def hybrid_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_search(corpus(spark, sf_dir), *asked(spark, sf_dir), 10)


@query(
    _sources_sql(40) + _THREE + " SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 9) AS score, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank, "
    "CAST(symbol_rank AS INTEGER) AS symbol_rank FROM r3 WHERE rank <= 10"
)
def hybrid_symbol_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid_symbol_search(corpus(spark, sf_dir), *asked(spark, sf_dir), 10)


@query(
    _sources_sql(40) + _THREE + _LEXICAL_SYMBOL + " SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 9) AS score, CAST(lexical_rank AS INTEGER) AS lexical_rank, "
    "CAST(symbol_rank AS INTEGER) AS symbol_rank FROM lr WHERE rank <= 10"
)
def lexical_symbol_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.lexical_symbol_search(corpus(spark, sf_dir), asked(spark, sf_dir)[0], 10)


@query(_sources_sql(80) + _TWO + """,
cand AS (SELECT query_id, chunk_id, rank, sum(length(d.text)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM r2 JOIN documents d ON d.doc_id = chunk_id WHERE rank <= 20),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id DESC) AS place FROM cand WHERE total <= 30000 OR rank = 1)
SELECT query_id, CAST(place AS INTEGER) AS rank, chunk_id, CAST(rank AS INTEGER) AS original_rank FROM kept WHERE place <= 5""")
def hybrid_rerank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reranker that puts the newest first."""
    newest = lambda shown: shown.select("query_id", "chunk_id", (-F.col("chunk_id")).alias("position"))
    return search.hybrid_search_with_reranking(corpus(spark, sf_dir), *asked(spark, sf_dir), newest, 20, 5)


@query(_sources_sql(20) + _THREE + _LEXICAL_SYMBOL + """,
x AS (SELECT 'semantic' AS strategy, query_id, chunk_id, rank FROM sem UNION ALL SELECT 'lexical', query_id, chunk_id, rank FROM lex
UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM r2 UNION ALL SELECT 'hybrid_symbol', query_id, chunk_id, rank FROM r3 UNION ALL SELECT 'lexical_symbol', query_id, chunk_id, rank FROM lr)
SELECT strategy, query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM x WHERE rank <= 5""")
def search_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.every_strategy(corpus(spark, sf_dir), *asked(spark, sf_dir), 5)


@query()
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both context strategies over the same seeds."""
    seeds, chunks = _seeds(spark, sf_dir)
    out = None
    for strategy in search.CONTEXT_STRATEGIES:
        own = search.rag_context(seeds, chunks, strategy).withColumn("strategy", F.lit(strategy))
        out = own if out is None else out.unionByName(own)
    return out
