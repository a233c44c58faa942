"""Queries over documents: ingest, index, chunks, BM25, identifiers, search, context."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.functions.vectors import hash_slot
from quarrykit.operators import chunking, context, evaluation, indexing, lexical, retrieval, searching, segments, trigrams
from quarrykit.plans.registry import SQL, query, table
from quarrykit.sources.shared import fingerprint, shared_dir

FOLD = "replace(lower({}), 'ß', 'ss')"
COMPOUND = r"[\p{L}\p{N}]+(?:[_.\-/][\p{L}\p{N}]+)*"
PATH = "concat(source, '/', lang, '/doc_', doc_id, '.txt')"


def path() -> Column:
    return F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", path().alias("path"), F.col("text").alias("content"))


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "path", F.lit(None).cast("string").alias("symbol"), "content")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("SELECT coalesce(lang, 'unknown') AS language, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(string_split(rtrim(text, chr(10)), chr(10)))) AS BIGINT) AS lines FROM documents GROUP BY 1")
def ingest_language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n", -1))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.sum(lines).cast("long").alias("lines"))


@query("""
WITH f AS (SELECT concat('src/f', doc_id, ['.py', '.md', '.txt', '.json'][doc_id % 4 + 1]) AS path, strlen(text) AS n FROM documents
UNION ALL SELECT concat(CASE WHEN page_id % 5 = 0 THEN 'node_modules/' ELSE 'web/' END, 'p', page_id, CASE WHEN page_id % 3 = 0 THEN '.js' ELSE '.html' END), strlen(html) FROM pages)
SELECT CASE WHEN path LIKE 'node\\_modules/%' ESCAPE '\\' THEN 'ignored directory' WHEN path LIKE '%.txt' OR path LIKE '%.html' THEN 'unsupported' WHEN path LIKE 'src/f1%' THEN 'ignored pattern'
WHEN n > 8000 THEN 'too large' ELSE 'kept' END AS reason, count(*) AS files, CAST(sum(n) AS BIGINT) AS bytes FROM f GROUP BY 1""")
def ingest_reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = F.array(*map(F.lit, (".py", ".md", ".txt", ".json")))
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.get(suffixes, (F.col("doc_id") % 4).cast("int"))).alias("path"), F.octet_length("text").alias("n"))
    folder, end = F.when(F.col("page_id") % 5 == 0, "node_modules/").otherwise("web/"), F.when(F.col("page_id") % 3 == 0, ".js").otherwise(".html")
    pages = table(spark, sf_dir, "pages").select(F.concat(folder, F.lit("p"), F.col("page_id").cast("string"), end).alias("path"), F.octet_length("html").alias("n"))
    p = F.col("path")
    reason = F.when(T.in_ignored_directory(p), "ignored directory").when(T.language_of(p).isNull(), "unsupported").when(T.matches_glob(p, ("f1*",)), "ignored pattern").when(F.col("n") > 8000, "too large").otherwise("kept")
    return docs.unionByName(pages).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").cast("long").alias("bytes"))


_VERSIONS = f"""
WITH b AS (SELECT {PATH} AS relative_path, sha256(text) AS content_hash, doc_id FROM documents WHERE doc_id % 10 <> 0),
a AS (SELECT {PATH} AS relative_path, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, 'x') ELSE text END) AS content_hash, doc_id FROM documents WHERE doc_id % 10 <> 1)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(current, before): relative_path, content_hash of two states of the documents."""
    docs = table(spark, sf_dir, "documents").withColumn("relative_path", path())
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    row = lambda df, t: df.select("relative_path", F.sha2(t, 256).alias("content_hash"))
    return row(docs.filter("doc_id % 10 <> 1"), changed), row(docs.filter("doc_id % 10 <> 0"), F.col("text"))


@query(_VERSIONS + """
SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, CASE WHEN b.relative_path IS NULL THEN 'added' WHEN a.relative_path IS NULL THEN 'deleted'
WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.relative_path = b.relative_path""")
def index_classify_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.classified(*versions(spark, sf_dir))


@query(_VERSIONS + "SELECT relative_path, content_hash FROM a")
def index_apply_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, before = versions(spark, sf_dir)
    moved = indexing.classified(current, before).filter("change <> 'unchanged'")
    upserted = current.join(moved.filter("change <> 'deleted'"), "relative_path", "left_semi")
    return indexing.applied(before, upserted, moved)


@query(_VERSIONS + f""",
s AS (SELECT a.relative_path, a.content_hash, CAST(regexp_extract(a.relative_path, 'doc_([0-9]+)', 1) AS BIGINT) AS i FROM a),
up AS (SELECT relative_path FROM s WHERE i % 7 = 0 OR i % 10 = 0), u AS (SELECT * FROM up WHERE relative_path NOT LIKE '%3.txt'),
de AS (SELECT relative_path FROM b WHERE relative_path LIKE '%1.txt' AND relative_path NOT LIKE '%31.txt' UNION SELECT relative_path FROM b WHERE relative_path LIKE '%77.txt' UNION ALL SELECT relative_path FROM b WHERE relative_path LIKE '%41.txt'),
p AS (SELECT 'deleted twice' AS problem, relative_path FROM de GROUP BY relative_path HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'upserted and deleted', u.relative_path FROM u JOIN de ON u.relative_path = de.relative_path
UNION ALL SELECT DISTINCT 'deleted but current', de.relative_path FROM de JOIN a ON a.relative_path = de.relative_path
UNION ALL SELECT 'left the snapshot but not deleted', relative_path FROM b WHERE relative_path NOT IN (SELECT relative_path FROM a) AND relative_path NOT IN (SELECT relative_path FROM de)
UNION ALL SELECT 'new but not upserted', relative_path FROM a WHERE relative_path NOT IN (SELECT relative_path FROM b) AND relative_path NOT IN (SELECT relative_path FROM u)
UNION ALL SELECT 'changed but not upserted', a.relative_path FROM a JOIN b ON a.relative_path = b.relative_path WHERE a.content_hash <> b.content_hash AND a.relative_path NOT IN (SELECT relative_path FROM u))
SELECT problem, count(*) AS files FROM p GROUP BY problem""")
def index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update that leaves some changed files out, deletes one too few, one too many and one twice."""
    current, before = versions(spark, sf_dir)
    number, name = F.regexp_extract("relative_path", "doc_([0-9]+)", 1).cast("long"), F.col("relative_path")
    upserted = current.filter(((number % 7 == 0) | (number % 10 == 0)) & ~name.endswith("3.txt")).select("relative_path")
    ends = lambda *of: before.filter(name.rlike("(?:" + "|".join(of) + ")[.]txt$")).select("relative_path")
    deleted = ends("1", "77").filter(~name.endswith("31.txt")).unionByName(ends("41"))
    none = upserted.filter("1 = 0").withColumn("chunk_index", F.lit(0))
    return indexing.update_violations(upserted, deleted, none, current, before).groupBy("problem").agg(F.count(F.lit(1)).alias("files"))


@query("""SELECT 'dup' AS problem, count(*) AS rows FROM (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
UNION ALL SELECT 'label without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'label not binary', count(*) FROM labels WHERE quality NOT IN (0, 1) OR toxic NOT IN (0, 1)""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    named = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("problem"), "rows")
    repeated = docs.groupBy("text").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return named(repeated, "dup").unionByName(named(labels.join(docs, "doc_id", "left_anti"), "label without document")).unionByName(named(labels.filter("quality not in (0, 1) or toxic not in (0, 1)"), "label not binary"))


_LINES = f"""
WITH d AS (SELECT {PATH} AS path, CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS parts, text FROM documents WHERE text <> ''),
l AS (SELECT path, len(parts) AS n, list_transform(parts, lambda x, i: CASE WHEN i < len(parts) OR ends_with(text, chr(10)) THEN x || chr(10) ELSE x END) AS lines FROM d),
c AS (SELECT path, n, lines, unnest(range(0, CASE WHEN n <= 20 THEN 1 ELSE CAST(ceil((n - 20) / 15.0) AS BIGINT) + 1 END)) AS i FROM l),
k AS (SELECT path, CAST(i AS INTEGER) AS chunk_index, CAST(i * 15 + 1 AS INTEGER) AS start_line, CAST(least(i * 15 + 20, n) AS INTEGER) AS end_line, array_to_string(lines[i * 15 + 1 : i * 15 + 20], '') AS content FROM c)"""


@query(_LINES + "SELECT path, chunk_index, start_line, end_line, sha256(content) AS content_hash FROM k")
def line_chunks_fast_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.line_windows(files(spark, sf_dir), 20, 5).select("path", "chunk_index", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query(_LINES + f", h AS (SELECT path, count(*) AS n FROM k GROUP BY path) SELECT {PATH} AS relative_path, sha256(text) AS content_hash, coalesce(h.n, 0) AS chunk_count FROM documents LEFT JOIN h ON h.path = {PATH}")
def index_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    chunks = chunking.line_windows(rows, 20, 5).select(F.col("path").alias("relative_path"))
    return indexing.manifest(rows.select(F.col("path").alias("relative_path"), F.sha2("content", 256).alias("content_hash")), chunks)


@query()
def line_chunks_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(files(spark, sf_dir).withColumn("language", F.lit("text")), "line_v1", 20, 5, 1500).select("path", "chunk_index", "start_line", "end_line", "kind", "content")


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a module: its lines are statements of a class's methods, seven a method; a fifth of the documents are one function."""
    clean = lambda line: F.regexp_replace(line, r"['\\\\\p{Cntrl}]", "_")
    parts = F.split(F.coalesce("content", F.lit("")), "\n", -1)
    method = F.transform(parts, lambda line, i: F.concat(F.when(i % 7 == 0, F.concat(F.lit("\n    def m"), i.cast("string"), F.lit("(self):\n"))).otherwise(""), F.lit("        v = '"), clean(line), F.lit("'\n")))
    body = F.transform(parts, lambda line, i: F.concat(F.lit("    v = '"), clean(line), F.lit("'\n")))
    module = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("import os\n\n\ndef whole():\n"), F.array_join(body, ""))).otherwise(F.concat(F.lit("import os\n\n\nclass Doc:\n    x = 1\n"), F.array_join(method, ""), F.lit("\n\ndef tail():\n    return os\n")))
    return files(spark, sf_dir).withColumn("content", module).withColumn("language", F.lit("python"))


@query()
def python_ast_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(python_files(spark, sf_dir), "python_ast_v1", 120, 20, 4000)


_CHUNKS = _LINES + ", s AS (SELECT path, chunk_index, start_line, end_line, content, row_number() OVER (PARTITION BY chunk_index % 3 ORDER BY path, chunk_index) AS rank, chunk_index % 3 AS query_id FROM k WHERE chunk_index > 0)"


def _seeds(spark: SparkSession, sf_dir: str, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(seeds, chunks): three queries' first k chunks by path."""
    rows = chunking.line_windows(files(spark, sf_dir), 20, 5).withColumn("strategy", F.lit("line_v1")).withColumn("symbol", F.lit(None).cast("string"))
    named = rows.filter("chunk_index > 0").withColumn("query_id", (F.col("chunk_index") % 3).cast("long"))
    return retrieval.top_k(named, ["query_id"], ["path", "chunk_index"], k), rows


@query(_CHUNKS + """, p AS (SELECT * FROM s WHERE rank <= 20),
n AS (SELECT p.query_id, p.path, p.chunk_index + o.o AS chunk_index, p.rank AS seed_rank, abs(o.o) AS distance FROM p, (VALUES (-1), (1)) AS o(o)),
f AS (SELECT n.*, row_number() OVER (PARTITION BY n.query_id, n.path, n.chunk_index ORDER BY seed_rank, distance) AS r FROM n JOIN k ON n.path = k.path AND n.chunk_index = k.chunk_index
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = n.query_id AND p.path = n.path AND p.chunk_index = n.chunk_index))
SELECT CAST(query_id AS BIGINT) AS query_id, path, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(seed_rank AS INTEGER) AS seed_rank, CAST(distance AS INTEGER) AS distance FROM f WHERE r = 1""")
def neighbor_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.neighbours(*_seeds(spark, sf_dir)).select("query_id", "path", "chunk_index", "seed_rank", "distance")


@query()
def context_pack_greedy_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, chunks = _seeds(spark, sf_dir)
    return context.pack_greedy(context.candidates(seeds, context.neighbours(seeds, chunks)), 2000)


@query(_CHUNKS + """, z AS (SELECT query_id, path, chunk_index, rank, length(content) AS chars FROM s WHERE rank <= 50),
r AS (SELECT *, sum(chars + 2) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM z)
SELECT CAST(query_id AS BIGINT) AS query_id, path, chunk_index, CAST(rank AS INTEGER) AS rank, CAST(chars AS INTEGER) AS chars FROM r WHERE total <= 20002 - 66 OR rank = 1""")
def context_pack_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _seeds(spark, sf_dir, 50)[0].withColumn("chars", F.char_length("content"))
    return context.pack_until_full(seeds, "chars").select("query_id", "path", "chunk_index", "rank", "chars")


@query(_CHUNKS + """, p AS (SELECT * FROM s WHERE rank <= 20),
g AS (SELECT DISTINCT query_id, path, 3 AS first_line, 24 AS last_line FROM s WHERE rank <= 25),
m AS (SELECT g.query_id, g.path, min(CASE WHEN greatest(0, least(p.end_line, last_line) - greatest(p.start_line, first_line) + 1) >= 5 THEN rank END) AS rank,
coalesce(max(CASE WHEN p.rank IS NOT NULL THEN greatest(0, least(p.end_line, last_line) - greatest(p.start_line, first_line) + 1) END), 0) AS covered FROM g LEFT JOIN p ON g.query_id = p.query_id AND g.path = p.path GROUP BY 1, 2)
SELECT CAST(query_id AS BIGINT) AS case_id, path AS span, CAST(rank AS INTEGER) AS rank, CAST(covered AS INTEGER) AS covered FROM m""")
def span_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = _seeds(spark, sf_dir, 25)[0].withColumnRenamed("query_id", "case_id")
    spans = seeds.select("case_id", F.col("path").alias("span"), "path", F.lit(3).alias("first_line"), F.lit(24).alias("last_line")).distinct()
    return evaluation.span_evidence(seeds.filter("rank <= 20").select("case_id", "path", "start_line", "end_line", "rank"), spans)


_INDEXES: dict[tuple[str, str, lexical.BM25], segments.SegmentedIndex] = {}


def bm25_index(spark: SparkSession, sf_dir: str, config: lexical.BM25, chunks: DataFrame | None = None, what: str = "documents", bounds: bool = True) -> segments.SegmentedIndex:
    """The index of a folder's documents, which lexical queries share; with bounds, if searches are to be pruned. It is brought up to date whenever the files have changed since: what is kept
    by path is where the index is, not what it says."""
    chunks = chunk_rows(spark, sf_dir) if chunks is None else chunks
    key = (spark.sparkContext.applicationId, f"{sf_dir}#{what}", config)
    if key not in _INDEXES:
        _INDEXES[key] = segments.SegmentedIndex(spark, f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}", config, bounds)
    _INDEXES[key].update(chunks, fingerprint(chunks))
    return _INDEXES[key]


_TOKENS = f"WITH d AS (SELECT doc_id, regexp_extract_all({FOLD.format(f'concat({PATH}, chr(10), text)')}, '{COMPOUND}') AS toks FROM documents)"


@query(_TOKENS + ", t AS (SELECT doc_id, unnest(toks) AS term FROM d), c AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total, max(tf) AS most FROM c GROUP BY term HAVING count(*) >= 5")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_index(spark, sf_dir, lexical.BM25()).term_stats().filter("df >= 5")


def _bm25_sql(text: str, stop: bool, weight: str, k: int, extra: str = "doc_id") -> str:
    kept = f"list_filter(toks, lambda x: NOT list_contains({list(T.STOPWORDS)!r}, x))"
    kept = f"CASE WHEN len({kept}) = 0 THEN toks ELSE {kept} END" if stop else "toks"
    return f"""
WITH d AS (SELECT {extra}, regexp_extract_all({FOLD.format(text)}, '{COMPOUND}') AS toks FROM documents),
s AS (SELECT count(*) AS n, avg(len(toks)) AS avgl FROM d),
p AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d), i AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
q0 AS (SELECT item_id, regexp_extract_all({FOLD.format('text')}, '{COMPOUND}') AS toks FROM benchmark),
q1 AS (SELECT item_id, unnest({kept}) AS term FROM q0), q AS (SELECT item_id, term, count(*) AS qf FROM q1 GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM i GROUP BY term),
r AS (SELECT q.item_id AS query_id, i.doc_id AS chunk_id, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgl))) * {weight} AS score
FROM q JOIN i ON q.term = i.term JOIN f ON f.term = q.term, s GROUP BY q.item_id, i.doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM r WHERE score > 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM o WHERE rank <= {k}"""


def _bm25(spark: SparkSession, sf_dir: str, config: lexical.BM25, k: int, chunks: DataFrame | None = None) -> DataFrame:
    index = bm25_index(spark, sf_dir, config, bounds=config != lexical.LEGACY).read() if chunks is None else lexical.read_index(spark, lexical.write_index(chunks, config), config)
    return index.top_k(lexical.query_terms(questions(spark, sf_dir), config), k)


@query(_bm25_sql(f"concat({PATH}, chr(10), text)", True, "1", 10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, lexical.BM25(), 10)


def short_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's two shortest and two longest words: a common term or two among rare ones, as people ask."""
    words = F.array_sort(F.array_distinct(F.transform(T.compounds(F.col("query")), lambda w: F.concat(F.lpad(F.char_length(w).cast("string"), 4, "0"), w))))
    picked = F.array_distinct(F.concat(F.slice(words, 1, 2), F.reverse(F.slice(F.reverse(words), 1, 2))))
    return questions(spark, sf_dir).withColumn("query", F.array_join(F.transform(picked, lambda w: F.substring(w, 5, 2**31 - 1)), " "))


_SHORT = (
    f"(SELECT item_id, array_to_string(list_transform(list_sort(list_distinct(list_concat(s[1:2], list_reverse(list_reverse(s)[1:2])))), lambda x: x[5:]), ' ') AS text FROM (SELECT item_id, "
    f"list_sort(list_distinct(list_transform(regexp_extract_all({FOLD.format('text')}, '{COMPOUND}'), lambda w: lpad(CAST(length(w) AS VARCHAR), 4, '0') || w))) AS s FROM benchmark)) AS short"
)


@query(_bm25_sql(f"concat({PATH}, chr(10), text)", True, "1", 10))
def bm25_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk with score bounds: slices and blocks of postings that can't matter aren't scored."""
    return bm25_index(spark, sf_dir, lexical.BM25()).pruned_top_k(lexical.query_terms(questions(spark, sf_dir)), 10)[0]


@query(_bm25_sql(f"concat({PATH}, chr(10), text)", True, "1", 10).replace("FROM benchmark", f"FROM {_SHORT}"))
def bm25_short_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_index(spark, sf_dir, lexical.BM25()).pruned_top_k(lexical.query_terms(short_questions(spark, sf_dir)), 10)[0]


@query()
def bm25_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many postings the terms of short and of whole questions have, and how many of them were scored."""
    index, out = bm25_index(spark, sf_dir, lexical.BM25()), None
    for kind, asked in (("short", short_questions(spark, sf_dir)), ("whole", questions(spark, sf_dir))):
        work = index.pruned_top_k(lexical.query_terms(asked), 10)[1].select(F.lit(kind).alias("kind"), "query_id", "postings", "scored")
        out = work if out is None else out.unionByName(work)
    return out.withColumn("share", F.round(F.col("scored") / F.col("postings"), 4))


@query(_bm25_sql("text", False, "1", 10))
def bm25_legacy_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, lexical.LEGACY, 10)


@query(_bm25_sql("concat(CASE WHEN doc_id % 4 = 0 THEN 'tests/test_' ELSE 'src/m_' END, doc_id, '.py', chr(10), text)", True, "max(CASE WHEN doc_id % 4 = 0 THEN 0.5 ELSE 1.0 END)", 10).replace("* max(CASE WHEN doc_id", "* max(CASE WHEN i.doc_id"))
def bm25_test_demotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("chunk_id") % 4 == 0, "tests/test_").otherwise("src/m_")
    rows = chunk_rows(spark, sf_dir).withColumn("path", F.concat(prefix, F.col("chunk_id").cast("string"), F.lit(".py")))
    return _bm25(spark, sf_dir, lexical.BM25(), 10, rows)


@query(f"WITH q AS (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all({FOLD.format('text')}, '{COMPOUND}'), lambda x: NOT list_contains({list(T.STOPWORDS)!r}, x))) AS term FROM benchmark) SELECT query_id, term, count(*) AS qf FROM q GROUP BY ALL")
def query_stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.query_terms(questions(spark, sf_dir)).drop("about_tests")


def _two_lists(spark: SparkSession, sf_dir: str, k: int) -> dict[str, DataFrame]:
    named = lambda df: df.select("query_id", "chunk_id", "rank")
    return {"new": named(_bm25(spark, sf_dir, lexical.BM25(), k)), "legacy": named(_bm25(spark, sf_dir, lexical.LEGACY, k))}


def _fused_sql(k: int) -> str:
    one = _bm25_sql(f"concat({PATH}, chr(10), text)", True, "1", 40).strip()
    two = _bm25_sql("text", False, "1", 40).strip()
    return f"""
WITH a AS ({one}), b AS ({two}),
u AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS new_rank, b.rank AS legacy_rank FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
s AS (SELECT *, coalesce(1 / (60 + new_rank), 0) + coalesce(1 / (60 + legacy_rank), 0) AS score FROM u),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(new_rank, legacy_rank), chunk_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 9) AS score, new_rank, legacy_rank FROM r WHERE rank <= {k}"""


@query(_fused_sql(10))
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fused(_two_lists(spark, sf_dir, 10 * retrieval.CANDIDATE_FACTOR), ["chunk_id"], 10)


@query(f"""WITH f AS ({_fused_sql(30).strip()}), c AS (SELECT query_id, chunk_id, rank, length(text) AS chars FROM f JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
t AS (SELECT *, sum(chars) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM c)
SELECT query_id, chunk_id, rank, CAST(chars AS INTEGER) AS chars FROM t WHERE total <= 30000 OR rank = 1""")
def rerank_bounded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = retrieval.fused(_two_lists(spark, sf_dir, 40), ["chunk_id"], 30)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.char_length("text").alias("chars"))
    return retrieval.rerank_candidates(ranked.join(sizes, "chunk_id"), "chars").select("query_id", "chunk_id", "rank", "chars")


@query(f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all({FOLD.format('text')}, '{COMPOUND}')) AS term FROM documents) SELECT doc_id, CAST(CAST('0x' || substr(sha256(term), 1, 4) AS INTEGER) % 64 AS INTEGER) AS slot, count(*) AS weight FROM t GROUP BY 1, 2")
def hashed_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.compounds(F.col("text"))).alias("term"))
    return tokens.groupBy("doc_id", hash_slot(F.col("term"), 64).alias("slot")).agg(F.count(F.lit(1)).alias("weight"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+') AS q, regexp_replace(text, '[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+', ' ', 'g') AS rest FROM documents),
i AS (SELECT DISTINCT doc_id, unnest(list_concat(q, list_filter(regexp_extract_all(rest, '[A-Za-z_][A-Za-z0-9_]*'), lambda w: length(w) >= 2))) AS identifier FROM d),
s AS (SELECT *, contains(identifier, '.') AS qualified, contains(identifier, '.') OR contains(identifier, '_') OR regexp_matches(identifier, '[a-z0-9][A-Z]') OR regexp_matches(identifier, '[A-Z][A-Z][a-z]{2}') AS strong FROM i)
SELECT identifier, qualified, strong, count(*) AS docs FROM s GROUP BY ALL""")
def identifier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.query_identifiers(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")))
    return found.groupBy("identifier", "qualified", "strong").agg(F.count(F.lit(1)).alias("docs"))


@query()
def code_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("lang", F.explode(T.code_tokens("text")).alias("term"))
    return tokens.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10")


@query(_LINES + f""", x AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_number FROM l),
m AS (SELECT path, line_number, rtrim(line, chr(10)) AS line, instr({FOLD.format('line')}, 'license') - 1 AS pos FROM x)
SELECT path, CAST(line_number AS INTEGER) AS line_number, CASE WHEN length(line) <= 500 THEN line ELSE substr(line, least(greatest(0, pos - 125), length(line) - 500) + 1, 500) END AS line FROM m WHERE pos >= 0""")
def search_code_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return searching.search(files(spark, sf_dir), "License")


@query(_LINES + r""", x AS (SELECT path, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_number FROM l),
m AS (SELECT path, line_number, 'class ' || replace(rtrim(line, chr(10)), '.', ':') AS line FROM x)
SELECT path, CAST(line_number AS INTEGER) AS line_number, 'class' AS kind FROM m WHERE regexp_matches(line, '^\s*class\s+Of(?:\s*[(:]|\s*$)')""")
def find_symbol_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as class declarations, so that some declare the symbol."""
    lines = searching.source_lines(files(spark, sf_dir)).withColumn("line", F.concat(F.lit("class "), F.replace("line", F.lit("."), F.lit(":"))))
    return lines.withColumn("kind", searching.declaration_kind(F.col("line"), "Of")).filter("kind is not null").select("path", "line_number", "kind")


_TRIGRAMS: dict[tuple[str, str], trigrams.TrigramIndex] = {}


def trigram_index(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None, what: str = "documents") -> trigrams.TrigramIndex:
    """The index of a folder's documents, or of rows made of them, made anew whenever their files have changed."""
    rows = files(spark, sf_dir) if rows is None else rows
    key = (spark.sparkContext.applicationId, f"{sf_dir}#{what}")
    if key not in _TRIGRAMS:
        _TRIGRAMS[key] = trigrams.TrigramIndex(spark, f"{shared_dir(spark)}/trigrams-{uuid.uuid4().hex}")
    _TRIGRAMS[key].update(rows, fingerprint(rows))
    return _TRIGRAMS[key]


@query(SQL["search_code_literal"])
def search_code_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_code_literal by way of the index."""
    return trigram_index(spark, sf_dir).search("License")


@query(SQL["find_symbol_regex"])
def find_symbol_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_symbol_regex by way of the index of its lines."""
    lines = F.regexp_replace(F.replace("content", F.lit("."), F.lit(":")), "(?md)^", "class ")
    index = trigram_index(spark, sf_dir, files(spark, sf_dir).withColumn("content", lines), "declared")
    return index.find_declarations("Of").select("path", "line_number", "kind")


@query("""SELECT page_id, sha256(concat('<source id="S', page_id, '">', chr(10), '<path>', e(url), '</path>', chr(10), '<lines>1-1</lines>', chr(10), '<content trust="untrusted-data" encoding="xml-escaped">', chr(10), e(html), '</content>', chr(10), '</source>')) AS block_hash,
CAST(ceil(length(concat('<source id="S', page_id, '">', chr(10), '<path>', e(url), '</path>', chr(10), '<lines>1-1</lines>', chr(10), '<content trust="untrusted-data" encoding="xml-escaped">', chr(10), e(html), '</content>', chr(10), '</source>')) / 4.0) AS BIGINT) AS tokens FROM pages""".replace("e(url)", "replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')").replace("e(html)", "replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"))
def xml_escape_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1)
    block = T.source_block(F.concat(F.lit("S"), F.col("page_id").cast("string")), F.col("url"), one, one, F.lit(None).cast("string"), F.col("html"))
    return table(spark, sf_dir, "pages").withColumn("block", block).select("page_id", F.sha2("block", 256).alias("block_hash"), T.token_estimate(F.col("block")).alias("tokens"))


@query()
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.redacted(F.col("text")).alias("text"))
    return rows.withColumn("found", F.col("text").contains("[REDACTED]"))


@query()
def redact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(T.public_text(F.col("html")), 256).alias("text_hash"))


@query("SELECT source, lang, count(*) AS files FROM documents GROUP BY ROLLUP(source, lang)")
def sources_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark-native extension: subtotals."""
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("files"))


@query("SELECT path, content_hash FROM (SELECT " + PATH + " AS path, sha256(text) AS content_hash FROM documents) ORDER BY path LIMIT 50 OFFSET 100")
def files_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrykit.operators.ranking import page

    return page(files(spark, sf_dir).select("path", F.sha2("content", 256).alias("content_hash")), ["path"], 50, 100)
