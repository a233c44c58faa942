import math

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import answering, chunking, context, evaluation, indexing, jobs, lexical, ranking, retrieval, search, searching, traces, vector
from quarrykit.operators.answering import Providers


def test_bm25_legacy_score(spark):
    chunks = spark.createDataFrame([(1, "a", None, "token token"), (2, "b", None, "other")], "chunk_id long, path string, symbol string, content string")
    rows = lexical.tokenised(chunks, lexical.LEGACY)
    terms = lexical.query_terms(spark.createDataFrame([(9, "token")], "query_id long, query string"), lexical.LEGACY)
    got = lexical.bm25_top_k(lexical.postings(rows), lexical.corpus_stats(rows), terms, 5, lexical.LEGACY).collect()
    want = math.log(1 + 1.5 / 1.5) * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2 / 1.5))
    assert [(r.chunk_id, r.rank) for r in got] == [(1, 1)] and got[0].score == pytest.approx(want, abs=1e-6)


def test_bm25_demotes_tests_and_keeps_stopword_questions(spark):
    chunks = spark.createDataFrame([(1, "tests/a.py", None, "alpha"), (2, "src/a.py", None, "alpha")], "chunk_id long, path string, symbol string, content string")
    rows = lexical.tokenised(chunks)
    index, stats = lexical.postings(rows), lexical.corpus_stats(rows)
    ask = lambda q: [r.chunk_id for r in lexical.bm25_top_k(index, stats, lexical.query_terms(spark.createDataFrame([(1, q)], "query_id long, query string")), 5).orderBy("rank").collect()]
    assert ask("where is alpha") == [2, 1] and ask("alpha tests") == [1, 2]
    kept = lexical.query_terms(spark.createDataFrame([(1, "where is the")], "query_id long, query string")).collect()
    assert {r.term for r in kept} == {"where", "is", "the"}


def test_fusion_order_and_scores(spark):
    rows = lambda items: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(items)], "query_id long, item string, rank int")
    got = retrieval.fused({"semantic": rows("abc"), "lexical": rows("cad")}, ["item"], 10).orderBy("rank").collect()
    assert [r.item for r in got] == ["a", "c", "b", "d"]
    assert [r.score for r in got] == pytest.approx([1 / 61 + 1 / 62, 1 / 63 + 1 / 61, 1 / 62, 1 / 63], abs=1e-8)
    assert retrieval.locations(got and retrieval.fused({"semantic": rows("a")}, ["item"], 1).withColumn("path", F.lit("p")).withColumn("chunk_index", F.lit(0))).first().found_by == "semantic"


def test_fusion_conflicts(spark):
    a = spark.createDataFrame([(1, "x", "one"), (1, "x", "one"), (1, "y", "two")], "query_id long, item string, content string").withColumn("rank", F.lit(1))
    b = spark.createDataFrame([(1, "y", "other")], "query_id long, item string, content string").withColumn("rank", F.lit(1))
    got = {(r["item"], r.problem) for r in retrieval.fusion_conflicts({"a": a, "b": b}, ["item"], "content").collect()}
    assert got == {("x", "repeated"), ("y", "content differs")}


def test_symbols(spark):
    chunks = spark.createDataFrame([("a.py", 0, "login", "User.login"), ("a.py", 1, "login", "User.login"), ("b.py", 0, "login", None), ("c.py", 0, "runAll", None)], "path string, chunk_index int, symbol string, qualified string")
    wanted = retrieval.query_identifiers(spark.createDataFrame([(1, "User.login runAll login")], "query_id long, query string"))
    got = [(r.tier, r.path, r.chunk_index) for r in retrieval.symbol_search(chunks, wanted).orderBy("rank").collect()]
    assert got == [(0, "a.py", 0), (1, "c.py", 0), (2, "b.py", 0)]


def test_rerank(spark):
    rows = spark.createDataFrame([(1, i, i, 10) for i in range(1, 6)], "query_id long, chunk_id long, rank int, chars int")
    shown = retrieval.rerank_candidates(rows, "chars", 4, 25)
    assert [r.chunk_id for r in shown.orderBy("rank").collect()] == [1, 2]
    answer = spark.createDataFrame([(1, 2, 0), (1, 7, 1)], "query_id long, chunk_id long, position int")
    assert {(r.chunk_id, r.problem) for r in retrieval.rerank_violations(shown, answer).collect()} == {(1, "missing"), (7, "unknown")}
    order = spark.createDataFrame([(1, 2, 0), (1, 1, 1)], "query_id long, chunk_id long, position int")
    assert [(r.chunk_id, r.original_rank) for r in retrieval.apply_rerank(shown, order, 2).orderBy("rank").collect()] == [(2, 2), (1, 1)]


@pytest.mark.parametrize(("lines", "max_lines", "overlap", "max_chars"), [(1, 5, 1, 100), (12, 5, 2, 1000), (12, 5, 2, 30), (3, 2, 1, 4), (0, 5, 1, 10)])
def test_line_windows_cover(lines, max_lines, overlap, max_chars):
    text = "".join(f"line {i}\r\n" for i in range(lines))
    windows = list(chunking.windows_of(text, max_lines, overlap, max_chars))
    covered = {n for a, b, _ in windows for n in range(a, b + 1)}
    assert covered == set(range(1, lines + 1)) and all(len(c) <= max_chars for *_, c in windows)
    starts = [a for a, *_ in windows]
    assert starts == sorted(starts)


def test_fast_path_equals_full_chunker(spark):
    texts = [(f"p{n}", "text", "".join(f"{i}\n" for i in range(n)) + "end") for n in (0, 5, 19, 20, 21, 50, 77)]
    files = spark.createDataFrame(texts, "path string, language string, content string")
    fast = {tuple(r) for r in chunking.line_windows(files, 20, 5).collect()}
    full = {(r.path, r.chunk_index, r.start_line, r.end_line, r.content) for r in chunking.chunks(files, "line_v1", 20, 5, 10**6).collect()}
    assert fast == full


SOURCE = '''import os

@deco
def f(x):
    def inner():
        return x
    return inner


class A:
    """doc"""

    y = 1

    def m(self):
        return 1
'''


def test_python_chunks(spark):
    files = spark.createDataFrame([("a.py", "python", SOURCE), ("b.py", "python", "def ("), ("c.md", "markdown", "x\n")], "path string, language string, content string")
    rows = chunking.chunks(files, "python_ast_v1").orderBy("path", "chunk_index").collect()
    a = [(r.start_line, r.end_line, r.kind, r.qualified) for r in rows if r.path == "a.py"]
    assert (3, 7, "function", "f") in a and (5, 6, "function", "f.inner") in a and (15, 16, "method", "A.m") in a and any(k == "class" and q == "A" for *_, k, q in a)
    assert {n for s, e, *_ in a for n in range(s, e + 1)} >= set(range(3, 8)) | set(range(10, 17))
    assert {r.kind for r in rows if r.path != "a.py"} == {"line_fallback"}


NESTED = """x = 1
def outer(a):
    b = 1
    if a:
        class Local:
            z = 3

            def m(self):
                return 1

            y = 2
    return b
class Empty:
    p = 1
    q = (2,
         3)
    r = 4
async def last():
    pass
"""


def test_python_units():
    got = [tuple(u)[:5] for u in chunking.python_units(NESTED)]
    assert got == [
        (1, 1, "module", None, None), (2, 12, "function", "outer", None), (5, 7, "class", "outer.Local", "outer"), (8, 9, "method", "outer.Local.m", "outer.Local"),
        (10, 11, "class", "outer.Local", "outer"), (13, 17, "class", "Empty", None), (18, 19, "function", "last", None),
    ]
    empty = next(u for u in chunking.python_units(NESTED) if u.qualified == "Empty")
    assert empty.breaks == {14, 16, 17}
    # Three lines at most: the class ends its first part behind a statement, not within one.
    lines = chunking.split_lines(NESTED)
    assert [(a, b) for a, b, _ in chunking.unit_parts(lines, empty, 3, 1000)] == [(13, 14), (15, 17)]
    assert [(a, b) for a, b, _ in chunking.unit_parts(lines, empty._replace(breaks=frozenset()), 3, 1000)] == [(13, 15), (16, 17)]
    assert [len(c) for *_, c in chunking.unit_parts(["a" * 25], chunking.Unit(1, 1, "module"), 5, 10)] == [9, 8, 8]


def test_fragments(spark):
    body = "".join(f"    v{i} = {i}\n" for i in range(300))
    files = spark.createDataFrame([("a.py", "python", f"def f():\n{body}")], "path string, language string, content string")
    rows = chunking.chunks(files, "python_ast_v1").orderBy("chunk_index").collect()
    assert [(r.kind, r.fragment_index, r.fragment_count, r.start_line, r.end_line, r.qualified, r.parent) for r in rows] == [
        ("structural_fragment", k + 1, 3, 120 * k + 1, min(301, 120 * k + 120), "f", None) for k in range(3)
    ]
    assert "".join(r.content for r in rows) == f"def f():\n{body}"


def test_python_query_covers_its_files(spark):
    from quarrykit.plans import documents

    small = "/root/testdata/sf0.001"
    texts = {r.path: r.content for r in documents.python_files(spark, small).collect()}
    made: dict[str, list] = {}
    for r in documents.python_ast_chunks(spark, small).collect():
        made.setdefault(r.path, []).append(r)
        assert r.end_line - r.start_line < 120 and len(r.content) <= 4000 and (r.kind == "structural_fragment") == (r.fragment_index is not None) and r.kind != "line_fallback"
    for path, text in texts.items():
        got = "".join(r.content for r in sorted(made[path], key=lambda r: r.chunk_index))
        assert got.replace("\n", "") == text.replace("\n", "")
    assert any(r.kind == "structural_fragment" for rows in made.values() for r in rows)


def test_search_limited(spark):
    files = spark.createDataFrame([("a/b.py", "x\nTODO one\ntodo two"), ("a/c.py", "todo three"), ("ab.py", "todo four")], "path string, content string")
    rows, more = searching.search_limited(files, "todo", 2)
    assert [(r.path, r.line_number) for r in rows.collect()] == [("a/b.py", 2), ("a/b.py", 3)] and more
    rows, more = searching.search_limited(files, "todo", 3, under="a")
    assert rows.count() == 3 and not more
    assert searching.search_limited(files, "todo", 5, case_sensitive=True)[0].count() == 3
    with pytest.raises(ValueError):
        searching.search_limited(files, "")


def test_dimensions(spark):
    rows = lambda *vs: spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(vs)], "id long, embedding array<float>")
    with pytest.raises(vector.DimensionError):
        vector.search(rows([1.0, 0, 0], [1.0, 0, 0, 0, 0]), rows([1.0, 0, 0]), 2)
    with pytest.raises(vector.DimensionError):
        vector.search(rows([1.0, 0, 0]), rows([1.0, 0]), 2)
    with pytest.raises(ValueError):
        vector.search(rows([1.0]), rows([1.0]), 2, "nearly")
    got = vector.search(rows([1.0, 0], [0.0, 1], [0.0, 0]), rows([1.0, 0]), 5).collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 1.0), (1, 0.0)]
    assert vector.search(rows(), rows([1.0]), 2).count() == 0


def test_search_errors(spark):
    chunks = spark.createDataFrame([(1, "a.py", 0, None, None, "alpha beta"), (2, "b.py", 0, "load_it", "m.load_it", "gamma")], "chunk_id long, path string, chunk_index int, symbol string, qualified string, content string")
    vectors = vector.hashed_vectors(chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")))
    corpus = search.Corpus(chunks, vectors, lexical.read_index(spark, lexical.write_index(chunks)))
    asked = lambda *qs: spark.createDataFrame(list(enumerate(qs)), "query_id long, query string")
    q_vectors = lambda q: vector.hashed_vectors(q.select(F.col("query_id").alias("id"), F.col("query").alias("text"))).withColumnRenamed("id", "query_id")
    q = asked("load_it", "alpha")
    got = {(r.query_id, r.chunk_id): r.symbol_rank for r in search.search(corpus, q, q_vectors(q), 2).collect()}
    assert got[(0, 2)] == 1 and got[(1, 1)] is None
    for bad in (lambda: search.search(corpus, q, None, 2), lambda: search.search(corpus, q, q_vectors(q), 2, "best"), lambda: search.search(corpus, asked("\u3000 "), q_vectors(q), 2), lambda: search.search(corpus, q, q_vectors(q), 0)):
        with pytest.raises(search.SearchError):
            bad()
    lost = lambda shown: shown.filter("rank > 1").select("query_id", "chunk_id", F.col("rank").alias("position"))
    with pytest.raises(search.SearchError):
        search.hybrid_search_with_reranking(corpus, q, q_vectors(q), lost)


def test_neighbours_and_packing(spark):
    chunks = spark.createDataFrame([("a", i, i * 10 + 1, i * 10 + 10, "x" * 100, "line_v1", "f" if i < 2 else None) for i in range(4)], "path string, chunk_index int, start_line int, end_line int, content string, strategy string, symbol string")
    seeds = chunks.filter("chunk_index = 1").withColumn("query_id", F.lit(1).cast("long")).withColumn("rank", F.lit(1))
    near = context.neighbours(seeds, chunks)
    assert {(r.chunk_index, r.origin) for r in near.collect()} == {(0, 1), (2, 2)}
    got = context.pack_greedy(context.candidates(seeds, near), 130).orderBy("source_no").collect()
    assert [r.chunk_index for r in got] == [1, 0] and not got[0].truncated
    cut = context.pack_greedy(context.candidates(seeds, near), 45).collect()
    assert len(cut) == 1 and cut[0].truncated and cut[0].tokens <= 45


def test_spans_and_means(spark):
    ranked = spark.createDataFrame([("c", "p", 1, 4, 1), ("c", "p", 3, 30, 2)], "case_id string, path string, start_line int, end_line int, rank int")
    spans = spark.createDataFrame([("c", "s", "p", 1, 20), ("c", "t", "q", 1, 2)], "case_id string, span string, path string, first_line int, last_line int")
    got = {r.span: (r["rank"], r.covered) for r in evaluation.span_evidence(ranked, spans).collect()}
    assert got == {"s": (2, 18), "t": (None, 0)}
    case = evaluation.span_cases(evaluation.span_evidence(ranked, spans)).first()
    assert (case.hit, case.target_recall, case.reciprocal_rank) == (True, 0.5, 0.5)


def test_traces(spark):
    events = spark.createDataFrame([("r", 1, "view", 0), ("r", 2, "click", 5), ("r", 4, "view", 9)], "run_id string, sequence int, event_type string, s int").withColumn("timestamp", F.timestamp_seconds("s"))
    assert [(r.after, r.missing) for r in traces.gaps(events).collect()] == [(2, 1)]
    assert [(r.sequence, r.ended_as, r.elapsed_ms) for r in traces.bracketed(events, "view", ["click"]).orderBy("sequence").collect()] == [(1, "click", 5000.0), (4, None, 0.0)]
    runs = spark.createDataFrame([("r", "running", None, None)], "run_id string, status string, ended_at timestamp, duration_ms double")
    assert {r.problem for r in traces.violations(runs, events).collect()} == {"sequence"}


def test_jobs(spark):
    columns = "id string, job_type string, repository_id long, status string, attempt_count int, created_at timestamp, started_at timestamp, finished_at timestamp, lease_owner string, lease_expires_at timestamp, cancel_requested_at timestamp, cancelled_at timestamp, side_effect_started_at timestamp, error_code string"
    from datetime import datetime

    t = lambda s: datetime(2024, 1, 1, 0, 0, s)
    rows = [
        ("a", "index", 1, "queued", 0, t(2), None, None, None, None, None, None, None, None),
        ("b", "index", 1, "queued", 0, t(1), None, None, None, None, None, None, None, None),
        ("c", "coding", 1, "running", 1, t(0), t(0), None, "w", t(3), None, None, t(1), None),
        ("d", "rag", 1, "running", 3, t(0), t(0), None, "w", t(3), None, None, None, None),
        ("e", "rag", 1, "running", 1, t(0), t(0), None, "w", t(3), t(2), None, None, None),
        ("f", "rag", 1, "running", 1, t(0), t(0), None, "w", t(9), None, None, None, None),
        ("g", "rag", 1, "running", 1, t(0), t(0), None, "w", t(3), None, None, None, None),
    ]
    table = spark.createDataFrame(rows, columns)
    now = F.lit(t(5))
    got = {r.id: (r.status, r.lease_owner) for r in jobs.claimed(table, ["w1"], now).collect()}
    assert got["b"] == ("running", "w1") and got["a"] == ("queued", None)
    after = {r.id: (r.status, r.error_code, r.lease_owner) for r in jobs.recovered(table, now).collect()}
    assert after["c"] == ("failed", "job_interrupted", None) and after["d"] == ("failed", "job_attempts_exhausted", None)
    assert after["e"] == ("cancelled", None, None) and after["f"] == ("running", None, "w") and after["g"] == ("queued", None, None)
    assert {r.id: r.status for r in jobs.cancel_requested(table, "a", now).collect()}["a"] == "cancelled"
    ended = {r.id: r.status for r in jobs.finished(table, "f", "w", "succeeded", now).collect()}
    assert ended["f"] == "succeeded" and {r.id: r.status for r in jobs.finished(table, "f", "x", "succeeded", now).collect()}["f"] == "running"
    states = {r.id: r.s for r in table.select("id", jobs.cancellation_state().alias("s")).collect()}
    assert states == {"a": "available", "b": "available", "c": "unavailable", "d": "available", "e": "requested", "f": "available", "g": "available"}


def test_index_violations(spark):
    f = lambda *paths: spark.createDataFrame([(p,) for p in paths], "relative_path string")
    chunks = spark.createDataFrame([("a", 0), ("a", 2), ("z", 0)], "relative_path string, chunk_index int")
    got = {(r.relative_path, r.problem) for r in indexing.update_violations(f("a", "q"), f("a", "d"), chunks, f("a", "d")).collect()}
    assert got == {("a", "upserted and deleted"), ("a", "deleted but current"), ("d", "deleted but current"), ("q", "upserted but not current"), ("z", "chunk of a file not upserted"), ("a", "chunk indexes not 0..n")}
    assert indexing.fingerprint({"b": 1, "a": 2}) == indexing.fingerprint({"a": 2, "b": 1})


def test_vectors(spark):
    import random

    random.seed(1)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(999, [0.0] * 8)]
    table = spark.createDataFrame(rows, "id long, embedding array<double>")
    exact = vector.exact_top_k(table, table.filter("id < 20"), 5, shard_rows=50)
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for q in (0, 7):
        v = rows[q][1]
        want = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w), i) for i, w in rows[:-1] if i != q))[:5]
        assert [r.vec_id for r in exact.filter(F.col("query_id") == q).orderBy("rank").collect()] == [i for _, i in want]
    found = vector.ann_top_k(table, table.filter("id < 20"), 5, n_cells=6, n_probes=5)
    assert vector.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.9


def test_batches(spark):
    rows = spark.createDataFrame([("k", i, 10) for i in range(7)], "key string, n int, chars int")
    got = [r.batch for r in vector.batches(rows, "chars", ["key"], ["n"], 3, 25).orderBy("n").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3]


def test_answering(spark):
    packed = spark.createDataFrame([(1, 1, "a.py", 1, 2, "A"), (1, 2, "b.py", 3, 4, "B")], "query_id long, source_no long, path string, start_line int, end_line int, block string")
    questions = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, query string")
    answers = answering.answered(answering.contexts(questions, packed, "block"), Providers(answer=lambda q, c: (c, ["S2", "S2", "S9"])))
    got = {r.query_id: r.answer for r in answers.collect()}
    assert got == {1: '<repository_context trust="untrusted-data">\nA\n\nB\n</repository_context>', 2: answering.NO_EVIDENCE}
    cited = [(r.source_id, r.path) for r in answering.citations(answers, packed).collect()]
    assert cited == [("S2", "b.py"), ("S9", None)]
    with pytest.raises(Exception, match="another number"):
        answering.embedded(packed, "block", Providers(embed=lambda t: []), "m").collect()


def test_page_limits(spark):
    with pytest.raises(ValueError, match="limit"):
        ranking.page(spark.range(3), ["id"], 0)
    rows, more = ranking.with_truncation(spark.range(5), ["id"], 3)
    assert more and rows.count() == 3
