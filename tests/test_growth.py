"""Work that grows with the input and no faster."""

import re

import numpy as np
import pyarrow as pa
import pytest

from quarrykit.operators import lexical, segments

SCHEMA = "chunk_id long, path string, symbol string, content string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_shuffles_no_row_a_query_and_chunk(spark):
    """What is dealt by chunk is chunks; queries' results are dealt by query alone, some k a task."""
    table = spark.createDataFrame([(i, f"{i}.py", None, f"common word{i % 7}") for i in range(200)], SCHEMA)
    index = lexical.read_index(spark, lexical.write_index(table))
    terms = lexical.query_terms(spark.createDataFrame([(q, f"common word{q}") for q in range(5)], "query_id long, query string"))
    found = lexical.bm25_top_k(index.rows, index.stats, terms, 3)
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan(found))
    assert dealt and not any("query_id" in d and "chunk_id" in d for d in dealt)
    assert {(r.query_id, r["rank"], r.chunk_id) for r in found.collect()} >= {(q, 1, q) for q in range(5)}


def test_bm25_in_shards_and_blocks(spark, monkeypatch):
    """However small shards and blocks are, results are the same."""
    table = spark.createDataFrame([(i, f"{i}.py", None, " ".join(f"w{(i * j) % 11}" for j in range(i % 40))) for i in range(150)] + [(999, None, None, None)], SCHEMA)
    terms = lexical.query_terms(spark.createDataFrame([(q, f"w{q} w{q + 1} w{q} w3") for q in range(9)], "query_id long, query string"), lexical.LEGACY)
    ask = lambda: sorted(map(tuple, lexical.read_index(spark, lexical.write_index(table, lexical.LEGACY), lexical.LEGACY).top_k(terms, 4).collect()))
    want = ask()
    for name, value in (("SHARD_TOKENS", 500), ("BLOCK_QUERIES", 2)):
        monkeypatch.setattr(lexical, name, value)
    assert len(want) == 36 and ask() == want


def test_queries_go_to_the_chunks(spark, monkeypatch):
    """No chunk is dealt anew for a batch of bounded size, which a larger one isn't; shares of the work don't tell in the results. A batch without a common term is a batch."""
    table = spark.createDataFrame([(i, f"{i}.py", None, f"common word{i % 7} w{i}") for i in range(90)] + [(200, "x.py", None, "")], SCHEMA)
    index = lexical.read_index(spark, lexical.write_index(table, lexical.LEGACY), lexical.LEGACY)
    terms = lexical.query_terms(spark.createDataFrame([(q, f"common word{q} w{q * 9}") for q in range(6)] + [(50, "w88"), (51, "nowhere")], "query_id long, query string"), lexical.LEGACY)
    told = lambda df: sorted(map(tuple, df.collect()))
    found = index.top_k(terms, 4)
    assert "CoGroup" not in plan(found)
    want = told(found)
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 2)
    assert told(index.top_k(terms, 4)) == want and len(want) == 25
    monkeypatch.setattr(lexical, "SENT_TERMS", 3)
    found = index.top_k(terms, 4)
    assert "CoGroup" in plan(found) and told(found) == want


def test_pruned_search_moves_no_chunk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SLICE_CHUNKS", 4)
    monkeypatch.setattr(segments, "SEED_SLICES", 2)
    rows = [(i, f"f{i % 5}/{i}.py", None, f"common word{i % 7} " + "filler " * (i % 9) + ("rare " if i % 40 == 0 else "")) for i in range(160)]
    index = segments.SegmentedIndex(spark, f"file://{tmp_path}/index", lexical.LEGACY)
    index.update(spark.createDataFrame(rows, SCHEMA))
    terms = lexical.query_terms(spark.createDataFrame([(1, "rare common"), (2, "word3"), (3, "rare word1 filler"), (4, "none")], "query_id long, query string"), lexical.LEGACY)
    told = lambda both: [sorted(map(tuple, df.collect())) for df in both]
    both = index.pruned_top_k(terms, 5)
    assert "CoGroup" not in plan(both[0])
    want = told(both)
    assert want[0] == told([index.read().top_k(terms, 5)])[0]
    for name in ("SENT_PAIRS", "SENT_TERMS"):
        monkeypatch.setattr(lexical, name, 1)
        both = index.pruned_top_k(terms, 5)
        assert "CoGroup" in plan(both[0]) and told(both) == want


def test_an_index_without_bounds_moves_no_chunk(spark, tmp_path):
    rows = [(i, f"{i}.py", None, f"common word{i % 7}") for i in range(30)]
    made = [segments.SegmentedIndex(spark, f"file://{tmp_path}/{b}", lexical.LEGACY, b) for b in (True, False)]
    for index in made:
        index.update(spark.createDataFrame(rows, SCHEMA))
        index.update(spark.createDataFrame(rows[5:] + [(40, "y.py", None, "common new")], SCHEMA))
    stats = [sorted(map(tuple, index.term_stats().collect())) for index in made]
    assert stats[0] == stats[1] and not (tmp_path / "False" / "headers").exists()
    with pytest.raises(ValueError):
        made[1].pruned_top_k(lexical.query_terms(spark.createDataFrame([(1, "common")], "query_id long, query string")), 3)


def test_symbols_meet_queries_by_their_first_places(spark):
    """However many chunks bear a name, a query sees some; the same as of all."""
    from pyspark.sql import functions as F

    from quarrykit.operators import retrieval
    from quarrykit.operators.ranking import keep_first, top_k

    chunks = spark.createDataFrame([(f"p{i * 37 % 100:03}.py", j, f"s{i % 3}", f"m{i % 2}.s{i % 3}") for i in range(100) for j in range(i % 4)], "path string, chunk_index int, symbol string, qualified string")
    asked = [(1, "s0", False, False), (1, "m1.s0", True, True), (1, "s1", False, True), (2, "s2", False, False), (3, "m0.s1", True, True), (3, "s1", False, False), (4, "none", False, False)]
    wanted = spark.createDataFrame(asked, "query_id long, identifier string, qualified boolean, strong boolean")
    names = chunks.select("path", "chunk_index", F.col("qualified").alias("identity"), F.col("qualified").alias("identifier"), F.lit(True).alias("qualified"))
    names = names.unionByName(chunks.select("path", "chunk_index", F.col("qualified").alias("identity"), F.col("symbol").alias("identifier"), F.lit(False).alias("qualified")))
    every = wanted.join(names, ["identifier", "qualified"]).withColumn("tier", F.expr("case when qualified then 0 when strong then 1 else 2 end"))
    first = keep_first(keep_first(every, ["query_id", "path", "chunk_index"], ["tier", "identifier"]), ["query_id", "path", "identity"], ["tier", "chunk_index"])
    columns = ["query_id", "rank", "tier", "identifier", "path", "chunk_index", "identity"]
    told = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    for limit in (1, 5, 30):
        found = retrieval.symbol_search(chunks, wanted, limit)
        assert told(found) == told(top_k(first, ["query_id"], ["tier", "path", "chunk_index"], limit))
    assert re.search(r"WindowGroupLimit \[identifier", plan(retrieval.symbol_search(chunks, wanted, 5)))


def test_slices_grow_with_the_chunks_that_share_a_folder_and_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SLICE_CHUNKS", 8)
    table = spark.createDataFrame([(i, f"f{i % 40}/{i}.py", None, "one two three") for i in range(320)], SCHEMA)
    index = segments.SegmentedIndex(spark, f"file://{tmp_path}/index", lexical.LEGACY)
    index.update(table)
    assert index.headers(index.state()).count() == 40


def test_reranking_reads_stored_candidates(spark):
    """What the answer is made of is what was shown: no search is in its plan."""
    from pyspark.sql import functions as F

    from quarrykit.operators import search, vector

    chunks = spark.createDataFrame([(i, f"{i}.py", 0, None, None, f"alpha beta{i}") for i in range(6)], "chunk_id long, path string, chunk_index int, symbol string, qualified string, content string")
    queries = spark.createDataFrame([(1, "alpha beta3")], "query_id long, query string")
    as_text = lambda df, i, t: vector.hashed_vectors(df.select(F.col(i).alias("id"), F.col(t).alias("text")))
    corpus = search.Corpus(chunks, as_text(chunks, "chunk_id", "content"), lexical.read_index(spark, lexical.write_index(chunks)))
    asked = as_text(queries, "query_id", "query").withColumnRenamed("id", "query_id")
    found = search.hybrid_search_with_reranking(corpus, queries, asked, lambda shown: shown.select("query_id", "chunk_id", F.col("chunk_id").alias("position")), 5, 2)
    assert "CoGroup" not in plan(found) and [r["rank"] for r in found.collect()] == [1, 2]


def test_strategies_search_each_source_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quarrykit.operators import search, vector

    rows = [(i, f"{i}.py", 0, f"name{i % 3}", f"m.name{i % 3}", f"alpha beta{i} gamma{i % 4}") for i in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, chunk_index int, symbol string, qualified string, content string")
    queries = spark.createDataFrame([(1, "alpha beta3 m.name1"), (2, "gamma2 name2"), (3, "name0")], "query_id long, query string")
    as_text = lambda df, i, t: vector.hashed_vectors(df.select(F.col(i).alias("id"), F.col(t).alias("text")))
    corpus = search.Corpus(chunks, as_text(chunks, "chunk_id", "content"), lexical.read_index(spark, lexical.write_index(chunks)))
    asked = as_text(queries, "query_id", "query").withColumnRenamed("id", "query_id")
    told = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id").collect()))
    want = {s: told(search.search(corpus, queries, asked, 3, s)) for s in search.STRATEGIES}
    made, plain = [], lexical.Index.top_k
    monkeypatch.setattr(lexical.Index, "top_k", lambda *a: made.append(1) or plain(*a))
    found = search.every_strategy(corpus, queries, asked, 3)
    assert len(made) == 1 and "MapInArrow" not in plan(found)
    assert {s: told(found.filter(F.col("strategy") == s)) for s in search.STRATEGIES} == want


def test_hashed_vectors_shuffle_no_token(spark):
    from quarrykit.operators import vector

    texts = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, ""), (3, None), (4, "x")], "id long, text string")
    found = vector.hashed_vectors(texts)
    assert "Generate" not in plan(found)
    got = {r.id: r.embedding for r in found.collect()}
    one = {r.id: r.embedding for r in vector.hashed_vectors(spark.createDataFrame([(1, "a b a b c"), (4, "x")], "id long, text string")).collect()}
    assert got == one and sum(got[1]) == 5 and len(got[1]) == 64


def test_context_quality_by_class_makes_no_pairs(spark):
    from pyspark.sql import functions as F

    from quarrykit.operators import evaluation

    items = spark.createDataFrame([(i, i % 4) for i in range(40)] + [(100, 9), (7, 3)], "item long, class int")
    cases = items.filter("item % 5 = 0").withColumnRenamed("item", "case_id")
    packed = spark.createDataFrame([(c, i, 10) for c in range(0, 40, 10) for i in (c, c + 1, c + 4, c + 8, 77) if i != 48], "case_id long, item long, tokens int")
    gold = cases.join(items, "class").filter("case_id <> item").select("case_id", "item")
    told = lambda df: sorted(map(tuple, df.collect()))
    found = evaluation.context_quality_by_class(packed, cases, items, 100)
    assert told(found) == told(evaluation.context_quality(packed, gold, 100))
    assert found.filter(F.col("case_id") == 100).count() == 0


def test_trigrams_are_split_in_place(spark, monkeypatch, tmp_path):
    """No shuffle makes postings; a text longer than a step, and texts of several steps, are found as by plain search."""
    from quarrykit.operators import searching, trigrams

    rows = spark.createDataFrame([("a", "x" * 130 + "needle" + "y" * 100), ("b", ""), ("c", None), ("d", "need\nle"), ("e", "the Needle, ne"), ("f", "n"), ("g", "ab" * 100 + "needl")], "path string, content string")
    made = trigrams._postings(rows.selectExpr("0 slice", "monotonically_increasing_id() file_id", "content"))
    assert "Exchange" not in plan(made) and "Generate" not in plan(made)
    told = lambda df: sorted(map(tuple, df.collect()))
    index = trigrams.TrigramIndex(spark, f"file://{tmp_path}/index")
    index.update(rows)
    for needle in ("needle", "abab", "n", "xn", "y" * 70):
        assert told(index.search(needle)) == told(searching.search(rows, needle))
    # In steps of any size, on this process's own batch: the masks are those of each trigram's places.
    texts = [t.encode() + b"\n\n" for t in ("x" * 130 + "needle" + "y" * 100, "", "need\nle", "ab" * 100 + "needl")]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 4, pa.int32()), pa.array(range(4), pa.int64()), pa.array(texts)], names=["slice", "file_id", "data"]).slice(1)
    want: dict = {}
    for i, t in enumerate(texts[1:], 1):
        for at in range(len(t) - 2):
            want[t[at : at + 3], i] = want.get((t[at : at + 3], i), 0) | 1 << at % 64
    for step in (64, 128, 1 << 20):
        monkeypatch.setattr(trigrams, "STEP", step)
        found: dict = {}
        for row in pa.Table.from_batches(trigrams._split_all([batch])).to_pylist():
            for f in row["files"]:
                found[row["gram"], f["file_id"]] = found.get((row["gram"], f["file_id"]), 0) | f["mask"] % (1 << 64)
        assert found == want


def test_sums_in_steps(monkeypatch):
    """Whatever is summed together, sums are the same."""
    queries = pa.table({"asked": pa.array([[{"term": f"w{(q + j) % 5}", "weight": 1.0 + q + j} for j in range(3)] for q in range(4)])})
    lists = [[f"w{(i * j) % 7}" for j in range(i % 6)] for i in range(30)]
    terms = pa.array(lists, pa.list_(pa.string()))
    parts = np.arange(sum(map(len, lists)), dtype=float)
    for most in (4, 50, 1 << 20):
        monkeypatch.setattr(lexical, "PRODUCTS", most)
        got = np.concatenate([total for _, _, (total,) in lexical.Asked(queries).sums(terms, parts)])
        at, want = 0, np.zeros((30, 4))
        for i, words in enumerate(lists):
            for w in words:
                for q in range(4):
                    want[i, q] += parts[at] * sum(t["weight"] for t in queries["asked"][q].as_py() if t["term"] == w)
                at += 1
        assert np.allclose(got, want)


def test_chunks_of_steps(spark):
    from quarrykit.operators import chunking

    rows = spark.createDataFrame([(f"{i}", "python", f"def f{i}():\n    return {i}\n" * (i % 5)) for i in range(60)] + [("null", "python", None)], "path string, language string, content string")
    told = lambda: sorted(map(str, chunking.chunks(rows, "python_ast_v1").collect()))
    assert len(told()) == 120
    assert list(chunking.steps(np.array([40, 20, 90, 10]), 64)) == [(0, 2), (2, 3), (3, 4)]
