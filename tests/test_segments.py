"""The segmented index against one made afresh; searches with bounds against whole ones."""

import random

import pytest
from pyspark.sql import functions as F

from quarrykit.operators import lexical, segments
from quarrykit.plans import documents, search  # noqa: F401  they register their queries
from quarrykit.plans.registry import QUERIES

SCHEMA = "chunk_id long, path string, symbol string, content string"


def texts(seed, ids):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    return {i: (i, f"{'tests/test_' if i % 9 == 0 else 'src/'}{i}.py", None, " ".join(rng.choices(words, weights, k=rng.choice([0, 3, 20, 80])))) for i in ids}


def fresh(spark, table, config, terms, k=10):
    at = lexical.write_index(table, config)
    index = lexical.read_index(spark, at, config)
    return lexical.bm25_top_k(index.postings, index.stats, terms, k, config)


def told(found):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 5)) for r in found.collect())


QUERIES_ASKED = [(1, "w0 w1 w2 w40 w55"), (2, "w3"), (3, "w0 w0 w1"), (4, "nothing of it"), (5, "w59 w58 w57 w0 w1 w2 w3 w4 test"), (6, "the w7")]


def test_updates_and_bounds(spark, tmp_path, monkeypatch):
    config = lexical.BM25()
    monkeypatch.setattr(segments, "SLICE_CHUNKS", 16)
    monkeypatch.setattr(segments, "MAX_SEGMENTS", 3)
    monkeypatch.setattr(segments, "SEED_SLICES", 3)
    index = segments.SegmentedIndex(spark, f"file://{tmp_path}/index", config)
    terms = lexical.query_terms(spark.createDataFrame(QUERIES_ASKED, "query_id long, query string"), config)
    now = texts(1, range(300))
    steps = [dict(now)]
    now = now | texts(2, range(20, 50))  # changed
    steps.append(dict(now))
    now = {i: r for i, r in now.items() if i % 10}  # gone
    steps.append(dict(now))
    now = now | texts(3, range(300, 420)) | texts(4, range(21, 29))  # new, changed again
    steps.append(dict(now))
    steps.append(now | texts(5, range(500, 505)))
    before: dict = {}
    for at, rows in enumerate(steps):
        table = spark.createDataFrame(sorted(rows.values()), SCHEMA)
        assert index.update(table, f"state {at}") == sum(before.get(i) != r for i, r in rows.items())
        assert index.update(table.filter("1 = 0"), f"state {at}") == 0  # the source hasn't changed, so it isn't looked at
        before = rows
        want = told(fresh(spark, table, config, terms))
        own = index.read()
        assert told(lexical.bm25_top_k(own.postings, own.stats, terms, 10, config)) == want
        found, work = index.pruned_top_k(terms, 10)
        assert told(found) == want
        assert all(0 <= r.scored <= r.postings for r in work.collect())
    assert len(index.state()["segments"]) <= 3
    index.update(table.filter("1 = 0"), "empty")
    assert index.counts() == segments.Counts(0, 0) and index.pruned_top_k(terms, 10)[0].count() == 0


def test_bounds_spare_postings(spark, tmp_path):
    """A rare term decides; a common one is scored for its chunks' slices alone."""
    rows = [(i, f"{i}.py", None, "common " * (1 + i % 3) + ("rare " * 5 if i % 400 == 0 else "") + "filler " * (i % 50)) for i in range(20_000)]
    index = segments.SegmentedIndex(spark, f"file://{tmp_path}/index", lexical.LEGACY)
    table = spark.createDataFrame(rows, SCHEMA)
    index.update(table)
    terms = lexical.query_terms(spark.createDataFrame([(1, "rare common")], "query_id long, query string"), lexical.LEGACY)
    found, work = index.pruned_top_k(terms, 10)
    assert told(found) == told(fresh(spark, table, lexical.LEGACY, terms))
    row = work.first()
    assert row.postings == 20_050 and row.scored < row.postings / 2


def test_another_configuration(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    segments.SegmentedIndex(spark, folder).update(spark.createDataFrame(list(texts(1, range(5)).values()), SCHEMA))
    with pytest.raises(ValueError):
        segments.SegmentedIndex(spark, folder, lexical.LEGACY).state()


def test_a_changed_table_is_answered_anew(spark, tmp_path):
    """The folder stays, its documents change: no answer names a document that is gone."""
    folder = str(tmp_path)
    source = "/root/testdata/sf0.001"
    spark.read.parquet(f"{source}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{source}/documents.parquet")
    for wanted in (docs.filter("doc_id < 120"), docs.filter("doc_id between 100 and 119"), docs.filter("doc_id >= 110")):
        wanted.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
        ids = {r.doc_id for r in wanted.collect()}
        for name in ("bm25_topk", "bm25_topk_pruned", "hybrid_search_topk"):
            found = {r.chunk_id for r in QUERIES[name](spark, folder).collect()}
            assert found and found <= ids
        assert QUERIES["token_stats"](spark, folder).agg(F.max("df")).first()[0] <= len(ids)
