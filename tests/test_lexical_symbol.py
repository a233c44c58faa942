"""BM25 fused with symbols: fragments that the text search saw, plain words without support, lone identifiers."""

from quarrykit.operators import lexical, search


def test_lexical_symbol(spark):
    rows = [
        (1, "a.py", 0, "load_table", "a.load_table", "first part of it"), (2, "a.py", 1, "load_table", "a.load_table", "second part that mentions parquet footers"),
        (3, "b.py", 0, "report", "b.report", "prints totals"), (4, "c.py", 0, None, None, "parquet footers and more parquet"), (5, "d.py", 0, "footers", "d.footers", "other things"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, chunk_index int, symbol string, qualified string, content string")
    at = lexical.write_index(chunks.drop("symbol").withColumnRenamed("qualified", "symbol"), lexical.LEGACY)
    corpus = search.Corpus(chunks, None, lexical.read_index(spark, at, lexical.LEGACY))
    asked = spark.createDataFrame([(1, "how does load_table read parquet footers"), (2, "load_table"), (3, "report on parquet"), (4, "footers")], "query_id long, query string")

    def found(**more):
        out: dict = {}
        for r in search.lexical_symbol_search(corpus, asked, 5, **more).collect():
            out.setdefault(r.query_id, {})[r.chunk_id] = (r.lexical_rank, r.symbol_rank)
        return out

    got = found()
    assert got[1][2][1] == 1 and got[1].get(1, (None, None))[1] is None  # the fragment that the text search saw
    assert got[2][1][1] == 1  # a lone identifier takes the first fragment
    assert 3 not in got[3] and 5 in got[4]  # a plain word without support goes, a lone one stays
    assert found(corroborate_weak=False)[3][3] == (None, 1)
    assert search.search(corpus, asked, None, 5, "lexical_symbol").count() == sum(map(len, got.values()))
