"""The trigram index against plain search, what it reads, and odd texts."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from quarrykit.operators import searching, trigrams
from quarrykit.plans import documents

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def index(spark, tmp_path, files, **kw):
    made = trigrams.TrigramIndex(spark, f"file://{tmp_path}/index")
    made.update(files, **kw)
    return made


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abAB \n") for _ in range(rng.randrange(400))) for _ in range(150)]
    texts += ["", "x", "ab", None, "zz" + "q" * 5000, "y" * 4094 + "needle over a piece's end", "n" * 70_000 + "\nStraße ΑΣΑ\n", "class Foo:\n  def bar(self):\nconst baz = 1\n", "Foo bar baz", "aaaa", "İstanbul"]
    return spark.createDataFrame([(f"p/{i % 150}.py", t) for i, t in enumerate(texts)], "path string, content string")


@pytest.mark.parametrize("slice_bytes", [1 << 30, 5000])
def test_equals_plain_search(spark, tmp_path, corpus, slice_bytes):
    made = index(spark, tmp_path, corpus, slice_bytes=slice_bytes)
    for needle, case in (("abab", False), ("AbAb", True), ("ba a", False), ("a", True), ("zq", False), ("aaaa", False), ("needle over", True), ("STRASSE", False), ("ΑΣ", True), ("q" * 300, False), ("nothing", False), ("i̇stan", False), ("baz", True)):
        assert rows(made.search(needle, case)) == rows(searching.search(corpus, needle, case)), needle
    for symbol in ("Foo", "bar", "baz", "ab", "Gone"):
        assert rows(made.find_declarations(symbol)) == rows(searching.find_declarations(corpus, symbol)), symbol
    with pytest.raises(ValueError, match="needle"):
        made.search("")


def test_masks_tell_places_apart(spark, tmp_path):
    files = spark.createDataFrame([("a", "abcdef"), ("b", "abc....bcd....cde....def"), ("c", "x" * 61 + "abcdef" + "x" * 300)], "path string, content string")
    made = index(spark, tmp_path, files)
    assert [r.path for r in made.candidates(["abcdef"]).orderBy("path").collect()] == ["a", "c"]
    assert [r.path for r in made.candidates(["abc"], ["cde", "gone"]).orderBy("path").collect()] == ["a", "b", "c"]


def test_other_files_are_not_read(spark, tmp_path):
    files = spark.createDataFrame([(f"f{i}", f"text of {i} " * 20 + ("wanted" if i == 17 else "")) for i in range(60)], "path string, content string")
    made = index(spark, tmp_path, files, slice_bytes=500)
    at = made._at().removeprefix("file://")
    holding = [r.slice for r in made._holding(made._at(), "wanted").collect()]
    assert len(holding) == 1
    spoilt = 0
    for file in Path(at, "texts").glob("slice=*/*.parquet"):
        if f"slice={holding[0]}/" not in str(file):
            file.write_bytes(b"not parquet")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            spoilt += 1
    assert spoilt > 10 and [r.path for r in made.search("wanted").collect()] == ["f17"]


def test_changed_files_get_new_answers(spark, tmp_path):
    of = lambda *texts: spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "path string, content string")
    made = index(spark, tmp_path, of("old words", "same"), source="1")
    assert not made.update(of("new words"), source="1") and made.search("old").count() == 1
    assert made.update(of("new words", "same"), source="2") and made.search("old").count() == 0 and made.search("new").count() == 1
    made.update(of().limit(0), source="3")
    assert made.search("same").count() == 0
    with pytest.raises(FileNotFoundError):
        trigrams.TrigramIndex(spark, f"file://{tmp_path}/none").search("x")


def test_documents(spark):
    made = documents.trigram_index(spark, SMALL)
    files = documents.files(spark, SMALL)
    for needle in ("License", "sample", "zzzz", "e"):
        assert rows(made.search(needle)) == rows(searching.search(files, needle))
