"""The pipeline, stage by stage, against brute force on a small documents table."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import LONG as LONG_LETTERS
from tests.llm.test_llm_operators import EDGES, PASSAGE, SMALL, brute_components, brute_repeats, check_packing

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402

from quarrykit.llm import language_id, secret_scan, tokens  # noqa: E402

LENGTH = 200


def _prose():
    """The odd texts, of words that the language stage knows."""
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SMALL}/documents.parquet", columns=["lang", "text"]).to_pylist()
    words = [w for r in table if r["lang"] == "en" and r["text"] for w in r["text"].split() if w.isascii() and w.isalpha()]
    rng = random.Random(8)
    passage, long = (" ".join(rng.choices(words, k=k)) for k in (90, 6000))
    return [(i, t and t.replace(LONG_LETTERS, long).replace(PASSAGE, passage)) for i, t in EDGES], long


ODD, LONG = _prose()


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    base = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(i, t, None, None, None) for i, t in ODD] + [(900100, "12 345 --", "en", "s", 9), (900101, None, None, None, None), (None, LONG, None, None, None), (None, LONG + " tail", None, None, None)]
    odd += [(900102, "qzxj wvkq zzxq jqkx vbnm plok qwzx wqzk jjxq", "en", "s", 9), (900103, "tämä on suomenkielinen lause jossa on monta sanaa", "en", "s", 9)]
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    base.unionByName(spark.createDataFrame(odd, base.schema)).write.parquet(f"{folder}/documents.parquet")
    return folder


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def whole_words(data, start, end):
    """Words of data that lie in start:end as a whole."""
    import re

    return sum(1 for m in re.finditer(rb"\S+", data) if start <= m.start() and m.end() <= end)


def cut(rows):
    """Texts without the repeated runs that hold more than 50 words, or 400 bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    counts = Counter(b[p : p + LENGTH] for _, b in texts for p in range(len(b) - LENGTH + 1))
    out = []
    for (i, b), (_, t) in zip(texts, rows, strict=True):
        gone = bytearray(len(b) + 1)
        for p in range(len(b) - LENGTH + 1):
            if counts[b[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = b"\1" * LENGTH
        start = None
        for p, g in enumerate(gone):
            if g and start is None:
                start = p
            elif not g and start is not None:
                if p - start < 400 and whole_words(b, start, p) <= 50:
                    gone[start:p] = bytes(p - start)
                start = None
        out.append((i, None if t is None else bytes(x for x, g in zip(b, gone, strict=False) if not g).decode(errors="ignore")))
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeated_passages", "secrets", "packing"]
    language, near, passages, secrets, packing = (f for _, f in corpus_pipeline.STAGES)

    told = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(docs)).collect()}
    kept = language(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert {i for i, _ in pairs(kept)} - {None} == {i for i, r in told.items() if r.lang_pred != "und" and r.score > 0 and (r.grams < 24 or r.share >= 0.4)} - {None}
    assert not {900001, 900002, 900003, 900100, 900101, 900102, 900103} & {i for i, _ in pairs(kept)} and {900005, 900009, 900012} <= {i for i, _ in pairs(kept)}

    rows = pairs(kept)
    single = near(spark, kept, sf_dir)
    assert len({i for i, _ in rows}) < len(rows) and (None, LONG) in rows
    assert {i for i, _ in pairs(single)} - {None} == {i for i, _, c in brute_components(rows, 5, 80) if i == c} - {None} and set(single.columns) == set(docs.columns)
    left = Counter(i for i, _ in pairs(single))
    assert left[900006] == 0 and left[900005] == 1 and left[900012] == 1 and sum(t.startswith(LONG) for _, t in pairs(single)) == 1

    rows = pairs(single)
    left = passages(spark, single, sf_dir)
    assert Counter(pairs(left)) == Counter(cut(rows)) and any(x[2] for x in brute_repeats(rows, LENGTH))

    masked = secrets(spark, left, sf_dir)
    encoding = tokens.tiktoken_encoding(tokens.TIKTOKEN_FILE)
    by_id = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    for (i, before), (j, after) in zip(by_id(pairs(left)), by_id(pairs(masked)), strict=True):
        base = secret_scan.base_spans(before or "")
        spans = base + secret_scan.random_spans(before or "", base, lambda s: len(encoding.encode_ordinary(s)), 2.0)
        assert i == j and (before == after) == (not spans)
        assert all((before[a:b] not in after) for a, _, b in spans)

    assert check_packing(packing(spark, masked, sf_dir).collect(), pairs(masked)) < 0.03


def test_stages_take_any_table(spark, sf_dir):
    """Empty tables, clashing names, and rows of which all are copies without an id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clash = docs.withColumns({c: F.lit("x") for c in ("lang_pred", "score", "key", "gid", "n", "share", "runs", "gone", "least", "own", "token")})
    for name, stage in corpus_pipeline.STAGES:
        empty, got = stage(spark, docs.filter("1 = 0"), sf_dir), stage(spark, clash, sf_dir)
        assert empty.count() == 0 and got.count() > 0, name
        if name != "packing":
            assert empty.columns == docs.columns and got.columns == clash.columns, name
            assert got.filter("score = 'x' and key = 'x'").count() == got.count(), name
    copies = spark.createDataFrame([(None, LONG, "en", "s", 1)] * 20, docs.schema)
    kept = corpus_pipeline.near_duplicates(spark, copies, sf_dir)
    assert kept.count() == 1 and corpus_pipeline.repeated_passages(spark, kept, sf_dir).first().text == LONG
    assert {r.text for r in corpus_pipeline.repeated_passages(spark, copies, sf_dir).collect()} == {""}


def test_run(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.filter("doc_id = 900005").count() == 1 and packed.filter("doc_id = 900001").count() == 0
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert full.filter("n > 2048").count() == 0
