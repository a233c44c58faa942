"""The manifest, the main text of pages and phrases, held against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrykit.llm import main_text, manifest, phrases

SMALL = "/root/testdata/sf0.001"
ROWS = [
    (900001, None, None, None, None), (900002, "", "", "", 0), (None, "no id", "en", "s", 5), (None, "no id", "en", "s", 5), (None, "other", "en", "s", None), (None, None, None, None, None),
    (900003, "same", "xx", "odd", 4), (900003, "same", "xx", "odd", 4), (900003, "differs", "xx", "odd", 7), (-5, "é中😀", "xx", "odd", 3), (-(2**63), "least", "xx", "odd", 2**63 - 1), (2**63 - 1, "most", "xx", "odd", -1),
    (900005, "one", "zz", "a|b", 3), (900006, "lang of two bytes", "é", "-", 17),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    more = spark.createDataFrame(ROWS + [(900100, "copy", "cc", "hot", 4)] * 300, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(1) for c in ("tree", "leaf", "key", "bin", "n", "a", "phrase", "words", "rank", "path", "root", "item", "block", "verified")}
    return base.unionByName(more).withColumns(extra).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, fanout):
    leaf = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def levels(nodes):
        made = [nodes]
        while len(made[-1]) > 1:
            made.append([sha("".join(made[-1][k : k + fanout])) for k in range(0, len(made[-1]), fanout)])
        return made

    def path(made, at):
        for nodes in made[:-1]:
            begin = at // fanout * fanout
            yield "".join(nodes[begin:at]), "".join(nodes[at + 1 : begin + fanout])
            at //= fanout

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    members = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: levels([leaf(r) for r in members[x]]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    root = top[-1][0]
    for k, x in enumerate(langs):
        for at, r in enumerate(members[x]):
            steps = [*path(trees[x], at), *path(top, k)]
            own = leaf((*r[:3], r[3] + 1, r[4])) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf(r)
            for before, after in steps:
                own = sha(before + own + after)
            yield r[0], leaf(r), trees[x][-1][0], root, sha("".join(a + b for a, b in steps)), own, own == root


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize(("fanout", "bin_keys", "leaves"), [(2, 4096, 4096), (2, 4, 4), (3, 16, 9)])
def test_manifest(docs, rows, monkeypatch, fanout, bin_keys, leaves):
    """Small bins and blocks take several digits and rounds; a third of the rows are equal."""
    monkeypatch.setattr(manifest, "BIN_KEYS", bin_keys)
    monkeypatch.setattr(manifest, "BLOCK_LEAVES", leaves)
    got = manifest.verified_manifest(docs, fanout)
    assert tuple(got.columns) == PROOF
    assert Counter(map(tuple, got.collect())) == Counter(brute_manifest(rows, fanout))


def test_manifest_small(spark, docs):
    assert manifest.verified_manifest(docs.filter("1 = 0")).count() == 0
    one = spark.createDataFrame([(3, "s", None, 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.verified_manifest(one).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == sha("") and got.verified == (zlib.crc32(b"3") % 7 != 0)
    with pytest.raises(ValueError):
        manifest.manifest(one, fanout=1)


def test_manifest_long_text(spark):
    row = (1, "s", "en", 9_000_000, "ab\n" * 3_000_000)
    table = spark.createDataFrame([row], "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest.verified_manifest(table).first().leaf == next(iter(brute_manifest([row], 2)))[1]


def test_ranks(spark):
    """Ids far apart and close together, of two trees, with ties."""
    rng = random.Random(2)
    keys = {("a", rng.choice([rng.randrange(50), rng.randrange(-(2**62), 2**62), None]), sha(str(k))) for k in range(400)} | {("b", k, sha(str(k))) for k in range(300)}
    table = spark.createDataFrame([(*k, rng.randint(1, 3)) for k in sorted(keys, key=str)], "tree string, doc_id long, leaf string, times long")
    got = manifest.ranked(table).collect()
    for tree in "ab":
        at = 0
        for row in sorted((r for r in got if r.tree == tree), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.leaf)):
            assert row.start == at
            at += row.times
    assert len(got) == len(keys)


def brute_phrases(rows, min_count, kept):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n = Counter(), Counter()
    for _, _, lang, _, text in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) == 1 or a < min_count:
            continue
        longer = [q for (x, q), b in counts.items() if x == lang and b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))] if len(p) < 5 else []
        if not longer:
            score, cut = min((1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:cut]], counts[lang, p[cut:]]))
    for lang, own in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:kept], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n[lang], -score


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(8)
    words = ["New", "york", "city", "é", "\x00x", "a-b", "und", "the", "THE", "😀"]
    made = []
    for k in range(240):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " ", ", ", ".\n", "\r", "\x0b"]) for _ in range(rng.randint(0, 60)))
        made.append((k % 7 or None, "s", rng.choice(["en", "en", "de", None, "und", ""]), 1, text))
    made += [(1, "s", "en", 1, None), (2, "s", "fr", 1, ""), (3, "s", "fr", 1, " ., \n"), (4, "s", "en", 1, "in the end " * 40), (4, "s", "en", 1, "in the end " * 40)]
    return spark.createDataFrame(made, "doc_id long, source string, lang string, n_chars long, text string").withColumn("phrase", F.lit(1)), made


@pytest.mark.parametrize(("bits", "block", "kept"), [(1 << 27, 12 << 20, 2000), (1 << 6, 500, 7)])
def test_phrases(talk, monkeypatch, bits, block, kept):
    """With a table of 64 bits nearly all phrases are counted; blocks of 500 bytes cut texts up."""
    monkeypatch.setattr(phrases, "TABLE_BITS", bits)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    table, made = talk
    got = phrases.collocations(table, min_count=8, kept=kept)
    assert Counter(map(tuple, got.collect())) == Counter(brute_phrases(made, 8, kept))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrase_runs():
    """Runs end where pieces do, and hold all bytes; texts without an end of a piece are taken whole."""
    import pyarrow as pa

    text = "aa bb, cc dd. " * 30 + "x" * 200 + " y" * 60 + "\nend"
    runs = [bytes(r) for r in phrases._segments(pa.array([text, "last words"], pa.large_string()), 50)]
    assert b"".join(runs) == (text + "\nlast words").encode().translate(phrases._bytes_map()) and len(runs) > 8
    assert all(r.endswith(b"\xff") for r in runs[:-1]) and max(map(len, runs)) > 300
    whole = [bytes(r) for r in phrases._segments(pa.array(["z" * 500], pa.large_string()), 50)]
    assert whole == [b"z" * 500]


def test_phrases_exact(spark):
    """Products that pass 64 bits: counts of tables are added up, scores come from them alone."""
    big = 4_000_000_000_000
    counted = spark.createDataFrame([("en", 1, "a", big), ("en", 1, "b", big + 1), ("en", 2, "a b", big - 7)], "lang string, words int, phrase string, a long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    assert phrases.scored_phrases(totals, counted).first().score == 1000 * (big - 7) * 3 * big // (big * (big + 1))


def test_phrases_empty(docs):
    assert phrases.collocations(docs.filter("1 = 0")).count() == 0
    assert phrases.collocations(docs.filter("text IS NULL")).count() == 0


PAGES = [
    (None, ""), ("", ""), ("plain text", "plain text"), ("<nav>menu</nav>", ""), ("<p>a &lt;b&gt; &nbsp; c\n\td &amp;amp; &copy;", "a <b> c d &amp; ©"),
    ("<title>no</title><script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> --><p>1 < 2 <3 and so on", "1 < 2 <3 and so on"),
    ("<article><h1>Title</h1><p>Is.<p><b>Of.<br>the</b></p><aside>no</aside><div class='ad-slot x'>no</div><footer>no</footer><p>End</p></article><p>no", "Title\nIs.\nOf. the\nEnd"),
    ("<header>no</header><main><header><h1>Title</h1></header><p>Text</p><form>no<input><button>no</button></form><ul><li>one<li>two</ul></main><footer>no</footer>", "Title\nText\none\ntwo"),
    ("<div id=menu><a href=/>Home</a></div><h1>Title of it</h1><p>Long text one that is quite long indeed.<p>Short.<div class=promo>no</div><p>More long text of this article here.<section id=comments><p>a long comment of a reader, no</p></section><div id=footer>no</div>",
     "Title of it\nLong text one that is quite long indeed.\nShort.\nMore long text of this article here."),
    ("<div>My site</div><nav>no</nav><p>" + "A sentence of some length. " * 9 + "</p><p>Of.</p><aside>no</aside><div>Tiny</div>", ("A sentence of some length. " * 9).strip() + "\nOf."),
    ("<form><article><p>Kept, though a form is around it</article></form>", "Kept, though a form is around it"), ("<p style='display:none'>no</p><p hidden>no</p><p>yes", "yes"),
    ("<article><p>Long article text that leads.</p><p>x</p></article><section class=related><article><p>Another one that is not it</p></article></section><article class=comment>no</article>", "Long article text that leads.\nx"),
    ("<p>one<br><br>two<br>three</p>", "one\ntwo three"), ("<p>cut <b", "cut"), ("<p>cut <!-- no", "cut"), ("<P CLASS=\"Cookie-Notice\">no</P><DIV>Yes</DIV>", "Yes"), ("<a href=x>all of it a link</a>", "all of it a link"),
    ("<article><p>a > b</p><p title='x > y'>q</p></span></div><p>r</article>", "a > b\nq\nr"),
]


def test_main_text(spark):
    rows = [(k, f"u{k}", page) for k, (page, _) in enumerate(PAGES)] + [(None, None, PAGES[2][0]), (1, "u1", "")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    got = main_text.extracted(table)
    want = [(k, f"u{k}", text, len(text)) for k, (_, text) in enumerate(PAGES)] + [(None, None, "plain text", 10), (1, "u1", "", 0)]
    assert Counter(map(tuple, got.collect())) == Counter(want) and got.columns == ["page_id", "url", "text", "n_chars"]
    assert main_text.extracted(table.filter("1 = 0")).count() == 0


def test_main_text_pages(spark):
    """All pages of the table, against what stands in their article, taken apart by plain expressions."""
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in main_text.extracted(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()}
    for page_id, page in pages.items():
        blocks = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)[1])
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks]
        assert got[page_id] == "\n".join(b for b in blocks if b)


def test_runs():
    assert main_text.runs([0, 0, 5, 1, 0, 0, 2, 0, 0, 0, 9, 0]) == [(2, 7, 6), (10, 11, 9)]
    assert main_text.runs([]) == [] and main_text.runs([0, 0]) == [] and main_text.runs([4]) == [(0, 1, 4)]


@pytest.mark.parametrize("page", ["<div>" * 60000 + "</span>" * 60000, "<b><div></b>" * 40000, '<a href="' * 60000, "<" * 200000, "<!--" * 60000, "<article><p>" + "long text " * 400000, "<p>x" * 100000])
def test_main_text_long(page):
    began = time.time()
    main_text.main_text(page)
    assert time.time() - began < 20
