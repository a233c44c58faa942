import math

import pytest
from pyspark.sql import functions as F

from quarrykit.functions import metrics, vectors
from quarrykit.functions import text as T


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "tokens"),
    [
        ("OpenAILLMClient", ["openaillmclient", "open", "ai", "llm", "client"]),
        ("foo_bar.baz", ["foo_bar.baz", "foo", "bar", "baz"]),
        ("utf8Decoder", ["utf8decoder", "utf", "8", "decoder"]),
        ("HTTPServer", ["httpserver", "http", "server"]),
        ("a a", ["a", "a"]),
        ("", []),
        ("XYZ", ["xyz"]),
    ],
)
def test_code_tokens(text, tokens):
    assert T.tokens_of(text) == tokens


def test_code_tokens_column(spark):
    rows = spark.createDataFrame([("getUserName",), (None,)], "t string").select(T.code_tokens("t").alias("x")).collect()
    assert rows[0]["x"] == ["getusername", "get", "user", "name"] and rows[1]["x"] == []


def test_lines(spark):
    assert one(spark, T.lines_kept(F.col("t")), t="a\r\nb\rc\nd") == ["a\r\n", "b\r", "c\n", "d"]
    assert one(spark, T.line_count(F.col("t")), t="") == 0
    assert one(spark, T.oversized_pieces(F.col("t"), 3), t="abcdefgh") == ["abc", "def", "gh"]


@pytest.mark.parametrize(("path", "test"), [("tests/a.py", True), ("src/test_a.py", True), ("src/a.spec.ts", True), ("src/a.py", False), ("src/conftest.py", True), ("Tests/x/y.go", True), ("test.py", False)])
def test_test_paths(spark, path, test):
    assert one(spark, T.is_test_path(F.col("p")), p=path) is test


@pytest.mark.parametrize(("path", "safe"), [("a/b.py", True), ("../a", False), ("/a", False), ("C:/a", False), ("a\\..\\b", False), ("", False), (".", False)])
def test_safe_paths(spark, path, safe):
    assert one(spark, T.is_safe_path(F.col("p")), p=path) is safe


def test_paths(spark):
    assert one(spark, T.language_of(F.col("p")), p="x/y.PY") == "python"
    assert one(spark, T.language_of(F.col("p")), p="x/y.exe") is None
    assert one(spark, T.in_ignored_directory(F.col("p")), p="a/Node_Modules/b.js")
    assert one(spark, T.is_git_path(F.col("p")), p="a/.GIT. /config")
    assert one(spark, T.matches_glob(F.col("p"), ("*.min.js", "x?.py")), p="a/B.MIN.js")
    assert one(spark, T.paths_overlap(F.lit("a/b"), F.lit("a/b/c"))) and not one(spark, T.paths_overlap(F.lit("a/b"), F.lit("a/bc")))


def test_identifiers(spark):
    found = one(spark, T.identifiers(F.col("q")), q="where is UserService.login and LLMReranker run BM25Index a IDs")
    assert [(i["text"], i["qualified"], i["strong"]) for i in found] == [
        ("UserService.login", True, True), ("where", False, False), ("is", False, False), ("and", False, False), ("LLMReranker", False, True),
        ("run", False, False), ("BM25Index", False, True), ("IDs", False, False),
    ]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("task-runner and risk-model", "task-runner and risk-model"),
        ("key sk-proj-abcdefgh12", "key [REDACTED]"),
        ("password = hunter2 ok", "password = [REDACTED] ok"),
        ("Authorization: Bearer abc.def", "[REDACTED]"),
        ("postgresql://u:p@h/db x", "[REDACTED] x"),
        ("https://me:pw@host/x", "https://[REDACTED]@host/x"),
        ("basic configuration", "basic configuration"),
        ("a\tb", "a b"),
    ],
)
def test_redaction(spark, text, clean):
    assert one(spark, T.redacted(F.col("t")), t=text) == clean


def test_public_text(spark):
    assert one(spark, T.public_text(F.col("t")), t="see /home/me/x.py or C:\\x\\y and and/or") == "see [REDACTED] or [REDACTED] and and/or"
    rows = spark.createDataFrame([("it calls secret_function here", "+    secret_function(1)\n")], "t string, d string")
    assert rows.select(T.public_review(F.col("t"), F.col("d")).alias("x")).first()["x"] == "it calls [REDACTED SOURCE] here"


def test_frames_and_blocks(spark):
    assert one(spark, T.sse_frame(F.lit(3), F.lit("a.b"), F.lit("{}"))) == "id: 3\nevent: a.b\ndata: {}\n\n"
    assert one(spark, T.xml_escaped(F.col("t")), t="a<b>&") == "a&lt;b&gt;&amp;"
    assert one(spark, T.token_estimate(F.col("t")), t="12345") == 2
    assert one(spark, T.request_host(F.col("h")), h="[::1]:80") == "[::1]" and one(spark, T.request_host(F.col("h")), h="Host:80") == "host"


def test_source_block(spark):
    got = one(spark, T.source_block(F.lit("S1"), F.lit("a&b.py"), F.lit(1), F.lit(2), F.lit("python"), F.lit("x<y\n"), F.lit(True)))
    assert got == '<source id="S1">\n<path>a&amp;b.py</path>\n<lines>1-2</lines>\n<language>python</language>\n<content trust="untrusted-data" encoding="xml-escaped" truncated="true">\nx&lt;y\n</content>\n</source>'
    assert one(spark, T.candidate_block(F.lit("C1"), F.lit("a"), F.lit(1), F.lit(1), F.lit(None).cast("string"), F.lit(""))).startswith('<candidate id="C1">\n<path>a</path>\n<lines>1-1</lines>\n<content')
    assert one(spark, T.truncated(F.col("t"), 5), t="x" * 60) == "xxxxx[truncated 55 chars]" and one(spark, T.truncated(F.col("t"), 5), t="x" * 20) == "x" * 20
    assert one(spark, T.embedding_text(True, F.lit("p"), F.lit(None).cast("string"), F.lit("line"), F.lit("c"))) == "Path: p\nSymbol: <module>\nKind: line\n\nc"


def test_cosine(spark):
    a, b, z = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, b)) == pytest.approx(1 / math.sqrt(2))
    assert one(spark, vectors.cosine(a, z)) is None and one(spark, vectors.cosine(a, F.array(F.lit(1.0)))) is None


def test_metrics(spark):
    gold, ranked = F.array(*map(F.lit, "ab")), F.array(*map(F.lit, "xaba"))
    assert one(spark, metrics.recall_at(gold, ranked, 2)) == 0.5
    assert one(spark, metrics.reciprocal_rank(gold, ranked)) == 0.5
    assert one(spark, metrics.reciprocal_rank(gold, F.array(F.lit("q")))) == 0
    best = 1 + 1 / math.log2(3)
    assert one(spark, metrics.ndcg_at(gold, ranked, 4)) == pytest.approx((1 / math.log2(3) + 0.5) / best)


def test_redaction_is_unicode(spark):
    """Columns and the Python form agree where words and white space aren't ASCII."""
    from quarrykit.functions.metadata import redact

    texts = ["token\u00a0=\u00a0abc123", "password\u3000:\u3000geheim", "see token = abc, secret:\u2003xyz9", "Bearer\u00a0abcdef", "étoken=abc123", "nothing here", "postgres://u:p@h/d\u00a0next"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.redacted(F.col("t")).alias("x")).collect()]
    assert got == [redact(t) for t in texts] and got[0] != texts[0] and got[1] != texts[1]


def test_public_review(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+    compute_everything(first_argument)\r\n-short\n \u00a0kept_line_here = 1\n+" + "z" * 300
    prose = "It has compute_everything(first_argument), first_argument and kept_line_here = 1; short stays, /home/user/x/y goes, " + "z" * 256
    row = spark.createDataFrame([(prose, diff), ("as it is", None), (None, diff), (prose, "")], "t string, d string").select(T.public_review(F.col("t"), F.col("d")).alias("x")).collect()
    mark = "[REDACTED SOURCE]"
    assert row[0].x == f"It has {mark}, {mark} and {mark}; short stays, [REDACTED] goes, {mark}"
    assert row[1].x == "as it is" and row[2].x is None and "compute_everything" in row[3].x and "/home" not in row[3].x
    many = "".join(f"+name_number_{k:04d}\n" for k in range(400))
    pieces = spark.createDataFrame([(many,)], "d string").select(T.source_pieces(F.col("d")).alias("p")).first().p
    assert len(pieces) == 128
