import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quarrykit.functions import metadata
from quarrykit.functions import text as T
from quarrykit.operators import evaluation, reports, traces
from quarrykit.sources import repositories
from quarrykit.streaming import progress


def test_metadata(spark):
    rows = spark.createDataFrame([('{"a": {"b": 1, "x": 2}, "c": "token=abcdef", "z": 1}',), ("[1]",), (None,), ("{",)], "t string")
    got = [json.loads(r.x) for r in rows.select(metadata.allow_listed(["a", "b", "c"])("t").alias("x")).collect()]
    assert got == [{"a": {"b": 1}, "c": "token=[REDACTED]"}, {}, {}, {}]
    assert [r.x for r in rows.select(metadata.is_json_object(F.col("t")).alias("x")).collect()] == [True, False, False, False]
    calls = spark.createDataFrame([("read_file", '{"path": "../x", "start_line": "1", "end_line": 3, "extra": 1}'), ("replace_text", '{"path": "a\\\\b.py", "old_text": "abc", "new_text": ""}')], "n string, t string")
    got = [json.loads(r.x) for r in calls.select(metadata.public_arguments("n", "t").alias("x")).collect()]
    assert got == [{"path": None, "start_line": None, "end_line": 3}, {"path": "a/b.py", "old_text_chars": 3, "new_text_chars": 0, "expected_sha256_present": False}]
    assert metadata.kept({"a": [[[[[1]]]]]}, None) == {"a": [[[[None]]]]} and metadata.kept(float("inf"), None) is None


def test_status(spark):
    text = "## main...origin/main\0R  new.py\0old.py\0?? B.py\0 M a.py\0"
    assert repositories.parse_status(text) == ("main", [(" M", "a.py"), ("??", "B.py"), ("R ", "new.py")], False)
    assert repositories.parse_status("## HEAD (no branch)\0")[0] is None and repositories.parse_status("## No commits yet on dev\0")[0] == "dev"
    assert repositories.parse_status(" M a.py\0 M half", cut=True) == (None, [(" M", "a.py")], True)
    rows = repositories.status_rows(spark.createDataFrame([(1, text, False), (2, "## x\0", False)], "id long, output string, cut boolean")).collect()
    assert len(rows) == 4 and [r.clean for r in rows if r.id == 2] == [True]


def test_archive_and_directory(spark, tmp_path):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode="w") as archive:
        for name, content in (("src/a.py", b"x"), ("src/sub/b.py", b"yy"), ("dist/c.js", b"z"), (".git/config", b"q")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    (tmp_path / "a.tar").write_bytes(data.getvalue())
    files = repositories.archive_files(spark, f"file://{tmp_path}/a.tar")
    assert {(r.relative_path, r.size_bytes) for r in files.collect()} == {("src/a.py", 1), ("src/sub/b.py", 2), ("dist/c.js", 1), (".git/config", 1)}
    assert {(r.path, r.kind) for r in repositories.directory(files).collect()} == {("src", "directory"), ("dist", "directory")}
    assert {(r.path, r.kind, r.size) for r in repositories.directory(files, "", True).collect()} == {("src", "directory", None), ("src/a.py", "file", 1), ("src/sub", "directory", None), ("src/sub/b.py", "file", 2)}
    assert {r.path for r in repositories.directory(files, "src").collect()} == {"src/a.py", "src/sub"}


def test_trace_text(spark):
    runs = spark.createDataFrame([("r", "rag", "succeeded", 1.5, 1, 2, 0, None)], "run_id string, run_type string, status string, duration_ms double, llm_calls int, tool_calls int, mutations int, tokens int")
    events = spark.createDataFrame([("r", 2, "b", None), ("r", 1, "a", '{"k":1}')], "run_id string, sequence int, event_type string, metadata string")
    assert reports.trace_text(runs, events).first().report == 'Run: r\nType: rag\nStatus: succeeded\nDuration: 1.5 ms\nLLM calls: 1\nTool calls: 2\nMutations: 0\nTokens (reported): unknown\n\nTimeline:\n1  a  {"k":1}\n2  b  {}'


def test_comparison(spark):
    rows = spark.createDataFrame([("bm25", "v5", 5, 1.0), ("bm25", "v5", 5, 0.0), ("hybrid", "v5", 10, 1.0)], "strategy string, version string, k int, hit double")
    got = {r.strategy: (r.cases, r.hit, r.problem) for r in reports.comparison(rows, ["version", "k"], ["hit"]).collect()}
    assert got == {"bm25": (2, "0.500", "k"), "hybrid": (1, "1.000", "k")}


def test_gold_spans(spark):
    files = spark.createDataFrame([("a.py", "x = 1\n@d\ndef f():\n    pass\nclass A:\n    def g(self):\n        return 1\n")], "path string, content string")
    targets = spark.createDataFrame([("1", "a.py", "f", None, None), ("2", "a.py", "A.g", None, None), ("3", "a.py", None, 1, 99), ("4", "b.py", "f", None, None), ("5", "a.py", "nope", None, None)], "case_id string, path string, symbol string, first int, last int")
    got = {r.case_id: (r.first_line, r.last_line, r.problem) for r in reports.gold_spans(targets, files).collect()}
    assert got == {"1": (2, 4, None), "2": (6, 7, None), "3": (1, 99, "lines beyond the file"), "4": (None, None, "no such path"), "5": (None, None, "no such symbol")}


def test_agent_checks(spark):
    files = spark.createDataFrame([("c", "a.py", "hello")], "case_id string, path string, content string")
    checks = spark.createDataFrame([("c", "a.py", "contains", "hell"), ("c", "b.py", "absent", ""), ("d", "a.py", "exists", "")], "case_id string, path string, kind string, text string")
    assert {r.case_id: r.passed for r in reports.hidden_checks(files, checks).collect()} == {"c": True, "d": False}
    seen = spark.createDataFrame([("r", 1, 0, True, "a", 1, 2), ("r", 2, 0, True, "a", 1, 2), ("r", 2, 1, True, "b", 1, 2), ("r", 3, 0, False, "c", 1, 2)], "run_id string, iteration int, at int, success boolean, path string, start_line int, end_line int")
    assert [(r.place, r.path) for r in reports.observed_evidence(seen).orderBy("place").collect()] == [(1, "a"), (2, "b")]
    steps = spark.createDataFrame([("r", i, 40) for i in range(5)], "run_id string, iteration int, size int")
    assert {(r.iteration, r.omitted) for r in reports.recent_history(steps, "size", 100).collect()} == {(4, 3), (3, 3)}


def test_best_effort_keeps_refused_batches(spark, tmp_path):
    taken = []

    def sink(batch, number):
        if number:
            raise OSError("full")
        taken.extend(r.x for r in batch.collect())

    put = progress.best_effort(sink, str(tmp_path / "dead"))
    put(spark.createDataFrame([(1,)], "x long"), 0)
    for _ in range(2):  # a batch that is run again replaces its own
        put(spark.createDataFrame([(2,), (3,)], "x long"), 1)
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert taken == [1] and sorted((r.x, r.error, r.batch) for r in dead.collect()) == [(2, "OSError", 1), (3, "OSError", 1)]


def test_hits_and_figures_without_cases(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "a", 4), (2, "b", 3)], "case_id long, item string, rank int")
    gold = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "case_id long, item string")
    assert tuple(evaluation.hit_rates(ranked, gold, [1, 3]).first()) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert tuple(evaluation.hit_rates(ranked, gold.limit(0), [1]).first()) == (0, None)


def test_sets_and_diffs(spark):
    before, after = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long"), spark.createDataFrame([(2,), (3,), (None,)], "k long")
    assert {(r.k, r.state) for r in traces.compared(before, after, ["k"]).collect()} == {(1, "gone"), (2, "kept"), (3, "new"), (None, "kept")}
    rows = spark.createDataFrame([("a", None, False), ("a", "b", True), ("", "b", False), ("x" * 50, None, False)], "u string, s string, t boolean")
    got = [r[0] for r in rows.select(T.whole_diff(F.col("u"), F.col("s"), F.col("t"), 40)).collect()]
    assert got == ["<unstaged_diff>\na\n</unstaged_diff>", None, "<staged_diff>\nb\n</staged_diff>", None]


def test_directory_is_bounded(spark):
    files = spark.createDataFrame([(f"src/{name}.py", 1) for name in ("b", "A", "a", "C")], "relative_path string, size_bytes long")
    rows, more = repositories.directory_listing(files, "src", most=3)
    assert [r.path for r in rows.collect()] == ["src/A.py", "src/a.py", "src/b.py"] and more
    rows, more = repositories.directory_listing(files, "src", most=4)
    assert rows.count() == 4 and not more
