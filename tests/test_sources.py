from pyspark.sql import functions as F

from quarrykit.sources import files, tables


def test_ingest(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    made = {"src/a.py": b"x = 1\ny\n", "src/b.md": b"\xef\xbb\xbfhi", "src/c.py": b"caf\xe9", "src/d.py": b"a\x00b", "src/e.exe": b"x", "src/f.py": b"\x81", "node_modules/g.js": b"x", "src/skip.py": b"x", "src/big.py": b"x" * 50}
    for name, data in made.items():
        (root / name).write_bytes(data)
    sources, skipped = files.ingest(files.scan(spark, f"file://{root}"), ("skip*",), 40)
    got = {r.relative_path: (r.language, r.content, r.line_count) for r in sources.collect()}
    assert got == {"src/a.py": ("python", "x = 1\ny\n", 2), "src/b.md": ("markdown", "hi", 1), "src/c.py": ("python", "café", 1)}
    assert {r.relative_path: r.reason for r in skipped.collect()} == {"src/d.py": "binary", "src/e.exe": "unsupported", "src/f.py": "undecodable", "node_modules/g.js": "ignored directory", "src/skip.py": "ignored pattern", "src/big.py": "too large"}
    shot = files.snapshot(sources).first()
    assert shot.file_count == 3 and shot.languages == {"markdown": 1, "python": 2}
    piece = files.read_lines(sources, "src/a.py", 2, 9).first()
    assert (piece.content, piece.end_line) == ("y\n", 2) and not files.read_lines(sources, "src/a.py", 3).collect()


def test_versions(spark, tmp_path):
    table = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    rows = lambda *r: spark.createDataFrame(list(r), "relative_path string, v int")
    table.replace(rows(("a", 1), ("b", 1)), "f1")
    tables.apply_update(table, rows(("b", 2), ("c", 2)), rows(("b", 0), ("c", 0), ("a", 0)).filter("relative_path <> 'a'"), "f1")
    assert {(r.relative_path, r.v) for r in table.read().collect()} == {("a", 1), ("b", 2), ("c", 2)}
    tables.apply_update(table, rows(("z", 9)), rows(("z", 9)), "f2")
    assert {(r.relative_path, r.v) for r in table.read().collect()} == {("z", 9)} and table.compatible("f2") and not table.compatible(None)


def test_trace_sink(spark, tmp_path):
    runs = spark.createDataFrame([("r", "succeeded")], "run_id string, status string")
    events = spark.createDataFrame([("r", 2, "b"), ("r", 1, "a")], "run_id string, sequence int, event_type string")
    tables.append_trace(runs, events, f"file://{tmp_path}/traces")
    assert spark.read.parquet(f"file://{tmp_path}/traces/events").count() == 2
    try:
        tables.append_trace(runs.withColumn("status", F.lit("running")), events, f"file://{tmp_path}/traces")
        raise AssertionError
    except ValueError:
        pass
