"""Reports: a run's trace as text, suites side by side, gold spans by name, and checks of what an agent did."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrykit.operators.ranking import keep_first, top_k


def trace_text(runs: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, report: a head, then a line an event. runs: run_id, run_type, status, duration_ms, llm_calls, tool_calls, mutations, tokens; events:
    run_id, sequence, event_type, metadata (JSON)."""
    line = F.concat(F.col("sequence").cast("string"), F.lit("  "), F.col("event_type"), F.lit("  "), F.coalesce("metadata", F.lit("{}")))
    lines = events.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", line.alias("line")))), lambda e: e["line"]), "\n").alias("lines"))
    named = [("Run", "run_id"), ("Type", "run_type"), ("Status", "status"), ("Duration", "duration_ms"), ("LLM calls", "llm_calls"), ("Tool calls", "tool_calls"), ("Mutations", "mutations"), ("Tokens (reported)", "tokens")]
    head = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown")), F.lit(" ms" if c == "duration_ms" else "")) for name, c in named]
    return runs.join(lines, "run_id", "left").select("run_id", F.concat_ws("\n", *head, F.lit(""), F.lit("Timeline:"), F.col("lines")).alias("report"))


def comparison(reports: DataFrame, same: list[str], metrics: list[str]) -> DataFrame:
    """A row a strategy with its metrics to three places; reports of another version, mode or k than the others' are an error that the row names."""
    one = reports.agg(F.array_compact(F.array(*(F.when(F.countDistinct(c) > 1, F.lit(c)) for c in same))).alias("differ"))
    rows = reports.groupBy("strategy").agg(F.count(F.lit(1)).alias("cases"), *(F.format_number(F.avg(F.col(m).cast("double")), 3).alias(m) for m in metrics))
    return rows.withColumn("problem", F.array_join(one.scalar(), ","))


def _definition(body: list[ast.stmt], steps: list[str]):
    for node in body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and node.name == steps[0]:
            return node if len(steps) == 1 else _definition(node.body, steps[1:])
    return None


def gold_spans(targets: DataFrame, files: DataFrame) -> DataFrame:
    """case_id, path, first_line, last_line, label, problem of targets (case_id, path, symbol or first and last). A symbol's lines begin at its
    first decorator; a path, symbol or line that isn't there is a problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for case, path, symbol, first, last, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                label = f"{path}::{symbol}" if symbol is not None else f"{path}#L{first}-L{last}"
                problem = None
                if content is None:
                    problem = "no such path"
                elif symbol is None:
                    problem = "lines beyond the file" if last > len(content.splitlines()) else None
                else:
                    try:
                        node = _definition(ast.parse(content).body, symbol.split("."))
                        problem = "no such symbol" if node is None else None
                        if node is not None:
                            first, last = min([node.lineno, *(d.lineno for d in node.decorator_list)]), node.end_lineno
                    except (SyntaxError, ValueError):
                        problem = "file doesn't parse"
                rows.append((case, path, first, last, label, problem))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["case_id", "path", "first_line", "last_line", "label", "problem"])

    joined = targets.join(files.select("path", "content"), "path", "left").select("case_id", "path", "symbol", F.col("first").cast("int"), F.col("last").cast("int"), "content")
    return joined.mapInArrow(run, "case_id string, path string, first_line int, last_line int, label string, problem string")


def observed_evidence(observations: DataFrame, most: int = 25) -> DataFrame:
    """run_id, place, path, start_line, end_line of what successful steps saw, each once, in order, at most most of them. observations: run_id,
    iteration, at, success, path, start_line, end_line."""
    keys = ["run_id", "path", "start_line", "end_line"]
    return top_k(keep_first(observations.filter("success"), keys, ["iteration", "at"]), ["run_id"], ["iteration", "at"], most, "place").select("run_id", "place", "path", "start_line", "end_line")


def hidden_checks(files: DataFrame, checks: DataFrame) -> DataFrame:
    """case_id, passed: every check holds. checks: case_id, path, kind (exists, absent, contains, lacks), text; files: case_id, path, content."""
    joined = checks.join(files, ["case_id", "path"], "left")
    there, has = F.col("content").isNotNull(), F.coalesce(F.contains("content", F.col("text")), F.lit(False))
    holds = F.when(F.col("kind") == "exists", there).when(F.col("kind") == "absent", ~there).when(F.col("kind") == "contains", has).when(F.col("kind") == "lacks", there & ~has)
    return joined.groupBy("case_id").agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("passed"))


def recent_history(steps: DataFrame, size: str, most: int, marker: int = 0) -> DataFrame:
    """Of each run the newest steps whose sizes fit most, oldest first; omitted counts the others."""
    newest = Window.partitionBy("run_id").orderBy(F.desc("iteration"))
    total = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = steps.withColumn("__total", total).withColumn("omitted", F.count_if(F.col("__total") > most - marker).over(Window.partitionBy("run_id")))
    return rows.withColumn("__n", F.row_number().over(newest)).filter((F.col("__total") <= most - marker) | (F.col("__n") == 1)).drop("__total", "__n")
