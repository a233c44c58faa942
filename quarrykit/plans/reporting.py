"""Queries over traces' metadata, directories, suites and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions.metadata import allow_listed, call_identity
from quarrykit.functions.text import is_protected_file, whole_diff
from quarrykit.operators import evaluation, ranking, reports
from quarrykit.operators.traces import recovered
from quarrykit.plans.documents import PATH, files
from quarrykit.plans.logs import _EVENTS, trace_events
from quarrykit.plans.registry import query, table
from quarrykit.sources.repositories import directory


@query("SELECT event_id, concat('{\"k\":', CAST(json_extract(props, '$.k') AS INTEGER), '}') AS metadata FROM events")
def metadata_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", allow_listed(["k"])("props").alias("metadata"))


@query(_EVENTS + """, l AS (SELECT run_id, count(*) AS n, string_agg(concat(sequence, '  ', event_type, '  ', '{"k":', k, '}'), chr(10) ORDER BY sequence) AS lines FROM e GROUP BY run_id)
SELECT run_id, sha256(concat('Run: ', run_id, chr(10), 'Type: agent', chr(10), 'Status: succeeded', chr(10), 'Duration: ', n, ' ms', chr(10), 'LLM calls: ', n, chr(10), 'Tool calls: unknown', chr(10), 'Mutations: 0', chr(10), 'Tokens (reported): unknown', chr(10), chr(10), 'Timeline:', chr(10), lines)) AS report_hash FROM l""")
def trace_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = trace_events(spark, sf_dir).withColumn("metadata", F.to_json(F.struct("k")))
    none = F.lit(None).cast("long")
    runs = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("duration_ms")).select("run_id", F.lit("agent").alias("run_type"), F.lit("succeeded").alias("status"), "duration_ms", F.col("duration_ms").alias("llm_calls"), none.alias("tool_calls"), F.lit(0).alias("mutations"), none.alias("tokens"))
    return reports.trace_text(runs, events).select("run_id", F.sha2("report", 256).alias("report_hash"))


@query(f"""WITH f AS (SELECT {PATH} AS p, strlen(text) AS n FROM documents WHERE source = 'src3'), r AS (SELECT string_split(substr(p, 6), '/') AS s, n FROM f)
SELECT DISTINCT concat('src3/', s[1]) AS path, CASE WHEN len(s) = 1 THEN 'file' ELSE 'directory' END AS kind, CASE WHEN len(s) = 1 THEN n END AS size FROM r
UNION SELECT DISTINCT concat('src3/', s[1], '/', s[2]), 'file', n FROM r WHERE len(s) = 2""")
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select(F.col("path").alias("relative_path"), F.octet_length("content").alias("size_bytes"))
    return directory(rows, "src3", True)


@query("SELECT lang AS strategy, count(*) AS cases, format('{:.3f}', avg(quality)) AS quality, format('{:.3f}', avg(toxic)) AS toxic, '' AS problem FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def suite_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("strategy")), "doc_id").withColumn("version", F.lit(1))
    return reports.comparison(rows, ["version"], ["quality", "toxic"])


@query("""WITH c AS (SELECT doc_id AS case_id, contains(text, 'the') AS a, NOT contains(text, 'License') AS b FROM documents) SELECT case_id, a AND b AS passed FROM c""")
def hidden_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"), F.lit("a").alias("path"), F.col("text").alias("content"))
    wanted = F.array(F.struct(F.lit("contains").alias("kind"), F.lit("the").alias("text")), F.struct(F.lit("lacks").alias("kind"), F.lit("License").alias("text")))
    return reports.hidden_checks(rows, rows.select("case_id", "path", F.inline(wanted)))


@query(_EVENTS + ", c AS (SELECT event_type, k, run_id % 3 AS revision FROM e) SELECT sha256(concat('{\"tool\":\"', event_type, '\",\"arguments\":\"', k, '\",\"revision\":', revision, '}')) AS identity, count(*) AS calls FROM c GROUP BY 1")
def call_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = call_identity(F.col("event_type"), F.col("k").cast("string"), F.col("run_id") % 3)
    return trace_events(spark, sf_dir).groupBy(identity.alias("identity")).agg(F.count(F.lit(1)).alias("calls"))


@query("""WITH e AS (SELECT conv_id AS run_id, turn AS iteration, length(text) AS size FROM conversations), t AS (SELECT *, sum(size) OVER (PARTITION BY run_id ORDER BY iteration DESC) AS total, row_number() OVER (PARTITION BY run_id ORDER BY iteration DESC) AS n FROM e),
o AS (SELECT *, count(*) FILTER (WHERE total > 400) OVER (PARTITION BY run_id) AS omitted FROM t) SELECT run_id, iteration, omitted FROM o WHERE total <= 400 OR n = 1""")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("iteration"), F.char_length("text").alias("size"))
    return reports.recent_history(steps, "size", 400).select("run_id", "iteration", "omitted")


@query("SELECT count(*) AS cases, avg(quality) AS quality, avg(toxic) FILTER (WHERE quality = 0) AS toxic_if_bad FROM labels")
def suite_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic_if_bad"), (F.col("quality") == 0).alias("bad"))
    return evaluation.suite_rates(rows, ["quality"], {"toxic_if_bad": "bad"})


@query("SELECT o_custkey, o_orderkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders) WHERE place <= 3")
def latest_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 3, "place").select("o_custkey", "o_orderkey", "place")


_PATHS = "CASE doc_id % 6 WHEN 0 THEN 'src/ConfTest.py' WHEN 1 THEN 'a/pyproject.toml. ' WHEN 2 THEN 'lib/x.pth' WHEN 3 THEN 'conftest.py/x.py' WHEN 4 THEN 'my_ruff.toml' ELSE 'tox.ini' END"


@query(f"SELECT doc_id, doc_id % 6 IN (0, 1, 2, 5) AS protected FROM (SELECT doc_id, {_PATHS} AS path FROM documents)")
def protected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", is_protected_file(F.expr(_PATHS)).alias("protected"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN text <> '' THEN concat('<unstaged_diff>', chr(10), text, chr(10), '</unstaged_diff>', chr(10)) ELSE '' END || concat('<staged_diff>', chr(10), source, chr(10), '</staged_diff>') AS diff FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND length(diff) <= 2000 THEN sha256(diff) END AS diff_hash FROM d""")
def review_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    diff = whole_diff(F.col("text"), F.col("source"), F.col("doc_id") % 3 == 0, 2000)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(diff, 256).alias("diff_hash"))


@query("""WITH g AS (SELECT l_orderkey AS case_id, arg_max(l_partkey, l_extendedprice * 10 - l_linenumber) AS item FROM lineitem GROUP BY l_orderkey),
f AS (SELECT case_id, min(l_linenumber) AS first FROM g JOIN lineitem ON l_orderkey = case_id AND l_partkey = item GROUP BY case_id)
SELECT count(*) AS cases, avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END) AS hit_1, avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END) AS hit_3, avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END) AS hit_5 FROM f""")
def exact_symbol_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("rank"), "l_extendedprice")
    gold = ranked.groupBy("case_id").agg(F.max_by("item", F.col("l_extendedprice") * 10 - F.col("rank")).alias("item"))
    return evaluation.hit_rates(ranked.drop("l_extendedprice"), gold, [1, 3, 5])


@query(_EVENTS + """, r AS (SELECT run_id, run_id % 4 AS mode, count(*) AS n, count(*) FILTER (WHERE event_type = 'view') AS llm, count(*) FILTER (WHERE event_type = 'click') AS tools, count(*) FILTER (WHERE event_type = 'purchase') AS muts,
count(*) FILTER (WHERE event_type = 'error') AS errs, coalesce(min(sequence) FILTER (WHERE event_type = 'error') < max(sequence) FILTER (WHERE event_type = 'purchase'), false) AS rec FROM e GROUP BY run_id),
c AS (SELECT *, muts > 0 AS done, tools > muts AS good, llm > tools AS ver FROM r)
SELECT mode, count(*) AS case_count, round(avg(done::INT), 6) AS workflow_completion_rate, round(avg(good::INT), 6) AS task_success_rate, round(avg((done AND NOT good)::INT), 6) AS false_positive_completion_rate, round(avg(ver::INT), 6) AS verification_pass_rate,
round(avg((rec AND done AND ver)::INT) FILTER (WHERE errs > 0), 6) AS recovery_rate, round(avg(llm), 6) AS mean_llm_calls, round(avg(tools), 6) AS mean_tool_calls, round(avg(muts), 6) AS mean_successful_mutations, round(avg(n), 6) AS mean_agent_iterations,
round(avg(CASE WHEN n % 2 = 0 THEN n END), 6) AS mean_completion_attempts, round(avg((n > 5)::INT), 6) AS planner_generation_rate, round(avg((errs = 0)::INT), 6) AS review_approval_rate, round(avg(errs + 1), 6) AS mean_review_attempts,
round(avg((errs > 0)::INT), 6) AS review_block_rate, count(*) FILTER (WHERE errs > 0 AND NOT good) AS false_positive_prevented_by_review_count FROM c GROUP BY mode""")
def coding_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    events = trace_events(spark, sf_dir)
    counts = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("iterations"), *(F.count_if(kind == k).alias(name) for k, name in (("view", "llm_calls"), ("click", "tool_calls"), ("purchase", "mutations"), ("error", "review_blocks"))))
    runs = counts.join(recovered(events, kind == "error", kind == "purchase"), "run_id")
    failed, good = F.col("review_blocks") > 0, F.col("tool_calls") > F.col("mutations")
    rows = runs.select(
        "*", (F.col("run_id") % 4).alias("mode"), (F.col("mutations") > 0).alias("completed"), good.alias("task_success"), (F.col("llm_calls") > F.col("tool_calls")).alias("verified"), failed.alias("expects_recovery"),
        (F.col("iterations") > 5).alias("planned"), (~failed).alias("review_approved"), (failed & ~good).alias("prevented_by_review"), F.when(F.col("iterations") % 2 == 0, F.col("iterations")).alias("completion_attempts"), (F.col("review_blocks") + 1).alias("review_attempts"),
    )
    return evaluation.coding_report(rows, ["mode"])
