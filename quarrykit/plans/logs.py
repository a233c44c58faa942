"""Queries over events, orders, conversations and the star tables: traces, jobs, fusion, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions import text as T
from quarrykit.operators import evaluation, indexing, jobs, ranking, retrieval, traces
from quarrykit.plans.registry import query, table
from quarrykit.streaming import progress

_EVENTS = "WITH e AS (SELECT event_id, user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_type, ts AS timestamp, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)"


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("run_id"), "event_type", F.col("ts").alias("timestamp"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return traces.numbered(rows, "run_id", ["timestamp", "event_id"])


@query("""SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'view') AS llm_calls, count(*) FILTER (WHERE event_type = 'click') AS tool_calls, count(*) FILTER (WHERE event_type = 'purchase') AS mutations,
count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 2) AS total, CASE WHEN count(DISTINCT user_id % 3) = 1 THEN max(user_id % 3) END AS model FROM events GROUP BY user_id""")
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumnRenamed("user_id", "run_id").withColumn("model", F.col("run_id") % 3)
    return traces.rollup(rows, "view", "click", "purchase", ["error"]).withColumn("total", F.round("total", 2))


@query("""WITH r AS (SELECT user_id, user_id % 10 AS grp, count(*) FILTER (WHERE event_type = 'view') AS calls, count(*) FILTER (WHERE event_type = 'view' AND (value >= 1 OR user_id % 10 < 5)) AS reported,
count(*) AS tokens FROM events GROUP BY user_id) SELECT grp, CAST(sum(calls) AS BIGINT) AS calls, CASE WHEN bool_and(calls = reported) AND sum(calls) > 0 THEN CAST(sum(tokens) AS BIGINT) END AS tokens FROM r GROUP BY grp""")
def trace_token_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = F.col("event_type") == "view"
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(view).alias("calls"), F.count_if(view & ((F.col("value") >= 1) | (F.col("user_id") % 10 < 5))).alias("reported"), F.count(F.lit(1)).alias("tokens"))
    return evaluation.all_or_nothing(runs.withColumn("grp", F.col("user_id") % 10), ["grp"], "calls", "reported", "tokens")


@query(_EVENTS + """, s AS (SELECT run_id, min(timestamp) AS started_at FROM e GROUP BY run_id ORDER BY started_at DESC, run_id LIMIT 20)
SELECT e.run_id, started_at, count(*) AS events, string_agg(event_type, ',' ORDER BY sequence) AS types FROM e JOIN s ON e.run_id = s.run_id GROUP BY e.run_id, started_at""")
def trace_listing_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = trace_events(spark, sf_dir)
    runs = events.groupBy("run_id").agg(F.min("timestamp").alias("started_at")).orderBy(F.desc("started_at"), "run_id").limit(20)
    rows = traces.nested(runs, events.join(runs.select("run_id"), "run_id", "left_semi"))
    return rows.select("run_id", "started_at", F.size("events").cast("long").alias("events"), F.array_join(F.transform("events", lambda e: e["event_type"]), ",").alias("types"))


@query(_EVENTS + "SELECT run_id, sequence, CASE WHEN event_type = 'error' THEN 'run.failed' ELSE concat('run.', event_type) END AS event, concat('{\"k\":', k, '}') AS data FROM e WHERE event_type <> 'signup'")
def progress_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "error", "run.failed").otherwise(F.concat(F.lit("run."), F.col("event_type")))
    return trace_events(spark, sf_dir).filter("event_type <> 'signup'").select("run_id", F.col("sequence").cast("long").alias("sequence"), name.alias("event"), F.to_json(F.struct("k")).alias("data"))


@query(_EVENTS + ", g AS (SELECT run_id, sequence, coalesce(lag(sequence) OVER (PARTITION BY run_id ORDER BY sequence), 0) AS after FROM e WHERE k % 7 <> 0) SELECT run_id, CAST(after AS BIGINT) AS after, CAST(sequence - after - 1 AS BIGINT) AS missing FROM g WHERE sequence - after > 1")
def progress_gap_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.gaps(trace_events(spark, sf_dir).filter("k % 7 <> 0").withColumn("sequence", F.col("sequence").cast("long"))).select("run_id", F.col("after").cast("long").alias("after"), F.col("missing").cast("long").alias("missing"))


@query(_EVENTS + """, b AS (SELECT run_id, sequence, event_type, timestamp, first_value(CASE WHEN event_type IN ('purchase', 'error') THEN event_type END IGNORE NULLS) OVER w AS ended_as,
first_value(CASE WHEN event_type IN ('purchase', 'error') THEN timestamp END IGNORE NULLS) OVER w AS t FROM e WINDOW w AS (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT run_id, CAST(sequence AS INTEGER) AS sequence, ended_as, greatest(0, epoch_us(t) - epoch_us(timestamp)) / 1000 AS elapsed_ms FROM b WHERE event_type = 'view' AND ended_as IS NOT NULL""")
def trace_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.bracketed(trace_events(spark, sf_dir), "view", ["purchase", "error"]).filter("ended_as is not null")


@query("SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS \"view\" FROM events GROUP BY user_id")
def tool_call_histogram_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "purchase", "view"]
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run_id")).agg(*(F.count_if(F.col("event_type") == k).alias(k) for k in kinds))


@query(_EVENTS + ", c AS (SELECT run_id, sequence, event_type, k, row_number() OVER (PARTITION BY run_id, event_type, k ORDER BY sequence) AS repeat FROM e) SELECT run_id, CAST(sequence AS INTEGER) AS sequence, CAST(repeat AS INTEGER) AS repeat, repeat >= 2 AS blocked FROM c")
def repeat_call_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.repeats(trace_events(spark, sf_dir), ["event_type", "k"], ["sequence"]).select("run_id", "sequence", "repeat", "blocked")


@query(_EVENTS + "SELECT run_id, CAST(sequence AS INTEGER) AS sequence, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY sequence) AS BIGINT) AS revision FROM e")
def workspace_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_events(spark, sf_dir).withColumn("revision", traces.running_count(F.col("event_type") == "purchase").cast("long")).select("run_id", "sequence", "revision")


@query(_EVENTS + """, s AS (SELECT run_id, sequence, event_type, k, max(CASE WHEN event_type IN ('view', 'click') THEN sequence END) OVER (PARTITION BY run_id ORDER BY sequence) AS at FROM e),
p AS (SELECT s.run_id, s.sequence, CASE WHEN o.event_type = 'view' THEN CAST(o.k AS VARCHAR) END AS pending FROM s LEFT JOIN e o ON o.run_id = s.run_id AND o.sequence = s.at)
SELECT run_id, CAST(sequence AS INTEGER) AS sequence, pending FROM p""")
def grounding_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trace_events(spark, sf_dir).withColumn("k", F.col("k").cast("string"))
    return traces.pending(rows, F.col("event_type") == "view", F.col("event_type") == "click", "k", ["sequence"]).select("run_id", "sequence", "pending")


@query("""WITH f AS (SELECT conv_id, text, min(turn) AS turn FROM conversations WHERE role <> 'system' GROUP BY conv_id, text),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS place FROM f) SELECT conv_id, turn, CAST(place AS INTEGER) AS place, sha256(text) AS text_hash FROM r WHERE place <= 25""")
def observed_evidence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role <> 'system'").groupBy("conv_id", "text").agg(F.min("turn").alias("turn"))
    return ranking.top_k(rows, ["conv_id"], ["turn", "text"], 25, "place").select("conv_id", "turn", "place", F.sha2("text", 256).alias("text_hash"))


_JOBS = """WITH j AS (SELECT o_orderkey AS id, o_custkey AS repository_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'coding' WHEN o_orderpriority LIKE '2%' THEN 'agent' WHEN o_orderpriority LIKE '3%' THEN 'rag' ELSE 'index' END AS job_type,
CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'succeeded' END AS status, o_orderdate AS created_at, o_orderkey % 4 AS attempt_count,
CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 300 SECOND END AS lease_expires_at, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS cancel_requested_at,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END AS side_effect_started_at FROM orders)"""
_NOW = "1997-06-01 00:00:00"


def job_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "1", "coding").when(first == "2", "agent").when(first == "3", "rag").otherwise("index")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("succeeded")
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    none = F.lit(None).cast("timestamp_ntz")
    return o.select(
        key.alias("id"), F.col("o_custkey").alias("repository_id"), kind.alias("job_type"), status.alias("status"), date.alias("created_at"), none.alias("started_at"), none.alias("finished_at"), (key % 4).alias("attempt_count"),
        F.when(status == "running", F.lit("w")).alias("lease_owner"), F.when(status == "running", date + F.expr("INTERVAL 300 SECOND")).alias("lease_expires_at"), F.when(key % 5 == 0, date).alias("cancel_requested_at"),
        none.alias("cancelled_at"), F.when(key % 3 == 0, date).alias("side_effect_started_at"), F.lit(None).cast("string").alias("error_code"),
    )


def now():
    return F.lit(_NOW).cast("timestamp_ntz")


@query(_JOBS + "SELECT id, concat('w', place) AS lease_owner, CAST(attempt_count + 1 AS BIGINT) AS attempt_count FROM (SELECT *, row_number() OVER (ORDER BY created_at, id) AS place FROM j WHERE status = 'queued') WHERE place <= 3")
def job_claim_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = jobs.claimed(job_rows(spark, sf_dir), ["w1", "w2", "w3"], now())
    return claimed.filter("status = 'running' and lease_owner <> 'w'").select("id", "lease_owner", "attempt_count")


@query(_JOBS + "SELECT id, repository_id, created_at FROM j WHERE status = 'queued' AND job_type = 'rag' ORDER BY created_at DESC, id LIMIT 50")
def job_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.listed(job_rows(spark, sf_dir), 50, "queued", "rag").select("id", "repository_id", "created_at")


@query(_JOBS + f"""SELECT id, CASE WHEN NOT (status = 'running' AND lease_expires_at <= TIMESTAMP '{_NOW}') THEN status WHEN job_type = 'coding' THEN 'failed' WHEN cancel_requested_at IS NOT NULL THEN 'cancelled' WHEN attempt_count >= 3 THEN 'failed' ELSE 'queued' END AS status,
CASE WHEN status = 'running' AND lease_expires_at <= TIMESTAMP '{_NOW}' THEN CASE WHEN job_type = 'coding' THEN 'job_interrupted' WHEN cancel_requested_at IS NULL AND attempt_count >= 3 THEN 'job_attempts_exhausted' END END AS error_code FROM j""")
def job_recover_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recovered(job_rows(spark, sf_dir), now()).select("id", "status", "error_code")


@query(_JOBS + """SELECT CASE WHEN job_type = 'coding' AND side_effect_started_at IS NOT NULL AND cancel_requested_at IS NOT NULL THEN 'deferred' WHEN status = 'succeeded' OR (job_type = 'coding' AND side_effect_started_at IS NOT NULL) THEN 'unavailable'
WHEN cancel_requested_at IS NOT NULL THEN 'requested' ELSE 'available' END AS state, count(*) AS jobs FROM j GROUP BY 1""")
def job_cancel_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_rows(spark, sf_dir).groupBy(jobs.cancellation_state().alias("state")).agg(F.count(F.lit(1)).alias("jobs"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 11 <> 0 AS requested, o_orderkey % 4 AS revision, o_orderkey % 5 <> 0 AS tests_passed, o_orderkey % 3 AS tests_revision, o_orderkey % 7 <> 0 AS ruff_passed, o_orderkey % 4 AS ruff_revision,
o_orderkey % 13 <> 0 AS diff_available, CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS unexpected, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN 'changes_required' ELSE 'approved' END AS verdict, o_orderkey % 4 AS rr FROM orders)
SELECT id, concat_ws(',', CASE WHEN NOT requested THEN 'not_requested' END, CASE WHEN NOT tests_passed THEN 'tests_failed' END, CASE WHEN tests_passed AND tests_revision <> revision THEN 'tests_stale' END, CASE WHEN NOT ruff_passed THEN 'ruff_failed' END,
CASE WHEN NOT diff_available THEN 'diff_missing' END, CASE WHEN unexpected > 0 THEN 'unexpected_files' END, CASE WHEN verdict IS NULL THEN 'review_missing' END, CASE WHEN verdict = 'changes_required' THEN 'review_requires_changes' END) AS blockers FROM r""")
def completion_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    verdict = F.when(k % 6 == 0, None).when(k % 6 == 1, "changes_required").otherwise("approved")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 11 != 0).alias("requested"), (k % 4).alias("revision"), (k % 5 != 0).alias("tests_passed"), (k % 3).alias("tests_revision"), (k % 7 != 0).alias("ruff_passed"), (k % 4).alias("ruff_revision"), (k % 13 != 0).alias("diff_available"), F.when(k % 17 == 0, 1).otherwise(0).alias("unexpected_files"), verdict.alias("review_verdict"), (k % 4).alias("review_revision"))
    return rows.select("id", F.array_join(jobs.completion_blockers(), ",").alias("blockers"))


@query("SELECT o_orderkey, count(l_orderkey) AS chunk_count FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def manifest_file_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("relative_path"), F.lit("").alias("content_hash"))
    counted = indexing.manifest(files, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relative_path")))
    return counted.select(F.col("relative_path").alias("o_orderkey"), "chunk_count")


@query("SELECT count(DISTINCT l_orderkey) AS files, count(*) AS chunks, min(l_returnflag) AS model FROM lineitem")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexing.summary(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("relative_path"), F.col("l_returnflag").alias("model")))


_SYMBOLS = """WITH c AS (SELECT concat('src/', lower(p_type), '/', p_brand, '.py') AS path, p_partkey AS chunk_index, replace(p_name, ' ', '_') AS symbol, concat(p_brand, '.', replace(p_name, ' ', '_')) AS qualified FROM part),
w(identifier, qualified, strong) AS (VALUES ('Brand#1.red_widget', true, true), ('small_ring', false, true), ('red_widget', false, true), ('blue_bolt', false, false)),
n AS (SELECT path, chunk_index, qualified AS identity, qualified AS identifier, true AS q FROM c UNION ALL SELECT path, chunk_index, qualified, symbol, false FROM c),
f AS (SELECT n.path, n.chunk_index, n.identity, n.identifier, CASE WHEN w.qualified THEN 0 WHEN w.strong THEN 1 ELSE 2 END AS tier FROM n JOIN w ON n.identifier = w.identifier AND n.q = w.qualified),
b AS (SELECT *, row_number() OVER (PARTITION BY path, chunk_index ORDER BY tier, identifier) AS r FROM f), d AS (SELECT *, row_number() OVER (PARTITION BY path, identity ORDER BY tier, chunk_index) AS s FROM b WHERE r = 1),
o AS (SELECT *, row_number() OVER (ORDER BY tier, path, chunk_index) AS rank FROM d WHERE s = 1)"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    chunks = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.col("p_brand"), F.lit(".py")).alias("path"), F.col("p_partkey").alias("chunk_index"), name.alias("symbol"), F.concat("p_brand", F.lit("."), name).alias("qualified"))
    wanted = spark.createDataFrame([(1, "Brand#1.red_widget", True, True), (1, "small_ring", False, True), (1, "red_widget", False, True), (1, "blue_bolt", False, False)], "query_id long, identifier string, qualified boolean, strong boolean")
    return retrieval.symbol_search(chunks, wanted, 50).drop("identity")


@query(_SYMBOLS + "SELECT CAST(1 AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(tier AS INTEGER) AS tier, identifier, path, chunk_index FROM o WHERE rank <= 50")
def symbol_tier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _symbols(spark, sf_dir)


@query(_SYMBOLS + ", k AS (SELECT * FROM o WHERE rank <= 50 AND (tier < 2 OR chunk_index % 2 = 0)) SELECT CAST(row_number() OVER (ORDER BY rank) AS INTEGER) AS rank, CAST(tier AS INTEGER) AS tier, path, chunk_index FROM k")
def symbol_weak_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.lit(1).cast("long").alias("query_id"), F.col("p_partkey").alias("chunk_index"))
    return retrieval.corroborated(_symbols(spark, sf_dir), ranked, ["chunk_index"]).select("rank", "tier", "path", "chunk_index")


def _lists(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("query_id"), F.col("c_custkey").alias("item"), "c_acctbal", "c_name", "c_mktsegment")
    of = lambda *order: ranking.top_k(rows, ["query_id"], list(order), 20).select("query_id", "item", "rank")
    return {"a": of(F.desc("c_acctbal"), "item"), "b": of("item"), "c": of("c_mktsegment", "item")}


def _rrf_sql(names: str) -> str:
    order = {"a": "c_acctbal DESC, c_custkey", "b": "c_custkey", "c": "c_mktsegment, c_custkey"}
    lists = ", ".join(f"{n} AS (SELECT * FROM (SELECT c_nationkey AS q, c_custkey AS item, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY {order[n]}) AS INTEGER) AS rank FROM customer) WHERE rank <= 20)" for n in names)
    union = " UNION ALL ".join(f"SELECT q, item, {', '.join(('rank' if m == n else 'NULL') + f' AS {m}_rank' for m in names)} FROM {n}" for n in names)
    return f"""WITH {lists}, u AS ({union}), g AS (SELECT q, item, {', '.join(f'max({n}_rank) AS {n}_rank' for n in names)} FROM u GROUP BY q, item),
s AS (SELECT *, {' + '.join(f'coalesce(1 / (60 + {n}_rank), 0)' for n in names)} AS score FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, least({', '.join(f'{n}_rank' for n in names)}), item) AS rank FROM s)
SELECT CAST(q AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, item, round(score, 9) AS score, {', '.join(f'{n}_rank' for n in names)} FROM r WHERE rank <= 10"""


@query(_rrf_sql("ab"))
def rrf_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _lists(spark, sf_dir)
    return retrieval.fused({n: lists[n] for n in "ab"}, ["item"], 10)


@query(_rrf_sql("abc"))
def rrf_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fused(_lists(spark, sf_dir), ["item"], 10)


@query("""WITH p AS (SELECT n_nationkey AS k, concat('r', n_regionkey, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE concat('/n', n_nationkey) END) AS path FROM nation)
SELECT a.k AS a, b.k AS b FROM p a JOIN p b ON a.k < b.k AND (a.path = b.path OR starts_with(b.path, a.path || '/') OR starts_with(a.path, b.path || '/'))""")
def path_overlap_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths overlap only where their first steps are the same, so that is the join's key."""
    tail = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.concat(F.lit("/n"), F.col("n_nationkey").cast("string")))
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), tail).alias("path")).withColumn("root", F.substring_index("path", "/", 1))
    a, b = p.select(F.col("k").alias("a"), F.col("path").alias("pa"), "root"), p.select(F.col("k").alias("b"), F.col("path").alias("pb"), "root")
    return a.join(b, "root").filter((F.col("a") < F.col("b")) & T.paths_overlap(F.col("pa"), F.col("pb"))).select("a", "b")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.finished(spark, progress.event_counts(progress.stream(spark, sf_dir)), "complete").withColumn("total", F.round("total", 2))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.finished(spark, progress.windowed(progress.stream(spark, sf_dir), "1 hour"), "complete").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.finished(spark, progress.sessions(progress.stream(spark, sf_dir), "30 minutes"), "complete").withColumn("started", F.col("started").cast("timestamp_ntz"))


@query(_EVENTS + "SELECT run_id, CAST(sequence AS BIGINT) AS sequence, event_id FROM e")
def stream_ordered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.finished(spark, progress.ordered_log(progress.stream(spark, sf_dir)), "append")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def job_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.one(table(spark, sf_dir, "orders"), o_orderkey=7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, least(0.5 * pow(2, o_orderkey % 10), 30.0) AS seconds FROM orders")
def job_back_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", jobs.back_off(F.col("o_orderkey") % 10, 0.5, 30).alias("seconds"))


@query(_EVENTS + "SELECT run_id, coalesce(min(sequence) FILTER (WHERE event_type = 'error') < max(sequence) FILTER (WHERE event_type = 'purchase'), false) AS recovered FROM e GROUP BY run_id")
def failure_before_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.recovered(trace_events(spark, sf_dir), F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("""WITH b AS (SELECT DISTINCT l_suppkey AS run, l_partkey AS part FROM lineitem WHERE l_linenumber <= 3), f AS (SELECT DISTINCT l_suppkey AS run, l_partkey AS part FROM lineitem WHERE l_linenumber >= 3)
SELECT coalesce(b.run, f.run) AS run, coalesce(b.part, f.part) AS part, CASE WHEN f.run IS NULL THEN 'gone' WHEN b.run IS NULL THEN 'new' ELSE 'kept' END AS state FROM b FULL JOIN f ON b.run = f.run AND b.part = f.part""")
def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_partkey").alias("part"), "l_linenumber")
    return traces.compared(rows.filter("l_linenumber <= 3"), rows.filter("l_linenumber >= 3"), ["run", "part"])


@query("""(SELECT o_custkey AS trace_id, 'gone' AS state FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey, 'gone' FROM orders WHERE o_orderstatus = 'O')
UNION ALL (SELECT o_custkey, 'new' FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey, 'new' FROM orders WHERE o_orderstatus = 'F')""")
def trace_id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "trace_id")
    return traces.compared(ids.filter("o_orderstatus = 'F'"), ids.filter("o_orderstatus = 'O'"), ["trace_id"]).filter("state <> 'kept'")


@query(_EVENTS + """, z AS (SELECT *, coalesce(count(*) FILTER (WHERE event_type IN ('purchase', 'error')) OVER (PARTITION BY run_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM e)
SELECT run_id, event_id, event_type FROM z WHERE ended = 0""")
def stream_until_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.finished(spark, progress.until_end(progress.stream(spark, sf_dir), ["purchase", "error"]), "append")


@query("""WITH o AS (SELECT user_id, ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts + INTERVAL 30 MINUTE, true) AS last, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events) AS mark FROM events)
SELECT user_id, ts + INTERVAL 30 MINUTE AS expired_at FROM o WHERE last AND ts + INTERVAL 30 MINUTE <= mark""")
def stream_expired_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = progress.finished(spark, progress.expired_leases(progress.stream(spark, sf_dir), "30 minutes"), "append")
    return rows.select("user_id", F.col("expired_at").cast("timestamp_ntz").alias("expired_at"))


@query("WITH m AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN left(props, length(props) - 1) ELSE props END AS value FROM events) SELECT event_id, CAST(json_extract(value, '$.k') AS INTEGER) AS k FROM m WHERE json_valid(value)")
def stream_malformed_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.when(F.col("event_id") % 7 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    rows = progress.parsed(progress.stream(spark, sf_dir).withColumn("value", cut), "value", "k int")
    return progress.finished(spark, rows.select("event_id", F.col("message.k").alias("k")), "append")
