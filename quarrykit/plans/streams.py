"""Registered queries of streams with state of their own, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.plans.registry import query
from quarrykit.streaming import progress, stateful

#: A stream's watermark trails its latest event, by whole milliseconds; what it hasn't passed isn't handed on.
_MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"


@query(f"""SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id
FROM events WHERE ts <= {_MARK}""")
def stream_reordered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    with stateful.state_store(spark):
        return progress.finished(spark, stateful.reordered_log(progress.stream(spark, sf_dir)), "append")


def job_messages(events: DataFrame) -> DataFrame:
    """Events as a queue's messages: a job a user and week, whose events submit, claim, renew, finish, cancel or stop it."""
    k = F.get_json_object("props", "$.k").cast("int")
    week = F.floor((F.dayofmonth("ts") - 1) / 7)
    job = F.col("user_id") * 8 + week
    of_error = F.when(k % 3 == 0, "cancel").when(k % 3 == 1, "stop").otherwise("effect")
    kind = (
        F.when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "beat")
        .when(F.col("event_type") == "purchase", "finish").otherwise(of_error)
    )
    return events.select(
        "ts", F.col("event_id").alias("message_id"), job.alias("job_id"), kind.alias("kind"), F.concat(F.lit("w"), (k % 2).cast("string")).alias("worker"),
        F.when(job % 4 == 0, "coding").otherwise("index").alias("job_type"), F.when(k % 5 == 0, "failed").otherwise("succeeded").alias("outcome"), F.lit("tool_error").alias("error_code"),
    )


# A job's messages one after another: x is the job after its lease's end, if that comes first, y after the message.
_QUEUE = f"""WITH RECURSIVE e AS (
  SELECT event_id, ts, event_type, user_id * 8 + CAST(floor((day(ts) - 1) / 7) AS BIGINT) AS job, CAST(json_extract(props, '$.k') AS INTEGER) AS k
  FROM events WHERE ts <= {_MARK}),
m AS (
  SELECT job, event_id, ts, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS n, concat('w', k % 2) AS worker, job % 4 = 0 AS coding, k % 5 = 0 AS fails,
    CASE event_type WHEN 'signup' THEN 'submit' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'beat' WHEN 'purchase' THEN 'finish'
      ELSE CASE k % 3 WHEN 0 THEN 'cancel' WHEN 1 THEN 'stop' ELSE 'effect' END END AS kind
  FROM e),
s(job, n, status, owner, lease, attempts, cancel, effect, error, ended, ended_as, ended_error, told, changed_at, message) AS (
  SELECT DISTINCT job, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), 0, false, false, CAST(NULL AS VARCHAR),
    CAST(NULL AS TIMESTAMP), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), false, CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT) FROM m
  UNION ALL
  SELECT job, n, CASE act WHEN 'submit' THEN 'queued' WHEN 'claim' THEN 'running' WHEN 'drop' THEN 'cancelled' WHEN 'stop' THEN 'cancelled'
      WHEN 'finish' THEN CASE WHEN fails THEN 'failed' ELSE 'succeeded' END ELSE status END,
    CASE WHEN act = 'claim' THEN worker WHEN act IN ('stop', 'finish') THEN NULL ELSE owner END,
    CASE WHEN act IN ('claim', 'beat') THEN ts + INTERVAL 6 HOUR WHEN act IN ('stop', 'finish') THEN NULL ELSE lease END,
    attempts + CASE WHEN act = 'claim' THEN 1 ELSE 0 END, cancel OR act IN ('drop', 'ask'), effect OR act = 'effect',
    CASE WHEN act = 'finish' AND fails THEN 'tool_error' ELSE error END, ended, ended_as, ended_error, act IN ('submit', 'claim', 'drop', 'stop', 'finish'), ts, event_id
  FROM (
    SELECT *, CASE WHEN status IS NULL THEN CASE WHEN kind = 'submit' THEN 'submit' ELSE '' END
      WHEN status = 'queued' THEN CASE kind WHEN 'claim' THEN 'claim' WHEN 'cancel' THEN 'drop' ELSE '' END
      WHEN status <> 'running' THEN '' WHEN kind = 'cancel' THEN 'ask' WHEN owner <> worker THEN ''
      WHEN kind IN ('beat', 'effect', 'finish') THEN kind WHEN kind = 'stop' AND cancel AND NOT (coding AND effect) THEN 'stop' ELSE '' END AS act
    FROM (
      SELECT m.job, m.n, m.ts, m.event_id, m.kind, m.worker, m.coding, m.fails, s.attempts, s.cancel, s.effect, o.ended, o.ended_as, o.ended_error,
        CASE WHEN o.ended IS NULL THEN s.status ELSE o.ended_as END AS status, CASE WHEN o.ended IS NULL THEN s.owner END AS owner,
        CASE WHEN o.ended IS NULL THEN s.lease END AS lease, CASE WHEN o.ended IS NULL THEN s.error ELSE o.ended_error END AS error
      FROM s JOIN m ON m.job = s.job AND m.n = s.n + 1, LATERAL (
        SELECT CASE WHEN s.lease <= m.ts THEN s.lease END AS ended,
          CASE WHEN m.coding THEN 'failed' WHEN s.cancel THEN 'cancelled' WHEN s.attempts >= 3 THEN 'failed' ELSE 'queued' END AS ended_as,
          CASE WHEN m.coding THEN 'job_interrupted' WHEN s.cancel THEN NULL WHEN s.attempts >= 3 THEN 'job_attempts_exhausted' END AS ended_error) o) x) y),
z AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY n DESC) AS back, job % 4 = 0 AS coding FROM s),
t AS (
  SELECT job, changed_at, message, status, owner, attempts, error FROM s WHERE told
  UNION ALL SELECT job, ended, NULL, ended_as, NULL, attempts - CASE WHEN told AND status = 'running' THEN 1 ELSE 0 END, ended_error FROM s WHERE ended IS NOT NULL
  UNION ALL SELECT job, lease, NULL, CASE WHEN coding THEN 'failed' WHEN cancel THEN 'cancelled' WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END, NULL, attempts,
    CASE WHEN coding THEN 'job_interrupted' WHEN cancel THEN NULL WHEN attempts >= 3 THEN 'job_attempts_exhausted' END
  FROM z WHERE back = 1 AND lease <= {_MARK})"""


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = stateful.job_transitions(job_messages(progress.stream(spark, sf_dir)), lease_us=6 * 3_600_000_000)
    with stateful.state_store(spark):
        return progress.finished(spark, changes, "append")


@query(_QUEUE + "SELECT job AS job_id, changed_at, message AS message_id, status, owner, attempts, error AS error_code FROM t")
def stream_job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transitions(spark, sf_dir).withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))


@query(_QUEUE + """, r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY changed_at DESC, message DESC NULLS LAST) AS back FROM t)
SELECT status, error AS error_code, attempts, count(*) AS jobs FROM r WHERE back = 1 GROUP BY ALL""")
def stream_job_end_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.last_states(_transitions(spark, sf_dir)).groupBy("status", "error_code", "attempts").agg(F.count(F.lit(1)).alias("jobs"))
