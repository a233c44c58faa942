"""Streams with state of their own: events dealt over batches, sent again, late, or without what they need."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarrykit.plans import registry, streams
from quarrykit.streaming import progress, stateful

EVENTS = "/root/testdata/sf0.001/events.parquet"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def dealt(tmp_path_factory):
    """A folder of batches: each event up to 50 minutes after its time, every third batch sent again at the end or a batch later."""
    folder = tmp_path_factory.mktemp("dealt")
    rows, rng = pq.read_table(EVENTS).to_pylist(), random.Random(5)
    rows.sort(key=lambda r: r["ts"] + timedelta(minutes=rng.uniform(0, 50)))
    step = len(rows) // 6 + 1
    batches = [rows[i : i + step] for i in range(0, len(rows), step)]
    batches = [*batches[:2], batches[1] + batches[2], *batches[3:], batches[0], batches[3]]
    for i, batch in enumerate(batches):
        at = folder / f"events-{i}.parquet"
        pq.write_table(pa.Table.from_pylist(batch, schema=pq.read_schema(EVENTS)), at)
        os.utime(at, (1_700_000_000 + i * 60,) * 2)
    return str(folder)


def batchwise(spark, folder, watermark="1 hour"):
    rows = spark.readStream.schema(progress.EVENTS).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def oracle(sql):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{EVENTS}')")
    return con.sql(sql).fetchall()


def ran(spark, df):
    with stateful.state_store(spark):
        return progress.finished(spark, df, "append")


def test_log_over_shuffled_batches(spark, dealt):
    got = ran(spark, stateful.reordered_log(batchwise(spark, dealt)))
    want = oracle(registry.SQL["stream_reordered_log"])
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 900


def test_jobs_over_shuffled_batches(spark, dealt):
    got = ran(spark, stateful.job_transitions(streams.job_messages(batchwise(spark, dealt)), 6 * 3_600_000_000))
    rows = [(r.job_id, r.changed_at, r.message_id, r.status, r.owner, r.attempts, r.error_code) for r in got.withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz")).collect()]
    want = oracle(registry.SQL["stream_job_transitions"])
    assert sorted(map(str, rows)) == sorted(map(str, want))
    seen = {(r[3], r[6]) for r in want}
    assert {("queued", None), ("running", None), ("succeeded", None), ("failed", "job_interrupted"), ("cancelled", None)} <= seen


def messages(spark, folder, *batches):
    """Batches of (minute, message, job, kind, worker), as a stream of one a trigger, with a last one that moves the watermark on."""
    fields = [("ts", pa.timestamp("us", "UTC")), ("message_id", pa.int64()), ("job_id", pa.int64()), ("kind", pa.string()), ("worker", pa.string()), ("job_type", pa.string()), ("outcome", pa.string()), ("error_code", pa.string())]
    for i, batch in enumerate([*batches, [(1_000_000, 10**6, 10**6, "beat", "w")]]):
        rows = [(None if m is None else START + timedelta(minutes=m), n, job, kind, worker, "coding" if job == 4 else "index", "failed" if n == 77 else "succeeded", "why") for m, n, job, kind, worker in batch]
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], t) for _, t in fields]
        pq.write_table(pa.table(columns, names=[n for n, _ in fields]), f"{folder}/m-{i}.parquet")
        os.utime(f"{folder}/m-{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema("ts timestamp, " + stateful.MESSAGES).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", "10 minutes")


def told(df):
    rows = df.orderBy("job_id", "changed_at", F.asc_nulls_first("message_id")).collect()
    return [(r.job_id, round((r.changed_at - START).total_seconds() / 60), r.message_id, r.status, r.owner, r.attempts, r.error_code) for r in rows]


def test_job_rules(spark, tmp_path):
    m = messages(
        spark, tmp_path,
        # 1: claimed by the first to ask, renewed by its owner alone; the lease ends before the message of the same time, so the job is queued, claimed anew and ends.
        [(0, 1, 1, "submit", None), (2, 3, 1, "claim", "b"), (1, 2, 1, "claim", "a"), (3, 4, 1, "beat", "a"), (4, 5, 1, "beat", "b"), (8, 6, 1, "claim", "b"), (9, 77, 1, "finish", "b"), (10, 8, 1, "claim", "a")],
        # 2: runs too often. 3: asked to stop, stopped. 4: coding, with side effects, isn't stopped and is interrupted.
        [(20, 20, 2, "submit", None), (21, 21, 2, "claim", "a"), (27, 22, 2, "claim", "a"), (40, 30, 3, "submit", None), (41, 31, 3, "claim", "a"), (42, 32, 3, "stop", "a"), (43, 33, 3, "cancel", None), (44, 34, 3, "stop", "b"), (45, 35, 3, "stop", "a"),
         (50, 40, 4, "submit", None), (51, 41, 4, "claim", "a"), (52, 42, 4, "effect", "a"), (53, 43, 4, "cancel", None), (54, 44, 4, "stop", "a")],
        [],
        # 5: cancelled while it waits; what is sent again, is late, or lacks its time or number changes nothing.
        [(60, 50, 5, "submit", None), (61, 51, 5, "cancel", None), (61, 51, 5, "cancel", None), (62, 52, 5, "claim", "a"), (None, 53, 5, "submit", None), (63, None, 5, "submit", None), (64, 54, 6, "claim", "a"), (1, 2, 1, "claim", "a")],
    )
    got = told(ran(spark, stateful.job_transitions(m, 5 * 60_000_000, 2)).filter("job_id < 100"))
    assert got == [
        (1, 0, 1, "queued", None, 0, None), (1, 1, 2, "running", "a", 1, None), (1, 8, None, "queued", None, 1, None), (1, 8, 6, "running", "b", 2, None), (1, 9, 77, "failed", None, 2, "why"),
        (2, 20, 20, "queued", None, 0, None), (2, 21, 21, "running", "a", 1, None), (2, 26, None, "queued", None, 1, None), (2, 27, 22, "running", "a", 2, None), (2, 32, None, "failed", None, 2, "job_attempts_exhausted"),
        (3, 40, 30, "queued", None, 0, None), (3, 41, 31, "running", "a", 1, None), (3, 45, 35, "cancelled", None, 1, None),
        (4, 50, 40, "queued", None, 0, None), (4, 51, 41, "running", "a", 1, None), (4, 56, None, "failed", None, 1, "job_interrupted"),
        (5, 60, 50, "queued", None, 0, None), (5, 61, 51, "cancelled", None, 0, None),
    ]


def test_jobs_that_are_there_already(spark, tmp_path):
    us = int((START - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    there = [(1, "running", "index", "a", us + 60_000_000, 1, True, False, None, None), (2, "queued", "index", None, None, 1, False, False, None, None), (3, "succeeded", "index", None, None, 1, False, False, None, us)]
    initial = spark.createDataFrame(there, "job_id long, " + stateful.JobQueue.state_schema)
    m = messages(spark, tmp_path, [(5, 1, 2, "claim", "a"), (6, 2, 2, "finish", "a"), (7, 3, 3, "claim", "a")], [(30, 4, 3, "submit", None), (90, 5, 3, "submit", None)])
    got = told(ran(spark, stateful.job_transitions(m, 5 * 60_000_000, keep_us=60 * 60_000_000, initial=initial)).filter("job_id < 100"))
    # A lease that ended while no message came; a job that ended is forgotten an hour later, and may be submitted again.
    assert got == [(1, 1, None, "cancelled", None, 1, None), (2, 5, 1, "running", "a", 2, None), (2, 6, 2, "succeeded", None, 2, None), (3, 90, 5, "queued", None, 0, None)]


def test_last_states(spark):
    rows = [(1, 0, 1, "queued", None, 0, None), (1, 5, None, "queued", None, 1, None), (1, 5, 6, "running", "b", 2, None), (2, 3, 9, "queued", None, 0, None)]
    made = spark.createDataFrame(rows, "job_id long, m long, message_id long, status string, owner string, attempts int, error_code string").withColumn("changed_at", F.timestamp_seconds("m"))
    assert {(r.job_id, r.status, r.attempts) for r in stateful.last_states(made).collect()} == {(1, "running", 2), (2, "queued", 0)}


def test_setting_is_restored(spark):
    before = spark.conf.get(stateful._PROVIDER, None)
    with stateful.state_store(spark):
        assert "RocksDB" in spark.conf.get(stateful._PROVIDER)
    assert spark.conf.get(stateful._PROVIDER, None) == before


def many(spark, folder, batches):
    """Batches of (second, event_id, run) as a stream of one a trigger; the last event moves the watermark on."""
    fields = [("ts", pa.timestamp("us", "UTC")), ("event_id", pa.int64()), ("user_id", pa.int64())]
    for i, batch in enumerate([*batches, [(10**7, -1, 10**6)]]):
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*((START + timedelta(seconds=s), n, run) for s, n, run in batch), strict=True), fields, strict=True)]
        pq.write_table(pa.table(columns, names=[n for n, _ in fields]), f"{folder}/e-{i}.parquet")
        os.utime(f"{folder}/e-{i}.parquet", (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema("ts timestamp, event_id long, user_id long").option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", "10 minutes")


def test_neighbouring_keys_share_calls_to_state(spark, tmp_path):
    """As many timers and rows of state as pages, not as jobs."""
    jobs = 10 << stateful.JOB_BITS
    m = messages(spark, tmp_path, [(0, i, i, "submit", None) for i in range(jobs)] + [(1, jobs + i, i, "claim", "a") for i in range(jobs)])
    with stateful.state_store(spark):
        asked = stateful.job_transitions(m).writeStream.format("memory").queryName("shared").outputMode("append").trigger(availableNow=True).start()
        asked.awaitTermination()
    used = [p["stateOperators"][0] for p in asked.recentProgress if p["stateOperators"]]
    assert max(u["customMetrics"]["numRegisteredTimers"] for u in used) <= 11 and max(u["numRowsTotal"] for u in used) < jobs
    told = {r.status: r["count"] for r in spark.table("shared").filter("job_id < 1000000").groupBy("status").count().collect()}
    assert told == {"queued": 2 * jobs - 1, "running": jobs, "failed": 1}  # leases end; job 4 is one of coding


@pytest.mark.parametrize("bits", [0, 2, 62])
def test_pages_of_any_width_give_the_same(spark, dealt, monkeypatch, bits):
    monkeypatch.setattr(stateful, "JOB_BITS", bits)
    monkeypatch.setattr(stateful, "RUN_BITS", bits)
    got = ran(spark, stateful.job_transitions(streams.job_messages(batchwise(spark, dealt)), 6 * 3_600_000_000)).withColumn("changed_at", F.col("changed_at").cast("timestamp_ntz"))
    assert sorted(str((r.job_id, r.changed_at, r.message_id, r.status, r.owner, r.attempts, r.error_code)) for r in got.collect()) == sorted(map(str, oracle(registry.SQL["stream_job_transitions"])))
    assert sorted(map(tuple, ran(spark, stateful.reordered_log(batchwise(spark, dealt))).collect())) == sorted(oracle(registry.SQL["stream_reordered_log"]))


def test_long_and_far_runs(spark, tmp_path):
    """More events than go to state or leave it at once, before and behind the watermark; an id is its run's own; keys at the ends of what is a key."""
    rows = [(i // 20, i, 5) for i in range(9000)]
    random.Random(3).shuffle(rows)
    far = (4, -1, 2**53 + 1, 2**63 - 1, -(2**63))
    got = ran(spark, stateful.reordered_log(many(spark, tmp_path, [rows[:4500], rows[4500:] + [(s, s, run) for s in (2, 1, 3) for run in far], [(700, 9999, 5)]])))
    seen = {}
    for r in got.filter("run_id <> 1000000").orderBy("run_id", "sequence").collect():
        seen.setdefault(r.run_id, []).append((r.sequence, r.event_id))
    assert seen.pop(5) == list(enumerate([*range(9000), 9999], 1))
    assert seen == {run: [(1, 1), (2, 2), (3, 3)] for run in far}
