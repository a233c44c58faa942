"""Streams whose events are taken in the order of their times, whatever batches they come in: a numbered log, and a queue of jobs with leases.

Each key keeps what the watermark hasn't passed yet. Once it has, nothing older can come (Spark drops it as late), so what is kept is
sorted, freed of repeated ids, and handed to the key's state machine; a timer in event time wakes it at its next event or
deadline. Results so don't depend on how events are dealt over batches, and a message that is sent again changes nothing: either its id
is still among the kept ones, or it is late.

Each call to Spark's state is a message between two processes, so keys share them: a page of neighbouring keys (those that are equal without
their last bits) is Spark's group, with one timer, lists of events that wait and one row of its keys' states, all in columns. Keys without neighbours
are pages of their own.

A page's events of one trigger are sorted in its task's memory; maxFilesPerTrigger or maxBytesPerTrigger bound them, and narrower pages deal
them over more tasks. State lies in RocksDB, which these operators need: see state_store(). Events without a key, an id or a time take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice
from operator import itemgetter
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarrykit.operators.jobs import ENDED

#: Events that go to a page's state, or rows that leave it, at once.
APPENDED = 4096
#: A page's keys, as bits: jobs have few messages each, while a run of a log may be long.
JOB_BITS, RUN_BITS = 6, 3
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB. The session's setting is then as before; a query keeps what it began with."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _up(us: int) -> int:
    """The first whole millisecond that isn't before us."""
    return -(-us // 1000)


def _columns(schema: str) -> tuple[list[str], str]:
    """The columns that a schema names, and the schema of as many lists."""
    fields = [field.split() for field in schema.split(", ")]
    return [name for name, _ in fields], ", ".join(f"{name} array<{kind}>" for name, kind in fields)


def _listed(rows: list[tuple]) -> Iterator[tuple]:
    """rows in blocks, each as a tuple of its columns."""
    for i in range(0, len(rows), APPENDED):
        yield tuple(map(list, zip(*rows[i : i + APPENDED], strict=True)))


class InOrder(StatefulProcessor):
    """A state machine over a key's events (time_us, id, and further columns) in order of time and id, for a page of keys at a time.

    machine(): rows for the events that are due, and the state after them; deadline(): the time in microseconds at which the state changes by
    itself, or None. The first column of events and of what comes out is the key."""

    events_schema: str
    state_schema: str
    out_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names, lists = _columns(self.events_schema)
        self.waiting = handle.getListState("waiting", lists)
        self.due = handle.getValueState("due", "ms long")
        self.kept = handle.getValueState("kept", _columns(f"{self.names[0]} long, {self.state_schema}")[1])

    def machine(self, key: int, state: tuple | None, events: list[tuple], mark: int) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def deadline(self, state: tuple | None) -> int | None:
        return None

    def _wake(self, ms: int) -> None:
        """One timer a page: the earliest that was asked for."""
        set_for = self.due.get()
        if set_for is not None and set_for[0] <= ms:
            return
        if set_for is not None:
            self.handle.deleteTimer(set_for[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def _states(self) -> dict[int, tuple]:
        kept = self.kept.get()
        return {} if kept is None else {key: tuple(state) for key, *state in zip(*kept, strict=True)}

    def _keep(self, states: dict[int, tuple]) -> None:
        self.kept.update(tuple(map(list, zip(*((key, *state) for key, state in states.items()), strict=True)))) if states else self.kept.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first, event = None, None
        while block := list(islice(rows, APPENDED)):
            event = event or itemgetter(*(block[0].__fields__.index(c) for c in self.names))
            events = [event(tuple(row)) for row in block]
            self.waiting.appendList(list(_listed(events)))
            earliest = min(e[1] for e in events)
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(_up(first))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready: dict[int, dict[int, tuple]] = {}
        later, out = [], []
        for block in self.waiting.get():
            for row in zip(*block, strict=True):
                if row[1] > mark:
                    later.append(row)
                    continue
                told = ready.setdefault(row[0], {})
                if row[2] not in told or row[1] < told[row[2]][0]:  # of messages that bear one id the first counts
                    told[row[2]] = row[1:]
        states = self._states()
        over = {k for k, state in states.items() if (end := self.deadline(state)) is not None and end <= mark}
        for k in sorted(ready.keys() | over):
            rows, state = self.machine(k, states.pop(k, None), sorted(ready.get(k, {}).values(), key=itemgetter(0, 1)), mark)
            out += rows
            if state is not None:
                states[k] = state
        self.waiting.clear()
        for block in _listed(later):
            self.waiting.appendList([block])
        if ready or over:
            self._keep(states)
        self.due.clear()
        wanted = [e[1] for e in later] + [end for state in states.values() if (end := self.deadline(state)) is not None]
        if wanted:
            self._wake(_up(min(wanted)))
        made = Row(*_columns(self.out_schema)[0])
        return (made(*block) for block in _listed(out))

    def close(self) -> None:
        pass


def _in_order(rows: DataFrame, machine: InOrder, bits: int, initial: DataFrame | None = None) -> DataFrame:
    """machine's rows. rows: ts and the machine's events; initial: its states."""
    key = _columns(machine.events_schema)[0][0]
    paged = lambda df: df.withColumn("page", F.shiftright(F.col(key).cast("long"), bits)).groupBy("page")
    columns, lists = _columns(machine.out_schema)
    made = paged(rows).transformWithState(machine, lists, "append", "eventTime", None if initial is None else paged(initial))
    return made.select(F.inline(F.arrays_zip(*columns)))


class Numbered(InOrder):
    """A key's events with numbers from 1. The last number is the machine's state; a run that has been silent for forget_us (if that is
    given) is forgotten, and would begin at 1 again."""

    events_schema, state_schema, out_schema = "run_id long, at_us long, event_id long", "last long, at_us long", "run_id long, sequence long, event_id long"

    def __init__(self, forget_us: int | None = None) -> None:
        self.forget_us = forget_us

    def deadline(self, state: tuple | None) -> int | None:
        return None if state is None or self.forget_us is None else state[1] + self.forget_us

    def machine(self, key: int, state: tuple | None, events: list[tuple], mark: int) -> tuple[list[tuple], tuple | None]:
        out = []
        for at, event_id in events:
            if state is not None and self.forget_us is not None and state[1] + self.forget_us <= at:
                state = None
            state = ((state[0] if state else 0) + 1, at)
            out.append((key, state[0], event_id))
        end = self.deadline(state)
        return out, None if end is not None and end <= mark else state


def _timed(events: DataFrame, key: str, ident: str) -> DataFrame:
    rows = events.filter(F.col(key).isNotNull() & F.col(ident).isNotNull() & F.col("ts").isNotNull())
    return rows.withColumn("at_us", F.unix_micros("ts"))


def reordered_log(events: DataFrame, run: str = "user_id", forget_us: int | None = None) -> DataFrame:
    """run_id, sequence, event_id: events (run, event_id, ts with a watermark) that the watermark has passed, numbered by time and id across batches."""
    rows = _timed(events, run, "event_id").select(F.col(run).cast("long").alias("run_id"), "ts", "at_us", "event_id")
    return _in_order(rows, Numbered(forget_us), RUN_BITS)


class Job(NamedTuple):
    """A job's state. Times are microseconds; ended_us is when it came to its end."""

    status: str
    job_type: str | None
    owner: str | None = None
    lease_us: int | None = None
    attempts: int = 0
    cancel: bool = False
    effect: bool = False
    error_code: str | None = None
    ended_us: int | None = None


JOB = {"status": "string", "job_type": "string", "owner": "string", "lease_us": "long", "attempts": "int", "cancel": "boolean", "effect": "boolean", "error_code": "string", "ended_us": "long"}
#: A queue's messages, beside ts.
MESSAGES = "message_id long, job_id long, kind string, worker string, job_type string, outcome string, error_code string"
TRANSITIONS = "job_id long, at_us long, message_id long, status string, owner string, attempts int, error_code string"


class JobQueue(InOrder):
    """The states of a job. Messages by kind:

    submit: a job that isn't known is queued; claim: a queued one runs for the worker, who holds a lease; beat: the lease begins anew;
    effect: side effects have begun; cancel: a queued one is cancelled, a running one is asked to stop; stop: the worker stops one that was asked to, unless it is
    one of coding with side effects; finish: it ends as the message's outcome says. beat, effect, stop and finish count from the lease's owner alone.

    A lease that ends, at its end and before a message of that very time: coding fails as interrupted; a job that was asked to stop is cancelled; one that has
    run too often fails; others are queued again. Jobs that ended are forgotten after keep_us: later messages of theirs do nothing until then."""

    events_schema = "job_id long, at_us long, message_id long, kind string, worker string, job_type string, outcome string, error_code string"
    state_schema = ", ".join(f"{c} {t}" for c, t in JOB.items())
    out_schema = TRANSITIONS

    def __init__(self, lease_us: int, max_attempts: int, keep_us: int | None) -> None:
        self.lease_us, self.max_attempts, self.keep_us = lease_us, max_attempts, keep_us

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        state = Job(*(initialState[c] for c in Job._fields))
        self._keep(self._states() | {initialState["job_id"]: state})
        end = self.deadline(state)
        if end is not None:
            self._wake(_up(end))

    def deadline(self, state: tuple | None) -> int | None:
        if state is None:
            return None
        job = Job(*state)
        if job.ended_us is not None:
            return None if self.keep_us is None else job.ended_us + self.keep_us
        return job.lease_us

    def _over(self, job: Job) -> Job:
        at, free = job.lease_us, {"owner": None, "lease_us": None}
        if job.job_type == "coding":
            return job._replace(status="failed", error_code="job_interrupted", ended_us=at, **free)
        if job.cancel:
            return job._replace(status="cancelled", ended_us=at, **free)
        if job.attempts >= self.max_attempts:
            return job._replace(status="failed", error_code="job_attempts_exhausted", ended_us=at, **free)
        return job._replace(status="queued", **free)

    def _told(self, job: Job | None, event: tuple) -> Job | None:
        at, _, kind, worker, job_type, outcome, error = event
        if job is None:
            return Job("queued", job_type) if kind == "submit" else None
        if job.status == "queued":
            if kind == "claim" and worker is not None:
                return job._replace(status="running", owner=worker, lease_us=at + self.lease_us, attempts=job.attempts + 1)
            if kind == "cancel":
                return job._replace(status="cancelled", cancel=True, ended_us=at)
            return job
        if job.status != "running":
            return job
        if kind == "cancel":
            return job._replace(cancel=True)
        if worker is None or worker != job.owner:
            return job
        free = {"owner": None, "lease_us": None, "ended_us": at}
        if kind == "beat":
            return job._replace(lease_us=at + self.lease_us)
        if kind == "effect":
            return job._replace(effect=True)
        if kind == "stop" and job.cancel and not (job.job_type == "coding" and job.effect):
            return job._replace(status="cancelled", error_code=None, **free)
        if kind == "finish" and outcome in ("succeeded", "failed"):
            return job._replace(status=outcome, error_code=error if outcome == "failed" else None, **free)
        return job

    def machine(self, key: int, state: tuple | None, events: list[tuple], mark: int) -> tuple[list[tuple], tuple | None]:
        job, out = None if state is None else Job(*state), []

        def emit(at: int, message: int | None) -> None:
            out.append((key, at, message, job.status, job.owner, job.attempts, job.error_code))

        def pass_deadline(now: int) -> None:
            nonlocal job
            end = self.deadline(job)
            if end is not None and end <= now:
                if job.status in ENDED:
                    job = None
                else:
                    job = self._over(job)
                    emit(end, None)
                    pass_deadline(now)

        for event in events:
            pass_deadline(event[0])
            before, job = job, self._told(job, event)
            if job is not None and (before is None or before.status != job.status):
                emit(event[0], event[1])
        pass_deadline(mark)
        return out, None if job is None else tuple(job)


def job_transitions(messages: DataFrame, lease_us: int = 300_000_000, max_attempts: int = 3, keep_us: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """changed_at, job_id, message_id (null where a lease ended), status, owner, attempts, error_code: each change of a job's status, up to the
    watermark. messages: MESSAGES with ts, watermarked. initial: job_id and JOB of jobs that are there already, one row each."""
    rows = _timed(messages, "job_id", "message_id").select("ts", *_columns(JobQueue.events_schema)[0])
    start = None if initial is None else initial.select("job_id", *(F.col(c).cast(t) for c, t in JOB.items()))
    made = _in_order(rows, JobQueue(lease_us, max_attempts, keep_us), JOB_BITS, start)
    return made.select(F.timestamp_micros("at_us").alias("changed_at"), *(c for c in made.columns if c != "at_us"))


def last_states(transitions: DataFrame) -> DataFrame:
    """Each job's last status, of transitions that are a table: of one time, the one of the greatest message comes last, a lease's end first."""
    order: Column = F.struct("changed_at", F.coalesce("message_id", F.lit(-(2**63))))
    fields = F.struct("changed_at", "status", "owner", "attempts", "error_code")
    return transitions.groupBy("job_id").agg(F.max_by(fields, order).alias("last")).select("job_id", "last.*")
