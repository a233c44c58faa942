"""Durable jobs as a table of rows: each transition is a function from rows to rows. A single writer applies them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.operators.ranking import top_k

ENDED = ("succeeded", "failed", "cancelled")


def cancellation_state() -> Column:
    unsafe = (F.col("job_type") == "coding") & F.col("side_effect_started_at").isNotNull()
    asked = F.col("cancel_requested_at").isNotNull()
    return (
        F.when(F.col("status") == "cancelled", "cancelled").when(unsafe & asked, "deferred")
        .when(F.col("status").isin(*ENDED) | unsafe, "unavailable").when(asked, "requested").otherwise("available")
    )


def _set(jobs: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(where, F.lit(False))
    return jobs.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def claimed(jobs: DataFrame, workers: list[str], now: Column, lease_seconds: int = 300) -> DataFrame:
    """The oldest queued jobs given to workers, one each, first in first out."""
    n = len(workers)
    next_jobs = jobs.filter("status = 'queued'").orderBy("created_at", "id").limit(n).select("id")
    # As many rows as there are workers.
    place = top_k(next_jobs.join(jobs.select("id", "created_at"), "id").withColumn("all", F.lit(0)), ["all"], ["created_at", "id"], n, "place").select("id", F.element_at(F.array(*map(F.lit, workers)), F.col("place")).alias("__worker"))
    rows = jobs.join(F.broadcast(place), "id", "left")
    hit = F.col("__worker").isNotNull()
    lease = now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    values = {"status": F.lit("running"), "lease_owner": F.col("__worker"), "lease_expires_at": lease, "started_at": now, "attempt_count": F.col("attempt_count") + 1}
    return _set(rows, hit, values).drop("__worker")


def _owned(job_id: str, worker: str) -> Column:
    return (F.col("id") == job_id) & (F.col("status") == "running") & (F.col("lease_owner") == worker)


def renewed(jobs: DataFrame, job_id: str, worker: str, now: Column, lease_seconds: int = 300) -> DataFrame:
    return _set(jobs, _owned(job_id, worker), {"lease_expires_at": now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))})


def finished(jobs: DataFrame, job_id: str, worker: str, status: str, now: Column, error_code: str | None = None) -> DataFrame:
    free = {"lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast("timestamp")}
    return _set(jobs, _owned(job_id, worker), {"status": F.lit(status), "finished_at": now, "error_code": F.lit(error_code).cast("string"), **free})


def cancel_requested(jobs: DataFrame, job_id: str, now: Column) -> DataFrame:
    """A queued job is cancelled at once, a running one is asked to stop, an ended one stays."""
    alive = (F.col("id") == job_id) & ~F.col("status").isin(*ENDED)
    queued = alive & (F.col("status") == "queued")
    jobs = _set(jobs, alive & F.col("cancel_requested_at").isNull(), {"cancel_requested_at": now})
    return _set(jobs.withColumn("__q", queued), F.col("__q"), {"status": F.lit("cancelled"), "cancelled_at": now, "finished_at": now}).drop("__q")


def recovered(jobs: DataFrame, now: Column, max_attempts: int = 3) -> DataFrame:
    """Running jobs whose lease is over: interrupted if they may have had effects, cancelled if that was asked for, failed
    after too many attempts, else queued again."""
    over = F.coalesce((F.col("status") == "running") & (F.col("lease_expires_at") <= now), F.lit(False))
    case = F.when(over, F.when(F.col("job_type") == "coding", "interrupted").when(F.col("cancel_requested_at").isNotNull(), "cancelled").when(F.col("attempt_count") >= max_attempts, "exhausted").otherwise("queued"))
    rows = jobs.withColumn("__case", case)
    of = lambda *names: F.coalesce(F.col("__case").isin(*names), F.lit(False))
    error = F.when(of("interrupted"), "job_interrupted").when(of("exhausted"), "job_attempts_exhausted").otherwise(F.col("error_code"))
    rows = rows.withColumn("status", F.when(of("interrupted", "exhausted"), "failed").when(of("cancelled"), "cancelled").when(of("queued"), "queued").otherwise(F.col("status"))).withColumn("error_code", error)
    rows = _set(rows, of("interrupted", "exhausted", "cancelled"), {"finished_at": now})
    rows = _set(rows, of("cancelled"), {"cancelled_at": now})
    rows = _set(rows, of("queued"), {"started_at": F.lit(None).cast(jobs.schema["started_at"].dataType)})
    return _set(rows, F.col("__case").isNotNull(), {"lease_owner": F.lit(None).cast("string"), "lease_expires_at": F.lit(None).cast(jobs.schema["lease_expires_at"].dataType)}).drop("__case")


def listed(jobs: DataFrame, limit: int, status: str | None = None, job_type: str | None = None, repository: int | None = None) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    for column, value in (("status", status), ("job_type", job_type), ("repository_id", repository)):
        jobs = jobs if value is None else jobs.filter(F.col(column) == value)
    return jobs.orderBy(F.desc("created_at"), "id").limit(limit)


def blockers(checks: dict[str, Column]) -> Column:
    """The names of the checks that hold, in order: what keeps a run from being complete."""
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items())))


def completion_blockers(require_tests: bool = True, require_ruff: bool = True, require_review: bool = True) -> Column:
    """Of a row with requested, revision, tests_passed, tests_revision, ruff_passed, ruff_revision, diff_available, unexpected_files,
    review_verdict, review_revision."""
    current = F.col("revision")
    checks = {"not_requested": ~F.col("requested")}
    for name, needed in (("tests", require_tests), ("ruff", require_ruff)):
        if needed:
            passed = F.coalesce(F.col(f"{name}_passed"), F.lit(False))
            checks |= {f"{name}_failed": ~passed, f"{name}_stale": passed & (F.col(f"{name}_revision") != current)}
    checks |= {"diff_missing": ~F.coalesce(F.col("diff_available"), F.lit(False)), "unexpected_files": F.col("unexpected_files") > 0}
    if require_review:
        there = F.col("review_verdict").isNotNull()
        fresh = F.col("review_revision") == current
        checks |= {"review_missing": ~there, "review_stale": there & ~fresh, "review_requires_changes": there & fresh & (F.col("review_verdict") == "changes_required")}
    return blockers(checks)


def back_off(attempt: Column, base: float, cap: float) -> Column:
    """Seconds to wait before the next attempt: doubled each time, cap at most."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(cap)))
