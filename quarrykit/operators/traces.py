"""Run traces: ordered event logs, roll-ups, brackets, gaps, public views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(run: str = "run_id", *by: str) -> Window:
    return Window.partitionBy(run).orderBy(*(by or ("sequence",)))


def numbered(events: DataFrame, run: str, by: list[str]) -> DataFrame:
    """events with sequence, 1..n in each run."""
    return events.withColumn("sequence", F.row_number().over(ordered(run, *by)))


def rollup(events: DataFrame, started: str, tools: str, mutated: str, failed: list[str], value: str = "value", model: str = "model") -> DataFrame:
    """A row a run: counts by type, the values' sum, and the model if the run has exactly one. All partial aggregates."""
    kind = F.col("event_type")
    one = F.when(F.countDistinct(model) == 1, F.max(model))
    return events.groupBy("run_id").agg(F.count_if(kind == started).alias("llm_calls"), F.count_if(kind == tools).alias("tool_calls"), F.count_if(kind == mutated).alias("mutations"), F.count_if(kind.isin(*failed)).alias("errors"), F.sum(value).alias("total"), one.alias("model"))


def bracketed(events: DataFrame, opens: str, closes: list[str]) -> DataFrame:
    """Each opening event with the next closing one of its run: run_id, sequence, ended_as, elapsed_ms (0 at least)."""
    after = ordered().rowsBetween(1, Window.unboundedFollowing)
    closing = F.first(F.when(F.col("event_type").isin(*closes), F.struct("event_type", "timestamp")), ignorenulls=True).over(after)
    rows = events.withColumn("end", closing).filter(F.col("event_type") == opens)
    elapsed = F.greatest(F.lit(0.0), (F.unix_micros(F.col("end.timestamp").cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 1000)
    return rows.select("run_id", "sequence", F.col("end.event_type").alias("ended_as"), elapsed.alias("elapsed_ms"))


def gaps(events: DataFrame) -> DataFrame:
    """Where a run's sequence skips: run_id, after, missing."""
    before = F.coalesce(F.lag("sequence").over(ordered()), F.lit(0))
    rows = events.withColumn("after", before).withColumn("missing", F.col("sequence") - F.col("after") - 1)
    return rows.filter("missing > 0").select("run_id", "after", "missing")


def violations(runs: DataFrame, events: DataFrame) -> DataFrame:
    """run_id, problem: sequences not 1..n, ended runs without an end or duration, running ones with."""
    counted = events.groupBy("run_id").agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"), F.countDistinct("sequence").alias("n"), F.count(F.lit(1)).alias("all"))
    broken = counted.filter("low <> 1 or high <> n or n <> `all`").select("run_id", F.lit("sequence").alias("problem"))
    ended = F.col("ended_at").isNotNull() & F.col("duration_ms").isNotNull()
    wrong = runs.filter((F.col("status") == "running") == ended).select("run_id", F.lit("end").alias("problem"))
    return broken.unionByName(wrong)


def nested(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Runs with their events in order, as an array."""
    own = events.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("sequence", "event_type", "timestamp"))).alias("events"))
    return runs.join(own, "run_id", "left")


def allowed(metadata: Column, keys: list[str]) -> Column:
    """A map cut to known keys."""
    return F.map_filter(metadata, lambda k, _: k.isin(*keys))


def running_count(flag: Column, run: str = "run_id", *by: str) -> Column:
    """How many rows of the run up to this one have flag: a workspace's revision."""
    return F.sum(F.when(flag, 1).otherwise(0)).over(ordered(run, *by).rowsBetween(Window.unboundedPreceding, 0))


def repeats(calls: DataFrame, identity: list[str], order: list[str], limit: int = 2) -> DataFrame:
    """calls with repeat (its number among equal calls of the run) and blocked (a limit-th one or later)."""
    n = F.row_number().over(Window.partitionBy("run_id", *identity).orderBy(*order))
    return calls.withColumn("repeat", n).withColumn("blocked", n >= limit)


def pending(events: DataFrame, sets: Column, clears: Column, value: str, order: list[str]) -> DataFrame:
    """events with pending: what the last setting event of the run left, null after a clearing one."""
    state = F.when(sets, F.struct(F.col(value).alias("v"))).when(clears, F.struct(F.lit(None).cast("string").alias("v")))
    return events.withColumn("pending", F.last(state, ignorenulls=True).over(ordered("run_id", *order).rowsBetween(Window.unboundedPreceding, 0))["v"])


def recovered(events: DataFrame, fails: Column, mends: Column, by: str = "sequence") -> DataFrame:
    """run_id, recovered: whether a mending event comes after a failure. The first of the one and the last of the other tell."""
    both = events.groupBy("run_id").agg(F.min(F.when(fails, F.col(by))).alias("failed"), F.max(F.when(mends, F.col(by))).alias("mended"))
    return both.select("run_id", F.coalesce(F.col("failed") < F.col("mended"), F.lit(False)).alias("recovered"))


def compared(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with state: kept, gone or new. One aggregate over both sides, so no side is held in one task, whatever the keys.
    A symmetric difference is what isn't kept."""
    sides = before.select(*keys, F.lit(True).alias("b"), F.lit(False).alias("a")).unionByName(after.select(*keys, F.lit(False).alias("b"), F.lit(True).alias("a")))
    seen = sides.groupBy(*keys).agg(F.bool_or("b").alias("b"), F.bool_or("a").alias("a"))
    return seen.select(*keys, F.when(F.col("b") & F.col("a"), "kept").when(F.col("b"), "gone").otherwise("new").alias("state"))
