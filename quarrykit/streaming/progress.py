"""Streams of run events: counts, windows, sessions, and an ordered log with kept state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrykit.functions.text import sse_frame
from quarrykit.sources.shared import shared_dir

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, sf_dir: str, watermark: str = "1 hour") -> DataFrame:
    """The events table as a stream with an event time."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def windowed(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("started"), "n")


def _number(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else 0
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    rows["sequence"] = range(last + 1, last + 1 + len(rows))
    state.update((last + len(rows),))
    yield pd.DataFrame({"run_id": key[0], "sequence": rows["sequence"].to_numpy(), "event_id": rows["event_id"].to_numpy()})


def ordered_log(events: DataFrame) -> DataFrame:
    """run_id, sequence, event_id: a run's events numbered from 1 as they arrive; a run's last number is all the state."""
    return events.groupBy("user_id").applyInPandasWithState(_number, "run_id long, sequence long, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def _until_end(ends: list[str]):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ended = state.exists and state.get[0]
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        closing = rows["event_type"].isin(ends).to_numpy()
        rows = rows.iloc[:0] if ended else rows.iloc[: int(closing.argmax()) + 1] if closing.any() else rows
        state.update((bool(ended or closing.any()),))
        yield pd.DataFrame({"run_id": [key[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "event_type": rows["event_type"].to_numpy()})

    return run


def until_end(events: DataFrame, ends: list[str]) -> DataFrame:
    """run_id, event_id, event_type: a run's events up to its first ending one, which is the last that is passed on. Whether
    a run has ended is all the state; later batches of an ended run give nothing."""
    return events.groupBy("user_id").applyInPandasWithState(_until_end(ends), "run_id long, event_id long, event_type string", "ended boolean", "append", GroupStateTimeout.NoTimeout)


def expired_leases(beats: DataFrame, lease: str, key: str = "user_id") -> DataFrame:
    """key, expired_at: leases that no beat has renewed in time, once the watermark has passed their end. A session of beats
    that renew one another is a lease, so Spark keeps the state and the timers."""
    return beats.groupBy(F.session_window("ts", lease).alias("w"), key).agg(F.count(F.lit(1)).alias("beats")).select(key, F.col("w.end").alias("expired_at"), "beats")


def parsed(messages: DataFrame, column: str, schema: str) -> DataFrame:
    """messages with message (a struct); those that aren't JSON, or null, are dropped."""
    return messages.filter(F.try_parse_json(column).isNotNull()).withColumn("message", F.from_json(column, schema))


def best_effort(sink: Callable[[DataFrame, int], None], dead_letters: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer that no failing sink stops: a batch that sink refuses goes to dead_letters with the error's name, under
    its number, so a batch that is run again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        try:
            sink(batch, number)
        except Exception as e:  # noqa: BLE001  whatever it is, it becomes a diagnostic
            batch.withColumn("error", F.lit(type(e).__name__)).write.mode("overwrite").parquet(f"{dead_letters}/batch={number}")

    return put


def frames(events: DataFrame) -> DataFrame:
    """events (sequence, event, data) as server-sent frames."""
    return events.select("run_id", "sequence", sse_frame(F.col("sequence"), F.col("event"), F.col("data")).alias("frame"))


def finished(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    """What is there, run through as a stream into a table of the session's shared folder."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}") if mode == "append" else batch.write.mode("overwrite").parquet(f"{at}/out")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out").select(*df.columns)
