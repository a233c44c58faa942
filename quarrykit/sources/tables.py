"""Versioned tables: a write makes a new version; a pointer file, written last, names the one that counts. One writer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Pointer:
    """A small JSON file of a folder, CURRENT, that names what counts there. It is replaced in one step: a reader finds the old one or the new one."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def get(self) -> dict | None:
        at = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def put(self, value: dict) -> None:
        new, at = self._path(f"{self.folder}/CURRENT.new"), self._path(f"{self.folder}/CURRENT")
        stream = self._fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        jvm = self.spark._jvm
        overwrite = jvm.java.lang.reflect.Array.newInstance(jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE.getClass(), 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark._jsc.hadoopConfiguration()).rename(new, at, overwrite)


class VersionedTable(Pointer):
    """A table in a folder that any of Spark's file systems holds."""

    def pointer(self) -> dict | None:
        return self.get()

    def read(self) -> DataFrame:
        now = self.pointer()
        if now is None:
            raise FileNotFoundError(f"{self.folder} has no version")
        return self.spark.read.parquet(f"{self.folder}/{now['version']}")

    def replace(self, rows: DataFrame, fingerprint: str | None = None, partition_by: list[str] | None = None) -> None:
        """rows become the table. Readers see the old version until the pointer moves."""
        version = f"v-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.folder}/{version}")
        # Old versions stay for readers that have begun: see expire().
        self.put({"version": version, "fingerprint": fingerprint})

    def expire(self, older_than_ms: int) -> list[str]:
        """Deletes versions that aren't current and were written longer ago than that; returns their names."""
        now = self.pointer()
        limit = self.spark._jvm.java.lang.System.currentTimeMillis() - older_than_ms
        gone = []
        for status in self._fs.listStatus(self._path(self.folder)):
            name = status.getPath().getName()
            if name.startswith("v-") and name != (now or {}).get("version") and status.getModificationTime() <= limit:
                self._fs.delete(status.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def compatible(self, fingerprint: str | None) -> bool:
        """Whether an incremental update with this fingerprint fits: both are there and equal."""
        now = self.pointer()
        return bool(now and fingerprint and now["fingerprint"] == fingerprint)


def apply_update(table: VersionedTable, upserted: DataFrame, touched: DataFrame, fingerprint: str) -> None:
    """Rows of touched paths give way to upserted ones; of another fingerprint, all do."""
    if table.compatible(fingerprint):
        kept = table.read().join(touched.select("relative_path").distinct(), "relative_path", "left_anti")
        upserted = kept.unionByName(upserted)
    table.replace(upserted, fingerprint)


def append_trace(runs: DataFrame, events: DataFrame, folder: str) -> None:
    """Ended runs and their events, in order, appended to two tables."""
    if runs.filter(F.col("status") == "running").limit(1).count():
        raise ValueError("a running trace can't be stored")
    runs.write.mode("append").parquet(f"{folder}/runs")
    events.sortWithinPartitions("run_id", "sequence").write.mode("append").parquet(f"{folder}/events")


def write_json_report(rows: DataFrame, path: str, one_file: bool = True) -> None:
    """A report is small: one file unless told otherwise."""
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").json(path)
