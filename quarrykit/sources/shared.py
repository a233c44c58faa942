"""The folder that driver and executors share, and tables that are kept there while a session needs them."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where a local session has none, a temporary folder that is then set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quarrykit-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def written(df: DataFrame, what: str) -> str:
    """The path of df as a table of the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: what is read more than once is worked out once, and a lost executor costs a reread."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, what))


def fingerprint(*tables: DataFrame) -> str:
    """What the tables' files are at present: a digest of their names, sizes and times. Another one tells that a table has changed."""
    found: set[str] = set()
    for df in tables:
        hadoop, conf = df.sparkSession._jvm.org.apache.hadoop.fs.Path, df.sparkSession._jsc.hadoopConfiguration()
        for name in df.inputFiles():
            at = hadoop(name)
            status = at.getFileSystem(conf).getFileStatus(at)
            found.add(f"{name}\n{status.getLen()}\n{status.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
