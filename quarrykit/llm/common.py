"""What the operators of this subpackage share: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where
    a local session has none, a temporary folder that is then set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='quarrykit-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, so a
    lost executor costs a reread and no recomputation."""
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path)
    # Spark removes a finished job's shuffle files once the driver has collected its objects, which may take it
    # half an hour to come to.
    df.sparkSession._jvm.System.gc()
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made._stored_at = path
    return made


def drop_stored(*tables: DataFrame) -> None:
    """Removes tables that stored() made and that nothing is to be read from again."""
    for df in tables:
        drop_path(df.sparkSession, df._stored_at)


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: Rows of a few numbers that are broadcast at most: some 40 MB.
BROADCAST_ROWS = 1_000_000


def if_small(df: DataFrame) -> DataFrame:
    """df, a stored table of a few columns of fixed size, marked for a broadcast if its rows, which are counted, are few enough; beyond
    that the join is the session's choice. So a join with texts moves no text while the other side is small."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Options of glibc's mallopt, and the size from which memory is mapped by itself, so that it goes back when it is freed.
_M_TRIM_THRESHOLD, _M_MMAP_THRESHOLD, _OWN_MAP = -1, -3, 1 << 20


def trimmed(fn):
    """fn, a map over batches, in a worker that gives free memory back: large arrays at once, the rest when its task ends. Workers live on,
    and several share an executor's memory."""

    def run(batches):
        import ctypes
        import gc

        import pyarrow as pa

        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(_M_MMAP_THRESHOLD, _OWN_MAP)
            libc.mallopt(_M_TRIM_THRESHOLD, _OWN_MAP)
        pa.set_memory_pool(pa.system_memory_pool())
        yield from fn(batches)
        gc.collect()
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


#: Rows and bytes that a Python worker gets at a time; Spark's own 10,000 rows of texts take a third of a small executor's memory, and
#: a thousand very long texts would take all of it.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the rows and the bytes of the session's Arrow batches, where the session's own bounds aren't lower. Spark reads these settings
    when a plan runs, so they stay set; they change no result."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "0")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
