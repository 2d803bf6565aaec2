"""Session helpers: tables in the shared folder, and which of them are small enough to broadcast."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SHARED_DIR_KEY = "spark.checkpoint.dir"

# Folders of local sessions without the setting, and what each application has written, by application id.
_LOCAL: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def _local_dir(spark: SparkSession) -> str:
    """One folder for a whole local session, deleted when the program ends."""
    application = spark.sparkContext.applicationId
    if application not in _LOCAL:
        _LOCAL[application] = tempfile.mkdtemp(prefix="dwitable-")
        atexit.register(shutil.rmtree, _LOCAL[application], ignore_errors=True)
    return _LOCAL[application]


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path in the folder the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Only a session whose executors are threads of this program may
    go without that setting; it has a folder of its own, which lasts as long as the program.
    """
    root = spark.conf.get(SHARED_DIR_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError(f"set {SHARED_DIR_KEY} to a folder that all executors share")
        root = _local_dir(spark)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete everything this application has put into the shared folder; returns how many paths that were.

    Call it between runs, when no table built before is needed any more.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
    return len(paths)


BATCH_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialise(df: DataFrame, purpose: str, batch_rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back, so that later steps do not compute it again.

    Unlike a cached block the files outlive the executors that wrote them. With ``batch_rows`` the rows that go to Python for
    this table go in batches of at most so many; the session's setting is as before afterwards. A task holds a batch several
    times, in the JVM and in Python, so long texts should go in few rows.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, purpose)
    before = spark.conf.get(BATCH_ROWS_KEY)
    few = batch_rows is not None and not 0 < int(before) <= batch_rows
    if few:
        spark.conf.set(BATCH_ROWS_KEY, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        if few:
            spark.conf.set(BATCH_ROWS_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


# A broadcast table is small in both: a narrow row of a few numbers takes about a hundred bytes in it, so this is about
# 100 MB; wider rows are held back by the size of the files they were written to.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A narrow table marked for broadcast if it has at most ``limit`` rows, else unchanged.

    Meant for given or written tables with one row per subject, volume or group, which are cheap to count. The count stops
    at the limit. Beyond it Spark joins by shuffle, and splits hot keys at run time. A table that takes work to
    compute goes through ``settled``.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def settle(df: DataFrame, purpose: str, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """A table computed once and written out, and whether it is small enough to broadcast.

    Rows are counted as they are written, and the size of the files decides with them, so this is one job.
    """
    spark = df.sparkSession
    path, rows = shared_dir(spark, purpose), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return spark.read.schema(df.schema).parquet(path), rows.get["rows"] <= limit and size <= most_bytes


def settled(df: DataFrame, purpose: str, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A small aggregate of a large table, computed once, written out, and marked for broadcast if it is small.

    Joining an aggregate to the table it comes from would otherwise shuffle the large table, because its size is only
    known once both sides have been shuffled.
    """
    written, small = settle(df, purpose, limit, most_bytes)
    return F.broadcast(written) if small else written


#: Rows that one task takes of a table dealt out by keys. Columns that compress well pass any bound on the bytes of a shuffle, which
#: holds for what is sent: tens of megabytes of names and flags are millions of rows once a task has read them.
DEALT_ROWS = 100_000


def parts_of(df: DataFrame) -> int:
    """In how many parts a table is dealt out by keys, so that the memory of a task does not grow with the table."""
    return max(1, math.ceil(df.count() / DEALT_ROWS))
