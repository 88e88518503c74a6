"""Intermediate tables in the folder that driver and executors share, and global row numbers."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class _Written(threading.local):
    """Paths that this thread's queries have written and not deleted, in order: queries of other threads are not among them."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()
#: All paths of all threads that are still there; they go when the driver's interpreter ends.
_left: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and all runs on this machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerlark-"))
        shared = context.getCheckpointDir().get()
    return shared.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # noqa: BLE001 - the session may already be gone when the interpreter ends
        return


def _sweep(spark: SparkSession) -> None:
    for path in list(_left):
        _remove(spark, path)
    _left.clear()


def owned(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver's interpreter ends."""
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _left:
        atexit.unregister(_sweep)
        atexit.register(_sweep, spark)
    _left.add(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; it goes with this thread's release(), or when the driver's interpreter ends."""
    path = owned(df.sparkSession, label)
    df.write.parquet(path)
    _written.paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def mark() -> int:
    """Where release() may begin: at the tables that saved() writes from now on, in this thread."""
    return len(_written.paths)


def release(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables that this thread has written with saved() since ``since``, but for those of ``keep``. Nothing that still reads them may be used any more."""
    kept = [df._saved_at for df in keep]
    for path in _written.paths[since:]:
        if path not in kept:
            _remove(spark, path)
            _left.discard(path)
    _written.paths[since:] = [path for path in _written.paths[since:] if path in kept]


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` with its rows numbered 0, 1, 2, ... by partition and then by place in it.

    The rows are written once, so the numbers hold. What is broadcast is one row per partition.
    """
    written = saved(df.withColumn("_row", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("_part").agg(F.count("*").alias("_n"))
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    number = F.col("_first") + F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return written.join(F.broadcast(firsts), "_part").withColumn(column, number).drop("_row", "_part", "_first")
