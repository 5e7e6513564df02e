"""What the operators of this subpackage share: tables, the shared folder, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    It lies under ``spark.checkpoint.dir``. Only on one machine, as in tests, a temporary folder
    stands in where that is unset, which goes when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="docframe-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        base = _local[0]
    return f"{base.rstrip('/')}/docframe-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, and a lost
    executor costs nothing that was written."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now: it waits for garbage
    collections of the driver, which may be far apart while executors' disks fill. What the
    driver's Python has freed goes back to the system where glibc can do that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small(df: DataFrame, most: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most ``most`` rows; Spark joins larger
    ones by shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def join_counted(left: DataFrame, right: DataFrame, key: str, share: float = 1e-3) -> DataFrame:
    """Inner join of left with right, which has one row for each key and in ``_n`` the number of
    its rows in left. Keys of more than ``share`` of all rows, so less than 1 / share keys, are
    broadcast; only the others are shuffled, of which none is hot."""
    total = right.agg(F.sum("_n")).first()[0] or 0
    hot = (F.col("_n") > share * total) & F.col(key).isNotNull()
    large, rest = F.broadcast(right.where(hot)), right.where(~hot)
    return left.join(large, key).unionByName(left.join(F.broadcast(right.where(hot).select(key)), key, "left_anti").join(rest, key)).drop("_n")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, whatever file system that is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def remove_table(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for df, which nothing reads any more."""
    remove(df.sparkSession, df._folder.rsplit("/", 1)[0])


def text_of(column) -> F.Column:
    """Null texts count as empty ones."""
    return F.coalesce(column.cast("string"), F.lit(""))


def uniform(*columns) -> F.Column:
    """A number in [0, 1) that depends on the values of columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(1 << 53))
