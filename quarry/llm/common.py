"""What the operators of this package share: shared storage, ordering helpers, bounded hints."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.storage import fresh_path

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A side of at most this many fixed-width rows (16 to 40 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of a few numbers that a task writes, where a bound of a table's rows is known.
ROWS_A_FILE = 1 << 14


def materialise(df: DataFrame, name: str, options: dict | None = None, most: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    most: a bound of its rows, if they are a few numbers each; it is then written in files of about ROWS_A_FILE rows, however
    many partitions it has. On local disks Hadoop starts a process (chmod) three times for a file, and until such a process
    runs its own program it counts as a second executor.
    """
    spark = df.sparkSession
    if most is not None:
        df = df.coalesce(1 + most // ROWS_A_FILE)
    path = fresh_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of materialised tables that no plan to come reads."""
    for t in tables:
        at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; otherwise as it is, and the join shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def spread(rows: int, per_bucket: int = 512) -> int:
    """Number of buckets, a power of two, that holds about per_bucket rows each."""
    return 1 << max(6, (max(1, rows) // per_bucket).bit_length())


def hash_bucket(h: Column, buckets: int) -> Column:
    """The top bits of a 64-bit hash: buckets follow the order of the hash as an unsigned number."""
    return F.shiftrightunsigned(h, 64 - (buckets.bit_length() - 1))


def running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, out: str) -> DataFrame:
    """Exclusive running sum of value within group by (bucket, order), without a task that holds a whole group.

    Sums per (group, bucket) are accumulated over the buckets of a group, then rows are ordered within their bucket only.
    """
    keys = [*group, bucket]
    each = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*keys).agg(F.sum(value).alias("_sum")).select(*keys, F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_base"))
    return df.join(base, keys).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(each), F.lit(0))).drop("_base")


def lean_batches(spark: SparkSession, megabytes: int = 16) -> None:
    """Arrow batches of a bounded number of bytes, so that very long texts or blocks stay small in Python workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = spark.conf.get(key).rstrip("b")
    if not found.isdigit() or int(found) > megabytes << 20:
        spark.conf.set(key, str(megabytes << 20))


def lean_worker(keep_encoders: bool = False) -> None:
    """Gives back what a reused Python worker still holds of stages before: encoders with their caches, and freed memory.

    An idle worker is handed to the next stage as it is, and the C library keeps freed memory of past batches.
    """
    bpe = sys.modules.get("quarry.llm.bpe")
    if bpe and not keep_encoders:
        bpe.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def hashed_share(df: DataFrame, key: str, most: int, rows: int) -> DataFrame:
    """About most of df's counted rows (all, if fewer), by a hash of the key: every task sends its share, not its own most."""
    if rows <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit(11), key), F.lit(1_000_000)) < int(1_000_000 * most / rows) + 1)
