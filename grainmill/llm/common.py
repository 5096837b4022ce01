"""What the operators share: scratch tables, text helpers, joins that survive a hot key."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A hot group has more than this share of all rows, so there are at most HOT_GROUPS of them.
HOT_GROUPS = 20_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes and rows of an Arrow batch, so that long texts do not fill a worker's memory.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES, "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS}


def bounded_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches of the session by bytes and rows, unless it has bounds of its own; no result depends on it."""
    conf = df.sparkSession.conf
    for key, most in _BATCH.items():
        if conf.get(key, None) is None:
            conf.set(key, str(most))


def give_back() -> None:
    """Freed memory of this process to the system."""
    import pyarrow as pa

    with contextlib.suppress(Exception):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run):
    """run, a function for mapInArrow, whose worker gives freed memory back when the task ends: workers outlive their tasks."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where none is named (local tests), one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="grainmill-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives a lost executor, is removed by freed() or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/grainmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _TABLES:
        atexit.register(_remove_all, spark)
    _TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables that are written and not yet removed.
_TABLES: list[str] = []


def _remove_all(spark: SparkSession) -> None:
    for path in _TABLES:
        _remove(spark, path)


def mark() -> int:
    """A point to which freed() goes back."""
    return len(_TABLES)


def freed(df: DataFrame, since: int) -> DataFrame:
    """df written, and the tables written since mark() gave `since` removed."""
    out = written(df)
    for path in _TABLES[since:-1]:
        _remove(df.sparkSession, path)
    del _TABLES[since:-1]
    return out


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) by hash: rows under a rate are a fixed sample, found without sending others anywhere."""
    return F.xxhash64(key) / F.lit(float(1 << 64)) + F.lit(0.5)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() does the same, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, row_key: str) -> DataFrame:
    """rows left-joined with groups, which has one row per key and the group's size in a column of that name.

    Groups of more than total / HOT_GROUPS rows are at most HOT_GROUPS in number, so these are broadcast;
    the rest are joined by a shuffle, in which the hot rows are spread by row_key. (The salt of groups is always 0, but not a literal:
    Spark would leave that out of the join's keys, and deal hot rows by their group.)
    """
    others = [c for c in groups.columns if c != key]
    hot = groups.filter(F.col(size) > F.lit(total / HOT_GROUPS)).select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in others])
    cold = groups.filter(F.col(size) <= F.lit(total / HOT_GROUPS)).select(F.col(key).alias("_ck"), F.pmod(F.hash(key), F.lit(1)).alias("_cs"), *[F.col(c).alias(f"_c_{c}") for c in others])
    out = rows.join(F.broadcast(hot), rows[key] == F.col("_hk"), "left")
    out = out.withColumn("_salt", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.hash(row_key), F.lit(1 << 20))))
    out = out.join(cold, (F.col(key) == F.col("_ck")) & (F.col("_salt") == F.col("_cs")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in others])
