"""Where jobs keep intermediate tables, and small helpers that several operators use."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a folder is made and set, but only in local mode; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sluice-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name for a new folder in the shared one; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/sluice-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.deleteOnExit(at)
    return store.makeQualified(at).toString()


def drop_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _set(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session, for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """df, written once as a table in the shared folder and read back.

    This cuts the lineage, so a lost executor costs a re-read instead of a recomputation, and the shuffle files
    that led to it are released as soon as the table is written. batch_bytes: about how much of the rows is given to
    Python at a time; by default as many rows as the session says, however long they are.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with _set(spark, **{_CLEAN: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def handing_back(each: Callable) -> Callable:
    """A function of batches which, when a task is through, gives the memory that is free again back to the system.

    The worker lives on for other stages' tasks; what it keeps for itself adds to what their own data takes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from each(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
        if trim:
            trim(0)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(key: Column, folds: int) -> Column:
    """crc32 of the key written as text, modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def given(keep: tuple, made: tuple) -> list[Column]:
    """The columns in keep; one with the name of a column that the operator makes is called `given_` and its name."""
    return [F.col(f"`{c}`").alias(f"given_{c}" if c in made else c) for c in keep]


def ranked(rows: DataFrame, column: str, rank: int, held: int = 10_000) -> float:
    """The value of the given rank (from 0) in the order of a column of numbers, which has no nulls.

    The span of values is divided by 1024 again and again, and only the part that holds the rank is looked at further,
    until it has `held` rows or one value: nothing is sorted but these.
    """
    x = F.col(column)
    lo, hi, n = rows.agg(F.min(x), F.max(x), F.count(x)).first()
    while n > held and lo < hi:
        inside = rows.where(x.between(lo, hi))
        part = F.least(F.floor((x - lo) / (hi - lo) * 1024), F.lit(1023)).alias("part")
        for r in sorted(inside.groupBy(part).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).collect()):
            if rank < r["n"]:
                lo, hi, n = r["lo"], r["hi"], r["n"]
                break
            rank -= r["n"]
    return lo if lo == hi else sorted(r[0] for r in rows.where(x.between(lo, hi)).select(x).collect())[rank]


def pieces(rows: int, each: int) -> int:
    """How many parts of about `each` rows hold `rows` rows."""
    return max(1, -(-int(rows or 0) // each))


def beside_groups(rows: DataFrame, groups: DataFrame, keys: list[str], members: str, total: int, least: int = 10_000, how: str = "inner") -> DataFrame:
    """rows joined with groups (a row for each key; members: how many of `total` rows have it), inner or left.

    Keys that more than a 1,000th of the rows have, and `least` rows, are fewer than 1,000, and are broadcast: their
    rows stay where they are. The other keys' rows are dealt by key.
    """
    most = max(least, total // 1000)
    hot, cold = groups.where(F.col(members) > most), groups.where(F.col(members) <= most)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)


def hash_below(rows: int, wanted: int, spare: int = 4) -> int:
    """A 64-bit hash below which about spare * wanted of so many rows lie: what is sampled is first cut to these, so
    that ranking them is bounded however many rows there are."""
    return min((1 << 63) - 1, int((1 << 64) * (spare * wanted / max(1, rows))) - (1 << 63))
