"""What the corpus operators share: tables, the shared folder, blocks of documents."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one block of documents holds on average.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset a temporary folder is set, which only a local master can share.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if not current:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tamarack-"))
        current = context.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tamarack/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage; its shuffle files are dropped."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p(path))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder, sorted; none if it is not there."""
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p(path))) if fs.exists(p(path)) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder; what is not there is no error."""
    fs, p = _file_system(spark, path)
    if not fs.delete(p(path), True) and fs.exists(p(path)):
        raise OSError(f"{path} could not be deleted")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """A file that is there whole or not at all: written under another name and renamed. False if there was one before."""
    fs, p = _file_system(spark, path)
    if fs.exists(p(path)):
        return False
    folder, _, name = path.rpartition("/")
    fs.mkdirs(p(folder))
    new = p(f"{folder}/.{name}-{uuid.uuid4().hex}")
    with contextlib.closing(fs.create(new, False)) as out:
        out.write(bytearray(text.encode()))
    # File systems refuse to rename onto what is there, or are asked first.
    if not fs.exists(p(path)) and fs.rename(new, p(path)):
        return True
    fs.delete(new, False)
    return False


def read_small(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    with contextlib.closing(fs.open(p(path))) as stream:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")


class Markers:
    """Numbered files in a folder, of which the last that is there counts; each is created once and whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def last(self) -> tuple[int, str]:
        """The largest number and its text; 0 if there is none."""
        number = max((int(n) for n in names_in(self.spark, self.path) if n.isdigit()), default=0)
        return number, read_small(self.spark, f"{self.path}/{number}") if number else ""

    def add(self, number: int, text: str) -> bool:
        return create_once(self.spark, f"{self.path}/{number}", text)


def text_of(column: str = "text") -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def block_count(df: DataFrame, text: Column, block_bytes: int = BLOCK_BYTES) -> tuple[int, int]:
    """Rows of df and the number of blocks that its text fills."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text) + 64).alias("b")).first()
    return row["n"], max(1, -(-(row["b"] or 0) // block_bytes))


def block_of(n_blocks: int, *keys: Column) -> Column:
    """A block number that spreads rows evenly, also where ids repeat or are null."""
    return F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).cast("long")


#: What empties the caches that are only worth their memory while their own operator runs.
_kept: list[Callable[[], None]] = []


def keeps(cached: Callable) -> Callable:
    """A function with a large lru_cache, which other operators' kernels empty: a worker outlives its step, and with it what it has cached."""
    _kept.append(cached.cache_clear)
    return cached


def let_go() -> None:
    for clear in _kept:
        clear()


def trimmed(kernel: Callable) -> Callable:
    """A function of groups that leaves no freed memory behind, nor what a step before has cached in its worker."""

    @functools.wraps(kernel)
    def run(*tables: pa.Table) -> pa.Table:
        let_go()
        try:
            return kernel(*tables)
        finally:
            trim()

    # Spark tells functions with a key from those without by their arguments.
    run.__signature__ = inspect.signature(kernel)
    return run


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {df.columns}")


def require_ids(df: DataFrame, name: str) -> None:
    """Raises an error unless the column is there and holds whole numbers."""
    require(df, name)
    kind = next(f.dataType for f in df.schema if f.name == name)
    if not isinstance(kind, (T.IntegralType, T.NullType)):
        raise TypeError(f"{name} must hold whole numbers, not {kind.simpleString()}")


def mark_of(column: str = "text") -> Column:
    """A hash by which rows of the same id but different texts are told apart."""
    return F.xxhash64(text_of(column))


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of decisions that are broadcast at most: some tens of bytes each, about 100 MB once they are hashed.
BROADCAST_ROWS = 1 << 20


def small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, broadcast if it has `most` rows at most, so that whole texts are not shuffled to meet a few rows; beyond, joined by shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def dropped(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id and text's mark are a row of gone (doc_id, mark); a null id is an id."""
    a, b = fresh(docs, "gone_id"), fresh(docs, "gone_mark")
    gone = small(stored(gone.toDF(a, b).distinct(), "gone"))
    own = F.col("doc_id").cast(gone.schema[a].dataType)
    return docs.join(gone, own.eqNullSafe(F.col(a)) & (mark_of() == F.col(b)), "left_anti")


def release(spark: SparkSession) -> None:
    """Has the driver collect garbage, upon which Spark drops the shuffle files of finished jobs that nothing refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)


def trim() -> None:
    """Returns freed memory of this Python worker to the system; workers live on between steps."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes that small groups handle between two returns of freed memory.
_TRIM_BYTES = 16 << 20
_handled = 0


def trim_after(n_bytes: int) -> None:
    """trim(), once so many bytes have been handled since the last time: for groups so small that each would spend its time on it."""
    global _handled
    _handled += n_bytes
    if _handled > _TRIM_BYTES:
        _handled = 0
        trim()
