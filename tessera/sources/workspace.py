"""Folders for stores and results between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in a local session."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the executors have no folder in common")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


@contextmanager
def batches(spark: SparkSession, rows: int):
    """Jobs run here send at most so many rows at once to Python; the session's setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 32 << 20) -> None:
    """Keep the batches sent to Python bounded in bytes as well as in rows; smaller bounds of the session stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key) or "0"
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


@contextmanager
def tidied(spark: SparkSession):
    """Shuffle files of what is written here are removed as soon as it is written; the session's setting comes back."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


_libc = None


def give_back() -> None:
    """Hand freed memory back to the system: Python workers are reused by whatever runs next."""
    global _libc
    pa.default_memory_pool().release_unused()
    if _libc is None:
        try:
            _libc = ctypes.CDLL("libc.so.6")
        except OSError:
            _libc = False
    if _libc:
        _libc.malloc_trim(0)


class Folder:
    """A folder of one caller, until ``release`` or the end of the program."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.release)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: later plans start here."""
        with tidied(self.spark):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def release(self) -> None:
        try:
            remove(self.spark, self.path)
        except Exception:  # the session has ended; its folder goes with it
            return
