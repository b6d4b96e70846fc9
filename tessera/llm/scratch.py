"""Tables written between steps, in the folder that all executors share.

A written table cuts lineage and outlives a lost executor.  The folder is the
one the cluster names in ``spark.checkpoint.dir``; only where that is unset and
the session is local (as in tests) a local one is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.workspace import give_back, small_batches, tidied


def shared_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: the executors have no folder in common")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """One operator call's tables.  ``drop`` removes all but the named ones; the
    rest go when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made: list[str] = []
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        if name not in self.made:
            self.made.append(name)
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; what was shuffled for it leaves the disk at once."""
        with tidied(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, keep: tuple[str, ...] = ()) -> None:
        gone = [n for n in self.made if n not in keep]
        try:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            for n in gone:
                p = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{n}")
                p.getFileSystem(conf).delete(p, True)
            if not keep:
                p = jvm.org.apache.hadoop.fs.Path(self.base)
                p.getFileSystem(conf).delete(p, True)
        except Exception:  # the session has ended; its folder goes with it
            return
        self.made = [n for n in self.made if n in keep]


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(run):
    """A function over Arrow batches that gives back what it has freed when its task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
