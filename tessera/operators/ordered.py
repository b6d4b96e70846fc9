"""Orders that are spread over range partitions: deep pages and runs of rows, without one task for all or for a group.

``Pages`` keeps an order that was sorted once: a page at any offset reads the one
or two partitions that hold it.  ``islands`` numbers runs of alike neighbours:
every partition numbers its own rows, and only what stands at partition borders
(the last row before, the breaks so far) is carried on, by group and partition.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as vec
from tessera.sources import workspace

from .batchsearch import _matrix

#: Rows of a partition, on average.
PART_ROWS = 1 << 20


def _parts(df: DataFrame, rows: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows)


class Pages:
    """A table sorted over partitions in a folder.  ``order``: columns as ``orderBy`` takes them, together unique for each row."""

    def __init__(self, spark: SparkSession, folder: str, order: list):
        self.spark, self.folder, self.order = spark, folder.rstrip("/"), order
        self.ends: list[int] | None = None
        self.schema = None

    def build(self, df: DataFrame, rows: int = PART_ROWS) -> Pages:
        """Sort once; gives itself."""
        spread = df.repartitionByRange(_parts(df, rows), *self.order).sortWithinPartitions(*self.order)
        spread = spread.withColumn("_part", F.spark_partition_id())
        spread.write.mode("overwrite").partitionBy("_part").parquet(f"{self.folder}/rows")
        self.ends, self.schema = None, spread.schema
        return self

    def _rows(self) -> DataFrame:
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(f"{self.folder}/rows")

    def counts(self) -> list[tuple[int, int]]:
        """Rows of each partition, which the footers of its files tell; one number a partition comes to the driver."""
        return sorted((r["_part"], r["n"]) for r in self._rows().groupBy("_part").agg(F.count("*").alias("n")).collect())

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """Rows offset+1 to offset+limit."""
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        if self.ends is None:
            known = self.counts()
            self.parts, self.ends = [p for p, _ in known], list(accumulate(n for _, n in known))
        first, last = bisect_right(self.ends, offset), bisect_right(self.ends, offset + limit - 1)
        before = self.ends[first - 1] if first else 0
        rows = self._rows().where(F.col("_part").isin(self.parts[first : last + 1] if limit else [])).drop("_part")
        return rows.orderBy(*self.order).offset(offset - before).limit(limit)


def _local_breaks(threshold: float):
    """Adds ``_local``: breaks so far among the group's rows in this partition, of rows (group, vector, ...) in order."""

    def run(batches):
        group, last, size, count = None, None, 0.0, 0
        for b in batches:
            if not b.num_rows:
                continue
            groups, lists = b.column(0), b.column(1)
            width = max(int(lists.value_lengths().fill_null(0).to_numpy().max(initial=0)), 1 if last is None else len(last))
            rows, sizes = _matrix(lists, width)
            known = lists.is_valid().to_numpy(zero_copy_only=False)
            codes = groups.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            same = np.append(last is not None and groups[0].as_py() == group, codes[1:] == codes[:-1])
            before = np.vstack((np.zeros((1, width)) if last is None else np.pad(last, (0, width - len(last)))[None, :], rows[:-1]))
            scale = np.append(size, sizes[:-1]) * sizes
            near = np.where(scale == 0, 0.0, (before * rows).sum(1) / np.where(scale == 0, 1, scale))
            # A row without vector is near to nothing and far from nothing.
            compared = same & known & np.append(last is None or size >= 0, known[:-1])
            breaks = compared & (np.round(near, 6) < threshold)
            total = np.cumsum(breaks)
            starts = np.flatnonzero(~same)
            base = np.zeros(len(total), np.int64)
            base[starts] = total[starts]
            local = total - np.maximum.accumulate(base)
            head = len(total) if not len(starts) else starts[0]
            local[:head] += count
            group, count = groups[-1].as_py(), int(local[-1])
            last, size = rows[-1], sizes[-1] if known[-1] else -1.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64())], names=[*b.schema.names, "_local"])

    return run


def islands(rows: DataFrame, group: str, order: str, vector: str = "embedding", threshold: float = 0.7, folder: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows with ``segment``: a new one of a group wherever neighbours are less alike than the threshold, as ``semantic_segments``."""
    spark = rows.sparkSession
    folder = folder or workspace.Folder(spark, "islands").path
    by = [F.asc_nulls_first(group), F.asc_nulls_first(order)]
    rest = [c for c in rows.columns if c not in (group, vector)]
    spread = rows.select(group, vector, *rest).repartitionByRange(_parts(rows, part_rows), *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id())
    types = ", ".join(f"`{c}` {t}" for c, t in spread.dtypes)
    with workspace.batches(spark, 5_000):
        spread.mapInArrow(_local_breaks(threshold), f"{types}, _local long").write.mode("overwrite").parquet(f"{folder}/local")
    local = spark.read.parquet(f"{folder}/local")
    # What a partition knows of a group: its first and last vector, and its breaks.
    ends = local.groupBy(F.col(group).alias("_group"), "_part").agg(F.min_by(vector, order).alias("_first"), F.max_by(vector, order).alias("_last"), F.max("_local").alias("_breaks"))
    w = Window.partitionBy("_group").orderBy("_part")
    between = F.coalesce((F.round(vec.cosine(F.lag("_last").over(w), F.col("_first")), 6) < threshold).cast("long"), F.lit(0))
    ends = ends.withColumn("_between", between)
    carried = F.sum(F.col("_between") + F.col("_breaks")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_breaks")
    # A partition has at most two groups that reach beyond it, so this table is as small as twice their number.
    carried = ends.withColumn("_before", carried).where("_before > 0").select("_group", F.col("_part").alias("_of"), "_before")
    out = local.join(F.broadcast(carried), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of")), "left")
    return out.withColumn("segment", F.col("_local") + F.coalesce("_before", F.lit(0))).select(*rows.columns, "segment")
