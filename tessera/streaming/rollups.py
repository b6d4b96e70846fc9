"""Daily log statistics from sketches that merge over any range of days.

A batch of the query log adds, for each of its days, one row: counts and sums,
an HLL sketch of the distinct queries and a sketch of the most frequent ones.
Rows of a day merge, so a batch never reads what is there, late rows need no
rescan, and a question about a range of days reads as many rows as it has days
and batches.  A batch that is run again overwrites its rows; ``compact`` merges
the rows of finished batches to one a day.

Exact: counts, sums, and with them averages.  ``distinct_queries`` has a relative
standard error of about 0.83 / sqrt(2**``LOG_BUCKETS``) (nearly exact while there
are few).  ``top`` is exact while a range has fewer than three quarters of
``TRACKED`` distinct queries; beyond, a count is too high by at most 3.5 times the
range's rows over ``TRACKED``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import workspace

LOG_BUCKETS = 14
TRACKED = 8_192

_MERGED = ("n", "zero_results", "results", "result_rows", "time_ms", "time_rows")


def day_rows(logs: DataFrame) -> DataFrame:
    """One row for each day of some log rows (query_text, num_results, search_time_ms, created_at)."""
    return logs.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("num_results") == 0).alias("zero_results"),
        F.sum(F.col("num_results").cast("long")).alias("results"),
        F.count("num_results").alias("result_rows"),
        F.sum(F.col("search_time_ms").cast("double")).alias("time_ms"),
        F.count("search_time_ms").alias("time_rows"),
        F.hll_sketch_agg("query_text", LOG_BUCKETS).alias("distinct"),
        F.expr(f"approx_top_k_accumulate(query_text, {TRACKED})").alias("frequent"),
    )


def _sketches() -> list:
    return [F.hll_union_agg("distinct").alias("distinct"), F.expr(f"approx_top_k_combine(frequent, {TRACKED})").alias("frequent")]


class Rollups:
    """The rows of all batches in a folder, by day."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add(self, logs: DataFrame, batch: int) -> None:
        """One batch's rows; few for each day, so they are written by few tasks."""
        day_rows(logs).write.mode("overwrite").parquet(f"{self.folder}/batch={batch}")

    def stream(self, logs: DataFrame, checkpoint: str):
        return logs.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)

    def rows(self, first=None, last=None) -> DataFrame:
        """Rows from a first to a last day; the files' statistics leave out other days."""
        rows = self.spark.read.parquet(self.folder)
        rows = rows if first is None else rows.where(F.col("day") >= F.lit(first).cast("date"))
        return rows if last is None else rows.where(F.col("day") <= F.lit(last).cast("date"))

    def days(self, first=None, last=None) -> DataFrame:
        """One row a day, merged over batches, in the form of ``day_rows``."""
        return self.rows(first, last).groupBy("day").agg(*(F.sum(c).alias(c) for c in _MERGED), *_sketches())

    def per_day(self, first=None, last=None) -> DataFrame:
        return self.rows(first, last).groupBy("day").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_queries"))

    def summary(self, first=None, last=None) -> DataFrame:
        """The figures of ``analytics.summary`` for a range of days."""
        merged = self.rows(first, last).agg(*(F.sum(c).alias(c) for c in _MERGED), F.hll_union_agg("distinct").alias("distinct"))
        mean = lambda total, n: F.round(F.coalesce(F.col(total) / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)), 6)
        return merged.select(
            F.coalesce("n", F.lit(0)).alias("total"), F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).alias("distinct_queries"), mean("results", "result_rows").alias("avg_results"),
            mean("time_ms", "time_rows").alias("avg_time_ms"), F.coalesce("zero_results", F.lit(0)).alias("zero_results"),
        )

    def top(self, k: int = 20, first=None, last=None) -> DataFrame:
        """query_text and n of the most frequent queries of a range of days; equal counts by text."""
        # Grouped, as the sketches' merge knows no empty input.
        merged = self.rows(first, last).groupBy(F.lit(1)).agg(_sketches()[1]).select(F.explode(F.expr(f"approx_top_k_estimate(frequent, {TRACKED})")).alias("q"))
        return merged.select(F.col("q.item").alias("query_text"), F.col("q.count").alias("n")).where("query_text is not null").orderBy(F.desc("n"), "query_text").limit(k)

    def compact(self, target: str) -> None:
        """One row a day, as the last batch's number, into a new folder."""
        last = self.spark.read.parquet(self.folder).agg(F.max("batch")).first()[0]
        if last is not None and not workspace.exists(self.spark, f"{target}/batch={last}/_SUCCESS"):
            self.days().repartition(1).write.mode("overwrite").parquet(f"{target}/batch={last}")
