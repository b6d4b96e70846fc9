"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def replace(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a new version; never to a path that ``df`` reads."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def export_json(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines in id order, the vector as text."""
    rows = chunks.withColumn("embedding", F.when(F.col("embedding").isNotNull(), F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]")))) if "embedding" in chunks.columns else chunks
    order = [c for c in ("id", "document_id", "chunk_index") if c in rows.columns]
    rows.orderBy(*order).write.mode("overwrite").json(path)


def shared_columns(df: DataFrame, target: list[str]) -> DataFrame:
    """Only the columns that the target has too, in its order."""
    return df.select(*[c for c in target if c in df.columns])


def append_log(asked: DataFrame, path: str) -> None:
    """Rows of the query log, in its columns, a folder per day."""
    from .tables import QUERY_LOGS, conform

    rows = conform(asked, QUERY_LOGS).withColumn("day", F.to_date("created_at"))
    append(rows, path, ["day"])


def save_checkpoint(pages: DataFrame, path: str) -> None:
    """What is known of each page, as JSON lines, in one go; never to a path that ``pages`` reads."""
    pages.write.mode("overwrite").json(path)


def clear_checkpoint(spark: SparkSession, path: str) -> None:
    """Nothing is left of a run that ended well; a path that is not there is fine."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=1000, **options).mode(mode).save()
