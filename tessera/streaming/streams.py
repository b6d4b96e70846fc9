"""Structured Streaming forms of the log statistics, limiters and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(logs: DataFrame, time: str = "created_at", late: str = "1 day") -> DataFrame:
    """Queries per day; batch and stream alike."""
    w = F.window(time, "1 day")
    src = logs.withWatermark(time, late) if logs.isStreaming else logs
    return src.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "n")


def failure_windows(logins: DataFrame, key: str, time: str, minutes: int = 15, most: int = 5, late: str = "1 hour") -> DataFrame:
    """Fixed windows in which a key failed at least ``most`` times."""
    src = logins.withWatermark(time, late) if logins.isStreaming else logins
    n = src.groupBy(F.col(key), F.window(time, f"{minutes} minutes").alias("w")).agg(F.count("*").alias("failures"))
    return n.where(F.col("failures") >= most).select(key, F.col("w.start").alias("window_start"), "failures")


def limiter(logins: DataFrame, key: str, minutes: int = 15, most: int = 5, late: str = "1 hour") -> DataFrame:
    """key, at, blocked for each attempt (key, at timestamp, ok boolean): blocked after ``most`` failures in a window that the first failure opens; a success resets it.

    A key's attempts of one batch are judged in order of their time; attempts
    later than ``late`` go, and a key whose window the watermark has passed is
    forgotten.
    """

    def run(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, start = state.get if state.exists else (0, 0)
        out = []
        for r in pd.concat(list(frames)).sort_values("at", kind="stable").itertuples():
            now = int(r.at.value // 1000)
            if now - start >= minutes * 60_000_000:
                count, start = 0, now
            blocked = count >= most
            if not blocked:
                count = 0 if r.ok else count + 1
            out.append((k[0], r.at, blocked))
        state.update((count, start))
        state.setTimeoutTimestamp(max(start // 1000 + minutes * 60_000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["key", "at", "blocked"])

    attempts = logins.select(F.col(key).cast("string").alias("key"), "at", "ok").withWatermark("at", late)
    return attempts.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, blocked boolean", "count int, start long", "append", GroupStateTimeout.EventTimeTimeout)


def cumulative_counts(asks: DataFrame, key: str = "guest_token") -> DataFrame:
    """Asks of each key so far (complete or update mode)."""
    return asks.groupBy(key).agg(F.count("*").alias("ask_count"))


def retained(logs: DataFrame, time: str, days: int, now=None) -> DataFrame:
    """Without rows older than ``days`` before now: for a stream, before the time of the batch that a row comes in.  Stateless."""
    now = F.current_timestamp() if now is None else F.lit(now)
    return logs.where(F.col(time) >= now.cast(dict(logs.dtypes)[time]) - F.expr(f"INTERVAL {days} DAYS"))


def as_stream(df: DataFrame, folder: str) -> DataFrame:
    """A stream of a table's rows through files in ``folder``, a batch per file."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_to_end(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything a stream gives until its input ends, from an in-memory table: for results of bounded size."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.table(name)


def one_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of one key that with the largest other columns, in their order, so that a rerun picks alike."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    largest = df.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_largest"))
    return largest.select(*(F.col(c) if c in keys else F.col("_largest")[c].alias(c) for c in df.columns))


def ingest(pages: DataFrame, store: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], keys: list[str]):
    """Append a stream of pages to a Parquet store that ``current`` reads, exactly once per batch.

    A batch writes its own rows into its own folder and reads nothing of the
    store, so its cost does not grow with what is there; a rerun batch overwrites
    its folder, so recovery changes nothing.
    """

    def append(batch: DataFrame, n: int) -> None:
        one_per_key(prepare(batch), keys).write.mode("overwrite").parquet(f"{store}/v={n}")

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)


def current(spark: SparkSession, store: str, document: str = "document_id", version: bool = False) -> DataFrame:
    """The rows of each document's last batch: all its earlier rows are exchanged for them.

    ``version`` keeps the batch number as column v.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(store)
    last = rows.groupBy(F.col(document).alias("_document")).agg(F.max("v").alias("_last"))
    kept = rows.join(last, F.col(document).eqNullSafe(F.col("_document")) & (F.col("v") == F.col("_last")), "left_semi")
    return kept if version else kept.drop("v")


def compact(spark: SparkSession, store: str, target: str, document: str = "document_id") -> None:
    """Write what ``current`` gives as the store's last batch into a new store, which the stream can go on with."""
    n = spark.read.option("mergeSchema", "true").parquet(store).agg(F.max("v")).first()[0]
    if n is not None:
        current(spark, store, document).write.mode("overwrite").parquet(f"{target}/v={n}")
