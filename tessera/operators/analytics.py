"""Usage statistics, FAQ lists, listings and pages over the query log and the corpus."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(logs: DataFrame) -> DataFrame:
    """All totals in one pass."""
    return logs.agg(
        F.count("*").alias("total"),
        F.count_distinct("query_text").alias("distinct_queries"),
        F.round(F.coalesce(F.avg("num_results"), F.lit(0.0)), 6).alias("avg_results"),
        F.round(F.coalesce(F.avg("search_time_ms"), F.lit(0.0)), 6).alias("avg_time_ms"),
        F.count_if(F.col("num_results") == 0).alias("zero_results"),
    )


def counts_by(logs: DataFrame, column: str) -> DataFrame:
    return logs.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def per_day(logs: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Queries of each day since ``days`` before ``as_of``, latest first."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    return logs.where(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day"))


def top_queries(logs: DataFrame, k: int = 20) -> DataFrame:
    return logs.groupBy("query_text").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query_text").limit(k)


def faq_top(logs: DataFrame, k: int = 30, shortest: int = 15, longest: int = 200) -> DataFrame:
    """Most asked questions of fitting length, with the last time each was asked."""
    fit = logs.where(F.char_length("query_text").between(shortest, longest))
    return fit.groupBy("query_text").agg(F.count("*").alias("n"), F.max("created_at").alias("last_asked")).orderBy(F.desc("n"), F.desc("last_asked"), "query_text").limit(k)


def faq_public(logs: DataFrame, pins: DataFrame, k: int = 8, shortest: int = 15, longest: int = 200) -> DataFrame:
    """Pinned questions by sort order, then the most asked ones that are not pinned, up to k."""
    pinned = pins.select(F.col("question"), F.lit(True).alias("pinned"), F.col("sort_order").cast("long").alias("_at")).orderBy("_at", "question").limit(k)
    others = logs.where(F.char_length("query_text").between(shortest, longest)).join(pins.select(F.col("question").alias("query_text")), "query_text", "left_anti")
    auto = others.groupBy("query_text").agg(F.count("*").alias("n"), F.max("created_at").alias("last")).orderBy(F.desc("n"), F.desc("last"), "query_text").limit(k)
    auto = auto.select(F.col("query_text").alias("question"), F.lit(False).alias("pinned"), F.row_number().over(Window.orderBy(F.desc("n"), F.desc("last"), "query_text")).cast("long").alias("_at"))
    every = pinned.unionByName(auto).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("pinned"), "_at", "question")))
    return every.where(F.col("pos") <= k).drop("_at")


def page(df: DataFrame, order: list, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """Rows offset+1 to offset+limit of an order that must be total."""
    if limit < 0:
        raise ValueError("limit must not be negative")
    return df.orderBy(*order).offset(max(0, offset)).limit(min(limit, most))


def document_listing(chunks: DataFrame) -> DataFrame:
    """A row per document: the smallest of its descriptions, and its number of chunks."""
    described = [c for c in ("title", "document_type", "category", "subcategory", "source_url") if c in chunks.columns]
    return chunks.groupBy("document_id").agg(*[F.min(c).alias(c) for c in described], F.count("*").alias("chunks")).orderBy("category", "document_id")


def categories(chunks: DataFrame) -> DataFrame:
    return chunks.select("category").where(F.coalesce("category", F.lit("")) != "").distinct().orderBy("category")


def ingest_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("category").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents")).orderBy(F.desc("chunks"), "category")


def ingest_totals(chunks: DataFrame) -> DataFrame:
    """One row: all chunks and all documents."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"))


def sessions_with_user(sessions: DataFrame, users: DataFrame, k: int = 200) -> DataFrame:
    """Latest sessions with their user's name, or a stand-in."""
    return sessions.join(users, "user_id", "left").withColumn("user_name", F.coalesce("user_name", F.lit("(deleted)"))).orderBy(F.desc_nulls_last("updated_at"), "id").limit(k)


def latest_per_user(sessions: DataFrame, k: int = 50) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "id")
    return sessions.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def message_counts(sessions: DataFrame, messages: str = "messages") -> DataFrame:
    """Messages per session; JSON text that is no array counts 0."""
    text = dict(sessions.dtypes)[messages] == "string"
    n = F.coalesce(F.json_array_length(messages), F.lit(0)) if text else F.greatest(F.size(messages), F.lit(0))
    return sessions.select("id", n.alias("message_count"))


def last_messages(sessions: DataFrame, n: int = 6) -> DataFrame:
    return sessions.withColumn("messages", F.when(F.size("messages") > n, F.slice("messages", -n, n)).otherwise(F.col("messages")))


def find_users(users: DataFrame, part: str) -> DataFrame:
    p = part.lower()
    return users.where(F.lower("email").contains(p) | F.lower("user_name").contains(p))


def bars(daily: DataFrame, days: int = 30) -> DataFrame:
    """Width in per cent of the busiest of the latest days."""
    latest = daily.orderBy(F.desc("day")).limit(days)
    return latest.withColumn("width", F.round(F.least(F.lit(100.0), F.col("n") * 100.0 / F.max("n").over(Window.partitionBy(F.lit(0)))), 6))


def token_valid(token: str, now: datetime):
    """The filter for a single-use token."""
    return (F.col("token") == token) & (F.col("expires_at") > F.lit(now)) & F.col("used_at").isNull()
