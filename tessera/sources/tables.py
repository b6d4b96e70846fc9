"""Logical tables and their binding to Parquet inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "string": T.StringType(), "int": T.IntegerType(), "float": T.FloatType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "vector": T.ArrayType(T.FloatType()), "strings": T.ArrayType(T.StringType())}


def _table(fields: str, **more: T.DataType) -> T.StructType:
    known = _TYPES | more
    return T.StructType([T.StructField(name, known[kind]) for name, kind in (x.split() for x in fields.split(","))])


CHUNKS = _table("id long, document_id string, title string, content string, document_type string, source_url string, category string, subcategory string, file_hash string, embedding vector, page_number int, chunk_index int, created_at timestamp, updated_at timestamp")
QUERY_LOGS = _table("id long, query_text string, detected_language string, detected_domain string, num_results int, top_score float, search_time_ms long, session_id string, user_id long, created_at timestamp")
CHAT_SOURCE = _table("title string, snippet string, source_url string, category string, subcategory string, score double")
MESSAGES = T.ArrayType(_table("role string, content string, created_at string, sources sources", sources=T.ArrayType(CHAT_SOURCE)))
SESSIONS = _table("id string, user_id long, title string, messages messages, created_at timestamp, updated_at timestamp", messages=MESSAGES)
USERS = _table("id long, email string, password_hash string, display_name string, role string, is_active boolean, email_verified boolean, created_at timestamp, updated_at timestamp")
API_KEYS = _table("id long, user_id long, key_prefix string, key_hash string, name string, permissions strings, rate_limit int, is_active boolean, last_used_at timestamp, created_at timestamp, expires_at timestamp")
FAQ_PINS = _table("id long, question string, pinned_by long, sort_order int, created_at timestamp")
GUEST_QUOTAS = _table("guest_token string, ask_count int, last_ask_at timestamp, created_at timestamp")
TOKENS = _table("id long, user_id long, token string, expires_at timestamp, used_at timestamp, created_at timestamp")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive schema evolution: missing columns become typed nulls, others are cast, extra ones stay behind."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def corpus(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """One chunk per document; with its vector where there is one, unless that is not asked for."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), F.col("lang").alias("category"), F.col("source").alias("source_url"))
    if not vectors:
        return docs
    return docs.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding"), "document_id", "left")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of several chunks per document: conversations by turn."""
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), F.col("text").alias("content"), F.col("role").alias("category"), F.concat(F.lit("conv/"), F.col("conv_id")).alias("source_url"))


def query_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query log: one row per event."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat_ws(" ", F.lit("query"), "event_type", F.coalesce(k.cast("string"), F.lit("none"))).alias("query_text"),
        F.when(F.col("user_id") % 3 == 0, "id").otherwise("en").alias("detected_language"),
        F.col("event_type").alias("detected_domain"),
        F.coalesce(F.pmod(k, F.lit(10)), F.lit(0)).cast("int").alias("num_results"),
        F.col("value").alias("search_time_ms"),
        "user_id",
        F.col("ts").alias("created_at"),
    )


def folded_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat sessions: conversations folded into ordered message arrays."""
    turns = read(spark, sf_dir, "conversations")
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return turns.groupBy(F.col("conv_id").alias("id")).agg(messages.alias("messages"))


# Accounts: customers are users, orders their sessions and tokens, suppliers API keys.


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    key = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(
        key.alias("id"), F.concat(F.lit("u"), key, F.lit("@example.com")).alias("email"), F.md5("c_name").alias("password_hash"), F.col("c_name").alias("display_name"), F.lit("user").alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"), (F.col("c_acctbal") >= 0).alias("email_verified"), born.alias("created_at"), born.alias("updated_at"),
    )
    return conform(rows, USERS)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    return conform(rows, SESSIONS)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token per order, good for a day; those of finished orders are used."""
    at = F.col("o_orderdate").cast("timestamp")
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.md5(F.col("o_orderkey").cast("string")).alias("token"), (at + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.when(F.col("o_orderstatus") == "F", at).alias("used_at"), at.alias("created_at"))
    return conform(rows, TOKENS)


def api_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key per supplier; those of suppliers in debt have expired."""
    at = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = read(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("user_id"), F.substring(F.md5("s_name"), 1, 8).alias("key_prefix"), F.md5("s_name").alias("key_hash"), F.col("s_name").alias("name"),
        F.array(F.lit("read")).alias("permissions"), F.lit(60).alias("rate_limit"), F.lit(True).alias("is_active"), at.alias("created_at"), F.when(F.col("s_acctbal") < 0, at).alias("expires_at"),
    )
    return conform(rows, API_KEYS)
