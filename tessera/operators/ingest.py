"""Incremental ingest as functional merges: old and new rows in, new rows out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.enrich import passage
from tessera.functions.text import SEPARATORS, strip


def upsert(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str], order: list | None = None) -> DataFrame:
    """ON CONFLICT (keys) DO UPDATE of the ``replaced`` columns; unmatched new rows are inserted.

    Of several new rows of one key the last in ``order`` counts.  Rows of both
    sides meet in one shuffle on the keys.
    """
    both = old.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    latest = [F.desc("_new"), *(order or [])]
    w = Window.partitionBy(*keys).orderBy(*latest)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    was = F.last(F.when(~F.col("_new"), F.struct(*[c for c in both.columns if c != "_new"])), ignorenulls=True).over(every)
    top = both.withColumns({"_n": F.row_number().over(w), "_was": was}).where("_n = 1")
    kept = [c for c in old.columns if c not in keys and c not in replaced]
    return top.select(*keys, *[F.col(c) for c in replaced], *[F.when(F.col("_was").isNotNull(), F.col(f"_was.{c}")).otherwise(F.col(c)).alias(c) for c in kept]).select(*old.columns)


def chunk_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Content, vector, title and time follow the new chunk; category and URL stay.  An empty vector becomes null."""
    if "embedding" in new.columns:
        new = new.withColumn("embedding", F.when(F.size("embedding") > 0, F.col("embedding")))
    replaced = [c for c in ("content", "embedding", "title", "updated_at") if c in old.columns]
    return upsert(old, new, ["document_id", "chunk_index"], replaced)


def session_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, ["id"], ["title", "messages", "updated_at"])


def insert_unique(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Plain insert; a key that is there already, or twice in the new rows, is an error when the result is computed."""
    both = old.unionByName(new)
    n = F.count("*").over(Window.partitionBy(*keys))
    return both.withColumn("_ok", F.when(n > 1, F.raise_error("duplicate key")).otherwise(F.lit(True)).cast("boolean")).where("_ok").drop("_ok")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def content_hash(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("file_hash", F.md5(text))


def changed(new: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("document_id", "file_hash")) -> DataFrame:
    """New rows whose (id, hash) is not known."""
    return new.join(known.select(*keys).distinct(), list(keys), "left_anti")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """document_id and status of each: new, changed, same, gone."""
    o, n = old.select("document_id", F.col("file_hash").alias("was")), new.select("document_id", F.col("file_hash").alias("is"))
    status = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").when(F.col("was") == F.col("is"), "same").otherwise("changed")
    return o.join(n, "document_id", "full_outer").select("document_id", status.alias("status"))


def replace_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the new rows' documents are exchanged for the new rows."""
    return old.join(new.select("document_id").distinct(), "document_id", "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys, keys.columns, "left_anti").select(*df.columns)


def retain(df: DataFrame, as_of, days: int, column: str = "created_at") -> DataFrame:
    return df.where(F.col(column) >= F.lit(as_of).cast(dict(df.dtypes)[column]) - F.expr(f"INTERVAL {days} DAYS"))


def update_documents(df: DataFrame, document_id: str, **values) -> DataFrame:
    """New metadata on all chunks of a document; its time stays."""
    hit = F.col("document_id") == document_id
    return df.withColumns({c: F.when(hit, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def update_chunk(df: DataFrame, document_id: str, chunk_index: int, content: str, embed=None) -> DataFrame:
    """New content of one chunk; with an embedder column function its vector too."""
    hit = (F.col("document_id") == document_id) & (F.col("chunk_index") == chunk_index)
    out = df.withColumn("content", F.when(hit, content).otherwise(F.col("content")))
    return out.withColumn("embedding", F.when(hit, embed(F.col("content"))).otherwise(F.col("embedding"))) if embed else out


def backfill_vectors(df: DataFrame, embed) -> DataFrame:
    """Vectors for the chunks that lack one."""
    return df.withColumn("embedding", F.coalesce("embedding", F.when(F.col("embedding").isNull(), embed(F.concat(F.lit("passage: "), "content")))))


def guest_counts(old: DataFrame, asks: DataFrame) -> DataFrame:
    """guest_token, ask_count after more asks."""
    more = asks.groupBy("guest_token").agg(F.count("*").cast("int").alias("ask_count"))
    return old.select("guest_token", "ask_count").unionByName(more).groupBy("guest_token").agg(F.sum("ask_count").cast("int").alias("ask_count"))


def pin(pins: DataFrame, question: str, pinned_by: int | None = None) -> DataFrame:
    """The pins with one more at the end, unless it is there."""
    last = pins.agg((F.coalesce(F.max("sort_order"), F.lit(0)) + 1).alias("sort_order"))
    new = last.select(F.lit(question).alias("question"), F.lit(pinned_by).cast("long").alias("pinned_by"), F.col("sort_order").cast(dict(pins.dtypes)["sort_order"]))
    return pins.unionByName(new.join(pins.select("question"), "question", "left_anti"), allowMissingColumns=True)


def headed_records(docs: DataFrame, chunks, category: str = "General", subcategory: str = "", document_type: str = "md", least: int = 20) -> DataFrame:
    """Stored rows, and what is embedded for them, of documents cut under their headings.

    docs: document_id, content, source_url; ``chunks`` gives an array of (chunk,
    path of headings) for the content.  The index counts dropped short chunks
    too; the title names the headings; the embedded text carries them in front.
    """
    every = docs.select("document_id", "source_url", F.md5("content").alias("file_hash"), F.posexplode(chunks).alias("chunk_index", "c"))
    body = strip(F.col("c.chunk"), SEPARATORS)
    path = F.filter("c.path", lambda x: x != "")
    title = F.when(F.size(path) > 0, F.concat(F.col("document_id").cast("string"), F.lit(" ("), F.array_join(path, " > "), F.lit(")"))).otherwise(F.col("document_id").cast("string"))
    rows = every.where(F.char_length(body) >= least)
    return rows.select(
        "document_id", title.alias("title"), body.alias("content"), F.lit(document_type).alias("document_type"), "source_url", F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"),
        "file_hash", "chunk_index", passage(body, F.col("document_id").cast("string"), *[F.get("c.path", F.lit(i)) for i in range(3)]).alias("embed_text"),
    )


def chunk_records(chunks: DataFrame, category: str = "Umum", subcategory: str = "—") -> DataFrame:
    """Stored rows of fresh chunks (source_url, chunk_index, chunk): ids come from the URL and content, so reruns agree."""
    return chunks.select(F.concat(F.lit("url-"), F.substring(F.sha2("source_url", 256), 1, 32)).alias("document_id"), "chunk_index", F.col("chunk").alias("content"), "source_url", F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), F.md5("chunk").alias("file_hash"))
