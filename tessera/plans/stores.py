"""Registered queries over stored indexes and tables of questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import tablefunctions, text
from tessera.operators import batchsearch, ordered
from tessera.operators.textindex import TextIndex
from tessera.operators.vectorindex import VectorIndex
from tessera.sources import tables
from tessera.sources.workspace import Folder

from .registry import _CHUNKS, _CORPUS, _COS, _KEYWORD, ORACLES, TERMS, K, query

_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}]+')"

# Full text by an inverted index ---------------------------------------------------------


def indexed(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The documents in two batches: the second brings two thirds, half of which the first had with another text."""
    corpus = tables.corpus(spark, sf_dir, vectors=False)
    third = F.pmod(F.col("document_id"), F.lit(3))
    index = TextIndex(spark, Folder(spark, "text-index").path)
    index.append(corpus.where(third < 2).withColumn("content", F.when(third == 1, F.concat(F.lit("the that with the that with "), F.upper("content"))).otherwise(F.col("content"))))
    index.append(corpus.where(third > 0))
    return index


@query(f"WITH {_CORPUS} {_KEYWORD}")
def indexed_fulltext_topk(spark, sf_dir):
    """As fulltext_topk, from the index: only the buckets of three terms are read."""
    return indexed(spark, sf_dir).topk(TERMS, K)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), text.tokens(F.col("text")).alias("terms"))


_MANY = f"""docs AS (SELECT doc_id AS document_id, {_WORDS.format('text')} AS toks FROM documents),
tf AS (SELECT document_id, term, count(*)::DOUBLE AS tf FROM (SELECT document_id, unnest(toks) AS term FROM docs) GROUP BY ALL),
asked AS (SELECT item_id, {_WORDS.format('text')} AS terms FROM benchmark),
words AS (SELECT item_id, unnest(terms) AS term FROM asked),
found AS (
  SELECT item_id, document_id, sum(1 - 1 / (1 + tf)) AS gain, count(DISTINCT term) AS met FROM words JOIN tf USING (term) GROUP BY ALL),
scored AS (
  SELECT item_id AS question_id, document_id, 0 AS chunk_index, round(gain / len(terms) / (1 + ln(greatest(len(toks), 1)::DOUBLE)), 6) AS score, met = len(list_distinct(terms)) AS every
  FROM found JOIN asked USING (item_id) JOIN docs USING (document_id))"""
_BEST = f"QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id) <= {K}"


@query(f"WITH {_MANY} SELECT question_id, document_id, chunk_index, score FROM scored WHERE every {_BEST}")
def fulltext_many(spark, sf_dir):
    """Each benchmark passage's words as a question: the documents that hold them all."""
    return indexed(spark, sf_dir).search(_questions(spark, sf_dir), K)


@query(f"WITH {_MANY} SELECT question_id, document_id, chunk_index, score FROM scored {_BEST}")
def fulltext_any_many(spark, sf_dir):
    """As fulltext_many, for documents that hold any of the words."""
    return indexed(spark, sf_dir).search(_questions(spark, sf_dir), K, every=False)


# Many questions at once ------------------------------------------------------------------


@query(f"SELECT a.vec_id AS question_id, b.vec_id AS document_id, 0 AS chunk_index, round({_COS.format('b.embedding', 'a.embedding')}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= {K}")
def vector_topk_many(spark, sf_dir):
    """The vectors whose id is divisible by 100 as questions, against all."""
    rows = tables.read(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return batchsearch.vector_topk_many(rows.select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding"), asked, K)


@query()
def indexed_vector_topk_many(spark, sf_dir):
    """As vector_topk_many, approximately, from an inverted file that got the vectors in two batches; tests measure its recall."""
    rows = tables.read(spark, sf_dir, "embeddings")
    corpus = rows.select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    index = VectorIndex(spark, Folder(spark, "vector-index").path)
    index.fit(corpus, K, 0.95)
    for part in (0, 1):
        index.append(corpus.where(F.pmod("document_id", F.lit(2)) == part))
    return index.search(rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector")), K)


# Words that make a passage a question of each class.
_OPENINGS = ("sebutkan semua", "bagaimana cara", "bandingkan", "")


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    return tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(opening, F.lit(" "), "text").alias("query"))


_KIND = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(query), {m!r})' for m in marks)} THEN '{name}'" for name, marks in text.QUERY_CLASSES) + " ELSE 'General' END"


@query(
    f"""WITH {_CHUNKS},
asked AS (SELECT *, {_KIND} AS kind, {_WORDS.format('query')} AS terms FROM (
  SELECT item_id AS question_id, CASE item_id % 4 {' '.join(f"WHEN {i} THEN '{o} '" for i, o in enumerate(_OPENINGS))} END || text AS query FROM benchmark)),
tf AS (SELECT document_id, chunk_index, term, count(*)::DOUBLE AS tf FROM (SELECT document_id, chunk_index, unnest(toks) AS term FROM chunks) GROUP BY ALL),
words AS (SELECT question_id, unnest(terms) AS term FROM asked),
found AS (SELECT question_id, document_id, chunk_index, sum(1 - 1 / (1 + tf)) AS gain FROM words JOIN tf USING (term) GROUP BY ALL),
hits AS (
  SELECT question_id, kind, document_id, chunk_index, round(gain / len(terms) / (1 + ln(greatest(len(toks), 1)::DOUBLE)), 6) AS score,
    row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, chunk_index) AS pos
  FROM found JOIN asked USING (question_id) JOIN chunks USING (document_id, chunk_index) QUALIFY pos <= {K}),
g AS (SELECT question_id, kind, document_id, min(pos) AS spot, count(*) >= 2 OR max(chunk_index) > 0 AS smart FROM hits GROUP BY question_id, kind, document_id),
d AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY spot) AS place, count(*) OVER (PARTITION BY question_id) AS docs FROM g),
h AS (SELECT *, CASE WHEN kind IN ('List', 'Procedural') THEN 'list' WHEN kind = 'Comparison' AND docs >= 2 THEN 'pair' ELSE 'smart' END AS how FROM d),
f AS (SELECT *, CASE how WHEN 'list' THEN true WHEN 'pair' THEN place <= 2 ELSE smart END AS whole FROM h),
u AS (
  SELECT f.question_id, f.kind, f.how, c.document_id, c.chunk_index, 1.0::DOUBLE AS score, 0 AS part, 0 AS spot FROM f JOIN chunks c USING (document_id) WHERE whole
  UNION ALL SELECT f.question_id, f.kind, how, document_id, chunk_index, score, 1, pos FROM hits JOIN f USING (question_id, document_id) WHERE NOT whole AND how = 'smart'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY CASE how WHEN 'smart' THEN part END, CASE how WHEN 'smart' THEN spot END, CASE how WHEN 'list' THEN chunk_index END, document_id, chunk_index) AS pos FROM u),
above AS (
  SELECT *, lag(score) OVER (PARTITION BY question_id ORDER BY pos) AS prev FROM (
    SELECT *, score >= CASE WHEN kind IN ('List', 'Procedural') THEN 0.06 ELSE 0.1 END AS fine, max(score) OVER (PARTITION BY question_id) AS most FROM ranked)
  WHERE fine OR (pos = 1 AND most < CASE WHEN kind IN ('List', 'Procedural') THEN 0.06 ELSE 0.1 END)),
cut AS (SELECT *, min(CASE WHEN kind NOT IN ('List', 'Procedural') AND prev > 0 AND (prev - score) / prev > 0.25 THEN pos END) OVER (PARTITION BY question_id) AS c FROM above),
one AS (SELECT *, concat('conv/', document_id) AS source_url FROM cut WHERE c IS NULL OR pos < c QUALIFY row_number() OVER (PARTITION BY question_id, document_id ORDER BY pos) = 1)
SELECT question_id, document_id, chunk_index, score, pos::INTEGER AS pos, source_url, category
FROM (SELECT one.*, chunks.category FROM one JOIN chunks USING (document_id, chunk_index)) QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY pos) <= 6"""
)
def ask_many(spark, sf_dir):
    """Benchmark passages as questions of every class to the conversations, answered by one plan."""
    chunks, asked = tables.chunks(spark, sf_dir), _told(spark, sf_dir)
    index = TextIndex(spark, Folder(spark, "text-index").path)
    index.append(chunks)
    hits = index.search(asked.select("question_id", text.tokens(F.col("query")).alias("terms")), K, every=False)
    return batchsearch.ask_many(chunks, hits, asked, min_score=0.1)


# Orders over range partitions ---------------------------------------------------------------


@query("SELECT event_id AS id, event_type, ts AS created_at FROM events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 9000")
def deep_log_page(spark, sf_dir):
    """A page far behind in the log; one partition of the sorted log is read for it."""
    logs = tables.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type", F.col("ts").alias("created_at"))
    return ordered.Pages(spark, Folder(spark, "log-pages").path, [F.desc("created_at"), F.desc("id")]).build(logs).page(50, 9000)


@query(
    f"""WITH n AS (SELECT vec_id, label, round({_COS.format('lag(embedding) OVER (PARTITION BY label ORDER BY vec_id)', 'embedding')}, 6) AS near FROM embeddings)
SELECT vec_id, label, sum(CASE WHEN near < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM n"""
)
def island_segments(spark, sf_dir):
    """As semantic_segments; a label's rows are spread over partitions."""
    return ordered.islands(tables.read(spark, sf_dir, "embeddings"), "label", "vec_id", threshold=0.1).select("vec_id", "label", "segment")


# Chunkers as table functions ------------------------------------------------------------------


@query(ORACLES["chunk_auto"])
def chunk_lateral(spark, sf_dir):
    """As chunk_auto, by a lateral join with a table function."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return tablefunctions.lateral_chunks(docs).select("doc_id", "chunk_index", "chunk")


@query(ORACLES["chunk_sentence"])
def chunk_lateral_sql(spark, sf_dir):
    """As chunk_sentence, in SQL."""
    tablefunctions.register(spark)
    docs = tables.read(spark, sf_dir, "documents")
    return spark.sql("SELECT d.doc_id, c.chunk_index, c.chunk FROM {docs} d, LATERAL chunks(d.text, 'sentence') c", docs=docs)
