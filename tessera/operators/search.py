"""Ranked search over a corpus of chunks, document expansion and source filtering.

A corpus has document_id, chunk_index, content, category, source_url and, for
vector search, embedding (null where missing).  Every ranking rounds scores to
six places and breaks ties by (document_id, chunk_index), so results are total
orders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import vectors as vec

KEY = ("document_id", "chunk_index")


def _ranked(df: DataFrame, k: int, name: str | None = None, nulls_first: bool = False) -> DataFrame:
    top = F.col("score").desc_nulls_first() if nulls_first else F.desc("score")
    best = df.orderBy(top, *KEY).limit(k)
    if name is None:
        return best
    # The limit comes first, so the single-partition window sees k rows.
    return best.withColumn(name, F.row_number().over(Window.orderBy(F.desc("score"), *KEY)))


def _in_category(corpus: DataFrame, category: str | None) -> DataFrame:
    return corpus if category is None else corpus.where(F.col("category") == category)


def vector_topk(corpus: DataFrame, query: Sequence[float], k: int, category: str | None = None) -> DataFrame:
    """Exact cosine top-k; chunks without a vector take no part."""
    hits = _in_category(corpus, category).where(F.col("embedding").isNotNull())
    return _ranked(hits.select(*KEY, F.round(vec.cosine(F.col("embedding"), vec.literal(query)), 6).alias("score")), k)


def _lexical(corpus: DataFrame, terms: list[str]) -> DataFrame:
    return corpus.withColumn("_tokens", tx.tokens(F.col("content"))).withColumn("_lex", tx.lexical_rank(F.col("_tokens"), terms))


def fulltext_topk(corpus: DataFrame, terms: list[str], k: int, category: str | None = None) -> DataFrame:
    """Chunks that hold all terms, by lexical rank."""
    hits = _lexical(_in_category(corpus, category), terms).where(tx.matches_all(F.col("_tokens"), terms))
    return _ranked(hits.select(*KEY, F.col("_lex").alias("score")), k)


def hybrid_topk(corpus: DataFrame, query: Sequence[float], terms: list[str], k: int, category: str | None = None, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Weighted sum of cosine (0 without a vector) and lexical rank; no match is required."""
    near = F.coalesce(vec.cosine(F.col("embedding"), vec.literal(query)), F.lit(0.0))
    hits = _lexical(_in_category(corpus, category), terms)
    return _ranked(hits.select(*KEY, F.round(weights[0] * near + weights[1] * F.col("_lex"), 6).alias("score")), k, nulls_first=True)


def rrf_topk(corpus: DataFrame, query: Sequence[float], terms: list[str], k: int, category: str | None = None, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of the vector and the lexical ranking, max(3k, 30) candidates of each."""
    n = max(3 * k, 30)
    some = _in_category(corpus, category)
    near = some.where(F.col("embedding").isNotNull()).select(*KEY, F.round(vec.cosine(F.col("embedding"), vec.literal(query)), 6).alias("score"))
    lex = _lexical(some, terms).select(*KEY, F.col("_lex").alias("score"))
    both = _ranked(near, n, "rk").unionByName(_ranked(lex, n, "rk"))
    fused = both.groupBy(*KEY).agg(F.round(F.sum(1.0 / (constant + F.col("rk"))), 6).alias("score"))
    return _ranked(fused, k)


def search(corpus: DataFrame, mode: str, k: int, terms: list[str], query: Sequence[float] | None = None, category: str | None = None) -> DataFrame:
    """semantic, keyword or hybrid; any other mode is rank fusion.  Hybrid falls back to keyword without a vector."""
    if mode == "keyword" or mode == "hybrid" and query is None:
        return fulltext_topk(corpus, terms, k, category)
    if query is None:
        raise ValueError(f"mode {mode!r} needs a query vector")
    if mode == "semantic":
        return vector_topk(corpus, query, k, category)
    return (hybrid_topk if mode == "hybrid" else rrf_topk)(corpus, query, terms, k, category)


def positioned(hits: DataFrame) -> DataFrame:
    """Hits (a top-k) with pos, from 1."""
    return hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), *KEY)))


# Expansion ------------------------------------------------------------------------


def fetch_documents(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """All chunks of the documents, with score 1."""
    return corpus.join(ids.select("document_id").distinct(), "document_id", "left_semi").select(*KEY, F.lit(1.0).alias("score"))


def hit_documents(hits: DataFrame, most: int | None = None) -> DataFrame:
    """Distinct documents in order of their first hit."""
    docs = hits.where(F.col("document_id").isNotNull()).groupBy("document_id").agg(F.min("pos").alias("first"))
    return docs if most is None else docs.orderBy("first").limit(most)


def expand_list(corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """All chunks of every hit document, in chunk order."""
    out = fetch_documents(corpus, hit_documents(hits)).dropDuplicates(list(KEY))
    return out.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), F.asc_nulls_first("chunk_index"), "document_id")))


def expand_comparison(corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """All chunks of the first two distinct documents; with fewer, as ``expand_smart``."""
    two = hit_documents(hits, 2)
    enough = two.agg((F.count("*") >= 2).alias("enough"))
    pair = fetch_documents(corpus, two).dropDuplicates(list(KEY)).withColumn("pos", F.row_number().over(Window.orderBy(*KEY)))
    other = expand_smart(corpus, hits)
    return pair.join(F.broadcast(enough.where("enough")), how="left_semi", on=F.lit(True)).unionByName(other.join(F.broadcast(enough.where("NOT enough")), how="left_semi", on=F.lit(True)))


def expand_smart(corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """Documents hit twice, or beyond their first chunk, are fetched whole, in document order; other hits follow."""
    docs = hits.groupBy("document_id").agg(F.count("*").alias("n"), F.max(F.coalesce(F.col("chunk_index"), F.lit(0)) > 0).alias("later")).where("n >= 2 OR later").select("document_id")
    whole = fetch_documents(corpus, docs).withColumns({"_part": F.lit(0), "_at": F.lit(0)})
    rest = hits.join(docs, "document_id", "left_anti").select(*KEY, "score", F.lit(1).alias("_part"), F.col("pos").alias("_at"))
    both = whole.unionByName(rest)
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("_part", "_at"))).where("_n = 1")
    return first.select(*KEY, "score", F.row_number().over(Window.orderBy("_part", "_at", *KEY)).alias("pos"))


def expand(corpus: DataFrame, hits: DataFrame, query_class: str) -> DataFrame:
    if query_class in ("List", "Procedural"):
        return expand_list(corpus, hits)
    return (expand_comparison if query_class == "Comparison" else expand_smart)(corpus, hits)


# Source filter --------------------------------------------------------------------


def filter_sources(ranked: DataFrame, query_class: str = "General", min_score: float = 0.40, gap: float = 0.25, most: int = 6) -> DataFrame:
    """The sources to answer from, of a bounded ranking (pos, score, source_url, title).

    A score threshold (laxer for lists and procedures; the first row if none
    passes), a cut at the first steep drop (not for those), one row per source,
    and at most ``most``.
    """
    broad = query_class in ("List", "Procedural")
    floor = min_score * 0.6 if broad else min_score
    every = Window.partitionBy(F.lit(0)).orderBy("pos")
    whole = Window.partitionBy(F.lit(0))
    marked = ranked.withColumn("_above", F.col("score") >= floor).withColumn("_any", F.max("_above").over(whole))
    kept = marked.where(F.col("_above") | (~F.col("_any") & (F.col("pos") == F.lit(1))))
    if not broad:
        before = F.lag("score").over(every)
        steep = F.when((before > 0) & ((before - F.col("score")) / before > gap), F.col("pos"))
        kept = kept.withColumn("_steep", steep).withColumn("_cut", F.min("_steep").over(whole)).where(F.col("_cut").isNull() | (F.col("pos") < F.col("_cut")))
    source = F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.col("title")) if "title" in ranked.columns else F.col("source_url")
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy(source).orderBy("pos"))).where("_n = 1")
    return kept.select(*ranked.columns).orderBy("pos").limit(most)


def context(rows: DataFrame) -> DataFrame:
    """One row ``context``: the numbered sources as a prompt holds them."""
    page = F.when(F.col("page_number").isNull(), "—").otherwise(F.concat(F.lit("hal. "), F.col("page_number").cast("string")))
    one = F.concat(F.lit("["), F.row_number().over(Window.orderBy("pos")).cast("string"), F.lit("] "), "title", F.lit(" ("), page, F.lit(")\nKategori: "), "category", F.lit(" / "), "subcategory", F.lit("\nSumber: "), "source_url", F.lit("\n\n"), "content")
    numbered = rows.select("pos", one.alias("one"))
    return numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "one"))), lambda x: x["one"]), "\n\n---\n\n").alias("context"))


def diverse_categories(rows: DataFrame, least: int = 3) -> DataFrame:
    """One row: the distinct categories, and whether there are enough for a hint."""
    names = F.array_sort(F.collect_set(F.nullif("category", F.lit(""))))
    return rows.agg(names.alias("categories")).withColumn("diverse", F.size("categories") >= least)


def ask(corpus: DataFrame, query: str, mode: str, k: int, vector: Sequence[float] | None = None, category: str | None = None, min_score: float = 0.40, most: int = 6) -> DataFrame:
    """Search, expansion and source filter as one lazy plan."""
    terms = query.lower().split()
    kind = tx.classify(query)
    hits = positioned(search(corpus, mode, k, terms, vector, category))
    wide = expand(corpus, hits, kind).join(corpus.select(*KEY, "source_url", "category"), list(KEY))
    return filter_sources(wide, kind, min_score, most=most)
