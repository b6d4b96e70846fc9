"""Search, expansion and source filter for a whole table of questions.

``vector_topk_many`` multiplies blocks of the corpus with the questions' matrix
inside the tasks: one scan for up to ``MOST_QUESTIONS`` questions, no join, no row
for a pair that is not among a task's best.  ``ask_many`` is ``search.ask`` with
the branches on the class of a question turned into data: classes, positions and
expansions are columns and windows by question, so one plan answers all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

from .search import KEY

#: Questions whose vectors are broadcast together; more are answered in as many scans.
MOST_QUESTIONS = 20_000
#: Corpus rows multiplied at once.
BLOCK_ROWS = 2_000
#: Candidates of a task that are kept before they are cut to the best k of each question.
HELD = 2_000_000


# Vectors ----------------------------------------------------------------------


def _matrix(lists: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in double precision, cut or filled with zeros to a width, and their norms; null elements count as nothing."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.nan_to_num(lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)) if lists.flatten().null_count else lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        out = values.reshape(-1, width)
        return out, np.sqrt((out * out).sum(1))
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = at < width
    out[row[inside], at[inside]] = values[inside]
    return out, np.sqrt(np.bincount(row, values * values, len(sizes)))


class _Best:
    """The best k rows of each question so far: by score rounded to six places, then key."""

    def __init__(self, questions: int, k: int):
        self.k, self.least, self.parts, self.size = k, np.full(questions, -np.inf), [], 0

    def add(self, scores: np.ndarray, keys: pd.DataFrame) -> None:
        """scores: questions x rows."""
        if scores.shape[1] >= self.k:
            self.least = np.maximum(self.least, np.partition(scores, scores.shape[1] - self.k, 1)[:, scores.shape[1] - self.k])
        q, r = np.nonzero(scores >= self.least[:, None])
        part = keys.iloc[r].reset_index(drop=True)
        part["q"], part["score"] = q, scores[q, r]
        self.parts.append(part)
        self.size += len(part)
        if self.size > HELD:
            self.cut()

    def offer(self, question: int, scores: np.ndarray, keys: pd.DataFrame, rows: np.ndarray) -> None:
        """Some rows for one question."""
        kept = scores >= self.least[question]
        if not kept.any():
            return
        part = keys.iloc[rows[kept]].reset_index(drop=True)
        part["q"], part["score"] = question, scores[kept]
        self.parts.append(part)
        self.size += len(part)
        if self.size > HELD or len(self.parts) > 2_000:
            self.cut()

    def cut(self) -> pd.DataFrame:
        every = pd.concat(self.parts, ignore_index=True)
        every = every[every["score"].to_numpy() >= self.least[every["q"].to_numpy()]]
        best = every.sort_values(["q", "score", *KEY], ascending=[True, False, True, True], na_position="first", kind="stable").groupby("q", sort=False).head(self.k)
        last = best.groupby("q").agg(n=("score", "size"), least=("score", "min"))
        full = last[last["n"] == self.k]
        self.least[full.index.to_numpy()] = full["least"].to_numpy()
        self.parts, self.size = [best], len(best)
        return best


def vector_topk_many(corpus: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """question_id, document_id, chunk_index, score: for each question (question_id long, vector array) what ``vector_topk`` gives.

    A question without a vector finds nothing.
    """
    spark = corpus.sparkSession
    some = corpus.where(F.col("embedding").isNotNull()).select(*KEY, "embedding")
    out = None
    for ids, vectors in _blocks_of(questions.where(F.col("vector").isNotNull()).select(F.col("question_id").cast("long"), "vector")):
        width = max(map(len, vectors))
        asked, norms = _matrix(pa.array(vectors, pa.list_(pa.float64())), max(1, width))
        sent = spark.sparkContext.broadcast((ids, asked, norms))
        found = some.mapInArrow(_multiplied(sent, k), f"question_id long, document_id {dict(some.dtypes)['document_id']}, chunk_index {dict(some.dtypes)['chunk_index']}, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return some.select(F.lit(0).cast("long").alias("question_id"), *KEY, F.lit(0.0).alias("score")).limit(0)
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *KEY))
    return out.withColumn("score", F.round("score", 6)).withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def _blocks_of(questions: DataFrame) -> Iterator[tuple[list[int], list]]:
    """Questions by blocks; only one block is on the driver."""
    ids, vectors = [], []
    for r in questions.toLocalIterator():
        ids.append(r.question_id)
        vectors.append([x or 0.0 for x in r.vector])
        if len(ids) == MOST_QUESTIONS:
            yield ids, vectors
            ids, vectors = [], []
    if ids:
        yield ids, vectors


def _multiplied(sent, k: int):
    def run(batches):
        ids, asked, norms = sent.value
        best, types = _Best(len(ids), k), None
        for batch in batches:
            types = batch.schema
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                rows, sizes = _matrix(part.column(2), asked.shape[1])
                size = norms[:, None] * sizes[None, :]
                with np.errstate(divide="ignore", invalid="ignore"):
                    scores = np.where(size == 0, 0.0, asked @ rows.T / size)
                best.add(np.round(scores, 6), part.select(list(KEY)).to_pandas())
        if types is not None and best.parts:
            top = best.cut()
            columns = [pa.array(np.array(ids, np.int64)[top["q"].to_numpy()]), *(pa.array(top[c], type=types.field(c).type, from_pandas=True) for c in KEY), pa.array(top["score"].to_numpy(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, ["question_id", *KEY, "score"])

    return run


# Questions as a table -----------------------------------------------------------


def positioned_many(hits: DataFrame) -> DataFrame:
    """Hits with pos from 1 in each question."""
    return hits.withColumn("pos", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *KEY)))


def expand_many(corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """``search.expand`` for all questions: hits carry question_id, kind and pos; the chunks carry their source_url and category.

    Hits are read once and the corpus once: a document that is fetched whole is
    joined at its first hit, any other hit is joined with its own chunk.
    """
    of_document = Window.partitionBy("question_id", "document_id")
    marked = hits.withColumns({"_first": F.min("pos").over(of_document), "_n": F.count("*").over(of_document), "_later": F.max(F.coalesce(F.col("chunk_index"), F.lit(0)) > 0).over(of_document)})
    # Documents of a question numbered by their first hit: dense, as all hits of one share it.
    in_order = Window.partitionBy("question_id").orderBy("_first")
    marked = marked.withColumn("_doc", F.dense_rank().over(in_order)).withColumn("_docs", F.max("_doc").over(Window.partitionBy("question_id")))
    listed = F.col("kind").isin("List", "Procedural")
    compared = (F.col("kind") == "Comparison") & (F.col("_docs") >= 2)
    smart = (F.col("_n") >= 2) | F.col("_later")
    marked = marked.withColumns({"_how": F.when(listed, "list").when(compared, "pair").otherwise("smart"), "_whole": F.when(listed, True).when(compared, F.col("_doc") <= 2).otherwise(smart)})
    wanted = marked.where(F.when(F.col("_whole"), F.col("pos") == F.col("_first")).otherwise(F.col("_how") == "smart"))
    wanted = wanted.select("question_id", "kind", "_how", "_whole", "pos", "score", F.col("document_id").alias("_document"), F.col("chunk_index").alias("_chunk"))
    chunks = corpus.select(*KEY, "source_url", "category").dropDuplicates(list(KEY))
    both = wanted.join(chunks, (F.col("_document") == F.col("document_id")) & (F.col("_whole") | F.col("_chunk").eqNullSafe(F.col("chunk_index"))))
    rows = both.select("question_id", "kind", "_how", *KEY, F.when(F.col("_whole"), 1.0).otherwise(F.col("score")).alias("score"), F.when(F.col("_whole"), 0).otherwise(1).alias("_part"), F.when(F.col("_whole"), 0).otherwise(F.col("pos")).alias("_at"), "source_url", "category")
    listing = F.col("_how") == "list"
    order = [F.when(F.col("_how") == "smart", F.col("_part")), F.when(F.col("_how") == "smart", F.col("_at")), F.when(listing, F.coalesce(F.col("chunk_index"), F.lit(-1))), "document_id", "chunk_index"]
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("question_id").orderBy(*order))).select("question_id", "kind", *KEY, "score", "pos", "source_url", "category")


def filter_sources_many(ranked: DataFrame, min_score: float = 0.40, gap: float = 0.25, most: int = 6) -> DataFrame:
    """``search.filter_sources`` for all questions, each by its kind."""
    broad = F.col("kind").isin("List", "Procedural")
    floor = F.when(broad, min_score * 0.6).otherwise(min_score)
    whole = Window.partitionBy("question_id")
    marked = ranked.withColumn("_above", F.col("score") >= floor).withColumn("_any", F.max("_above").over(whole))
    kept = marked.where(F.col("_above") | (~F.col("_any") & (F.col("pos") == 1)))
    before = F.lag("score").over(whole.orderBy("pos"))
    steep = F.when(~broad & (before > 0) & ((before - F.col("score")) / before > gap), F.col("pos"))
    kept = kept.withColumn("_steep", steep).withColumn("_cut", F.min("_steep").over(whole)).where(F.col("_cut").isNull() | (F.col("pos") < F.col("_cut")))
    source = F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.col("title")) if "title" in ranked.columns else F.col("source_url")
    one = F.row_number().over(Window.partitionBy("question_id", source).orderBy("pos"))
    kept = kept.withColumn("_one", one).where("_one = 1")
    return kept.withColumn("_place", F.row_number().over(whole.orderBy("pos"))).where(F.col("_place") <= most).select(*ranked.columns)


def ask_many(corpus: DataFrame, hits: DataFrame, questions: DataFrame, min_score: float = 0.40, most: int = 6) -> DataFrame:
    """Expansion and source filter of the hits of many questions (question_id, query): what ``search.ask`` gives for each."""
    kinds = questions.select(F.col("question_id").cast("long").alias("question_id"), tx.classify_query(F.col("query")).alias("kind"))
    positioned = positioned_many(hits).join(kinds, "question_id")
    return filter_sources_many(expand_many(corpus, positioned), min_score, most=most).drop("kind")
