"""Chunkers as table functions for SQL and lateral joins.

    tablefunctions.register(spark)
    spark.sql("SELECT d.doc_id, c.* FROM documents d, LATERAL chunks(d.text, 'sentence') c")
    spark.sql("SELECT d.doc_id, c.* FROM documents d, LATERAL chunks_after(d.text, 'fixed', 3) c")

Rows travel to Python as Arrow batches and a document's chunks come back as rows,
so a long document is never one array in the engine.  ``chunks_after`` starts
behind a chunk that is known already: a broken-off job goes on where a document
stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.workspace import small_batches

from .chunking import STRATEGIES, by_sentence
from .text import detect_strategy

_ROW = "chunk_index int, chunk string"


class Chunks:
    """chunk_index and chunk of a text, by the strategy's name (unknown ones cut at sentences); a null text has none."""

    def eval(self, text: str, strategy: str) -> Iterator[tuple[int, str]]:
        if text is not None:
            yield from enumerate(STRATEGIES.get(strategy, by_sentence)(text))


class ChunksAfter:
    """As ``Chunks``, without the chunks up to a number (null: from the start)."""

    def eval(self, text: str, strategy: str, after: int) -> Iterator[tuple[int, str]]:
        for i, chunk in Chunks().eval(text, strategy):
            if after is None or i > after:
                yield i, chunk


def _function(kind: type):
    return F.udtf(kind, returnType=_ROW, useArrow=True)


def register(spark: SparkSession) -> None:
    """chunks and chunks_after for SQL; batches are kept small, as each row's chunks are a table of their own in a worker."""
    small_batches(spark, 500, 8 << 20)
    spark.udtf.register("chunks", _function(Chunks))
    spark.udtf.register("chunks_after", _function(ChunksAfter))


def lateral_chunks(docs: DataFrame, text: str = "text", strategy: str | None = None) -> DataFrame:
    """docs with a row for each chunk; the strategy is that of each text unless one is named."""
    small_batches(docs.sparkSession, 500, 8 << 20)
    name = detect_strategy(F.col(text)) if strategy is None else F.lit(strategy)
    named = docs.withColumn("_strategy", name)
    made = _function(Chunks)(F.col(text).outer(), F.col("_strategy").outer())
    return named.lateralJoin(made).drop("_strategy")
