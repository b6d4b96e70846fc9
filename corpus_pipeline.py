"""The corpus pipeline: filter, deduplicate, mix and encode the documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last
return the columns of ``documents``; between stages the rows are written as
Parquet and read again, so a lost executor costs one stage at most.

Rows: extra columns go through every stage but the last, whatever their names.
Null and empty texts have too few words and are rejected by the rules; a stage
called by itself keeps them where nothing speaks against them (the classifier
gives them weight 0, near-dedup takes each for a group of its own, the mix never
takes a document without words, the codec gives null ids or none).  Rows without
doc_id are documents like others.  Repeated rows (one doc_id, one text) are
judged alike, and near-dedup keeps one of them.  Ties at the classifier's cut are
all kept.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import importance, lattice_codec, minhash_dedup, mixing, quality_cascade
from tessera.llm.scratch import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_cascade.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents unlike the target text go."""
    return importance.keep_selected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8)."""
    return minhash_dedup.one_per_group(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs, F.array("source"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, piece_ids of each document, and whether decoding gives its text back."""
    coded = lattice_codec.coded(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids", "lossless")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

#: The classifier's noise and the sampled segmentations have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    scratch.drop(keep=(STAGES[-1][0],))
    return docs
