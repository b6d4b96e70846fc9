"""The upsert store: commits are whole or nothing, and writing twice changes nothing."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.sources import upserts

SCHEMA = "document_id string, chunk_index int, content string, embedding array<float>"
KEYS = ["document_id", "chunk_index"]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upsert_by_key(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a", 0, "x", [1.0]), ("a", 1, "y", None), (None, None, "z", [])], SCHEMA)
    second = spark.createDataFrame([("a", 1, "new", [2.0, 3.0]), ("b", 0, None, None), (None, None, "nn", None)], SCHEMA)
    upserts.write(first.repartition(3), path, KEYS)
    assert rows(upserts.read(spark, path)) == rows(first)
    for _ in range(2):
        upserts.write(second.repartition(2), f"file://{path}", KEYS)
        assert rows(upserts.read(spark, path)) == rows(second.unionByName(first.where("content = 'x'")))
    want = rows(upserts.read(spark, path))
    upserts.compact(spark, path)
    assert rows(upserts.read(spark, path)) == want and len(upserts.versions(path)) == 4
    upserts.write(first, path, KEYS, "overwrite")
    assert rows(upserts.read(spark, path)) == rows(first)


def test_failed_task_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "store")
    upserts.write(spark.range(100).selectExpr("id", "id * 2 AS v").repartition(4), path, ["id"])
    before, files = rows(upserts.read(spark, path)), sorted(os.listdir(f"{path}/commits"))
    broken = spark.range(0, 100, 1, 4).withColumn("v", F.when(F.col("id") == 99, F.raise_error("killed").cast("long")).otherwise(F.lit(-1).cast("long")))
    with pytest.raises(Exception, match="killed"):
        upserts.write(broken, path, ["id"])
    assert rows(upserts.read(spark, path)) == before and sorted(os.listdir(f"{path}/commits")) == files
    left = [f for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")]
    assert len(left) == len(upserts.versions(path)[0]["files"])


def test_file_that_no_commit_names_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    upserts.write(spark.range(5).selectExpr("id", "1 AS v"), path, ["id"])
    spark.range(50, 60).selectExpr("id", "7 AS v").write.parquet(f"{path}/data/left-over")
    assert upserts.read(spark, path).count() == 5


def test_new_columns_and_repeated_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    upserts.write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), path, ["id"])
    upserts.write(spark.createDataFrame([(2, "c", 5), (2, "d", 4), (3, None, None)], "id int, v string, w int"), path, ["id"])
    assert rows(upserts.read(spark, path)) == [(1, "a", None), (2, "d", 4), (3, None, None)]


def test_store_as_chunk_merge(spark, tmp_path):
    """The same as the merge of two versions that hold all columns."""
    old = spark.range(50).selectExpr("CAST(id AS string) document_id", "0 chunk_index", "'o' content")
    new = spark.range(30, 70).selectExpr("CAST(id AS string) document_id", "0 chunk_index", "'n' content")
    for df in (old, new):
        upserts.write(df, str(tmp_path / "s"), KEYS)
    assert rows(upserts.read(spark, str(tmp_path / "s"))) == rows(ingest.upsert(old, new, KEYS, ["content"]))


def test_what_cannot_be_written(spark, tmp_path):
    with pytest.raises(Exception, match="keys"):
        spark.range(3).write.format("tessera_upsert").option("path", str(tmp_path)).mode("append").save()
    with pytest.raises(Exception, match="nokey"):
        upserts.write(spark.range(3), str(tmp_path), ["nokey"])
    with pytest.raises(FileNotFoundError):
        upserts.read(spark, str(tmp_path / "none"))
    upserts.write(spark.range(0), str(tmp_path / "empty"), ["id"])
    assert upserts.read(spark, str(tmp_path / "empty")).count() == 0
