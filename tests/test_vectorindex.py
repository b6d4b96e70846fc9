"""Approximate search: recall measured against exact search, cells pruned, batches appended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import batchsearch
from tessera.operators.vectorindex import VectorIndex

SCHEMA = "document_id long, chunk_index int, embedding array<float>"


def frame(spark, x, first=0):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"document_id": np.arange(first, first + len(x)), "chunk_index": np.zeros(len(x), np.int32), "embedding": [r.astype(np.float32).tolist() for r in x]}), SCHEMA)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 32))
    return centres[rng.integers(0, 150, 21_000)] + 0.6 * rng.normal(size=(21_000, 32))


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    """Fitted on the first batch; the second is assigned to the cells that are there."""
    found = VectorIndex(spark, str(tmp_path_factory.mktemp("vectors")))
    first = frame(spark, vectors[:14_000])
    found.fit(first, 10, 0.95)
    found.append(first.repartition(4))
    found.append(frame(spark, vectors[14_000:], 14_000).repartition(2))
    return found


def test_recall_over_20_000_vectors(spark, vectors, index):
    asked = frame(spark, vectors).where("document_id % 200 = 0").select(F.col("document_id").alias("question_id"), F.col("embedding").alias("vector"))
    exact = {(r.question_id, r.document_id): r.score for r in batchsearch.vector_topk_many(frame(spark, vectors), asked, 10).collect()}
    rows = index.search(asked, 10).collect()
    found = {(r.question_id, r.document_id): r.score for r in rows}
    assert len(rows) == len(found) == 10 * 105
    assert len(exact.keys() & found.keys()) / len(exact) >= 0.9
    assert all(abs(exact[k] - found[k]) < 2e-6 for k in exact.keys() & found.keys())
    every = {(r.question_id, r.document_id) for r in index.search(asked, 10, probes=10**6, margin=10**6).collect()}
    assert len(every & exact.keys()) >= len(exact) - 2  # sums of another order may round a tie otherwise


def test_few_cells_are_read(spark, vectors, index):
    model = index.model()
    assert model.probes < len(model.cells) / 3
    one = spark.createDataFrame([(1, [float(x) for x in vectors[5]])], "question_id long, vector array<double>")
    cells = model.near(vectors[5:6] / np.linalg.norm(vectors[5]), model.probes)[0].tolist()
    files = index.cells(cells).inputFiles()
    assert {int(f.split("cell=")[1].split("/")[0]) for f in index.cells(cells).select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} <= set(cells)
    plan = index.search(one, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:200] and files


def test_odd_vectors(spark, index, tmp_path):
    odd = spark.createDataFrame([(1, 0, None), (2, 0, [0.0] * 32), (3, 0, []), (4, None, [1.0] * 32), (4, 1, [1.0] * 32)], SCHEMA)
    small = VectorIndex(spark, str(tmp_path))
    small.fit(odd.where("document_id = 4"), 2)
    small.append(odd)
    asked = spark.createDataFrame([(1, [1.0] * 32), (2, [0.0] * 32), (3, None)], "question_id long, vector array<double>")
    assert [(r.question_id, r.document_id, r.chunk_index, r.score) for r in small.search(asked, 5).collect()] == [(1, 4, None, 1.0), (1, 4, 1, 1.0)]
    with pytest.raises(ValueError):
        VectorIndex(spark, str(tmp_path / "x")).fit(odd.where("document_id < 3"))


def test_recall_of_the_registered_query(spark):
    from tessera.plans import stores

    exact, found = ({(r.question_id, r.document_id) for r in f(spark, "/root/testdata/sf0.1").collect()} for f in (stores.vector_topk_many, stores.indexed_vector_topk_many))
    assert len(found) == len(exact) and len(exact & found) / len(exact) >= 0.9
