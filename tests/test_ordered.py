"""Deep pages and islands against plain offset and plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.operators import ordered


def test_pages_are_offsets(spark, tmp_path):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, rng.randrange(50), None if i % 7 == 0 else "x") for i in range(2_000)], "id long, v int, t string")
    order = [F.desc_nulls_last("v"), F.asc("id")]
    pages = ordered.Pages(spark, str(tmp_path), order).build(rows, 100)
    for offset, limit in ((0, 10), (95, 20), (1990, 50), (5000, 5), (7, 0), (300, 700)):
        assert pages.page(limit, offset).collect() == rows.orderBy(*order).offset(offset).limit(limit).collect()
    assert len(pages.counts()) > 5
    read = pages.page(5, 1500).inputFiles()
    files = pages.page(5, 1500).select(F.input_file_name()).distinct().count()
    assert files == 1 and read
    with pytest.raises(ValueError):
        pages.page(-1)
    assert ordered.Pages(spark, str(tmp_path / "none"), order).build(rows.limit(0)).page(5).collect() == []


@pytest.mark.parametrize("groups", [1, 3, 200])
def test_islands_are_segments(spark, groups):
    rng = random.Random(groups)
    rows = [(i, None if groups == 3 and i % 3 == 0 else i % groups, None if i % 31 == 0 else [0.0] * 4 if i % 37 == 0 else [rng.gauss(0.3, 1) for _ in range(4)], "clash") for i in range(1_200)]
    df = spark.createDataFrame(rows, "id long, g int, embedding array<float>, extra string")
    got = ordered.islands(df, "g", "id", threshold=0.2, part_rows=90)
    want = chunking.semantic_segments(df, "g", "id", threshold=0.2)
    assert sorted(map(tuple, got.select("id", "segment").collect())) == sorted(map(tuple, want.select("id", "segment").collect()))
    if groups == 1:
        sizes = [r["count"] for r in df.sparkSession.read.parquet(got.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_part").count().collect()]
        assert len(sizes) > 5 and max(sizes) < 400


def test_islands_of_nothing(spark):
    assert ordered.islands(spark.createDataFrame([], "id long, g int, embedding array<float>"), "g", "id").collect() == []
