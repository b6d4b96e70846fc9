"""Chunkers as table functions against the array form."""

from pyspark.sql import functions as F

from tessera.functions import chunking, tablefunctions

ROWS = [(1, "One sentence here is quite long enough. Another one follows it right away! " * 30, "x"), (2, "", "x"), (3, None, "x"), (4, "1. a\n2. b\n3. c\n\n" * 60, "x"), (5, "x" * 5_000, "x")]


def rows(df):
    return sorted(map(tuple, df.select("id", "chunk_index", "chunk").collect()))


def test_lateral_join_is_the_array(spark):
    docs = spark.createDataFrame(ROWS, "id int, text string, clash string")
    for name in (None, "sentence", "structural", "fixed"):
        want = chunking.explode_chunks(docs, chunking.chunked(F.col("text"), name or "auto"))
        assert rows(tablefunctions.lateral_chunks(docs, "text", name)) == rows(want)


def test_sql_and_going_on(spark):
    docs = spark.createDataFrame(ROWS, "id int, text string, clash string")
    docs.createOrReplaceTempView("chunked_docs")
    tablefunctions.register(spark)
    every = rows(spark.sql("SELECT id, c.* FROM chunked_docs, LATERAL chunks(text, 'fixed') c"))
    done = spark.createDataFrame([(1, 0), (5, 2)], "id int, after int")
    done.createOrReplaceTempView("chunked_done")
    rest = rows(spark.sql("SELECT d.id, c.* FROM chunked_docs d LEFT JOIN chunked_done USING (id), LATERAL chunks_after(d.text, 'fixed', after) c"))
    assert rest == [r for r in every if not (r[0] == 1 and r[1] <= 0 or r[0] == 5 and r[1] <= 2)]
    assert every and rows(tablefunctions.lateral_chunks(docs.limit(0))) == []
