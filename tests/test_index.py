"""The stored inverted index and the search for tables of questions, against plain search."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import batchsearch, search, textindex
from tessera.operators.textindex import TextIndex
from tessera.sources import tables

CORPUS = "document_id long, chunk_index int, content string, category string, source_url string, embedding array<float>"
VOCABULARY = "the of and to a in that rain river stone été Straße 42 über cloud ridge".split()


def made(seed, n, spread=5):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(VOCABULARY))]
    return [(i // spread, i % spread, " ".join(rng.choices(VOCABULARY, weights, k=rng.randrange(0, 40))), rng.choice(["en", "de", None]), f"u{i % 9}", [rng.gauss(0, 1) for _ in range(8)] if i % 4 else None) for i in range(n)]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


KEYED = ("document_id", "chunk_index", "score")


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(made(1, 900), CORPUS).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    """Small segments and blocks, filled in three batches, with chunks that came again."""
    found = TextIndex(spark, str(tmp_path_factory.mktemp("index")), buckets=4, segment=60)
    found.append(corpus.where("document_id < 100").withColumn("content", F.when(F.col("document_id") % 3 == 0, F.concat(F.lit("river the the "), "content")).otherwise(F.col("content"))))
    found.append(corpus.where("document_id >= 60 and document_id < 120"))
    found.append(corpus.where("document_id < 60 or document_id >= 120"))
    return found


@pytest.mark.parametrize("terms", [["the"], ["the", "of"], ["the", "of", "rain"], ["42", "straße"], ["the", "the", "of"], ["nowhere"], ["the", "nowhere"], []])
def test_index_is_fulltext(corpus, index, terms):
    for k in (1, 7, 400):
        assert rows(index.topk(terms, k), *KEYED) == rows(search.fulltext_topk(corpus, terms, k), *KEYED)


def test_index_in_category(corpus, index):
    assert rows(index.topk(["the", "of"], 9, "de"), *KEYED) == rows(search.fulltext_topk(corpus, ["the", "of"], 9, "de"), *KEYED)


def test_early_end_leaves_blocks_out(index, monkeypatch):
    """With k = 1 most blocks' bounds lie under the best score found."""
    from tessera.operators import textindex

    rng, seen = np.random.default_rng(0), []
    blocks, n = np.arange(200), 200 * 10
    gain = np.repeat(np.linspace(0, 1, 200), 10) * rng.random(n)
    best = gain.reshape(200, 10).max(1)
    term = blocks, best, np.arange(0, n + 1, 10), np.arange(n), gain

    class Watched(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice) and at.stop is not None:
                seen.append(at.start)
            return super().__getitem__(at)

    watched = (*term[:3], term[3].view(Watched), gain)
    numbers, scores = textindex._all_terms({"x": watched}, {"x": 1}, 1, np.zeros(0, int), 1e-9)
    assert scores.max() == gain.max() and len(set(seen)) < 40


def test_plan_reads_only_the_terms_buckets(index):
    plan = index.postings(["rain"])._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:400]
    assert "EqualTo(term,rain)" in plan.replace(" ", "") or "In(term,[rain])" in plan.replace(" ", "")
    files = index.postings(["rain"]).select(F.input_file_name()).distinct().collect()
    assert {r[0].split("bucket=")[1].split("/")[0] for r in files} == {str(index.spark.sql(f"SELECT pmod(xxhash64('rain'), {index.buckets})").first()[0])}


def test_broken_off_append_changes_nothing(spark, corpus, tmp_path):
    found = TextIndex(spark, str(tmp_path / "i"), segment=100)
    found.append(corpus.where("document_id < 90"))
    before = rows(found.topk(["the"], 20), *KEYED)

    class Broken(Exception):
        pass

    def broken(*a):
        raise Broken

    half = TextIndex(spark, found.path, segment=100)
    half._chunks = broken
    with pytest.raises(Broken):
        half.append(corpus.where("document_id >= 80"))
    assert rows(found.topk(["the"], 20), *KEYED) == before and found.batches() == [0]
    found.append(corpus.where("document_id >= 80"))
    assert rows(found.topk(["the"], 20), *KEYED) == rows(search.fulltext_topk(corpus, ["the"], 20), *KEYED)
    assert found.chunks().count() == corpus.count()


def test_empty_index_and_texts(spark, tmp_path):
    found = TextIndex(spark, str(tmp_path / "none"))
    assert found.topk(["the"], 3).collect() == []
    found.append(spark.createDataFrame([(1, 0, None, None, "u", None), (2, 0, "", "x", "u", None), (3, None, "the", None, "u", None), (3, None, "THE end", None, "u", None)], CORPUS))
    got = found.topk(["the"], 3).collect()
    assert [(r.document_id, r.chunk_index) for r in got] == [(3, None)]


def test_many_questions_are_one_each(spark, corpus, index):
    asked = [(i, random.Random(i).choices(VOCABULARY, k=i % 4)) for i in range(30)] + [(99, None)]
    questions = spark.createDataFrame(asked, "question_id long, terms array<string>")
    terms = {i: [t.lower() for t in ts or []] for i, ts in asked}
    lowered = questions.withColumn("terms", F.transform("terms", F.lower))
    got = index.search(lowered, 5).collect()
    for i, ts in terms.items():
        mine = sorted((r.document_id, r.chunk_index, r.score) for r in got if r.question_id == i)
        assert mine == rows(search.fulltext_topk(corpus, ts, 5), *KEYED), ts


def test_questions_for_any_term(spark, corpus, index):
    questions = spark.createDataFrame([(1, ["rain", "ridge", "été"]), (2, ["nowhere", "cloud"])], "question_id long, terms array<string>")
    got = index.search(questions, 8, every=False).collect()
    for i, ts in ((1, ["rain", "ridge", "été"]), (2, ["nowhere", "cloud"])):
        ranked = search._lexical(corpus, ts).where(F.arrays_overlap(F.col("_tokens"), F.array(*map(F.lit, ts)))).select("document_id", "chunk_index", F.col("_lex").alias("score"))
        want = rows(ranked.orderBy(F.desc("score"), "document_id", "chunk_index").limit(8), *KEYED)
        assert sorted((r.document_id, r.chunk_index, r.score) for r in got if r.question_id == i) == want


def test_vectors_of_many_questions(spark, corpus, monkeypatch):
    monkeypatch.setattr(batchsearch, "BLOCK_ROWS", 50)
    monkeypatch.setattr(batchsearch, "HELD", 100)
    rng = random.Random(4)
    asked = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(6)] + [(7, [0.0] * 8), (8, [1.0, 2.0]), (9, None)]
    questions = spark.createDataFrame(asked, "question_id long, vector array<double>")
    copies = corpus.unionByName(corpus.where("document_id < 40").withColumn("document_id", F.col("document_id") + 1000))
    for most in (20_000, 4):
        monkeypatch.setattr(batchsearch, "MOST_QUESTIONS", most)
        got = batchsearch.vector_topk_many(copies, questions, 6).collect()
        for i, v in asked:
            mine = sorted((r.document_id, r.chunk_index, r.score) for r in got if r.question_id == i)
            assert mine == (rows(search.vector_topk(copies, v, 6), *KEYED) if v else [])
    assert batchsearch.vector_topk_many(copies, questions.limit(0), 6).collect() == []


def test_vectors_scan_the_corpus_once(spark, sf):
    embedded = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding")
    asked = embedded.select(F.col("document_id").alias("question_id"), F.col("embedding").alias("vector")).limit(50)
    plan = batchsearch.vector_topk_many(embedded, asked, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("floor", [0.1, 0.4, 3.0])
def test_ask_many_is_ask_for_each(spark, corpus, index, floor):
    """Every class, against one ask after another."""
    told = {1: "sebutkan the of", 2: "bagaimana cara the rain", 3: "bandingkan the and river", 4: "the of", 5: "apa itu the", 6: "bandingkan nowhere", 7: "ridge", 8: "siapa the 42"}
    asked = spark.createDataFrame(list(told.items()), "question_id long, query string")
    known = lambda q: [w for w in q.lower().split() if w in VOCABULARY]
    terms = spark.createDataFrame([(i, known(q)) for i, q in told.items()], "question_id long, terms array<string>")
    got = batchsearch.ask_many(corpus, index.search(terms, 6), asked, floor).collect()
    for i, q in told.items():
        hits = search.positioned(search.fulltext_topk(corpus, known(q), 6))
        kind = tx.classify(q)
        wide = search.expand(corpus, hits, kind).join(corpus.select("document_id", "chunk_index", "source_url", "category"), ["document_id", "chunk_index"])
        want = [(r.document_id, r.chunk_index, r.score, r.pos, r.source_url, r.category) for r in search.filter_sources(wide, kind, floor).collect()]
        mine = [(r.document_id, r.chunk_index, r.score, r.pos, r.source_url, r.category) for r in got if r.question_id == i]
        assert sorted(mine, key=lambda r: r[3]) == sorted(want, key=lambda r: r[3]), q


def test_packed_blocks():
    from tessera.operators import textindex

    rng = np.random.default_rng(2)
    counts = rng.integers(1, 40, 50)
    ends = np.cumsum(counts)
    places = rng.integers(0, 1024, ends[-1])
    for width, most in ((2, 2**16), (4, 2**32)):
        times, sizes = rng.integers(1, most, ends[-1]), rng.integers(0, most, ends[-1])
        blobs = textindex._packed(places, times, sizes, ends, width).to_pylist()
        for a, b, blob in zip(ends - counts, ends, blobs):
            for got, want in zip(textindex._unpacked(blob), (places, times, sizes)):
                assert got.tolist() == want[a:b].tolist()


def test_long_texts_in_the_index(spark, tmp_path):
    """More tokens, and more of one, than 16 bits hold."""
    rows = [(1, 0, "a b " * 70_000, "x", "u", None), (2, 0, "a b", "x", "u", None), (3, 0, "a " * 10, "x", "u", None)]
    docs = spark.createDataFrame(rows, CORPUS)
    found = TextIndex(spark, str(tmp_path / "long"))
    found.append(docs)
    assert rows_of_three(found.topk(["a"], 3)) == rows_of_three(search.fulltext_topk(docs, ["a"], 3))


def rows_of_three(df):
    return rows(df, *KEYED)


def test_what_is_asked_goes_to_a_segment_once(spark, tmp_path, monkeypatch):
    """Neither the questions nor the stale chunks travel with every block, and segments are bounded in bytes."""
    monkeypatch.setattr(textindex, "SEGMENT_BYTES", 500)
    docs = spark.range(400).selectExpr("CAST(id AS string) document_id", "0 chunk_index", "concat('a b w', id % 7, ' v', id % 50) content", "CAST(id % 2 AS string) category")
    index = TextIndex(spark, str(tmp_path))
    index.append(docs)
    index.append(docs.where("document_id % 3 = 0"))
    assert index._chunks([0]).select("segment").distinct().count() > 2
    seen = []
    search = textindex._segment_search
    monkeypatch.setattr(textindex, "_segment_search", lambda *a: seen.append(a) or search(*a))
    asked = spark.createDataFrame([(i, ["a", f"w{i % 7}", "b"]) for i in range(60)], "question_id long, terms array<string>")
    found = index.search(asked, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and seen and found.groupBy("question_id").count().where("count = 5").count() == 60
