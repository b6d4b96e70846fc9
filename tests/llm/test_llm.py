"""The training-data operators against brute force, exact round trips and held-out labels, with awkward rows."""

import collections
import math
import os
import re
import zlib
from functools import reduce

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bitpack, components, importance, label_sharding, lattice_codec, minhash_dedup, mixing, quality_cascade, queries, rp_forest, scratch, token_counts, toxicity

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType()), T.StructField("key", T.StringType())])
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, sources=None):
    rows = [(i, t, None, (sources or ["s"] * len(texts))[i], None if t is None else len(t), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = " ".join(f"w{i}" for i in range(30_000))
AWKWARD = [None, "", " \n\t", "one", "one two", "the same text here twice over", "the same text here twice over", "x" * 5000, LONG, LONG + " end", "▁ lit▁eral  spaces", "<|endoftext|> and <s>", "naïve café 🎉 日本", "a\nb\n\n c\r\n", "the the the the the the the the the the"]


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def sets_of(texts, k):
    out = []
    for t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def brute_components(texts, k, num, den):
    sets = sets_of(texts, k)
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_copies(n=60, words=120, seed=1):
    """A base with edits of all degrees, chains of edits and unrelated texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}" for i in range(4000)]
    base = [vocabulary[i] for i in rng.integers(0, 4000, words)]
    out = []
    for i in range(n):
        w = list(base if i % 3 or not out else out[-1].split())
        for _ in range(i % 7):
            kind, at = int(rng.integers(0, 3)), int(rng.integers(0, len(w)))
            w[at : at + (kind != 1)] = [vocabulary[rng.integers(0, 4000)]] * (kind != 2)
        out.append(" ".join(w))
    return out + [" ".join(vocabulary[i] for i in rng.integers(0, 4000, 50)) for _ in range(10)]


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, num):
    texts = near_copies() + AWKWARD
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(frame(spark, texts), k, num, 100).collect()}
    assert got == brute_components(texts, k, num, 100)


def test_near_duplicates_edges(spark, awkward):
    assert minhash_dedup.near_duplicates(awkward.limit(0)).count() == 0
    twice = awkward.union(awkward)
    assert minhash_dedup.near_duplicates(twice).count() == len(AWKWARD)
    kept = minhash_dedup.one_per_group(awkward, 3, 85)
    assert kept.columns == awkward.columns and kept.where("doc_id = 6").count() == 0
    assert minhash_dedup.match_threshold(0.85) == 16


def test_rows_without_id(spark, sf, awkward):
    none = awkward.withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id")))
    labels = spark.read.parquet(f"{sf}/labels.parquet").union(spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int"))
    assert minhash_dedup.near_duplicates(none.union(none)).where("doc_id IS NULL AND kept").count() == 0
    assert bitpack.round_trip(none).count() == len(AWKWARD)
    for out in (label_sharding.shard(none), token_counts.count_tokens(none), importance.select(none, labels), quality_cascade.judge(none), lattice_codec.digests(none), toxicity.score(none, labels), mixing.mix(none, F.array("source"))):
        assert out.count() == len(AWKWARD)


def test_components(spark):
    s = scratch.Scratch(spark, "test")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (50, 70)], "a long, b long")
    got = {r.node: r.comp for r in components.components(links, s, "c").collect()}
    assert got == {i: 0 for i in range(21)} | {100: 50, 50: 50, 70: 50}
    s.drop()


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)) * rng.uniform(0.5, 2, (600, 1))
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] + [1.0] * 7, 0), (1060, [None] + [1.0] * 7, 0), (1080, [1.0], 0), (599, rows[599][1], 0)] + [(2000 + i, rows[0][1], 0) for i in range(30)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = collections.defaultdict(list)
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0, k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    every = {i: v for i, v, _ in rows} | {2000 + i: rows[0][1] for i in range(30)}
    hits = 0
    for q in (i for i in every if i % 20 == 0):
        exact = sorted((-sum(a * b for a, b in zip(every[q], v)), i) for i, v in every.items() if i != q)[:20]
        hits += len({i for _, i in exact} & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and all(s == reduce(lambda t, ab: t + ab[0] * ab[1], zip(every[q], every[i]), 0.0) for i, s in got[q])
    assert hits / (20 * len(got)) > 0.9 and set(got) == {i for i in every if i % 20 == 0}
    assert rp_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def recall(got, x):
    """Share of the true 20 nearest of every 20th row that were found."""
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(len(score)) * 20] = -np.inf
    near = np.argsort(-score, axis=1)[:, :20]
    return sum(len(got[20 * i] & set(n.tolist())) for i, n in enumerate(near)) / near.size


def search(spark, x):
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in rp_forest.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect():
        got[r.query_id].add(r.vec_id)
    assert set(got) == set(range(0, len(x), 20)) and all(len(v) == 20 for v in got.values())
    return got


def test_forest_recall(spark):
    x = np.random.default_rng(3).normal(size=(20_000, 16))
    assert recall(search(spark, x), x) > 0.92


def test_answers_come_from_leaves(spark, monkeypatch):
    """With hardly any leaf visited, hardly anything is found."""
    x = np.random.default_rng(3).normal(size=(6000, 16))
    monkeypatch.setattr(rp_forest.Forest, "_calibrate", lambda *_: 0.0)
    assert recall(search(spark, x), x) < 0.5


def test_query_recall(spark, sf):
    """The registered query against brute force on its whole table."""
    t = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = collections.defaultdict(list)
    for r in queries.QUERIES["op2_nearest_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id))
        assert r.score == reduce(lambda s, ab: s + ab[0] * ab[1], zip(t[r.query_id].tolist(), t[r.vec_id].tolist()), 0.0)
    hits = 0
    for q in (i for i in t if i % 20 == 0):
        exact = sorted((i for i in t if i != q), key=lambda i: (-float(t[q] @ t[i]), i))[:20]
        assert [k for k, _ in got[q]] == list(range(1, 21))
        hits += len({i for _, i in got[q]} & set(exact))
    assert hits / (20 * len(got)) > 0.9


def test_sharding(spark, awkward):
    texts = ["hot"] * 200 + [f"t{i // 3}" for i in range(300)] + [f"single {i}" for i in range(600)] + AWKWARD
    rows = label_sharding.shard(frame(spark, texts), 8).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    at = {r.doc_id: r for r in rows}
    assert all(at[i].size == 16 + len((t or "").encode()) and at[i].text_crc32 == zlib.crc32((t or "").encode()) for i, t in enumerate(texts))
    groups = collections.defaultdict(set)
    for i, t in enumerate(texts):
        groups[t].add(at[i].shard)
    assert len(groups["hot"]) <= 5 and sum(len(g) > 1 for t, g in groups.items() if t and t[0] == "t") <= 5
    assert label_sharding.shard(awkward.limit(0)).count() == 0
    assert label_sharding.shard(awkward).count() == len(AWKWARD)


@pytest.mark.parametrize("share,needed", [(3, 14), (5, 8), (10, 4)])
def test_sharding_gathers_large_groups(spark, share, needed):
    n = 12_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % share == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    rows = label_sharding.shard(docs, 40).select("doc_id", "shard").collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(rows) == n and set(sizes.values()) == {n // 40}
    assert needed <= len({r.shard for r in rows if r.doc_id % share == 0}) <= needed + 2


def test_token_counts(spark, awkward, small):
    from public_tokenizers import path
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    docs = awkward.select("doc_id", "text").union(small.select(F.col("doc_id") + 1000, "text"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in token_counts.count_tokens(docs).collect():
        n = len(sp.encode(text[r.doc_id] or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((text[r.doc_id] or "").encode()), n > 4096)


def test_importance(spark, sf, awkward):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = importance.select(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in kept}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.97 and n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.9
    assert importance.select(awkward, labels.limit(0)).where("kept").count() == len(AWKWARD)
    assert importance.select(awkward.limit(0), labels).count() == 0
    out = importance.keep_selected(awkward, labels.limit(0))
    assert out.columns == awkward.columns and out.count() == len(AWKWARD)


def test_ngrams_against_brute_force():
    import pyarrow as pa

    texts = ["A b, c", "", "x", "a b"]
    got = [len(b[f[i] : f[i + 1]]) for b, f in importance.ngrams(pa.array(texts)) for i in range(len(f) - 1)]
    assert got == [4 + 3, 0, 1, 2 + 1]
    (b, f), = importance.ngrams(pa.array(["a b", "A  B", "b a"]))
    one, two, other = (sorted(b[f[i] : f[i + 1]].tolist()) for i in range(3))
    assert one == two != other


def test_kth_largest(spark):
    keys = [5, -3, 5, 2**61, -(2**61), 0]
    df = spark.createDataFrame([(k,) for k in keys], "key long")
    assert [importance.kth_largest(df, k) for k in range(1, 7)] == sorted(keys, reverse=True)
    assert importance.kth_largest(df, 0) is None and importance.kth_largest(df, 7) is None


def test_quality_rules(spark, awkward, small):
    docs = awkward.select("doc_id", "text").union(small.select(F.col("doc_id") + 1000, "text"))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in quality_cascade.judge(docs).collect():
        t = text[r.doc_id] or ""
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.kept == (r.rejected_by is None)
    kept = quality_cascade.keep_good(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_cascade.judge(awkward).where("kept").collect()}
    assert quality_cascade.judge(awkward.limit(0)).count() == 0


def test_lattice_codec(spark, awkward, small):
    docs = awkward.union(awkward)
    coded = lattice_codec.encode(docs)
    rows = lattice_codec.decode(coded).collect()
    assert all(r.decoded == r.text and (r.piece_ids is None) == (r.text is None) for r in rows)
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add(tuple(r.piece_ids or ()))
    assert all(len(v) == 1 for v in by_id.values())
    assert lattice_codec.digests(small).where("NOT lossless").count() == 0
    assert lattice_codec.encode(docs.limit(0)).count() == 0


def test_lattice_distribution():
    codec = lattice_codec.Codec("piece_bpe_32k.model", 1.0)
    p = codec.pieces

    def paths(s):
        if not s:
            yield (), 1.0
        for n in range(1, len(s) + 1):
            if s[:n] in p.score:
                for q, w in paths(s[n:]):
                    yield (p.id[s[:n]], *q), w * (2.0 - p.score[s[:n]]) ** -1.0

    weights = dict(paths("▁mention"))
    total = sum(weights.values())
    n = 20_000
    flat, at = codec.encode(["mention"] * n, list(range(n)))
    seen = collections.Counter(tuple(x.tolist()) for x in np.split(flat, at[1:-1]))
    assert set(seen) <= set(weights)
    for path, w in weights.items():
        assert abs(seen[path] / n - w / total) < 5 * math.sqrt(w / total / n) + 1e-4
    one = codec.draw(codec.forward("▁mention"), 0.3)
    assert one in weights


def test_toxicity(spark, awkward):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    y, p = np.array([r.toxic for r in rows]), np.array([r.predicted for r in rows])
    assert (y == p).mean() > 0.93 and p[y == 1].mean() > 0.75
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    none = toxicity.score(awkward, labels.limit(0)).collect()
    assert len(none) == len(AWKWARD) and {r.predicted for r in none} == {0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_toxicity_trains_on_one_text_of_a_repeated_id(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 6 + 1, f"text {i % 6} {i // 6 % 2}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 7)] * 3, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, toxic, share: seen.append((texts, toxic)) or {"table": np.zeros(toxicity.CLASSES**3), "bias": -1.0, "slope": 0.0, "offset": 0.0})
    toxicity.fit(docs, labels)
    used = [i for i in range(1, 7) if zlib.crc32(str(i).encode()) % 5]
    assert used and sorted(zip(*seen[0])) == [(f"text {i - 1} 0", i % 2) for i in used]


def test_toxicity_tolerates_inserted_characters():
    cls = [toxicity.words([t])[0].tolist() for t in ("idiot", "i.d-i*o_t", "i d i o t")]
    assert cls[0] == cls[1] and sorted(cls[0]) == sorted(cls[2])


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 9001, np.uint64).astype(np.uint32)
    image = bitpack.Image(bitpack.write_image([7, 9, 11], [5000, 0, 4001], ids, bits))
    assert (image.ids(0, 9001) == ids).all() and (image.document(2) == ids[5000:]).all() and not len(image.document(1))
    assert (image.ids(4090, 4100) == ids[4090:4100]).all()
    with pytest.raises(ValueError):
        bitpack.Image(b"x" * 100)


def test_token_files(spark, awkward, small):
    docs = awkward.select("doc_id", "text").union(small.select(F.col("doc_id") + 1000, "text"))
    tokenizer = bitpack._tokenizer("byte_bpe_50k.json")
    start, expected = 0, {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        expected[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitpack.round_trip(docs).collect()} == expected
    assert bitpack.round_trip(docs.limit(0)).count() == 0


def test_mixing(spark, small):
    sources = ["a", "b", None, "é"]
    docs = small.withColumn("source", F.get(F.array(*[F.lit(x) for x in sources]), (F.col("doc_id") % 4).cast("int")))
    rows = mixing.mix(docs, F.array("source")).collect()
    again = mixing.mix(docs.repartition(7), F.array("source")).collect()
    assert {tuple(r) for r in rows} == {tuple(r) for r in again}
    source = {r.doc_id: r.source for r in docs.collect()}
    size, target, taken = collections.Counter(), {}, collections.Counter()
    for r in rows:
        s = source[r.doc_id]
        size[s] += r.size
        taken[s] += r.taken
        target[s] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    names = ["a", "b", "é", None]
    assert [target[s] for s in names] == mixing.reshared_targets([size[s] for s in names], [3, 1, 2, 3], 1.5, 2)
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 1 for s in names)
    assert mixing.mix(docs.limit(0), F.array("source")).count() == 0
    out = mixing.mixed(docs, F.array("source"))
    assert out.columns == docs.columns and out.count() == sum(r.taken // r.size for r in rows if r.size)


def test_flow_with_overlapping_sources():
    flow = mixing.min_cost_flow({"x": 100, "y": 50, "xy": 100}, {"x": 150, "y": 140}, {"x": ["x"], "y": ["y"], "xy": ["x", "y"]}, 2)
    assert sum(v for (_, s), v in flow.items() if s == "x") == 150 and sum(v for (_, s), v in flow.items() if s == "y") == 140
    used = collections.Counter()
    for (p, _), v in flow.items():
        used[p] += v
    assert sum(max(0, used[p] - n) for p, n in {"x": 100, "y": 50, "xy": 100}.items()) == 40
    assert mixing.reshared_targets([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, 250 / 3, 500 / 3]
    assert mixing.reshared_targets([], [], 1.5, 2) == []


def test_awkward_mix(spark, awkward):
    rows = mixing.mix(awkward, F.array("source")).collect()
    assert len(rows) == len(AWKWARD) and all(r.taken == 0 for r in rows if r.size == 0)


def test_queries_against_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df, rel = queries.QUERIES[name](spark, sf), con.sql(sql)
        at = [rel.columns.index(c) for c in df.columns]
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall()), name


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    base = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns or name == "sentencepiece"
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= set(base)
        if name == "near_dedup":
            kept = [r.text for r in docs.collect()]
            assert {c for _, c in brute_components(kept, 5, 80, 100).values()} == set(range(len(kept)))
    assert docs.where("NOT lossless").count() == 0
    assert os.path.basename(corpus_pipeline.__file__) == "corpus_pipeline.py"
