"""Selection, flow, kernel and cascade against plain computations, and awkward rows through every pipeline stage."""

import collections
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitpack, components, importance, label_sharding, lattice_codec, minhash_dedup, mixing, quality_cascade, scratch, toxicity, wordhash

SF = "/root/testdata/sf0.001"


def gumbels(docs, seed):
    return {r.doc_id: r.g for r in docs.select("doc_id", importance.gumbel(seed).alias("g")).collect()}


def test_importance_resampling(spark):
    """Counts, weights, noise and the top k, computed one by one."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & set(text)
    grams = {i: next(importance.ngrams(pa.array([t])))[0] if t else np.zeros(0, np.int64) for i, t in text.items()}
    size = 1 << importance.BUCKET_BITS
    raw, target = np.zeros(size), np.zeros(size)
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += i in good
    p, q = ((c + importance.SMOOTH) / (c.sum() + importance.SMOOTH * size) for c in (target, raw))
    weight = {i: importance.WEIGHT * np.mean(np.log(p[g]) - np.log(q[g])) if len(g) else 0.0 for i, g in grams.items()}
    cut = sorted(weight[i] for i in good)[int(importance.LOSS * len(good))]
    k = sum(w >= cut - 1e-9 for w in weight.values())
    noise = gumbels(docs, 11)
    best = sorted(text, key=lambda i: -(weight[i] + noise[i]))[:k]
    rows = importance.select(docs, labels).collect()
    assert all(abs(r.log_weight - weight[r.doc_id]) < 1e-6 for r in rows)
    assert {r.doc_id for r in rows if r.kept} == set(best)


def test_importance_on_rows_it_was_not_fitted_on(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fold = F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(3)) == 0
    rows = importance.select(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").groupBy("quality", "kept").count().collect()
    n = collections.Counter({(r.quality, r.kept): r["count"] for r in rows})
    assert n[1, True] / (n[1, True] + n[1, False]) > 0.95 and n[0, False] / (n[0, True] + n[0, False]) > 0.85


@pytest.mark.parametrize("supply,quotas", [((2, 1, 2), (3, 3)), ((1, 1, 1), (4, 4)), ((2, 2, 0), (3, 1)), ((0, 2, 2), (2, 4)), ((2, 0, 1), (5, 1))])
def test_flow_is_the_cheapest(supply, quotas):
    """Of all ways to fill the quotas as far as they can be filled, none repeats less."""
    members = {"x": ["X"], "y": ["Y"], "xy": ["X", "Y"]}
    supply, quotas = dict(zip(members, supply)), dict(zip("XY", quotas))
    arcs = [(p, s) for p, m in members.items() for s in m]

    def outcome(flow):
        used = {p: sum(v for (a, _), v in flow.items() if a == p) for p in supply}
        fits = all(used[p] <= 2 * supply[p] for p in supply) and all(sum(v for (_, b), v in flow.items() if b == s) <= quotas[s] for s in quotas)
        return (-sum(flow.values()), sum(max(0, used[p] - supply[p]) for p in supply)) if fits else (1, 0)

    best = min(outcome(dict(zip(arcs, v))) for v in itertools.product(range(6), repeat=len(arcs)))
    assert outcome({**dict.fromkeys(arcs, 0), **mixing.min_cost_flow(supply, quotas, members, 2)}) == best


def test_mix_takes_the_seeded_order(spark):
    """What is taken is a leading part of the seeded order, and then at most FILLS documents that fit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in mixing.mix(docs, F.array("source")).collect()}
    order = collections.defaultdict(list)
    base = mixing._mixed_rows(docs, F.array("source")).join(docs.select("doc_id", "source"), "doc_id")
    for r in base.select("doc_id", "source", F.shiftrightunsigned(F.xxhash64(F.lit(17), "_doc", "_print"), 2).alias("o")).collect():
        order[r.source].append((r.o, r.doc_id))
    for own in order.values():
        times = [rows[i].taken // rows[i].size if rows[i].size else None for _, i in sorted(own)]
        times = [t for t in times if t is not None]
        low = min(times)
        cut = next((k for k, t in enumerate(times) if t == low), len(times))
        assert sum(t > low for t in times[cut:]) <= mixing.FILLS and max(times) - low <= 1


def test_repeated_and_nameless_rows_in_a_mix(spark):
    rows = [(7, "", "a"), (7, "one two three", "a"), (7, "one two three", "a"), (None, "x y", "a"), (None, "x y", "b"), (8, "p q r s", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, F.array("source")).collect()
    assert len(out) == len(rows) and all(r.taken == 0 for r in out if r.size == 0)
    taken = collections.Counter((r.doc_id, r.size) for r in out for _ in range(r.taken // r.size if r.size else 0))
    got = collections.Counter((r.doc_id, len(r.text.split())) for r in mixing.mixed(docs, F.array("source")).collect())
    assert got == taken and (7, 0) not in got


def spelled(word):
    """A word as classes, as training holds it: a mark in front, the one behind is added by the kernel."""
    cls, starts, ends, _ = toxicity.words([word])
    return cls.astype(np.uint8).tobytes()[starts[0] : ends[0]]


def brute_kernel(a, b):
    """Common subsequences of three characters over marked words, each occurrence weighing DECAY to its span, spans up to five; scaled as the operator scales."""

    def triples(u):
        u, out = u + b"\x01", collections.Counter()
        for i, j, k in itertools.combinations(range(len(u)), 3):
            if k - i <= 4:
                out[u[i], u[j], u[k]] += toxicity.DECAY ** (k - i + 1)
        return out

    x, y = triples(a), triples(b)
    scale = [sum(toxicity.DECAY ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(len(u) + 1), 3) if k - i <= 4) ** 0.5 for u in (a, b)]
    return sum(w * y[t] for t, w in x.items()) / (scale[0] * scale[1])


@pytest.mark.parametrize("a,b", [("idiot", "idiot"), ("idiot", "idxiot"), ("idiot", "ixdxixoxt"), ("stupid", "stuupid"), ("idiot", "garden"), ("moron", "mor0n"), ("banana", "ananas")])
def test_kernel(a, b):
    u, v = spelled(a), spelled(b)
    assert toxicity._kernel([u], toxicity._features([v]))[0, 0] == pytest.approx(brute_kernel(u, v), rel=1e-5)


def test_kernel_tolerates_gaps_and_insertions():
    """A spelling with a letter put in or a gap is nearer to the word than words that share letters with it."""
    marks = toxicity._features([spelled("idiot")])
    near = dict(zip(words := ["idxiot", "idiiot", "i.d.i.o.t", "i d i o t", "idioot", "edition", "toxin", "garden"], toxicity._kernel([spelled(w) for w in words], marks)[:, 0]))
    assert near["i.d.i.o.t"] == near["i d i o t"] == pytest.approx(1.0, abs=0.2)
    assert min(near[w] for w in ("idxiot", "idiiot", "idioot")) > 0.5 > max(near[w] for w in ("edition", "toxin", "garden")) + 0.1


def test_svm_finds_spellings_it_has_not_seen():
    """Trained on whole labelled sentences; new spellings of the insults are found, clean sentences are not."""
    rng = np.random.default_rng(5)
    clean = ["the garden is green", "a letter came today", "we read about the river", "music for the evening", "bread and butter", "the train was late again", "numbers in a long list"]
    texts, toxic = [], []
    for i in range(400):
        parts = [clean[j] + f" w{rng.integers(0, 300)}" for j in rng.integers(0, len(clean), 4)]
        if i % 2:
            parts.insert(int(rng.integers(0, 4)), f"you {['idiot', 'moron'][i // 2 % 2]} there")
        texts.append(". ".join(parts))
        toxic.append(i % 2)
    m = toxicity.train(texts, toxic, 0.5)
    new = ["you idxiot there", "such a mooron he is", "you i.d.i.o.t", "m o r o n"]
    f = toxicity.worst(new + clean, m["table"], m["bias"])
    assert f[: len(new)].min() > f[len(new) :].max()


def test_sharding_gathers_what_brute_force_gathers(spark):
    """Groups that fit into a shard end up whole, unless quotas force one or two apart; law and slots hold."""
    texts = [f"g{i // 5}" for i in range(100)] + [f"single {i}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = label_sharding.shard(docs, 5).collect()
    at, sizes = {r.doc_id: r.shard for r in rows}, collections.Counter(r.shard for r in rows)
    cut = sum(at[i] != at[j] for g in range(20) for i, j in itertools.combinations(range(5 * g, 5 * g + 5), 2))
    start = {r.doc_id: r.s for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("s")).collect()}
    cut_before = sum(start[i] != start[j] for g in range(20) for i, j in itertools.combinations(range(5 * g, 5 * g + 5), 2))
    assert set(sizes.values()) == {40} and cut <= 0.1 * cut_before


def test_cascade_stops_at_the_first_rejection(spark):
    """Rules behind the one that rejects are not evaluated; the order and the estimates are the same in every run."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, two = (quality_cascade.estimate(docs, quality_cascade.default_rules) for _ in range(2))
    assert one == two == quality_cascade.estimate(docs.repartition(3), quality_cascade.default_rules)
    order = quality_cascade.cascade_order(one)
    assert order == sorted(one, key=lambda r: (-(one[r][1] + 1e-4) / one[r][0], r))
    bomb = F.raise_error(F.lit("evaluated")).cast("boolean")
    rules = [quality_cascade.Rule("a", F.col("doc_id") >= 0, ()), quality_cascade.Rule("b", bomb, ())]
    assert {r[0] for r in docs.select(quality_cascade.first_rejection(rules, ["a", "b"])).collect()} == {"a"}
    with pytest.raises(Exception, match="evaluated"):
        docs.select(quality_cascade.first_rejection(rules, ["b", "a"])).collect()
    judged = quality_cascade.judge(docs).collect()
    kept = {r.doc_id for r in quality_cascade.keep_good(docs).collect()}
    assert kept == {r.doc_id for r in judged if r.kept} and {r.rejected_by for r in judged} <= {None, *order}


def test_counting_agreements_decides_candidates(spark):
    """The count over packed signatures is an upper bound of the agreeing coordinates, and drops pairs that share a token."""
    texts = [" ".join(f"v{j}" for j in range(i, i + 60)) for i in range(0, 60, 4)]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, named boolean")
    sig = minhash_dedup.signatures(docs, 3).collect()
    full = {r.doc_id: np.frombuffer(r.sig, "<u4") for r in sig}
    reps = spark.createDataFrame([(r.doc_id, r.n_shingles, r.sig) for r in sig], "node long, n long, sig binary")
    counts = spark.sparkContext.broadcast(np.zeros(1 << minhash_dedup.COUNT_BITS, np.int64))
    need = minhash_dedup.match_threshold(0.85)
    post = minhash_dedup._postings(reps, counts, minhash_dedup.K - need + 1)
    x, y = post.alias("x"), post.alias("y")
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), minhash_dedup._agreeing("x.", "y.").alias("n")).distinct().collect()
    agree = {(r.a, r.b): int((full[r.a] == full[r.b]).sum()) for r in met}
    assert all(r.n >= agree[r.a, r.b] for r in met)
    assert 0 < sum(r.n >= need for r in met) < len(met)
    # No pair that agrees often enough is missed by the postings.
    pairs = {(a, b) for a, b in itertools.combinations(sorted(full), 2) if (full[a] == full[b]).sum() >= need}
    assert pairs <= {(r.a, r.b) for r in met if r.n >= need}


def test_long_texts_hash_alike():
    """Spans of a text that goes slice by slice hash as they do by themselves."""
    words = [f"word{i}".encode() for i in range(300_000)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    assert len(data) > 2 * wordhash.BLOCK_BYTES
    starts, ends, _ = wordhash.word_spans(data, np.array([0, len(data)]))
    got = wordhash.span_hashes(data, starts, ends)
    for i in (0, 1, 150_000, 299_999):
        own = np.frombuffer(words[i], np.uint8)
        assert got[i] == wordhash.span_hashes(own, np.array([0]), np.array([len(own)]))[0]
    assert len(np.unique(got)) == len(words) and len(wordhash._powers["up"]) <= 2 * wordhash.BLOCK_BYTES + 1


def test_components_that_do_not_rest_raise(spark, monkeypatch):
    monkeypatch.setattr(components, "ROUNDS", 1)
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(links, scratch.Scratch(spark, "test"), "c")


CLASHES = ("_kept_id", "_key", "_copies", "_copy", "_doc", "_print", "_name", "ws", "kept", "node", "key", "piece_ids", "lossless", "decoded", "n_words", "token", "label", "_order")


@pytest.fixture(scope="module")
def odd(spark):
    plain = "a plain text about gardens and rivers with more than twenty words so that no rule on few words can reject it at once today"
    texts = [(1, plain), (2, plain), (2, plain), (3, plain + " indeed"), (None, "words of their own " * 3 + plain[::-1]), (None, None), (4, None), (5, ""), (6, " \n\t"), (7, "x" * 5000), (8, "same same"), (8, "other other")]
    docs = spark.createDataFrame([(i, t, "en", ["s", None][k % 2], 1) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


@pytest.mark.parametrize("name", ["quality_rules", "quality_classifier", "near_dedup", "source_mix", "sentencepiece"])
def test_stage_on_odd_rows(spark, odd, name):
    stage = dict(stages())[name]
    out = stage(spark, odd, SF)
    rows = out.collect()
    assert stage(spark, odd.limit(0), SF).count() == 0
    if name == "sentencepiece":
        assert len(rows) == odd.count() and all(r.lossless for r in rows)
        assert all((r.n_pieces in (None, -1)) == (r.piece_ids is None) for r in rows)
        return
    assert out.columns == odd.columns and {r.label for r in rows} <= {"clash"}
    seen = collections.Counter((r.doc_id, r.text) for r in rows)
    if name == "quality_rules":
        assert seen == {(1, rows[0].text): 1, (2, rows[0].text): 2, (3, rows[0].text + " indeed"): 1, **{k: v for k, v in seen.items() if k[0] is None}}
    if name == "near_dedup":
        groups = brute_groups(odd)
        assert len(rows) == len(groups) and all(any(k in g for g in groups) for k in seen)
    if name == "source_mix":
        assert all(t and t.split() for _, t in seen) and max(seen.values()) <= 4


def brute_groups(df):
    """Groups of rows (doc_id, text) whose sets of five words are alike at 0.8; rows without words stay apart, but for repeated ones."""
    import re

    found: list = []
    for key in dict.fromkeys((r.doc_id, r.text) for r in df.collect()):
        w = re.findall(r"[^\x20\x09-\x0D]+", (key[1] or "").lower())
        s = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        near = [g for g in found if any(s and 100 * len(s & t) >= 80 * len(s | t) for _, t in g) or any(k == key for k, _ in g) or (not s and key[0] is None and any(k[0] is None and not t for k, t in g) and (key[1] or "") == (g[0][0][1] or ""))]
        merged = [(key, s)] + [x for g in near for x in g]
        found = [g for g in found if g not in near] + [merged]
    return [{k for k, _ in g} for g in found]


def test_nameless_rows_and_ties_in_token_files(spark):
    rows = [(None, "b"), (5, "y"), (5, "x"), (None, "a"), (5, "x"), (-3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"part": F.lit(1), "start": F.lit(2)})
    one, two = (bitpack.round_trip(d, tokenizer="byte_bpe_50k.json").orderBy("start").collect() for d in (df, df.repartition(5)))
    assert [tuple(r) for r in one] == [tuple(r) for r in two] and [r.doc_id for r in one] == [None, None, -3, 5, 5, 5]
    ends = np.cumsum([r.n_tokens for r in one])
    assert [r.start for r in one] == [0, *ends[:-1].tolist()]


def test_codec_in_one_worker(spark, odd):
    docs = odd.select("doc_id", "text")
    both = {(r.doc_id, r.text): (r.piece_ids, r.lossless) for r in lattice_codec.coded(docs).collect()}
    apart = {(r.doc_id, r.text): (r.piece_ids, r.decoded == r.text) for r in lattice_codec.decode(lattice_codec.encode(docs)).collect()}
    assert both == apart


def test_one_per_group_shuffles_no_text(spark, monkeypatch):
    """However many documents stay or go, and however many broadcasts that takes."""
    rows = [(i if i % 7 else None, " ".join(f"w{i % 30 if i % 3 else i}x{j}" for j in range(40)), i) for i in range(300)] + [(5, "another text of one name", 5), (5, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more long")
    want = sorted(map(str, minhash_dedup.one_per_group(docs).select("doc_id", "text").collect()))
    monkeypatch.setattr(minhash_dedup, "BROADCAST_ROWS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = minhash_dedup.one_per_group(docs)
        assert sorted(map(str, kept.select("doc_id", "text").collect())) == want and len(want) < 300
        assert "SortMergeJoin" not in kept.where("doc_id > 10")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
