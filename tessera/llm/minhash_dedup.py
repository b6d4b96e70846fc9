"""Near-duplicate detection by a signature-coordinate inverted join.

Every distinct word-run set gets a MinHash signature of ``K`` coordinates and is
posted under coordinate-value tokens.  Two sets that agree in at least ``T``
coordinates share a token among the first ``K - T + 1`` tokens of either, when
all sets order their tokens alike; here rare tokens come first, so passages that
many documents share stay out of the postings (prefix merging).  Pairs that
collide are counted on their packed signatures, those that agree in fewer than
``T`` coordinates there are skipped before anything is shuffled for them, and the
survivors are confirmed on the full sets of the whole texts.  Sets are compared
as 64-bit hashes of their word runs.  (Collisions among the first ``K - T + 1``
tokens alone could rule nothing out: one leaves ``T - 1`` tokens behind it.)

No posting list is expanded into all its pairs.  First each list's members meet
only the list's most central member, its hub.  What could still join two classes:

* Two sets that both met one hub.  If they share no deviation from it (no run
  that both lack, none that both add), their similarity is at most that of
  either with the hub, so they cannot link unless both link with it.  Otherwise
  the deviations they must share are so many, compared with those they have,
  that the first few of them in a common order collide; only such collisions
  are looked at, added runs (which are rare) before missing ones.
* Pairs of a list that met no common hub: members outside the list's largest
  class so far meet members of its other classes.

Both are confirmed on full sets; all steps together examine every pair whose
signatures match and that could join two classes.

Rows: null, empty or blank texts have an empty set and are linked with nothing.
Repeated rows of one doc_id and one word-run set count once.  Texts with equal
sets are one class from the start, however many they are.  A row without doc_id
takes part under a name made from its text; it takes the smallest doc_id of its
class, null where its class has none, and counts as kept only in
``one_per_group``, where a class without any doc_id keeps one of its rows.  Other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, fresh, lean, small_batches
from .wordhash import LOWER, blocks, mix, run_hashes, span_hashes, word_spans

K = 32
#: Chance that a pair exactly at the threshold is missed by its signature.
MISS = 1e-6
#: Buckets of the token counts that order the tokens; a fixed size, whatever the input.
COUNT_BITS = 16
#: Rows of ids, a few machine words each, that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Broadcasts of so many rows that one step makes at most, before texts are shuffled.
BROADCASTS = 8
#: Partners of one set that are compared with it in one task.
SPREAD = 4_000


@lru_cache
def match_threshold(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The largest T with P(fewer than T of k coordinates agree) <= miss at this similarity."""
    below = 0.0
    for t in range(k):
        below += comb(k, t) * similarity**t * (1 - similarity) ** (k - t)
        if below > miss:
            return max(1, t)
    return k


def text_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's set of word runs, as sorted 64-bit hashes."""
    for _, _, data, offs in blocks(texts):
        data = LOWER[data]
        starts, ends, firsts = word_spans(data, offs)
        runs, at = run_hashes(span_hashes(data, starts, ends), firsts, width)
        for i in range(len(offs) - 1):
            yield np.unique(runs[at[i] : at[i + 1]])


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, named, n_shingles, f1, f2 (the set's identity), sig (K unsigned 32-bit values; null for an empty set)."""

    def run(batches):
        for b in batches:
            ns, f1, f2, sigs = [], [], [], []
            sets, size = [], 0
            for one in [*text_sets(b.column(1), width), None]:
                if one is not None:
                    sets.append(one)
                    size += len(one)
                if sets and (one is None or size > 1 << 18):
                    n = np.array([len(s) for s in sets])
                    every, full = np.concatenate(sets), np.flatnonzero(n)
                    at = np.concatenate(([0], np.cumsum(n)))[:-1][full]
                    sig = np.zeros((len(sets), K), "<u4")
                    a, c = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                    if len(full):
                        for k in range(K):
                            sig[full, k] = np.minimum.reduceat(mix(every, 10 + k), at) >> np.uint64(32)
                        a[full] = np.add.reduceat(mix(every, 1), at)
                        c[full] = np.add.reduceat(mix(every, 2), at)
                    ns.append(n), f1.append(a.view(np.int64)), f2.append(c.view(np.int64))
                    sigs += [s.tobytes() if m else None for s, m in zip(sig, n)]
                    sets, size = [], 0
            if ns:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.concatenate(ns), pa.int64()), pa.array(np.concatenate(f1)), pa.array(np.concatenate(f2)), pa.array(sigs, pa.binary())], ["doc_id", "named", "n_shingles", "f1", "f2", "sig"])

    return docs.select("doc_id", "text", "named").mapInArrow(lean(run), "doc_id long, named boolean, n_shingles long, f1 long, f2 long, sig binary")


def _tokens(sigs: pa.Array) -> np.ndarray:
    sig = np.frombuffer(b"".join(sigs.to_pylist()), "<u4").reshape(-1, K).astype(np.uint64)
    return mix(sig | (np.arange(K, dtype=np.uint64) << np.uint64(32)), 3)


def _token_counts(reps: DataFrame) -> DataFrame:
    """How many signatures have a token in each of 2**COUNT_BITS buckets."""

    def run(batches):
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount((_tokens(b.column(0)) >> np.uint64(64 - COUNT_BITS)).ravel().astype(np.int64), minlength=1 << COUNT_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    return reps.select("sig").mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _postings(reps: DataFrame, counts, prefix: int) -> DataFrame:
    """token, apart, node, n, pos, s0..s3: each set under its first ``prefix`` tokens, with 8 bits of every coordinate.

    apart is low for sets whose tokens many sets have: the middle of a group of near copies.
    """

    def run(batches):
        freq = counts.value
        for b in batches:
            if not b.num_rows:
                continue
            t = _tokens(b.column(2))
            small = (t >> np.uint64(8)).astype(np.uint8)
            packed = np.ascontiguousarray(small).view("<i8")
            often = freq[(t >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]
            order = np.lexsort((t, often), axis=1)[:, :prefix]
            apart = -often.sum(1)
            rows = np.repeat(np.arange(len(t)), prefix)
            token = np.take_along_axis(t, order, 1).ravel().view(np.int64)
            node, n = (np.asarray(b.column(i))[rows] for i in (0, 1))
            apart = apart[rows]
            pos = np.tile(np.arange(prefix, dtype=np.int32), len(t))
            for i in range(0, len(token), 50_000):
                s = slice(i, i + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (token, apart, node, n, pos, *(packed[rows, j] for j in range(4)))], ["token", "apart", "node", "n", "pos", "s0", "s1", "s2", "s3"])

    return reps.select("node", "n", "sig").mapInArrow(lean(run), "token long, apart long, node long, n long, pos int, s0 long, s1 long, s2 long, s3 long")


def _agreeing(a: str, b: str) -> F.Column:
    """An upper bound on the coordinates in which two packed signatures agree."""
    differing = F.lit(0)
    for j in range(4):
        x = F.col(f"{a}s{j}").bitwiseXOR(F.col(f"{b}s{j}"))
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return F.lit(K) - differing


def _side_by_side(pairs: DataFrame, docs: DataFrame, s: Scratch) -> DataFrame:
    """For pairs (a, b): a, b, text, with the text of a first (b null), then those of its partners.

    A text of a is sent once for every ``SPREAD`` partners, and a partner's text
    once for each pair; partners of one a are dealt over as many tasks.
    """
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / SPREAD).cast("int").alias("parts"))
    ends = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("node"))
    firsts = spread.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("node"))
    ends = s.table(ends.unionByName(firsts), f"ends-{len(s.made)}")
    texts = docs.select(F.col("doc_id").alias("node"), "text")
    both = reduce(DataFrame.unionByName, (texts.join(few, "node") for few in _parts(ends, "node"))).select("a", "part", "b", "text", F.xxhash64("text").alias("h"))
    return both.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"), "h")


def _few(df: DataFrame) -> DataFrame:
    """A written table, broadcast if it has few rows; beyond that Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _parts(df: DataFrame, key: str) -> list[DataFrame]:
    """A written table cut by ``key`` into parts of few rows, to be broadcast one by one; beyond ``BROADCASTS`` of them whole."""
    n = max(1, ceil(df.count() / BROADCAST_ROWS))
    return [F.broadcast(df.where(F.pmod(F.xxhash64(F.lit(47), key), F.lit(n)) == i)) for i in range(n)] if n <= BROADCASTS else [df]


def _set_pairs(batches, width: int):
    """(a, b, set of a, set of b) of the rows of ``_side_by_side``; one set of an a is held at a time.

    Of several rows of one doc_id the first counts.
    """
    held, last = None, None
    for batch in batches:
        for a, part, b, one in zip(*(batch.column(c).to_pylist() for c in range(3)), text_sets(batch.column(3), width)):
            if (a, part, b) == last:
                continue
            last = a, part, b
            if b is None:
                held = one
            else:
                yield a, b, held, one


def confirmed(pairs: DataFrame, docs: DataFrame, s: Scratch, width: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have den * intersection >= num * union."""

    def run(batches):
        kept: list[tuple[int, int]] = []
        for a, b, x, y in _set_pairs(batches, width):
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both > 0 and den * both >= num * (len(x) + len(y) - both):
                kept.append((a, b))
            if len(kept) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], ["a", "b"])
                kept = []
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], ["a", "b"])

    return _side_by_side(pairs, docs, s).mapInArrow(lean(run), "a long, b long")


def compared(pairs: DataFrame, docs: DataFrame, s: Scratch, width: int, num: int, den: int) -> DataFrame:
    """For pairs (a: hub, b: node): whether they link, how many runs of the hub b lacks and how many it adds, and all these deviations.

    spare is num * (sizes) - (num + den) * intersection, over 0 where they do not
    link.  A partner with which b could join classes shares with it
    s >= (spare of the one that is not linked + w of the other) / (num + den)
    deviations, w being den * lacking + num * added; the first ``firsts`` of b's
    are so many that one of the shared is among them.  Added runs (even) come
    before lacking ones (odd).  m0..m3 mark each deviation in one of 256 bits,
    twice counts those that found their bit marked.
    """

    def run(batches):
        def out():
            names, linked, numbers, mark, runs = (list(c) for c in zip(*rows))
            at = np.concatenate(([0], np.cumsum([len(f) for f in runs])))
            columns = [*np.array(names, np.int64).T, np.array(linked), *np.array(numbers, np.int64).T, *np.array(mark, np.int64).T]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(runs)))], ["a", "b", "linked", "lack", "add", "spare", "firsts", "twice", "m0", "m1", "m2", "m3", "runs"])

        rows, size = [], 0
        for a, b, x, y in _set_pairs(batches, width):
            gone, new = np.setdiff1d(x, y, assume_unique=True), np.setdiff1d(y, x, assume_unique=True)
            over = num * (len(x) + len(y)) - (num + den) * (len(x) - len(gone))
            must = -(-over // (num + den)) if over > 0 else (den * len(gone) + num * len(new)) // (num + den) + 1
            every = np.concatenate((new & ~np.uint64(1), gone | np.uint64(1)))
            bits = np.zeros(256, bool)
            bits[(every >> np.uint64(56)).astype(np.int64)] = True
            numbers = len(gone), len(new), over, max(0, len(every) - must + 1), len(every) - int(bits.sum())
            rows.append(((a, b), over <= 0, numbers, np.packbits(bits).view("<i8"), every.view(np.int64)))
            size += len(every) + 20
            if size > 500_000:
                yield out()
                rows, size = [], 0
        if rows:
            yield out()

    return _side_by_side(pairs, docs, s).mapInArrow(lean(run), "a long, b long, linked boolean, lack long, add long, spare long, firsts long, twice long, m0 long, m1 long, m2 long, m3 long, runs array<long>")


def _around_hubs(met: DataFrame, comp: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets of different classes that met one hub.

    Pairs that collide in a first deviation are decided exactly: two sets have
    |hub| less what either lacks, plus their shared deviations, in common.
    """
    busy = met.groupBy("a").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("out")).where("n > 1 AND out > 0").select("a")
    own = met.join(busy, "a").join(comp.select(F.col("node").alias("b"), "comp"), "b", "left").withColumn("comp", F.coalesce("comp", "b"))
    own = own.select("a", F.col("b").alias("node"), "comp", "linked", "lack", "add", "spare", "twice", "m0", "m1", "m2", "m3", (F.col("lack") * den + F.col("add") * num).alias("w"), F.size("runs").alias("n"), F.posexplode(F.slice("runs", F.lit(1), F.col("firsts").cast("int"))).alias("pos", "run"))
    x, y = own.where("NOT linked").alias("x"), own.alias("y")
    share = F.col("x.spare") + F.col("y.w")
    few, more = F.least("x.lack", "y.lack"), F.least("x.add", "y.add")
    room = (few + more) * (num + den) >= share
    # A shared lacking run counts only where the shared ones may all be of that kind.
    kind = (F.col("x.run").bitwiseAND(F.lit(1)) == 0) | (few * (num + den) >= share)
    # The first shared one leaves room for the others behind it.
    kind = kind & (F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) * (num + den) >= share)
    # Shared ones have marks in common, but for those that found their bit marked.
    common = sum((F.bit_count(F.col(f"x.m{j}").bitwiseAND(F.col(f"y.m{j}"))) for j in range(4)), F.least("x.twice", "y.twice"))
    kind = kind & (common * (num + den) >= share)
    hits = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.run") == F.col("y.run")) & (F.col("x.comp") != F.col("y.comp")) & room & kind)
    hits = hits.select("x.a", F.col("x.node").alias("x"), F.col("y.node").alias("y"), share.alias("share")).distinct()
    hits = hits.join(met.select("a", F.col("b").alias("x"), F.col("runs").alias("xs")), ["a", "x"]).join(met.select("a", F.col("b").alias("y"), F.col("runs").alias("ys")), ["a", "y"])
    hits = hits.where(F.size(F.array_intersect("xs", "ys")) * (num + den) >= F.col("share"))
    return hits.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _name(docs: DataFrame) -> F.Column:
    """doc_id, or for a row without one a number over 2**62 made from its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.lit(41), F.coalesce("text", F.lit(""))), 3))


def _classed(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, Scratch]:
    """doc_id (see ``_name``), named, n_shingles, component_id of all documents."""
    spark = docs.sparkSession
    small_batches(spark)
    s = Scratch(spark, "minhash")
    docs = docs.select(_name(docs).alias("doc_id"), "text", F.col("doc_id").isNotNull().alias("named"))
    need = match_threshold(num / den)
    prefix = K - need + 1

    sig = s.table(signatures(docs, width), "sig")
    full = sig.where("n_shingles > 0")
    reps = s.table(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "reps")
    counts = np.zeros(1 << COUNT_BITS, np.int64)
    for r in _token_counts(reps).toLocalIterator():
        counts[r.bucket] = r.n
    # Most tokens are one set's alone; only the others' postings go on.
    post = _postings(reps, spark.sparkContext.broadcast(counts), prefix)
    shared = s.table(post.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token"), "shared")
    post = s.table(post.join(_few(shared), "token", "left_semi"), "postings")

    # Each list's members against its most central member.
    near = (F.col("n") * den >= F.col("l.n") * num) & (F.col("l.n") * den >= F.col("n") * num)
    lists = post.groupBy("token").agg(F.min(F.struct("apart", "node", "n", "pos", "s0", "s1", "s2", "s3")).alias("l"), F.count("*").alias("m"))
    met = post.join(lists, "token").where((F.col("node") != F.col("l.node")) & near & (_agreeing("", "l.") >= need))
    pairs = s.table(met.select(F.col("l.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    seen = s.table(compared(pairs, docs, s, width, num, den), "seen")
    links = seen.where("linked").select("a", "b")
    comp = components(links, s, "c0")

    # What is left in lists of several classes: pairs that met no common hub.
    at = post.join(lists.where("m > 2").select("token", F.col("l.node").alias("hub")), "token").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    at = at.join(seen.select(F.col("a").alias("hub"), F.col("b").alias("node"), F.lit(True).alias("met")), ["hub", "node"], "left")
    at = s.table(at.withColumn("met", F.coalesce("met", F.col("hub") == F.col("node"))), "classed")
    sizes = at.groupBy("token", "comp").agg(F.count("*").alias("n"), F.count_if(~F.col("met")).alias("out")).groupBy("token").agg(F.max_by("comp", "n").alias("main"), F.count("*").alias("classes"), F.sum("out").alias("out"))
    met_hubs = seen.select(F.col("b").alias("node"), "a").union(seen.select("a", "a")).groupBy("node").agg(F.collect_set("a").alias("hubs"))
    open_lists = at.join(sizes.where("classes > 1 AND out > 0").select("token", "main"), "token").join(met_hubs, "node", "left")
    open_lists = s.table(open_lists.withColumn("hubs", F.coalesce("hubs", F.array().cast("array<long>"))), "open")
    x, y = open_lists.where("comp != main").alias("x"), open_lists.alias("y")
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.comp") != F.col("y.comp")) & ~F.arrays_overlap("x.hubs", "y.hubs") & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))) & (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num) & (_agreeing("x.", "y.") >= need))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    rest = s.table(rest.join(seen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "rest")
    more = s.table(confirmed(rest, docs, s, width, num, den).unionByName(_around_hubs(seen, comp, num, den)), "links1")
    if not more.isEmpty():
        comp = components(links.unionByName(more), s, "c1")

    classes = reps.select("f1", "f2", "node").join(comp, "node", "left").select("f1", "f2", F.coalesce("comp", "node").alias("component_id"))
    out = sig.select("doc_id", "named", "n_shingles", "f1", "f2").dropDuplicates(["doc_id", "f1", "f2"]).join(classes, ["f1", "f2"], "left")
    out = s.table(out.select("doc_id", "named", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")), "result")
    s.drop(keep=("result",))
    return out, s


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Documents are linked when den * |intersection| >= num * |union| of their sets
    of ``width`` consecutive lower-cased words.  component_id is the smallest
    doc_id reachable over links; kept marks that document itself.
    """
    out, _ = _classed(docs, width, num, den)
    named = F.col("named") | (F.col("component_id") < (1 << 62))
    return out.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "n_shingles", F.when(named, F.col("component_id")).alias("component_id"), (F.col("named") & (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def one_per_group(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents themselves, one of each group, all their columns kept.

    Of rows of one doc_id and one text one stays.  A document without words is a
    group of its own.
    """
    out, s = _classed(docs, width, num, den)
    name, print_ = fresh("_name", docs), fresh("_print", docs)
    keyed = docs.withColumns({name: _name(docs), print_: F.xxhash64(F.lit(43), F.coalesce("text", F.lit("")))})
    # Those that go are named, as they are fewer: no text is shuffled for that.
    gone = s.table(out.groupBy(F.col("doc_id").alias(name)).agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays").select(name), "gone")
    for few in _parts(gone, name):
        keyed = keyed.join(few, name, "left_anti")
    again = s.table(keyed.groupBy(name, print_).agg(F.count("*").alias("n")).where("n > 1").select(name, print_), "again")
    if again.isEmpty():
        return keyed.drop(name, print_)
    once = keyed.join(again, [name, print_], "left_anti").unionByName(keyed.join(again, [name, print_], "left_semi").dropDuplicates([name, print_]))
    return once.drop(name, print_)
