"""Divergence of the word use of sources, by a baseline-correction inverted index.

For each language the kept terms are those in at least ``min_docs`` of its
documents; every (lang, source) group gives each of them the smoothed share
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), and two shares differ by
f(p, q) = floor((p - q)**2 / (p + q)).

A pair of sources starts at V * f(p0, q0), as if neither held any term, where p0
and q0 are their shares of a zero count.  Then only what postings change is added:

* a term one of them holds: f(p, q0) - f(p0, q0).  That depends on the count
  alone, so a source's counts are first grouped into a histogram and each
  distinct count meets the language's other sources once;
* a term both hold, beyond those two: f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0),
  summed over the posting lists as arrays inside the tasks, of which each sends
  one row for a pair of sources.

So the work follows the postings, not terms times pairs; the pairs themselves are
rows of the result.  Terms over-used by a source are ranked by a window that
Spark cuts to the first ranks before it shuffles.

Occurrences are counted in the tasks over blocks of texts, so the shuffle carries
a term once for a source and block.  All numbers are integers; shares are
computed as decimals of 38 digits, so they stay exact for any count.

Rows: null text, lang and source are read as empty; a group without terms, or a
language of which no term is kept, has rows for its pairs all the same (value 0
where V = 0); each row is a document, repeated or not; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, lean, small_batches
from .wordhash import LOWER, blocks, span_hashes

SCALE = 1_000_000_000
#: Bytes of texts counted together.
COUNTED_BYTES = 16 << 20
#: Sources whose table is broadcast, at most; beyond, Spark joins as it finds fit.
SENT_SOURCES = 50_000

_TERM = np.ones(256, bool)
_TERM[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


# Counting -----------------------------------------------------------------


def _term_spans(data: np.ndarray, offs: np.ndarray):
    """Starts, ends and text of all terms: runs of ASCII letters and characters beyond ASCII."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def counts(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of every term of a group in these texts."""
    # Terms are known by their hash within one block of texts, and by themselves from there on.
    known: dict[int, int] = {}
    terms: list[bytes] = []
    docs, codes = [], []
    for i, _, data, offs in blocks(texts):
        starts, ends, owner = _term_spans(data, offs)
        small = LOWER[data]
        local, unique = pd.factorize(span_hashes(small, starts, ends))
        at = np.zeros(len(unique), np.int64)
        at[local[::-1]] = np.arange(len(local))[::-1]
        raw, code = small.tobytes(), np.zeros(len(unique), np.int64)
        for k, (h, a, b) in enumerate(zip(unique.tolist(), starts[at].tolist(), ends[at].tolist())):
            c = known.get(h)
            if c is None:
                c = known[h] = len(terms)
                terms.append(raw[a:b])
            code[k] = c
        docs.append(owner + i)
        codes.append(code[local])
    n = max(1, len(terms))
    held, times = np.unique(np.concatenate(docs) * n + np.concatenate(codes) if docs else np.zeros(0, np.int64), return_counts=True)
    key, of = np.unique(groups[held // n] * n + held % n, return_inverse=True)
    return key // n, [terms[c] for c in (key % n).tolist()], np.bincount(of, times, len(key)).astype(np.int64), np.bincount(of, minlength=len(key))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: partial counts, several rows for one term of a source."""

    def flush(held):
        batch = pa.Table.from_batches(held)
        key = pd.MultiIndex.from_arrays([batch.column(0).to_pandas(), batch.column(1).to_pandas()])
        groups, names = pd.factorize(key)
        text = pa.concat_arrays(batch.column(2).cast(pa.large_string()).chunks)
        group, terms, n, d = counts(text, groups)
        lang, source = (pa.array(names.get_level_values(k), pa.string()).take(pa.array(group)) for k in (0, 1))
        # Bounded batches, however many terms there are.
        every = pa.RecordBatch.from_arrays([lang, source, pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(d)], ["lang", "source", "term", "n", "docs"])
        for i in range(0, len(n), 100_000):
            yield every.slice(i, 100_000)

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size > COUNTED_BYTES:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), "lang string, source string, term string, n long, docs long")


# Shares -------------------------------------------------------------------


def _whole(column):
    return F.col(column).cast("decimal(20,0)")


def _share(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + 2) / (total + 2 terms)), exactly."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * (cast({count} as decimal(20,0)) + cast(2 as decimal(20,0)))) div (cast({total} as decimal(20,0)) + 2 * cast({terms} as decimal(20,0)))")


def difference(p, q):
    """floor((p - q)**2 / (p + q)); shares are at most SCALE + 1, so 64 bits hold the square."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _both(batches):
    """Corrections for terms that two sources hold: lang, a, b (a before b) and their sum, once a batch."""
    for batch in batches:
        lang = pd.factorize(batch.column(0).to_pandas())
        lists = batch.column(1)
        sizes = lists.value_lengths().to_numpy()
        of, p, p0 = (lists.flatten().field(k) for k in range(3))
        names = pd.factorize(of.to_pandas())
        of, p, p0 = names[0], p.to_numpy(), p0.to_numpy()
        row = np.repeat(lang[0], sizes)
        last = np.repeat(np.cumsum(sizes), sizes)
        n, sums = len(names[1]), {}
        # Step d: each posting meets the one d places further on in its list.
        for d in range(1, int(sizes.max(initial=0))):
            i = np.flatnonzero(np.arange(len(of)) + d < last)
            j = i + d
            value = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
            key, at = np.unique((row[i] * n + of[i]) * n + of[j], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, value)
            for k, v in zip(key.tolist(), total.tolist()):
                sums[k] = sums.get(k, 0) + v
        keys = np.array(list(sums), np.int64)
        a, b = pa.array(names[1], pa.string()), pa.array(lang[1], pa.string())
        yield pa.RecordBatch.from_arrays([b.take(pa.array(keys // n // n if n else keys)), a.take(pa.array(keys // max(n, 1) % max(n, 1))), a.take(pa.array(keys % max(n, 1))), pa.array(list(sums.values()), pa.int64())], ["lang", "a", "b", "value"])


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far a source's words are from each other source's, and its terms."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "audit")
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = term_counts(plain).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # One row a term: its posting list, as long as the language has sources.
    lists = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("posts")).where(F.col("docs") >= min_docs)
    lists = scratch.table(lists.select("lang", "term", "posts"), "lists")

    posts = lists.select("lang", "term", F.inline("posts"))
    size = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = lists.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = plain.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = scratch.table(groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms"))).withColumn("p0", F.when(F.col("terms") > 0, _share("0", "total", "terms"))), "groups")
    few = groups.count() <= SENT_SOURCES
    sent = F.broadcast if few else (lambda df: df)

    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"), F.first("terms").alias("terms"))
    usual = lists.select("lang", "term", F.expr("aggregate(posts, 0L, (s, x) -> s + x.n)").alias("n")).join(sent(whole), "lang").select("lang", "term", _share("n", "all", "terms").alias("q"))
    shared = posts.join(sent(groups), ["lang", "source"]).withColumn("p", _share("n", "total", "terms"))

    # Terms of a source above their share in the whole language.
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shared.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), difference("p", "q").alias("value"))
    top_terms = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # Pairs of sources: the start, then the corrections.
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    start = groups.join(sent(other), "lang").where("source <> item").select("lang", "source", "item", F.when(F.col("terms") > 0, F.col("terms") * difference("p0", "q0")).otherwise(F.lit(0)).alias("value"))
    histogram = shared.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    one = histogram.join(sent(other), "lang").where("source <> item").select("lang", "source", "item", (F.col("times") * (difference("p", "q0") - difference("p0", "q0"))).alias("value"))
    both = shared.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "p0"))).alias("posts")).select("lang", "posts").mapInArrow(lean(_both), "lang string, source string, item string, value long")
    one, both = (df.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for df in (one, both))
    turned = [df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value") for df in (one, both)]
    value = start.unionByName(one).unionByName(both)
    for df in turned:
        value = value.unionByName(df)
    pairs = value.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    order = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(order).unionByName(top_terms.select(order))
