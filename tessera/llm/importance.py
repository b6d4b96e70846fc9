"""Quality by importance resampling with hashed n-gram models.

Two bag-of-n-grams models are counted over hashed unigrams and bigrams of the
lower-cased tokens: one of the target (documents labelled good; a bounded sample
of labelled rows) and one of the raw text (all documents).  A document's log
importance weight is the mean over its n-grams of log p_target - log p_raw,
times ``WEIGHT`` n-grams, so that length does not decide.  Adding Gumbel noise
seeded by doc_id and taking the k largest keys samples k documents without
replacement in proportion to their weights.

k is the number of documents whose weight reaches the cut that all but
``LOSS`` of the good labelled documents reach; the k-th key is found by radix
histograms, never by a global sort.

Rows: null and empty texts have no n-grams and weight 0; rows that tie at the
k-th key are all kept; repeated rows have equal keys; without labels of both
kinds everything is kept.  Other columns are kept or ignored as the function
says.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, give_back, lean, small_batches
from .wordhash import LOWER, blocks, mix, span_hashes

BUCKET_BITS = 16
#: Most labelled rows that the target model and the cut are fitted on.
LABELLED = 20_000
#: Share of the good labelled rows that may fall under the cut.
LOSS = 0.002
#: A document's weight is that of so many mean n-grams.
WEIGHT = 256.0
SMOOTH = 1.0

_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1


def ngrams(texts: pa.Array):
    """For each run of texts: n-gram buckets and the index of each text's first (one more at the end)."""
    for _, _, data, offs in blocks(texts):
        data = LOWER[data]
        kind = _KIND[data]
        new = np.zeros(len(data) + 1, bool)
        new[offs] = True
        new = new[:-1]
        change = np.ones(len(data), bool)
        change[1:] = (kind[1:] != kind[:-1]) | new[1:]
        starts = np.flatnonzero(change)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        token = kind[starts] > 0
        starts, ends = starts[token], ends[token]
        firsts = np.searchsorted(starts, offs)
        h = span_hashes(data, starts, ends)
        pair = mix(h[:-1] * np.uint64(3) + h[1:], 1) if len(h) else h
        inner = np.ones(len(pair), bool)
        cut = firsts[1:-1] - 1
        inner[cut[(cut >= 0) & (cut < len(pair))]] = False
        place = np.concatenate((np.arange(len(h)), np.flatnonzero(inner)))
        order = np.argsort(place, kind="stable")
        bucket = (np.concatenate((h, pair[inner])) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)[order]
        yield bucket, np.searchsorted(place[order], firsts)


def counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches):
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for b in batches:
            for bucket, _ in ngrams(b.column(0)):
                total += np.bincount(bucket, minlength=1 << BUCKET_BITS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = docs.select("text").mapInArrow(lean(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << BUCKET_BITS)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total


def log_weight(ratios):
    """A column function: the log importance weight of each text."""

    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        out = []
        for bucket, firsts in ngrams(texts):
            sums = np.concatenate(([0.0], np.cumsum(ratios.value[bucket])))[firsts]
            n = np.diff(firsts)
            out.append(WEIGHT * np.diff(sums) / np.maximum(n, 1))
        give_back()
        return pa.array(np.round(np.concatenate(out), 9) if out else np.zeros(0), pa.float64())

    return weigh


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of a bounded sample of labelled rows, the same in every run."""
    some = labels.where("quality IS NOT NULL").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(LABELLED)
    some = some.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_good"))
    return docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(some), "_id")


def fit(docs: DataFrame, labels: DataFrame):
    """(broadcast log ratios, cut) or None without labels of both kinds."""
    marked = _labelled(docs, labels)
    target, raw = counts(marked.where("_good = 1")), counts(docs)
    if not target.any():
        return None
    p, q = ((c + SMOOTH) / (c.sum() + SMOOTH * len(c)) for c in (target, raw))
    ratios = docs.sparkSession.sparkContext.broadcast(np.log(p) - np.log(q))
    seen = marked.select("_good", log_weight(ratios)("text").alias("w")).groupBy("_good").agg(F.percentile_approx("w", F.lit(LOSS), F.lit(100_000)).alias("low")).collect()
    low = {r._good: r.low for r in seen}
    return (ratios, low[1]) if 0 in low else None


def gumbel(seed: int) -> F.Column:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 12) + 0.5) * F.lit(2.0**-52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of a long column ``key`` under 2**62 in size, by four rounds of 2**16 bins."""
    if k <= 0:
        return None
    high, shifted = 0, keys.select((F.col("key") + (1 << 62)).alias("key"))
    for shift in (48, 32, 16, 0):
        inside = shifted.where(F.shiftright("key", shift + 16) == high) if shift < 48 else shifted
        bins = inside.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.count("*").alias("n")).collect()
        for r in sorted(bins, key=lambda r: -r.bin):
            if k <= r.n:
                high = r.bin
                break
            k -= r.n
        else:
            return None
    return high - (1 << 62)


def scores(docs: DataFrame, labels: DataFrame, seed: int = 11) -> tuple[DataFrame, int | None, object]:
    """(doc_id, log_weight, key of every document, the k-th key, the fitted ratios)."""
    small_batches(docs.sparkSession)
    s = Scratch(docs.sparkSession, "importance")
    fitted = fit(docs, labels)
    ratios, cut = fitted or (docs.sparkSession.sparkContext.broadcast(np.zeros(1 << BUCKET_BITS)), float("-inf"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), log_weight(ratios)("text").alias("log_weight"))
    base = s.table(base.withColumn("key", _key(F.col("log_weight"), seed)), "scores")
    k = base.where(F.col("log_weight") >= cut).count()
    return base, kth_largest(base, k), ratios


def _key(weight: F.Column, seed: int) -> F.Column:
    return F.round((weight + gumbel(seed)) * (1 << 32)).cast("long")


def select(docs: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, log_weight, key, kept for every document."""
    base, last, _ = scores(docs, labels, seed)
    return base.withColumn("kept", F.col("key") >= last if last is not None else F.lit(False))


def keep_selected(docs: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """The sampled documents with their own columns; texts are weighed again instead of being shuffled."""
    _, last, ratios = scores(docs, labels, seed)
    if last is None:
        return docs.limit(0)
    own = fresh("_key", docs)
    return docs.withColumn(own, _key(log_weight(ratios)(F.col("text")), seed)).where(F.col(own) >= last).drop(own)
