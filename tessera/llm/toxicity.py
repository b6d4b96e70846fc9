"""Toxicity by a string-subsequence-kernel SVM with Nystrom landmarks.

Texts are read as words of letters and digits; other characters inside a word
are dropped and words of one letter in a row are joined, so ``i.d.i.o.t`` and
``i d i o t`` are one word.  The kernel of two words counts common subsequences
of three characters with gaps, each occurrence weighing DECAY to the power of
the length it spans; so inserted characters cost little.  Spans are bounded,
which makes the kernel a sum over an explicit table of character triples.

An SVM over Nystrom features of landmark words is trained on labelled texts, as
multi-instance learning: the labels are of whole texts (sentences or documents),
the kernel is of words, and which words make a text toxic is unknown.  So a text
is the set of its words, each toxic text is represented by its most suspicious
word so far, clean documents by frequent and by hard words,
and the SVM is refitted a few times.  The decision function folds into one
weight per triple, so scoring a text is a few table look-ups per character.  A
document's score is a logistic function of its worst word.

Rows: null and empty texts, and texts without letters or digits, score as texts
without any suspicious word; repeated rows score alike; a text of any length is
scored whole (training reads the first 39 characters of a word).  Of several
texts under one doc_id training reads the first in order.  Without labels of both
kinds every score is the share of toxic labels, or 0.  Labels of held-out rows are never read; labels, lang, source and
doc_id are no inputs of a score.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

DECAY = 0.6
#: Offsets of the second and third character.
GAPS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: Bounds of the training sample: rows of each label, and bytes of a text.
TOXIC_ROWS, CLEAN_ROWS, TEXT_BYTES = 2_500, 4_000, 16_384
LANDMARKS, ROUNDS = 192, 5
CLASSES = 64
BLOCK_CHARS = 400_000

_CLASS = np.full(0x3000, -1, np.int16)
for _c in range(0x3000):
    if chr(_c).isspace():
        _CLASS[_c] = 0
    elif "a" <= chr(_c) <= "z":
        _CLASS[_c] = 2 + _c - 97
    elif "0" <= chr(_c) <= "9":
        _CLASS[_c] = 28 + _c - 48
    elif chr(_c).isalnum():
        _CLASS[_c] = 38 + (_c * 40503 >> 4) % 26


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Character classes of all words, each with a mark of class 1 in front and behind; starts (at the mark), ends (at the mark behind), first word of each text."""
    texts = [t.lower() for t in texts]
    code = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    cls = np.where(code < 0x3000, _CLASS[np.minimum(code, 0x2FFF)], (38 + code % 26).astype(np.int16))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])  # the space before each text

    def spans(cls):
        inside = np.concatenate(([False], cls > 0, [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        return edge[::2], edge[1::2]

    keep = cls >= 0
    bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
    cls = cls[keep]
    starts, ends = spans(cls)
    text_of = np.searchsorted(bounds, starts, "right")
    one = ends - starts == 1
    join = np.flatnonzero(one[:-1] & one[1:] & (text_of[:-1] == text_of[1:])) if len(starts) > 1 else np.zeros(0, int)
    if len(join):
        drop = np.zeros(len(cls) + 1, np.int32)
        np.add.at(drop, ends[join], 1)
        np.add.at(drop, starts[join + 1], -1)
        keep = np.cumsum(drop[:-1]) == 0
        bounds = np.concatenate(([0], np.cumsum(keep)))[bounds]
        cls = cls[keep]
        starts, ends = spans(cls)
    cls = cls.copy()
    cls[starts - 1] = 1
    cls[ends] = 1
    return cls, starts - 1, ends, np.searchsorted(starts, bounds)


def self_kernel(length: np.ndarray) -> np.ndarray:
    """Square root of the kernel of a word of so many characters (front mark included) with itself, its triples being distinct."""
    length = length + 1
    total = np.zeros(len(length))
    for _, k in GAPS:
        total += np.maximum(length - k, 0) * DECAY ** (2 * (k + 1))
    return np.sqrt(np.maximum(total, DECAY**6))


def triples(cls: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """For each gap pattern: positions of the first character, the triple, its weight."""
    last = np.zeros(len(cls), np.int64)
    last[starts] = ends + 1
    last = np.maximum.accumulate(last)
    c = cls.astype(np.int64)
    for j, k in GAPS:
        at = np.flatnonzero(np.arange(len(c)) + k < last)
        yield at, (c[at] * CLASSES + c[at + j]) * CLASSES + c[at + k], DECAY ** (k + 1)


def worst(texts: list[str], table: np.ndarray, bias: float) -> np.ndarray:
    """The largest decision value of a word of each text; of a text without words, that of a word without triples."""
    cls, starts, ends, firsts = words(texts)
    out = np.full(len(texts), min(bias, -1.0))
    if not len(starts):
        return out
    value = np.zeros(len(cls))
    for at, triple, weight in triples(cls, starts, ends):
        value[at] += weight * table[triple]
    f = np.add.reduceat(value, starts) / self_kernel(ends - starts) + bias
    full = np.flatnonzero(np.diff(firsts))
    if len(full):
        out[full] = np.maximum.reduceat(f, firsts[full])
    return out


# Training, on the driver, on a sample of bounded size --------------------------


def _features(units: list[bytes]) -> list[dict[int, float]]:
    """Kernel features of words given as bytes of classes, scaled to a self-kernel of 1."""
    out = []
    for u in units:
        n, d = len(u), {}
        u += b"\x01"
        for j, k in GAPS:
            w = DECAY ** (k + 1)
            for p in range(n + 1 - k):
                t = (u[p] * CLASSES + u[p + j]) * CLASSES + u[p + k]
                d[t] = d.get(t, 0.0) + w
        s = float(self_kernel(np.array([n]))[0])
        out.append({t: w / s for t, w in d.items()})
    return out


def _kernel(units: list[bytes], landmarks: list[dict[int, float]]) -> np.ndarray:
    at = {t: i for i, t in enumerate(sorted({t for d in landmarks for t in d}))}
    right = np.zeros((len(at), len(landmarks)), np.float32)
    for j, d in enumerate(landmarks):
        for t, w in d.items():
            right[at[t], j] = w
    out = []
    for i in range(0, len(units), 500):
        left = np.zeros((len(units[i : i + 500]), len(at)), np.float32)
        for r, d in enumerate(_features(units[i : i + 500])):
            for t, w in d.items():
                if t in at:
                    left[r, at[t]] = w
        out.append(left @ right)
    return np.concatenate(out).astype(float) if out else np.zeros((0, len(landmarks)))


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge SVM with an intercept as the last weight, by Newton steps over the active rows."""
    z = np.hstack((z, np.ones((len(z), 1))))
    w = np.zeros(z.shape[1])
    for _ in range(30):
        active = y * (z @ w) < 1
        za, ca = z[active], weight[active]
        new = np.linalg.solve(ridge * np.eye(len(w)) + za.T @ (za * ca[:, None]), za.T @ (ca * y[active]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def _unit_sets(texts: list[str]) -> list[set[bytes]]:
    out = []
    for i in range(0, len(texts), 200):
        cls, starts, ends, firsts = words(texts[i : i + 200])
        raw = cls.astype(np.uint8).tobytes()
        spans = list(zip(starts.tolist(), ends.tolist()))
        out += [{raw[a:b][:40] for a, b in spans[m:n]} for m, n in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
    return out


def train(texts: list[str], toxic: list[int], share: float) -> dict:
    """table, bias, slope, offset from labelled texts; share: of toxic rows among all labelled ones."""
    y = np.array(toxic, bool)
    if y.all() or not y.any():
        p = min(1 - 1e-6, max(1e-6, share if len(y) else 0.0))
        return {"table": np.zeros(CLASSES**3), "bias": -1.0, "slope": 0.0, "offset": float(np.log(p / (1 - p)))}
    sets = _unit_sets(texts)
    fold = np.arange(len(y)) % 4 == 3  # kept for the logistic function
    # A copied text counts once.
    pos = [set(s) for s in dict.fromkeys(frozenset(s) for s, t, k in zip(sets, y, fold) if t and not k)]
    neg = [set(s) for s in dict.fromkeys(frozenset(s) for s, t, k in zip(sets, y, fold) if not t and not k)]
    if not pos or not neg:
        pos, neg = [s for s, t in zip(sets, y) if t], [s for s, t in zip(sets, y) if not t]
    in_pos, in_neg = Counter(u for s in pos for u in s), Counter(u for s in neg for u in s)
    odds = {u: np.log((n + 0.05) / len(pos)) - np.log((in_neg[u] + 0.5) / max(1, len(neg))) for u, n in in_pos.items() if n >= 3}
    value = dict(odds)
    common = [u for u, _ in sorted(in_neg.items(), key=lambda x: (-x[1], x[0]))[:2500]]
    rest = sorted(in_neg, key=lambda u: hash_order(u))[:2500]
    hard: list[bytes] = []
    table, bias = np.zeros(CLASSES**3), 0.0
    for turn in range(ROUNDS):
        witness = Counter()
        for s in pos:
            best = max(((value.get(u, -9.0), u) for u in s), default=(-9.0, b""))
            if best[0] > (1.0 if turn == 0 else -0.5):
                witness[best[1]] += 1
        for u, o in odds.items():  # words that toxic documents clearly prefer stay, whatever else those documents hold
            if o > 2.5 and in_pos[u] >= 5:
                witness[u] = max(witness[u], in_pos[u])
        good = [u for u, _ in sorted(witness.items(), key=lambda x: (-x[1], x[0]))[:3000]]
        bad = list(dict.fromkeys(u for u in [*hard, *common, *rest] if u not in witness or in_neg[u] * len(pos) > in_pos[u] * len(neg)))
        if not good or not bad:
            break
        every = good + bad
        marks = (good[: LANDMARKS * 2 // 3] + bad[: LANDMARKS - min(len(good), LANDMARKS * 2 // 3)])[:LANDMARKS]
        features = _features(marks)
        between = _kernel(marks, features)
        root, vectors = np.linalg.eigh(between)
        half = vectors @ np.diag(1 / np.sqrt(np.maximum(root, 1e-3))) @ vectors.T
        z = _kernel(every, features) @ half
        weight = np.array([min(20.0, 1.0 + witness[u]) for u in good] + [min(20.0, 1.0 + in_neg[u]) for u in bad])
        target = np.array([1.0] * len(good) + [-1.0] * len(bad))
        w = _svm(z, target, weight)
        beta, bias = half @ w[:-1], float(w[-1])
        table = np.zeros(CLASSES**3)
        for b, d in zip(beta, features):
            for t, x in d.items():
                table[t] += b * x
        pool = [*{u for s in pos for u in s}, *in_neg]
        f = _decide(pool, table, bias)
        value = dict(zip(pool, f))
        hard = sorted(in_neg, key=lambda u: (-value[u], u))[:1500]
    top = np.array([worst([t], table, bias)[0] for t, k in zip(texts, fold) if k])
    yk = y[fold].astype(float)
    prior = np.where(yk == 1, share / max(yk.mean(), 1e-9), (1 - share) / max(1 - yk.mean(), 1e-9))
    a = np.zeros(2)
    x = np.stack((top, np.ones(len(top))), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = x.T @ (x * (prior * p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
        a = a - np.linalg.solve(h, x.T @ (prior * (p - yk)) + 1e-2 * a)
    return {"table": table, "bias": bias, "slope": float(a[0]), "offset": float(a[1])}


def hash_order(u: bytes) -> int:
    import zlib

    return zlib.crc32(u)


def _decide(units: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """Decision values of words given as bytes of classes."""
    out = []
    for i in range(0, len(units), 20_000):
        part = units[i : i + 20_000]
        cls = np.frombuffer(b"".join([*part, b"\x01"]), np.uint8)
        ends = np.cumsum([len(u) for u in part])
        starts = ends - [len(u) for u in part]
        value = np.zeros(len(cls))
        for at, triple, weight in triples(cls, starts, ends):
            value[at] += weight * table[triple]
        out.append(np.add.reduceat(value, starts) / self_kernel(ends - starts) + bias)
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from labelled rows that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    marks = labels.where(~held_out & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64(F.lit(3), "_id"), F.col("_id")]
    some = marks.where("toxic = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(marks.where("toxic = 0").orderBy(*order).limit(CLEAN_ROWS))
    texts = docs.where(F.octet_length("text") <= TEXT_BYTES).select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(some), "_id")
    # Rows of one doc_id give one text, so that what is collected is bounded in rows, too.
    texts = texts.groupBy("_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(((r._id, r.text, r.toxic) for r in texts.collect()), key=lambda r: (hash_order(str(r[0]).encode()), r[0], r[1]))
    return train([r[1] for r in rows], [r[2] for r in rows], counts.get(1, 0) / max(1, sum(counts.values())))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels))

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        m, out, some, size = model.value, [], [], 0
        for i in range(0, len(texts), 64):
            for t in [x or "" for x in texts.slice(i, 64).to_pylist()]:
                some.append(t)
                size += len(t)
                if size > BLOCK_CHARS:
                    out.append(worst(some, m["table"], m["bias"]))
                    some, size = [], 0
        if some:
            out.append(worst(some, m["table"], m["bias"]))
        top = np.concatenate(out) if out else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(m["slope"] * top + m["offset"], -30, 30))), pa.float64())

    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), toxicity("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
