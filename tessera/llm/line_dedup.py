"""Lines that many documents share, found through a sharded minimal perfect hash.

A line's key is the line without white space at its ends, A-Z in lower case.  A
key of at least ``min_chars`` code points held by at least ``min_docs`` documents
is frequent; its lines go, except in the largest doc_id that holds it.

1. Every document sends the 128-bit digest of each distinct key once; digests are
   counted over distinct documents, with a partial count before the shuffle, so
   a line that a third of all documents hold is no hot key.
2. Frequent digests are dealt into shards by their first bits (about
   ``SHARD_KEYS`` each).  A shard is one row: a minimal perfect hash (levels of
   bit arrays: keys alone in their bit are placed, the others go on to the next
   level; the rank of the bit is the key's slot) and, in slot order, arrays of
   64-bit fingerprints, document counts and largest doc_ids.
3. Documents probe the arrays.  Up to ``SENT_BYTES`` of arrays, measured on the
   written shards, are broadcast and every task answers its own documents.
   Larger indexes stay in their partitions and the probes (a digest and the
   document's key, no text) are dealt to the shards, each shard in ``COPIES``
   copies so that probes of a very frequent line are spread.

Unlike lines share a fingerprint with probability 2**-64 a probe.

Rows: a null or empty text is one empty line.  Rows of one doc_id are one
document for the count, and each of them keeps or loses lines by that doc_id.
A row without doc_id is a document of its own and smaller than every doc_id; a
line that only such rows hold stays everywhere.  Line ends other than ``\\n`` are
white space of the line.  An empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, lean, small_batches
from .wordhash import mix

WHITE = b" \t\n\v\f\r"
#: Keys of one shard, on average.
SHARD_KEYS = 1 << 15
#: Bytes of arrays that are broadcast at most.
SENT_BYTES = 64 << 20
#: Copies of each shard where probes are dealt out.
COPIES = 8
#: Bits of a level for each key that is still without a place.
ROOM = 2


# Keys ---------------------------------------------------------------------


def digests(lines: list[bytes], min_chars: int) -> dict[int, bytes]:
    """Digest of the key of each line whose key is long enough, by the line's place."""
    out = {}
    for i, line in enumerate(lines):
        key = line.strip(WHITE)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars):
            out[i] = blake2b(key.lower(), digest_size=16).digest()
    return out


def halves(found) -> np.ndarray:
    """Digests as rows of two signed 64-bit numbers."""
    return np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


# The minimal perfect hash -------------------------------------------------


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each key on a level; both halves of a key take part, so unlike keys part sooner or later."""
    a, b = keys[:, 0].view(np.uint64), keys[:, 1].view(np.uint64)
    return ((mix(a, 2 * level) + mix(b, 2 * level + 1)) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n-1 for n distinct keys; any other key gets some slot or none."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes))).tolist()
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = -(-ROOM * len(keys) // 64) * 64
            at = _bit(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.starts[level] + _bit(keys[left], level, size)
            word, bit = self.words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            rank = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            out[left[hit]] = rank
            left = left[~hit]
        return out


class Shard:
    """Fingerprints, document counts and largest doc_ids of some keys, addressed by their perfect hash."""

    COLUMNS = "sizes array<long>, words binary, prints binary, counts binary, largest binary"

    def __init__(self, sizes, words, prints, counts, largest):
        self.hash = PerfectHash(list(sizes), np.frombuffer(words, "<u8"))
        self.prints, self.counts, self.largest = (np.frombuffer(x, "<i8") for x in (prints, counts, largest))

    @staticmethod
    def row(keys: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> dict:
        hashed = PerfectHash.build(keys)
        order = np.argsort(hashed.slots(keys))
        arrays = {"prints": keys[order, 1], "counts": counts[order], "largest": largest[order]}
        return {"sizes": hashed.sizes, "words": hashed.words.astype("<u8").tobytes()} | {k: v.astype("<i8").tobytes() for k, v in arrays.items()}

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where it isn't held."""
        slots = self.hash.slots(keys)
        some = np.flatnonzero(slots >= 0)
        wrong = some[self.prints[slots[some]] != keys[some, 1]]
        slots[wrong] = -1
        return slots


def shard_of(high, bits: int):
    """Shard of digests by their first bits, the same for a column and for an array."""
    if isinstance(high, np.ndarray):
        return (high.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)
    return F.shiftrightunsigned(high, 64 - bits).cast("int") if bits else F.lit(0)


# Building -----------------------------------------------------------------


def frequent_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """high, low (the digest), docs, largest of every key that enough documents hold."""

    def run(batches):
        # A row without doc_id counts by a number of its own.
        nameless = TaskContext.get().partitionId() << 33
        for b in batches:
            ids, found, other = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = set(digests(_lines(text), min_chars).values())
                nameless += doc_id is None
                found += mine
                ids += [doc_id] * len(mine)
                other += [nameless if doc_id is None else -1] * len(mine)
            keys = halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(ids, pa.int64()), pa.array(other, pa.int64())], ["high", "low", "doc_id", "nameless"])

    small_batches(docs.sparkSession)
    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(run), "high long, low long, doc_id long, nameless long")
    counted = held.distinct().groupBy("high", "low").agg(F.count("*").alias("docs"), F.max("doc_id").alias("largest"))
    return counted.where((F.col("docs") >= min_docs) & F.col("largest").isNotNull())


def build_shards(frequent: DataFrame, bits: int) -> DataFrame:
    """One row a shard: shard and the columns of ``Shard``."""

    def build(table):
        keys = np.stack([table[c].to_numpy() for c in ("high", "low")], 1)
        row = Shard.row(keys, table["docs"].to_numpy(), table["largest"].to_numpy())
        schema = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("words", "prints", "counts", "largest"))])
        return pa.Table.from_pylist([{"shard": table["shard"][0].as_py()} | row], schema=schema)

    return frequent.withColumn("shard", shard_of(F.col("high"), bits)).groupBy("shard").applyInArrow(build, f"shard int, {Shard.COLUMNS}")


# Probing ------------------------------------------------------------------

_OUT = "doc_id long, n_lines long, n_dropped long, text string"


def _answer(docs_batch, gone_of, min_chars: int) -> pa.RecordBatch:
    """The documents of a batch without the lines that ``gone_of(keys, owners, doc_ids)`` names."""
    ids = docs_batch.column(0)
    texts = [_lines(t) for t in docs_batch.column(1).to_pylist()]
    found = [digests(lines, min_chars) for lines in texts]
    sizes = [len(x) for x in found]
    keys = halves(x for f in found for x in f.values())
    gone = gone_of(keys, np.repeat(np.arange(len(texts)), sizes), ids)
    ends, out, dropped = np.cumsum([0, *sizes]), [], []
    for lines, f, a, b in zip(texts, found, ends, ends[1:]):
        lost = {i for i, g in zip(f, gone[a:b].tolist()) if g}
        dropped.append(len(lost))
        out.append((b"\n".join(x for i, x in enumerate(lines) if i not in lost) if lost else b"\n".join(lines)).decode("utf-8", "replace"))
    return pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in texts], pa.int64()), pa.array(dropped, pa.int64()), pa.array(out, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])


def _doc_ids(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)


def _lost(shard: Shard, keys: np.ndarray, doc_ids: np.ndarray, nameless: np.ndarray) -> np.ndarray:
    slots = shard.find(keys)
    return (slots >= 0) & (nameless | (shard.largest[slots] != doc_ids))


@lru_cache(1)
def _shards(sent) -> dict[int, Shard]:
    return {k: Shard(*x) for k, x in sent.value.items()}


def _probe_here(docs: DataFrame, shards: DataFrame, bits: int, min_chars: int) -> DataFrame:
    """Every task probes all shards, which it got by broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast({r.shard: tuple(r)[1:] for r in shards.toLocalIterator()})

    def run(batches):
        index = _shards(sent)

        def gone_of(keys, owners, ids):
            doc_ids, nameless = (x[owners] for x in _doc_ids(ids))
            gone, of = np.zeros(len(keys), bool), shard_of(keys[:, 0], bits)
            for k in np.unique(of).tolist():
                if k in index:
                    at = np.flatnonzero(of == k)
                    gone[at] = _lost(index[k], keys[at], doc_ids[at], nameless[at])
            return gone

        for b in batches:
            yield _answer(b, gone_of, min_chars)

    return docs.mapInArrow(lean(run), _OUT)


def _probe_there(docs: DataFrame, shards: DataFrame, bits: int, min_chars: int, scratch: Scratch) -> DataFrame:
    """Probes go to the shards; what is lost comes back by document.

    A document is known by doc_id and a hash of its text: rows alike in both lose the same lines.
    """

    def ask(batches):
        for b in batches:
            found = [set(digests(_lines(t), min_chars).values()) for t in b.column(1).to_pylist()]
            keys = halves(x for f in found for x in f)
            owners = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            of = shard_of(keys[:, 0], bits)
            yield pa.RecordBatch.from_arrays([pa.array(of.astype(np.int32)), b.column(0).take(owners), b.column(2).take(owners), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["shard", "doc_id", "body", "high", "low"])

    def answer(batches):
        now, shard = None, None
        for b in batches:
            at, of, kinds = 0, b.column(0).to_numpy(), b.column(1).to_numpy()
            # A batch is cut where a shard's own row (kind 0) stands or another shard begins.
            cuts = np.flatnonzero((kinds == 0) | (np.append(-1, of[:-1]) != of)).tolist()
            for at, end in zip(cuts if cuts[:1] == [0] else [0, *cuts], [*(c for c in cuts if c), len(of)]):
                if kinds[at] == 0:
                    r = b.slice(at, 1).to_pylist()[0]
                    now, shard = of[at], Shard(*(r[c] for c in ("sizes", "words", "prints", "counts", "largest")))
                    at += 1
                if at < end and now == of[at]:
                    part = b.slice(at, end - at)
                    keys = np.stack([part.column(c).to_numpy() for c in ("high", "low")], 1)
                    yield part.select(["doc_id", "body", "high", "low"]).filter(pa.array(_lost(shard, keys, *_doc_ids(part.column("doc_id")))))

    def finish(batches):
        for b in batches:
            lists = b.column(2).to_pylist()
            sets = [set(map(tuple, ((x["high"], x["low"]) for x in g or ()))) for g in lists]
            yield _answer(b, lambda keys, owners, ids: np.array([tuple(k) in sets[o] for k, o in zip(keys.tolist(), owners.tolist())], bool), min_chars)

    docs = docs.withColumn("body", F.xxhash64("text"))
    probes = docs.mapInArrow(lean(ask), "shard int, doc_id long, body long, high long, low long").distinct()
    images = shards.select("*", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    both = images.withColumn("kind", F.lit(0)).unionByName(probes.withColumns({"kind": F.lit(1), "copy": F.pmod(F.xxhash64("doc_id", "body"), F.lit(COPIES)).cast("int")}), allowMissingColumns=True)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), COPIES << max(0, bits - 4))
    dealt = both.repartition(n, "shard", "copy").withColumn("of", F.col("shard") * COPIES + F.col("copy")).sortWithinPartitions("of", "kind")
    lost = dealt.select("of", "kind", "doc_id", "body", "high", "low", "sizes", "words", "prints", "counts", "largest").mapInArrow(lean(answer), "doc_id long, body long, high long, low long")
    lists = scratch.table(lost.groupBy("doc_id", "body").agg(F.collect_set(F.struct("high", "low")).alias("gone")), "lost")
    same = docs["doc_id"].eqNullSafe(lists["doc_id"]) & (docs["body"] == lists["body"])
    return docs.join(lists, same, "left").select(docs["doc_id"], docs["text"], lists["gone"]).mapInArrow(lean(finish), _OUT)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the text that is left, of every row."""
    scratch = Scratch(docs.sparkSession, "lines")
    frequent = scratch.table(frequent_lines(docs, min_chars, min_docs), "frequent")
    bits = max(0, (frequent.count() // SHARD_KEYS).bit_length())
    shards = scratch.table(build_shards(frequent, bits), "shards")
    size = shards.agg(F.sum(F.length("words") + F.length("prints") + F.length("counts") + F.length("largest"))).first()[0] or 0
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    if size <= sent_bytes:
        return _probe_here(plain, shards, bits, min_chars)
    return _probe_there(plain, shards, bits, min_chars, scratch)
