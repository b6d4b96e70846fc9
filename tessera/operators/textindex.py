"""Full-text search by a stored inverted index.

``fulltext_topk`` reads every text for every question.  The index keeps, for each
term, its postings; a question reads only the buckets of its terms.

* Chunks are dealt into segments of one category (about ``SEGMENT`` chunks or
  ``SEGMENT_BYTES`` of text each) and numbered within them in key order.
* A posting block is a row: term, segment, and for up to 2**``BLOCK_BITS``
  consecutive numbers the chunks that hold the term, how often, their lengths in
  tokens (packed arrays), and the block's best contribution to a score.  A
  segment's blocks are made in one pass over its chunks, as arrays.
* Rows lie in a folder for each bucket of terms, sorted by term, so a question's
  terms prune folders and row groups.
* A batch of chunks is appended as segments of its own.  Chunks that came again
  are noted as stale in the older batches; a batch counts once its manifest row
  is written, so an append that was broken off changes nothing and can be run
  again.

A question is answered segment by segment: blocks that cannot reach the k-th best
score found so far are left out, which the terms' block maxima tell without
reading further; only each segment's best chunks are ranked together.  Scores and
ties are those of ``fulltext_topk``.  Any number of questions share one scan; they
are grouped by ``QUESTIONS`` so that no task holds more than that.  What is asked
and which chunks are stale go to each segment once, beside the blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text as tx
from tessera.sources import workspace

from .search import KEY

BUCKETS = 32
SEGMENT = 1 << 14
SEGMENT_BYTES = 16 << 20
BLOCK_BITS = 10
QUESTIONS = 500
#: Terms of all questions that are broadcast, at most.
SENT_TERMS = 200_000
#: Scores closer than this may be equal once they are rounded.
CLOSE = 1e-6

#: A posting block; posts: a byte w (2, or 4 where that does not hold the numbers), then the chunks' places in the block, how
#: often, and sizes, as little-endian numbers of 2, w and w bytes; best is rounded up.
_ROW = "category string, segment long, term string, block int, posts binary, best float"


class TextIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, segment: int = SEGMENT):
        self.spark, self.path, self.buckets, self.segment = spark, path.rstrip("/"), buckets, segment

    # Storing ----------------------------------------------------------------

    def batches(self) -> list[int]:
        """Numbers of the batches that are complete."""
        if not workspace.exists(self.spark, f"{self.path}/manifest"):
            return []
        return sorted(r.batch for r in self.spark.read.schema("chunks long, batch int").parquet(f"{self.path}/manifest").select("batch").collect())

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("batch").isin(self.batches()))

    def append(self, corpus: DataFrame) -> int:
        """Index a batch of chunks (document_id, chunk_index, content, category); gives its number.

        Of chunks with one key in a batch the one with the largest text counts.
        """
        known = self.batches()
        n = known[-1] + 1 if known else 0
        category = F.col("category").cast("string") if "category" in corpus.columns else F.lit(None).cast("string")
        rows = corpus.select(*KEY, category.alias("category"), "content")
        parts = F.greatest(F.ceil(F.count("*") / self.segment), F.ceil(F.coalesce(F.sum(F.octet_length("content").cast("long")), F.lit(0)) / SEGMENT_BYTES))
        with workspace.tidied(self.spark):
            rows.groupBy(F.col("category").alias("_category")).agg(parts.alias("_parts")).write.mode("overwrite").parquet(f"{self.path}/parts/batch={n}")
        counted = self.spark.read.schema("_category string, _parts long").parquet(f"{self.path}/parts/batch={n}")
        # A join by category would send a category's texts to one task.
        counted = F.broadcast(counted) if counted.count() <= SENT_TERMS else counted
        dealt = rows.join(counted, F.col("category").eqNullSafe(F.col("_category")))
        dealt = dealt.withColumn("segment", F.xxhash64("category", F.pmod(F.xxhash64(*KEY), F.col("_parts")))).drop("_category", "_parts")
        # One shuffle of the texts; a segment's chunks then stand together in key order, equal keys side by side.
        ordered = dealt.repartition("segment").sortWithinPartitions("segment", *KEY, F.desc_nulls_last("content"))
        counted = ordered.select("segment", "category", *KEY, tx.tokens(F.col("content")).alias("tokens"))
        types = dict(rows.dtypes)
        built = counted.mapInArrow(_blocks_of_segments, f"{_ROW}, document_id {types['document_id']}, chunk_index {types['chunk_index']}, number int, size int")
        # Chunks go to a folder beside those of the buckets.
        placed = built.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(self._bucket()))
        with workspace.batches(self.spark, 500), workspace.tidied(self.spark):
            placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "segment", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={n}")

        chunks = self._chunks([n])
        if known:
            older = self._chunks(known).select(*KEY, "segment", "number", F.col("batch").alias("of"))
            stale = older.join(chunks.select(*KEY), [older[c].eqNullSafe(chunks[c]) for c in KEY], "left_semi").select("of", "segment", "number")
        else:
            stale = self.spark.createDataFrame([], "of int, segment long, number int")
        with workspace.tidied(self.spark):
            stale.write.mode("overwrite").parquet(f"{self.path}/stale/batch={n}")
        self.spark.range(1).select(F.lit(chunks.count()).cast("long").alias("chunks")).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={n}")
        return n

    def _bucket(self):
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    def _chunks(self, batches: list[int] | None = None) -> DataFrame:
        """All chunks of complete batches (or of these), stale ones among them."""
        batches = self.batches() if batches is None else batches
        rows = self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/batch={n}/bucket=-1" for n in batches])
        return rows.select(*KEY, "category", "segment", "number", "size", "batch")

    def chunks(self) -> DataFrame:
        """The chunks that are searched: keys, category and size in tokens."""
        gone = self._table("stale", "of int, segment long, number int, batch int").select(F.col("of").alias("batch"), "segment", "number")
        return self._chunks().join(gone, ["batch", "segment", "number"], "left_anti").select(*KEY, "category", "size")

    # Searching --------------------------------------------------------------

    def postings(self, terms: DataFrame | list[str], category: str | None = None) -> DataFrame:
        """Blocks of the terms: of a list by pruned folders and pushed filters, of a table by a join."""
        blocks = self._table("rows", f"{_ROW}, batch int, bucket int").where(F.col("bucket") >= 0)
        if category is not None:
            blocks = blocks.where(F.col("category") == category)
        if isinstance(terms, list):
            buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string").select(self._bucket()).distinct().collect()] if terms else []
            return blocks.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return blocks.join(terms.withColumn("bucket", self._bucket()), ["bucket", "term"])

    def search(self, questions: DataFrame, k: int, every: bool = True, category: str | None = None) -> DataFrame:
        """question_id, document_id, chunk_index, score of each question's best k chunks.

        questions: question_id long and terms array<string>.  ``every``: all terms
        must occur (a question without terms finds nothing); else one must.
        """
        if not self.batches():
            return self.spark.createDataFrame([], "question_id long, document_id string, chunk_index int, score double")
        asked = questions.select(F.col("question_id").cast("long").alias("question_id"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
        of = asked.select("question_id", F.size("terms").alias("length"), F.size(F.array_distinct("terms")).alias("distinct"), F.explode("terms").alias("term"))
        of = of.groupBy("question_id", "term").agg(F.count("*").cast("int").alias("weight"), F.first("length").alias("length"), F.first("distinct").alias("distinct"))
        group = F.pmod(F.xxhash64("question_id"), F.lit(max(1, math.ceil(asked.count() / QUESTIONS)))).cast("int")
        wanted = of.groupBy("term", group.alias("questions")).agg(F.collect_list(F.struct("question_id", "weight", "length", "distinct")).alias("asks"))
        few = wanted.count() <= SENT_TERMS
        names = wanted.select("term", "questions")
        blocks = self.postings(F.broadcast(names) if few else names, category).select("questions", "batch", "segment", "term", "block", "posts", "best")
        segments = self._chunks().select("batch", "segment", "category").distinct()
        segments = (segments if category is None else segments.where(F.col("category") == category)).drop("category")
        gone = self._table("stale", "of int, segment long, number int, batch int").groupBy(F.col("of").alias("batch"), "segment").agg(F.collect_set("number").alias("gone"))
        # A segment's blocks, and beside them, once, what is asked and which of its chunks are stale.
        rows = blocks.unionByName(F.broadcast(segments).crossJoin(wanted), allowMissingColumns=True)
        rows = rows.unionByName(gone.crossJoin(F.broadcast(wanted.select("questions").distinct())), allowMissingColumns=True)
        found = rows.groupBy("questions", "batch", "segment").applyInArrow(_segment_search(k, every), "question_id long, batch int, segment long, number int, score double")
        keyed = found.join(self._chunks().select("batch", "segment", "number", *KEY), ["batch", "segment", "number"]).withColumn("score", F.round("score", 6))
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *KEY))
        return keyed.withColumn("_n", place).where(F.col("_n") <= k).select("question_id", *KEY, "score")

    def topk(self, terms: list[str], k: int, category: str | None = None) -> DataFrame:
        """As ``fulltext_topk``, for one question; its buckets are pruned when the plan is made."""
        one = self.spark.createDataFrame([(0, terms)], "question_id long, terms array<string>")
        return self.search(one, k, category=category).drop("question_id")


# Building a segment ---------------------------------------------------------------


def _packed(places: np.ndarray, times: np.ndarray, sizes: np.ndarray, ends: np.ndarray, width: int) -> pa.Array:
    """The posts of blocks that end at ``ends``, as binary values."""
    counts = np.diff(np.append(0, ends))
    lengths = 1 + counts * (2 + 2 * width)
    offsets = np.append(0, np.cumsum(lengths))
    out = np.zeros(offsets[-1], np.uint8)
    out[offsets[:-1]] = width
    rank = np.arange(len(places)) - np.repeat(ends - counts, counts)
    start, n = np.repeat(offsets[:-1] + 1, counts), np.repeat(counts, counts)
    for values, size, before in ((places, 2, 0), (times, width, 2), (sizes, width, 2 + width)):
        at = start + n * before + rank * size
        out[at[:, None] + np.arange(size)] = np.ascontiguousarray(values.astype(f"<u{size}")).view(np.uint8).reshape(-1, size)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def _unpacked(posts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, times and sizes of a block."""
    width = posts[0]
    n = (len(posts) - 1) // (2 + 2 * width)
    return np.frombuffer(posts, "<u2", n, 1), np.frombuffer(posts, f"<u{width}", n, 1 + 2 * n), np.frombuffer(posts, f"<u{width}", n, 1 + (2 + width) * n)


def _blocks_of_segments(batches):
    """Chunk rows, and the posting blocks of each segment, of rows (segment, category, document_id, chunk_index, tokens) in order."""
    now = None
    for batch in batches:
        segments = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(segments[1:] != segments[:-1]) + 1).tolist(), len(segments)] if len(segments) else []
        for a, b in zip(cuts, cuts[1:]):
            if now is None or now.segment != int(segments[a]):
                if now is not None:
                    yield from now.blocks()
                now = _Segment(int(segments[a]), batch.column(1)[a].as_py())
            yield from now.add(batch.slice(a, b - a))
    if now is not None:
        yield from now.blocks()
    workspace.give_back()


class _Segment:
    """Postings of one segment, gathered batch by batch; tokens are let go as soon as they are counted."""

    def __init__(self, segment: int, category: str | None):
        self.segment, self.category, self.size, self.last = segment, category, 0, None
        self.terms, self.codes, self.numbers, self.times, self.sizes = [], [], [], [], []
        self.types: list[pa.DataType] = []

    def add(self, rows: pa.RecordBatch):
        """Count a batch's tokens; gives its chunk rows."""
        keys = [rows.column(c) for c in KEY]
        self.types = [k.type for k in keys]
        # Of rows with one key the first counts.
        first = np.ones(len(rows), bool)
        codes = [k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in keys]
        first[1:] = np.logical_or(*(c[1:] != c[:-1] for c in codes))
        first[0] = self.last != [k[0].as_py() for k in keys]
        self.last = [k[len(rows) - 1].as_py() for k in keys]
        rows = rows.filter(pa.array(first))
        n = len(rows)
        if not n:
            return
        tokens = rows.column("tokens")
        sizes = tokens.value_lengths().to_numpy().astype(np.int64)
        words = tokens.flatten().dictionary_encode()
        key, times = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
        for held, values in ((self.terms, words.dictionary), (self.codes, (key // n).astype(np.int32)), (self.numbers, (key % n + self.size).astype(np.int32)), (self.times, times.astype(np.int32)), (self.sizes, sizes.astype(np.int32))):
            held.append(values)
        none = [pa.nulls(n, t) for t in (pa.string(), pa.int32(), pa.binary(), pa.float32())]
        yield pa.RecordBatch.from_arrays([rows.column("category"), rows.column("segment"), *none, *(rows.column(c) for c in KEY), pa.array(np.arange(self.size, self.size + n), pa.int32()), pa.array(sizes, pa.int32())], names=_NAMES)
        self.size += n

    def blocks(self):
        every = pa.chunked_array(self.terms, pa.string()).combine_chunks()
        every = (every.combine_chunks() if isinstance(every, pa.ChunkedArray) else every).dictionary_encode()
        terms, known = every.dictionary, every.indices.to_numpy(zero_copy_only=False)
        shift = np.cumsum([0, *(len(t) for t in self.terms)])
        term = np.concatenate([known[c + o] for c, o in zip(self.codes, shift)]) if self.codes else np.zeros(0, np.int32)
        # Batches come in order, so a stable sort by term keeps the numbers in order.
        order = np.argsort(term, kind="stable").astype(np.int32)
        term, self.codes, known, every = term[order], None, None, None
        number = np.concatenate(self.numbers)[order]
        self.numbers = None
        times = np.concatenate(self.times)[order]
        self.times, order, sizes = None, None, np.concatenate(self.sizes)
        starts = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (number[1:] >> BLOCK_BITS != number[:-1] >> BLOCK_BITS))) if len(term) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(term)) if len(starts) else starts
        wide = 4 if len(times) and max(times.max(), sizes.max()) > 65_535 else 2
        for i in range(0, len(starts), 20_000):
            some = starts[i : i + 20_000]
            a, b, m = some[0], ends[min(i + 20_000, len(ends)) - 1], len(some)
            upto = ends[i : i + 20_000] - a
            size = sizes[number[a:b]]
            gain = (1 - 1 / (1 + times[a:b])) / (1 + np.log(np.maximum(size, 1)))
            columns = [pa.array([self.category] * m, pa.string()), pa.array(np.full(m, self.segment), pa.int64()), terms.take(pa.array(term[some])), pa.array(number[some] >> BLOCK_BITS, pa.int32())]
            columns += [_packed(number[a:b] & ((1 << BLOCK_BITS) - 1), times[a:b], size, upto, wide), pa.array(np.nextafter(np.maximum.reduceat(gain, some - a).astype(np.float32), np.float32(np.inf)))]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(m, t) for t in self.types), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())], names=_NAMES)


_NAMES = ["category", "segment", "term", "block", "posts", "best", *KEY, "number", "size"]


# Searching a segment ----------------------------------------------------------------


def _segment_search(k: int, every: bool):
    schema = pa.schema([("question_id", pa.int64()), ("batch", pa.int32()), ("segment", pa.int64()), ("number", pa.int32()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        batch, segment = table["batch"][0].as_py(), table["segment"][0].as_py()
        gone = table["gone"].drop_null()
        gone = np.asarray(gone[0].values).astype(np.int64) if len(gone) else np.zeros(0, np.int64)
        postings, asks = _postings(table)
        out: dict[str, list] = {"question_id": [], "number": [], "score": []}
        for question, terms in asks.items():
            (length, distinct), weights = terms.pop(None), terms
            if every and len(weights) < distinct:
                continue
            numbers, scores = (_all_terms if every else _any_term)({t: postings[t] for t in weights}, weights, k, gone, CLOSE * length)
            out["question_id"].append(np.full(len(numbers), question))
            out["number"].append(numbers)
            out["score"].append(scores / length)
        arrays = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        n = len(arrays["number"])
        arrays |= {"batch": np.full(n, batch), "segment": np.full(n, segment)}
        return pa.table([pa.array(arrays[f.name]).cast(f.type) for f in schema], schema=schema)

    return run


def _postings(table: pa.Table):
    """By term: block numbers, bounds, starts and the postings in order; by question: its terms' weights and lengths."""
    postings, asks = {}, {}
    asked = table.filter(table["asks"].is_valid()).select(["term", "asks"])
    table = table.filter(table["posts"].is_valid()).drop_columns(["asks", "gone"])
    if not len(table):
        return postings, asks
    table = table.combine_chunks().sort_by([("term", "ascending"), ("block", "ascending")])
    terms, bests, blocks = table["term"].to_pylist(), table["best"].to_numpy().astype(np.float64), table["block"].to_numpy()
    posts = [_unpacked(x) for x in table["posts"].to_pylist()]
    ends = np.concatenate(([0], np.cumsum([len(p) for p, _, _ in posts], dtype=np.int64)))
    numbers = np.concatenate([p.astype(np.int64) + (b << BLOCK_BITS) for (p, _, _), b in zip(posts, blocks.tolist())])
    times, sizes = (np.concatenate([x[k] for x in posts]).astype(np.float64) for k in (1, 2))
    gain = (1 - 1 / (1 + times)) / (1 + np.log(np.maximum(sizes, 1)))
    cuts = [i for i, t in enumerate(terms) if i == 0 or t != terms[i - 1]] + [len(terms)]
    for a, b in zip(cuts, cuts[1:]):
        span = slice(ends[a], ends[b])
        postings[terms[a]] = blocks[a:b], bests[a:b], ends[a : b + 1] - ends[a], numbers[span], gain[span]
    for term, asking in zip(asked["term"].to_pylist(), asked["asks"]):
        for x in asking.as_py() if term in postings else ():
            mine = asks.setdefault(x["question_id"], {None: (x["length"], x["distinct"])})
            mine[term] = x["weight"]
    return postings, asks


def _best(numbers, scores, k, close):
    """The best k and all that may equal the k-th once rounded; equal scores by number, so ties beyond k are left out only where they lose."""
    if len(numbers) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least - close
        numbers, scores = numbers[keep], scores[keep]
    return numbers, scores


def _all_terms(postings, weights, k, gone, close):
    """Chunks that hold all terms, block by block from the highest bound, until no bound reaches the k-th score."""
    shared = None
    for blocks, *_ in postings.values():
        shared = blocks if shared is None else np.intersect1d(shared, blocks, assume_unique=True)
    places = {t: np.searchsorted(p[0], shared) for t, p in postings.items()}
    bound = sum(weights[t] * p[1][places[t]] for t, p in postings.items())
    numbers, scores, least = [], [], -np.inf
    # The rarest term first: what is left to look up only shrinks.
    order = sorted(postings, key=lambda t: len(postings[t][3]))
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < least - close:
            break
        found = total = None
        for t in order:
            _, _, starts, held, gain = postings[t]
            a, b = starts[places[t][i]], starts[places[t][i] + 1]
            if found is None:
                found, total = held[a:b], weights[t] * gain[a:b]
            else:
                at = np.searchsorted(held[a:b], found)
                same = at < b - a
                same[same] = held[a:b][at[same]] == found[same]
                found, total = found[same], total[same] + weights[t] * gain[a:b][at[same]]
        if len(gone):
            kept = ~np.isin(found, gone)
            found, total = found[kept], total[kept]
        if len(found):
            numbers.append(found)
            scores.append(total)
            every = np.concatenate(scores)
            if len(every) >= k:
                least = np.partition(every, len(every) - k)[len(every) - k]
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(0)
    return _best(np.concatenate(numbers), np.concatenate(scores), k, close)


def _any_term(postings, weights, k, gone, close):
    numbers, at = np.unique(np.concatenate([p[3] for p in postings.values()]), return_inverse=True)
    scores = np.bincount(at, np.concatenate([weights[t] * p[4] for t, p in postings.items()]), len(numbers))
    if len(gone):
        kept = ~np.isin(numbers, gone)
        numbers, scores = numbers[kept], scores[kept]
    return _best(numbers, scores, k, close)
