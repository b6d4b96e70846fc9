"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits the space by hyperplanes halfway between two random vectors of
a bounded sample, at the sample's median, until leaves hold about ``LEAF`` rows, or 2 * sqrt(rows) where
that is more, so that the leaves a query reaches grow slower than the rows.
Largest inner products become nearest directions by one more coordinate that
brings every vector to the same length.  All rows are indexed: each falls into
one leaf of every tree.

A query walks all trees with one priority queue, most promising side first,
until the leaves it has reached hold enough rows.  How many are enough is
calibrated: for some sampled vectors the true neighbours within the sample are
computed, and so many rows are asked for that ``RECALL`` of them are reached.
(Vectors without any structure need a fixed share of all rows, whatever the
index; structured ones need few.)

Rows and queries that share a leaf then meet in one task.  The first ``HOME`` of
what a query asks for, its most promising leaves, goes first; the k-th score
found there is a lower bound with which it visits the other leaves, so that
these pass on only what can still matter, and what is passed on grows with the
queries, not with the rows they meet.  Products are screened by a matrix
product; scores are inner products of the original vectors in double precision,
summed in order, and the merger of the leaves' hits is their exact reranking.
All answers come from leaves.

The model (sample, hyperplanes, rows per leaf) has a fixed bound, whatever the
input; leaves of more than ``PART`` rows, such as one very frequent vector, are
split over several tasks.  A task holds the rows of one part of a leaf; the
queries stream past them.

Rows: vectors that are null, zero, of another length than most, or that hold
null or non-finite numbers take no part; a query never finds its own vec_id;
ties go to the smaller vec_id; rows repeated with one vec_id are found once; an
empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .wordhash import mix

TREES, LEAF, PART = 6, 200, 4_096
#: Share of the true neighbours to be reached, vectors it is calibrated on, and share of a query's rows that it visits first.
RECALL, CALIBRATED, HOME = 0.95, 200, 0.125
#: Bounds of the sample that the trees are fitted on and of their hyperplanes.
SAMPLE_ROWS, SAMPLE_BYTES, MODEL_BYTES = 60_000, 48 << 20, 32 << 20


class Forest:
    """normals, offsets: of inner nodes; child: node or, below 0, leaf; numbered through all trees."""

    def __init__(self, sample: np.ndarray, length: float, rows: int, trees: int = TREES, leaf: int = LEAF, seed: int = 0, k: int = 20):
        self.length = length
        x, rng = self.lift(sample), np.random.default_rng(seed)
        width = x.shape[1]
        leaf = max(leaf, 2 * int(rows**0.5))
        most = max(2, min(rows // leaf + 1, MODEL_BYTES // (4 * width * trees)))
        small = max(2, len(x) // most)
        self.roots, normals, offsets, child, leaves, held = [], [], [], [], 0, []
        for _ in range(trees):
            stack = [(np.arange(len(x)), None)]
            first = True
            while stack:
                at, parent = stack.pop()
                split = None
                if len(at) > small:
                    for _ in range(4):
                        a, b = rng.choice(len(at), 2, replace=False)
                        normal = x[at[a]] - x[at[b]]
                        size = np.sqrt(normal @ normal)
                        if size > 0:
                            side = x[at] @ (normal / size)
                            middle = np.median(side)
                            right = side > middle
                            if right.any() and not right.all():
                                split = normal / size, middle, right
                                break
                if split is None:
                    node = -1 - leaves
                    leaves += 1
                    held.append(len(at))
                else:
                    node = len(normals)
                    normals.append(split[0]), offsets.append(split[1]), child.append([0, 0])
                    stack += [(at[~split[2]], (node, 0)), (at[split[2]], (node, 1))]
                if first:
                    self.roots.append(node)
                    first = False
                if parent:
                    child[parent[0]][parent[1]] = node
        self.normals = np.array(normals, np.float32).reshape(-1, width)
        self.offsets, self.child, self.leaves = np.array(offsets, np.float32), np.array(child, np.int64).reshape(-1, 2), leaves
        # In any case leaves that hold k rows besides the query's own, each being in every tree.
        self.enough = max(self._calibrate(sample, np.array(held), rng, k) * rows / max(1, len(x)), trees * (k + 1))

    def _calibrate(self, sample: np.ndarray, held: np.ndarray, rng, k: int) -> float:
        """Rows that leaves must hold, in the sample, for RECALL of the k nearest sampled vectors to be among them."""
        need = []
        for j in rng.permutation(len(sample))[:CALIBRATED]:
            score = sample @ sample[j].astype(np.float32)
            score[j] = -np.inf
            near = np.argsort(-score, kind="stable")[: min(k, len(sample) - 1)]
            order = np.array(self.search(sample[j], held, len(sample) * len(self.roots) + 1))
            reached = np.zeros(self.leaves)
            reached[order] = np.cumsum(held[order])
            if len(near):
                need += reached[self.place(sample[near])].min(1).tolist()
        return float(np.quantile(need, RECALL)) if need else 1.0

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One more coordinate: what a vector lacks to the greatest length; 0 for a query."""
        x = x.astype(np.float32)
        lack = np.zeros(len(x), np.float32) if query else np.sqrt(np.maximum(self.length - (x.astype(float) ** 2).sum(1), 0)).astype(np.float32)
        return np.hstack((x, lack[:, None]))

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x, out = self.lift(x), np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root)
            while len(at := np.flatnonzero(node >= 0)):
                n = node[at]
                side = np.einsum("ij,ij->i", x[at], self.normals[n]) > self.offsets[n]
                node[at] = self.child[n, side.astype(int)]
            out[:, t] = -1 - node
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
        """Leaves for one query, best first, until they hold ``enough`` rows (with repetition, a row being in every tree)."""
        q = self.lift(q[None], query=True)[0]
        q /= np.sqrt(q @ q)
        far = (self.normals @ q - self.offsets).tolist()
        child, heap, found, held = self.child, [(-np.inf, t, r) for t, r in enumerate(self.roots)], [], 0
        n = len(heap)
        while heap and held < enough:
            near, _, node = heappop(heap)
            if node < 0:
                found.append(-1 - node)
                held += sizes[-1 - node]
                continue
            d = far[node]
            for side, margin in ((0, -d), (1, d)):
                heappush(heap, (max(near, -margin), n, int(child[node, side])))
                n += 1
        return found


def _usable(v: str, width: int | None = None) -> F.Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine if width is None else fine & (F.size(v) == width), F.lit(False))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in order of the coordinates."""
    s = np.zeros(len(q))
    for d in range(q.shape[1]):
        s += q[:, d] * x[:, d]
    return s


def _top(who: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((vec, -score, who))
    who, vec, score = who[order], vec[order], score[order]
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, int)
    place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
    keep = place < k
    return who[keep], vec[keep], score[keep]


def _meet(width: int, k: int):
    """Per run of (leaf, part): rows come first and are held, queries stream past; yields each query's k best of the run that reach its bound."""

    def hits(ids, q, low, names, x):
        size = np.sqrt((q**2).sum(1)) * np.sqrt((x**2).sum(1).max())
        s = q @ x.T
        s[ids[:, None] == names[None]] = -np.inf
        if len(names) > k:
            low = np.maximum(low, np.partition(s, -k, axis=1)[:, -k])
        at, r = np.nonzero((s >= (low - 1e-13 * width * size)[:, None]) & np.isfinite(s))
        return _top(ids[at], names[r], _products(q[at], x[r]), k)

    def run(batches):
        key, names, rows, met, size = None, [], [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            leaf, part, asks, rid, bound = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2, 3, 5))
            x = _matrix(b.column(4), width)
            cut = np.flatnonzero((leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *cut], [*cut, len(leaf)]):
                if key != (leaf[a], part[a]):
                    key, names, rows = (leaf[a], part[a]), [], []
                if not asks[a]:
                    # Rows come in order of their id; one repeated is met once.
                    fresh = a + np.flatnonzero(np.concatenate(([not names or rid[a] != names[-1][-1]], rid[a + 1 : z] != rid[a : z - 1])))
                    if len(fresh):
                        names.append(rid[fresh]), rows.append(x[fresh].astype(float))
                    continue
                if len(names) > 1:
                    names, rows = [np.concatenate(names)], [np.concatenate(rows)]
                for i in range(a, z if names else a, 256):
                    j = min(z, i + 256)
                    met.append(hits(rid[i:j], x[i:j].astype(float), bound[i:j], names[0], rows[0]))
                    size += len(met[-1][0])
                    if size > 100_000:
                        yield _hits(met)
                        met, size = [], 0
        if size:
            yield _hits(met)

    return run


def _hits(met: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*met)], ["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: F.Column, k: int = 20, trees: int = TREES, leaf: int = LEAF, seed: int = 0) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``queries`` holds for, its k nearest other rows by inner product."""
    spark = vectors.sparkSession
    small_batches(spark)
    s = Scratch(spark, "forest")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & _usable("v"))
    widths = base.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("length")).orderBy(F.desc("n"), "w").first()
    if widths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, rows, length = widths.w, widths.n, widths.length
    base = base.where(F.size("v") == width)
    most = min(SAMPLE_ROWS, SAMPLE_BYTES // (4 * width))
    sample = base if rows <= most else base.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1 << 30)) < int((1 << 30) * most / rows))
    sample = sample.groupBy("vec_id").agg(F.min("v").alias("v")).toArrow()
    order = np.argsort(sample["vec_id"].to_numpy(), kind="stable")
    sample = _matrix(sample["v"].combine_chunks(), width)[order]
    forest = spark.sparkContext.broadcast(Forest(sample, length, rows, trees, leaf, seed, k))

    def place(batches):
        for b in batches:
            if b.num_rows:
                at = forest.value.place(_matrix(b.column(1), width)).astype(np.int32)
                leaves = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * at.shape[1]), pa.array(at.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, leaves], ["vec_id", "v", "asks", "leaves"])

    kind = base.schema["v"].dataType.simpleString()
    placed = s.table(base.mapInArrow(place, f"vec_id long, v {kind}, asks boolean, leaves array<int>"), "placed")
    sizes = np.zeros(forest.value.leaves, np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf"), "vec_id").groupBy("leaf").agg(F.count_distinct("vec_id").alias("n")).toLocalIterator():
        sizes[r.leaf] = r.n
    facts = spark.sparkContext.broadcast((sizes, -(-sizes // PART)))

    def rows_of(leaf, part, asks, ids, v, low, at):
        at = pa.array(at)
        columns = [pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(at), asks, np.int32)), ids.take(at), v.take(at), low.take(at)]
        return pa.RecordBatch.from_arrays(columns, ["leaf", "part", "asks", "id", "v", "low"])

    def held(batches):
        """Every row in its part of its leaf of every tree."""
        for b in batches:
            for i in range(0, b.num_rows, 512):
                ids, v, leaves = (b.column(c).slice(i, 512) for c in (0, 1, 3))
                leaf, at = leaves.flatten().to_numpy(), np.repeat(np.arange(len(ids)), trees)
                part = mix(ids.to_numpy()[at].astype(np.uint64), 9) % facts.value[1][leaf].astype(np.uint64)
                yield rows_of(leaf, part.astype(np.int32), 0, ids, v, pa.array(np.zeros(len(ids))), at)

    def visits(first: bool):
        """Every query in all parts of the leaves it visits first, or of the others."""

        def run(batches):
            sizes, parts = facts.value
            for b in batches:
                for i in range(0, b.num_rows, 64):
                    ids, v, low = (b.column(c).slice(i, 64) for c in range(3))
                    leaf, part, at = [], [], []
                    for j, q in enumerate(_matrix(v, width)):
                        found = np.array(forest.value.search(q, sizes, forest.value.enough), np.int64)
                        held = np.cumsum(sizes[found])
                        home = held - sizes[found] < max(HOME * forest.value.enough, trees * (k + 1))
                        for x in found[home == first].tolist():
                            n = int(parts[x])
                            leaf += [x] * n
                            part += range(n)
                            at += [j] * n
                    yield rows_of(leaf, part, 1, ids, v, low, np.array(at, np.int64))

        return run

    schema = f"leaf int, part int, asks int, id long, v {kind}, low double"

    def meet(asking: DataFrame, first: bool) -> DataFrame:
        both = placed.mapInArrow(held, schema).unionByName(asking.mapInArrow(visits(first), schema))
        return both.repartition("leaf", "part").sortWithinPartitions("leaf", "part", "asks", "id").mapInArrow(_meet(width, k), "query_id long, vec_id long, score double")

    asks = placed.where("asks").select("vec_id", "v")
    near = s.table(_best(meet(asks.withColumn("low", F.lit(float("-inf"))), True), k), "near")
    bound = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("low"))
    rest = meet(asks.join(bound, "vec_id", "left").withColumn("low", F.coalesce("low", F.lit(float("-inf")))), False)
    out = s.table(_best(near.drop("rank").unionByName(rest), k), "result")
    s.drop(keep=("result",))
    return out
