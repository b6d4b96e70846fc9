"""Approximate vector search by an inverted file with product-quantised residuals.

A model is fitted on at most ``SAMPLE`` vectors: cells by spherical k-means, and
for each of ``PARTS`` slices of the residuals (vector minus its cell's centre)
256 centres.  Every vector is stored in its cell's folder with its codes (one byte
a slice) beside it.  A question reads the folders of its nearest cells, scores
their rows from a table of slice products, and compares the best of them, by a
wide margin, exactly.  How many cells to read and how many rows to compare is
calibrated on the sample for a recall asked for.

Batches are appended by assigning their vectors to the cells that are there; a
batch counts once its manifest row is written.  Scores are those of
``vector_topk``: exact cosine, rounded to six places, ties by key.  Chunks without
a vector or with a zero vector take no part.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import workspace

from .batchsearch import _Best, _blocks_of, _matrix
from .search import KEY

#: Vectors that the model is fitted on, and those of them that calibrate it.
SAMPLE, ASKED = 20_000, 200
PARTS, CODES = 8, 256
ROUNDS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-30)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's rounds; an empty cell takes a random row."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        near = _nearest(x, centres)
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


class Model:
    """Cells' centres and the centres of residual slices; vectors are compared at unit length."""

    def __init__(self, cells: np.ndarray, slices: np.ndarray, probes: int = 1, margin: int = 100):
        self.cells, self.slices, self.probes, self.margin = cells, slices, probes, margin

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, recall: float, seed: int = 5) -> Model:
        rng, x = np.random.default_rng(seed), _unit(sample)
        cells = _means(x, min(len(x), max(1, int(math.sqrt(len(x))))), rng)
        width = -(-x.shape[1] // PARTS)
        rest = np.pad(x - cells[_nearest(x, cells)], ((0, 0), (0, width * PARTS - x.shape[1])))
        slices = np.stack([_means(rest[:, i * width : (i + 1) * width], min(CODES, len(x)), rng) for i in range(PARTS)])
        model = cls(cells, slices)
        model._calibrate(x, k, recall, rng)
        return model

    def _calibrate(self, x: np.ndarray, k: int, recall: float, rng) -> None:
        """The fewest cells, then the fewest rows to compare, that reach the recall among sampled questions."""
        asked = x[rng.choice(len(x), min(ASKED, len(x)), replace=False)]
        exact, (cell, codes) = asked @ x.T, self.assign(x)
        true = np.argsort(-exact, 1, kind="stable")[:, :k]
        rank = np.argsort(np.argsort(-(asked @ self.cells.T), 1, kind="stable"), 1)
        needed = np.take_along_axis(rank, cell[true], 1)
        self.probes = next((n for n in range(1, len(self.cells) + 1) if (needed < n).mean() >= (1 + recall) / 2), len(self.cells))
        guess = np.stack([self.guess(q, cell, codes) for q in asked])
        guess[np.take_along_axis(rank, np.broadcast_to(cell, guess.shape), 1) >= self.probes] = -np.inf
        place = np.take_along_axis(np.argsort(np.argsort(-guess, 1, kind="stable"), 1), true, 1)
        self.margin = next((n for n in (k * 2**i for i in range(30)) if n >= len(x) or ((place < n) & (needed < self.probes)).mean() >= recall), len(x))

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and codes of unit vectors."""
        cell = _nearest(x, self.cells)
        width = self.slices.shape[2]
        rest = np.pad(x - self.cells[cell], ((0, 0), (0, width * PARTS - x.shape[1])))
        return cell, np.stack([_nearest(rest[:, i * width : (i + 1) * width], self.slices[i]) for i in range(PARTS)], 1).astype(np.uint8)

    def guess(self, question: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate products of a unit question with rows, from one table for each slice."""
        width = self.slices.shape[2]
        padded = np.pad(question, (0, width * PARTS - len(question))).reshape(PARTS, width)
        table = np.einsum("pcw,pw->pc", self.slices, padded)
        return (self.cells @ question)[cell] + sum(table[i][codes[:, i]] for i in range(PARTS))

    def near(self, questions: np.ndarray, probes: int) -> np.ndarray:
        """Each question's nearest cells."""
        return np.argsort(-(questions @ self.cells.T), 1, kind="stable")[:, :probes]

    def text(self) -> str:
        return json.dumps({"cells": self.cells.tolist(), "slices": self.slices.tolist(), "probes": self.probes, "margin": self.margin})

    @classmethod
    def of(cls, text: str) -> Model:
        d = json.loads(text)
        return cls(np.array(d["cells"]), np.array(d["slices"]), d["probes"], d["margin"])


class VectorIndex:
    """An index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def model(self) -> Model:
        return Model.of(self.spark.read.parquet(f"{self.folder}/model").first().model)

    def fit(self, corpus: DataFrame, k: int = 10, recall: float = 0.95) -> Model:
        """Fit and keep a model; the sample is chosen by a hash, in one pass and without a sort."""
        some = corpus.where(F.size("embedding") > 0)
        share = min(1.0, 1.2 * SAMPLE / max(1, some.count()))
        picked = some.where(F.pmod(F.xxhash64(*KEY), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("embedding").limit(SAMPLE)
        rows = [r for r in picked.toPandas()["embedding"] if np.any(r)]
        if not rows:
            raise ValueError("no vectors to fit on")
        model = Model.fit(np.array([np.asarray(r, float) for r in rows]), k, recall)
        self.spark.createDataFrame([(model.text(),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/model")
        return model

    def batches(self) -> list[int]:
        if not workspace.exists(self.spark, f"{self.folder}/manifest"):
            return []
        return sorted(r.batch for r in self.spark.read.schema("rows long, batch int").parquet(f"{self.folder}/manifest").select("batch").collect())

    def append(self, corpus: DataFrame) -> int:
        """Assign a batch's vectors to cells and store them; gives its number."""
        model, known = self.model(), self.batches()
        n = known[-1] + 1 if known else 0
        sent = self.spark.sparkContext.broadcast(model)

        def run(batches):
            model = sent.value
            for b in batches:
                x, sizes = _matrix(b.column(2), model.cells.shape[1])
                b, x = b.filter(pa.array(sizes > 0)), x[sizes > 0]
                cell, codes = model.assign(_unit(x))
                blobs = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns, blobs, pa.array(cell, pa.int32())], names=[*KEY, "embedding", "codes", "cell"])

        rows = corpus.where(F.col("embedding").isNotNull()).select(*KEY, "embedding")
        types = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        placed = rows.mapInArrow(run, f"{types}, codes binary, cell int")
        # A cell's rows are split where they are many, and put together where they are few.
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/rows/batch={n}")
        self.spark.createDataFrame([(0,)], "rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={n}")
        return n

    def cells(self, cells: list[int] | None = None) -> DataFrame:
        """Rows of complete batches, of some cells: other folders are not read."""
        rows = self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*[f"{self.folder}/rows/batch={n}" for n in self.batches()])
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def search(self, questions: DataFrame, k: int, probes: int | None = None, margin: int | None = None) -> DataFrame:
        """question_id, document_id, chunk_index, score: each question's (question_id, vector) best k of those found, best first by score and key."""
        model, out = self.model(), None
        probes, margin = probes or model.probes, margin or model.margin
        for ids, vectors in _blocks_of(questions.where(F.col("vector").isNotNull()).select(F.col("question_id").cast("long"), "vector")):
            asked, sizes = _matrix(pa.array(vectors, pa.list_(pa.float64())), model.cells.shape[1])
            asked = _unit(asked)
            of: dict[int, list[int]] = {}
            for q, cells in enumerate(model.near(asked, probes).tolist()):
                for c in cells if sizes[q] > 0 else ():
                    of.setdefault(c, []).append(q)
            sent = self.spark.sparkContext.broadcast((model, ids, asked, of))
            rows = self.cells(sorted(of)).select("cell", *KEY, "codes", "embedding")
            types = dict(rows.dtypes)
            found = rows.mapInArrow(_probed(sent, k, margin), f"question_id long, document_id {types['document_id']}, chunk_index {types['chunk_index']}, score double")
            out = found if out is None else out.unionByName(found)
        if out is None:
            raise ValueError("no questions")
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), *KEY))
        return out.withColumn("score", F.round("score", 6)).withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def _probed(sent, k: int, margin: int):
    def run(batches):
        model, ids, asked, of = sent.value
        best, types = _Best(len(ids), k), None
        for b in batches:
            types = b.schema
            cell = b.column(0).to_numpy()
            keys = b.select(list(KEY)).to_pandas()
            codes = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, PARTS)
            rows, _ = _matrix(b.column(4), model.cells.shape[1])
            rows = _unit(rows)
            for c in np.unique(cell).tolist():
                at = np.flatnonzero(cell == c)
                for q in of.get(c, ()):
                    mine = at
                    if len(at) > margin:
                        guess = model.guess(asked[q], cell[at], codes[at])
                        mine = at[np.argpartition(-guess, margin)[:margin]]
                    best.offer(q, np.round(rows[mine] @ asked[q], 6), keys, mine)
        if types is not None and best.parts:
            top = best.cut()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[top["q"].to_numpy()]), *(pa.array(top[c], type=types.field(c).type, from_pandas=True) for c in KEY), pa.array(top["score"].to_numpy(np.float64))], ["question_id", *KEY, "score"])

    return run
