"""Vector expressions and embedders."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; the longer vector's rest counts nothing."""
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0, null where a vector is null."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


class HashEmbedder:
    """A deterministic embedder without a model: signed feature hashing of words, unit length."""

    def __init__(self, width: int = 768, seed: int = 0):
        self.width, self.seed = width, seed

    def embed(self, text: str) -> np.ndarray:
        import zlib

        v = np.zeros(self.width, np.float32)
        for word in text.lower().split():
            h = zlib.crc32(word.encode(), self.seed)
            v[h % self.width] += 1.0 if h & 0x80000000 else -1.0
        n = np.sqrt(v @ v)
        return v / n if n else v

    def column(self):
        """An Arrow UDF from text to vector; a null text gives a null vector."""
        embed = self.embed

        @F.arrow_udf("array<float>")
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else embed(t) for t in texts.to_pylist()], pa.list_(pa.float32()))

        return run
