"""Sampled SentencePiece segmentations by forward filtering, backward sampling.

A segment's piece lattice has an edge for every piece of the vocabulary that
occurs in it, and for a character without a piece an edge of its UTF-8 byte
pieces.  The forward pass sums the weights of all paths to each position; the
backward pass draws the last piece of the segment in proportion to them, then
the one before it, and so on.  The draw of the k-th segment of a row is a number
in [0, 1) made from the row's key, so the same row is always cut alike, wherever
and however often it runs.

A piece's weight is (rank + 2) ** -theta, by its rank in the vocabulary, and
2 ** -20 for a byte: high theta samples near the best path.

Segments of up to ``SHORT`` characters, nearly all, go through both passes
together as numpy arrays, grouped by length; longer ones one by one.

Decoding joins the pieces' bytes and is lossless: U+2581 in a text is
written as bytes, never as the mark of a space.

Rows: a null text gives null ids and decodes to null; an empty text gives no
ids; repeated rows are cut alike; other columns are kept.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import BAR, SEGMENTS, load
from .scratch import lean, small_batches
from .wordhash import mix

#: Longest segment that takes the array path, and characters of one block of texts.
SHORT, BLOCK_CHARS = 24, 400_000
#: Beyond this length weights are rescaled on the way.
SAFE = 80
_P, _M, _SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 19


class _Table:
    """Pieces by a rolling hash of their characters, with open addressing."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        n = 1 << _SLOT_BITS
        self.hash, self.id, self.weight = np.zeros(n + 64, np.uint64), np.full(n + 64, -1, np.int64), np.zeros(n + 64)
        self.probes = 1
        for piece, (i, w) in pieces.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = (h + np.uint64(ord(c) + 1)) * _P
            at, k = int(self.slot(h)[0]), 1
            while self.id[at] >= 0:
                at, k = at + 1, k + 1
            self.hash[at], self.id[at], self.weight[at] = h[0], i, w
            self.probes = max(self.probes, k)

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h * _M) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: no piece) and weights (0)."""
        at = self.slot(h)
        held = self.id[at]
        hit = (self.hash[at] == h) & (held >= 0)
        ids, weights = np.where(hit, held, -1), np.where(hit, self.weight[at], 0.0)
        open_ = np.nonzero((held >= 0) & ~hit)
        for k in range(1, self.probes):
            if not len(open_[0]):
                break
            step, want = at[open_] + k, h[open_]
            hit = (self.hash[step] == want) & (self.id[step] >= 0)
            ids[tuple(x[hit] for x in open_)], weights[tuple(x[hit] for x in open_)] = self.id[step[hit]], self.weight[step[hit]]
            more = (self.id[step] >= 0) & ~hit
            open_ = tuple(x[more] for x in open_)
        return ids, weights


class Codec:
    def __init__(self, model: str, theta: float):
        self.pieces = p = load(model)
        # A factor per character that all paths of a segment share keeps sums near 1.
        self.byte_weight = 2.0**-20 * 24.0
        self.literal = tuple(p.byte_id[b] for b in BAR.encode())
        self.edges: dict[str, tuple[float, tuple[int]]] = {}
        for piece, score in p.score.items():
            rank = -score if score > -1e8 else float(p.size)
            self.edges[piece] = (rank + 2.0) ** -theta * 24.0 ** len(piece), (p.id[piece],)
        self.table = _Table({piece: (ids[0], weight) for piece, (weight, ids) in self.edges.items()})

    # One segment

    def forward(self, s: str) -> list[list[tuple[float, int, tuple[int, ...]]]]:
        """For each end, (weight of all paths up to and with this edge, start, ids) of the edges that lead there."""
        n, edges, longest, byte_weight = len(s), self.edges, self.pieces.longest, self.byte_weight
        total = [0.0] * (n + 1)
        total[0] = 1.0
        to: list[list] = [[] for _ in range(n + 1)]
        for i in range(n):
            t = total[i]
            if n > SAFE and not 1e-100 < t < 1e100:
                for k in range(i, min(n, i + longest) + 1):
                    total[k] /= t
                    to[k] = [(c / t, a, ids) for c, a, ids in to[k]]
                t = total[i]
            for j in range(i + 1, min(n, i + longest) + 1):
                if edge := edges.get(s[i:j]):
                    total[j] += t * edge[0]
                    to[j].append((total[j], i, edge[1]))
            if s[i] not in edges:
                raw = s[i].encode()
                total[i + 1] += t * byte_weight ** len(raw)
                to[i + 1].append((total[i + 1], i, tuple(self.pieces.byte_id[b] for b in raw)))
        return to

    def draw(self, to, u: float) -> tuple[int, ...]:
        """One path, by a number in [0, 1) of which each choice uses its share."""
        at, path = len(to) - 1, []
        while at:
            edges = to[at]
            target, low = u * edges[-1][0], 0.0
            for edge in edges:
                if target < edge[0] or edge is edges[-1]:
                    break
                low = edge[0]
            u = min(max((target - low) / ((edge[0] - low) or 1.0), 0.0), 1 - 2.0**-53)
            path.append(edge[2])
            at = edge[1]
        return tuple(chain.from_iterable(reversed(path)))

    # Many segments

    def together(self, chars: np.ndarray, which: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws for segments of one length n: chars (distinct segments, n), which of them and a number for each draw.

        Returns (draws, n) piece ids from the last piece to the first, and how
        many there are.  -1 - c stands for the bytes of a character c.
        """
        kinds, n = chars.shape
        most = min(n, self.pieces.longest)
        ids, cum = np.full((kinds, n + 1, most), -1, np.int64), np.zeros((kinds, n + 1, most))
        h = np.zeros((kinds, n), np.uint64)
        code = chars.astype(np.uint64) + np.uint64(1)
        for size in range(1, most + 1):
            h = (h[:, : n - size + 1] + code[:, size - 1 :]) * _P
            found, weight = self.table.find(h)
            if size == 1:
                lone = found < 0
                if lone.any():
                    c = chars[lone].astype(np.int64)
                    found[lone] = -1 - c
                    weight[lone] = self.byte_weight ** (1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF))
            ids[:, size:, size - 1], cum[:, size:, size - 1] = found, weight
        total = np.zeros((kinds, n + 1))
        total[:, 0] = 1.0
        for j in range(1, n + 1):
            t = np.zeros(kinds)
            for size in range(1, min(j, most) + 1):
                t = t + total[:, j - size] * cum[:, j, size - 1]
                cum[:, j, size - 1] = t
            cum[:, j, min(j, most) :] = t[:, None]
            total[:, j] = t
        out, counts = np.zeros((len(which), n), np.int64), np.zeros(len(which), np.int64)
        rows, at = np.arange(len(which)), np.full(len(which), n)
        while len(rows):
            c = cum[which[rows], at]
            target = u[rows] * c[:, -1]
            size = np.minimum((c <= target[:, None]).sum(1), at - 1)
            high, low = c[np.arange(len(rows)), size], np.where(size > 0, c[np.arange(len(rows)), size - 1], 0.0)
            u[rows] = np.clip((target - low) / np.where(high > low, high - low, 1.0), 0.0, 1 - 2.0**-53)
            out[rows, counts[rows]] = ids[which[rows], at, size]
            counts[rows] += 1
            at = at - size - 1
            rows, at = rows[at > 0], at[at > 0]
        return out, counts

    def encode(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the index of each text's first (one more at the end)."""
        plain = ["" if not t or BAR in t else BAR + t.replace(" ", BAR) for t in texts]
        code = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate(([0], np.cumsum([len(t) for t in plain])))
        bar, line = code == ord(BAR), code == 10
        cut = np.zeros(len(code) + 1, bool)
        cut[begins] = True
        cut[1:-1] |= (bar[1:] & ~bar[:-1]) | line[1:] | line[:-1]
        starts = np.flatnonzero(cut[:-1])
        sizes = np.diff(np.append(starts, len(code)))
        firsts = np.searchsorted(starts, begins)
        place = np.arange(len(starts)) - np.repeat(firsts[:-1], np.diff(firsts))
        seed = mix(np.array([k & (2**64 - 1) for k in keys], np.uint64), 5)
        u = (mix(np.repeat(seed, np.diff(firsts)) + place.astype(np.uint64), 6) >> np.uint64(11)) * 2.0**-53
        counts, parts = np.zeros(len(starts), np.int64), []
        for n in range(1, SHORT + 1):
            at = np.flatnonzero(sizes == n)
            if not len(at):
                continue
            chars = code[starts[at][:, None] + np.arange(n)]
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = (h + chars[:, k].astype(np.uint64) + np.uint64(1)) * _P
            _, first, which = np.unique(h, return_index=True, return_inverse=True)
            ids, counts[at] = self.together(chars[first], which, u[at])
            parts.append((at, ids))
        longer = np.flatnonzero(sizes > SHORT)
        whole = [np.array(self.draw(self.forward(code[a : a + n].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")), x), np.int64) for a, n, x in zip(starts[longer].tolist(), sizes[longer].tolist(), u[longer].tolist())]
        counts[longer] = [len(x) for x in whole]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for at, ids in parts:
            for k in range(ids.shape[1]):
                some = counts[at] > k
                flat[ends[at[some]] - 1 - k] = ids[some, k]
        for a, x in zip((ends - counts)[longer].tolist(), whole):
            flat[a : a + len(x)] = x
        offsets = np.concatenate(([0], ends))[firsts]
        if (flat < 0).any():
            flat, offsets = self._spell(flat, offsets)
        other = [i for i, t in enumerate(texts) if t and BAR in t]
        if not other:
            return flat, offsets
        rows = np.split(flat, offsets[1:-1])
        for i in other:
            rows[i] = np.array(self.guarded(texts[i], keys[i]), np.int64)
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def _spell(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces for the characters that have no piece."""
        at = np.flatnonzero(flat < 0)
        raw = [chr(-1 - int(c)).encode("utf-8", "surrogatepass") for c in flat[at]]
        n = np.ones(len(flat), np.int64)
        n[at] = [len(r) for r in raw]
        ends = np.cumsum(n)
        out = np.repeat(flat, n)
        for a, r in zip((ends - n)[at].tolist(), raw):
            out[a : a + len(r)] = [self.pieces.byte_id[b] for b in r]
        return out, np.concatenate(([0], ends))[offsets]

    def guarded(self, text: str, key: int) -> list[int]:
        """A text that holds U+2581 itself: what lies between goes through the passes, it is spelled in bytes."""
        first, *rest = (x.replace(" ", BAR) for x in text.split(BAR))
        segments = [*SEGMENTS.findall(BAR + first)]
        for part in rest:
            segments += [None, *SEGMENTS.findall(part)]
        seed = mix(np.array([key & (2**64 - 1)], np.uint64), 5)
        u = ((mix(seed + np.arange(len(segments), dtype=np.uint64), 6) >> np.uint64(11)) * 2.0**-53).tolist()
        return list(chain.from_iterable(self.literal if s is None else self.draw(self.forward(s), x) for s, x in zip(segments, u)))

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.surface.__getitem__, ids)).decode()[1:]


_codecs: dict[tuple, Codec] = {}


def _codec(model: str, theta: float) -> Codec:
    if (model, theta) not in _codecs:
        _codecs[model, theta] = Codec(model, theta)
    return _codecs[model, theta]


def _encoding(model: str, theta: float, seed: int, column: str):
    """Batches with doc_id and text get a column of ids."""

    def run(batches):
        codec = _codec(model, theta)
        for b in batches:
            keys, texts = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text"))
            a = 0
            while a < b.num_rows:  # blocks of bounded size
                z, size, held = a, 0, []
                while z < b.num_rows and (not held or size < BLOCK_CHARS):
                    held.append(texts[z].as_py())
                    size += len(held[-1] or "")
                    z += 1
                names = [(k or 0) * 0x100000001B3 + seed for k in keys.slice(a, z - a).to_pylist()]
                flat, offsets = codec.encode([t or "" for t in held], names)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array([t is None for t in held]))
                yield pa.RecordBatch.from_arrays([*b.slice(a, z - a).columns, ids], [*b.schema.names, column])
                a = z

    return run


def _decoding(model: str, column: str, into: str):
    """Batches with a column of ids get the text that they stand for."""

    def run(batches):
        codec = _codec(model, 1.0)
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                texts = [None if x is None else codec.decode(x) for x in part.column(part.schema.get_field_index(column)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, into])

    return run


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind, True)])


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", theta: float = 1.0, seed: int = 0, column: str = "piece_ids") -> DataFrame:
    """The rows with an array of the ids of one sampled segmentation of the whole text, keyed by doc_id.

    A column of the input named like ``column`` is replaced.
    """
    small_batches(docs.sparkSession)
    base = docs.drop(column)
    return base.mapInArrow(lean(_encoding(model, theta, seed, column)), _with(base, column, T.ArrayType(T.IntegerType(), False)))


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", column: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """The rows with the text that the ids stand for; a column named like ``into`` is replaced."""
    small_batches(encoded.sparkSession)
    base = encoded.drop(into)
    return base.mapInArrow(lean(_decoding(model, column, into)), _with(base, into, T.StringType()))


def coded(docs: DataFrame, model: str = "piece_bpe_32k.model", theta: float = 1.0, seed: int = 0) -> DataFrame:
    """The rows with piece_ids, and lossless: whether decoding them gives the text back.

    Both directions run in one Python worker, ids and decoded text never
    leaving it in between.  Columns of these names are replaced; lossless is
    true for a null text too, which has null ids.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("piece_ids", "lossless")
    schema = _with(base, "piece_ids", T.ArrayType(T.IntegerType(), False)).add("lossless", T.BooleanType())

    def run(batches):
        codec = _codec(model, theta)
        for b in _encoding(model, theta, seed, "piece_ids")(batches):
            same, at = [], b.schema.get_field_index("text")
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                same += [t is None and ids is None or ids is not None and codec.decode(ids) == t for ids, t in zip(part.column(b.num_columns - 1).to_pylist(), part.column(at).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same, pa.bool_())], [*b.schema.names, "lossless"])

    return base.mapInArrow(lean(run), schema)


def digests(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), lossless; all null for a null text."""
    import zlib

    model, theta, seed = kw.get("model", "piece_bpe_32k.model"), kw.get("theta", 1.0), kw.get("seed", 0)

    def run(batches):
        codec = _codec(model, theta)
        for b in _encoding(model, theta, seed, "piece_ids")(batches):
            n, crc, same = [], [], []
            for i in range(0, b.num_rows, 128):
                for ids, text in zip(b.column(2).slice(i, 128), b.column(1).slice(i, 128).to_pylist()):
                    if text is None:
                        n.append(None), crc.append(None), same.append(None)
                        continue
                    values = ids.values.to_numpy() if ids.values is not None else np.zeros(0, np.int32)
                    n.append(len(values)), crc.append(zlib.crc32(values.astype("<u4").tobytes()))
                    same.append(codec.decode(values.tolist()) == text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "lossless"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
