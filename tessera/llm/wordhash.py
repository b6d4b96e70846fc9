"""Vectorised hashing of the words of many texts at once, straight from Arrow buffers.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  All words of a block of
texts are hashed with prefix sums of a polynomial over random byte values
modulo 2**64, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts looked at together; also of the spans hashed at once and of the powers kept.
BLOCK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, 256, np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser, applied elementwise."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) >= n:
        return _powers["up"], _powers["down"]
    made = {}
    for k, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
        p = np.full(max(n, BLOCK_BYTES + 1) if n <= 2 * BLOCK_BYTES else n, base, np.uint64)
        p[0] = 1
        made[k] = np.multiply.accumulate(p)
    if n <= 2 * BLOCK_BYTES:  # longer spans are rare; their powers are not kept
        _powers.update(made)
    return made["up"], made["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last+1, bytes, offsets) of runs of texts of about ``size`` bytes; a longer text is a run of its own."""
    data, offs = buffers(texts)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    new = np.zeros(len(data) + 1, bool)
    new[offs] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | new[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | new[1:-1]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, wherever it lies; spans come in order."""
    if len(data) <= 2 * BLOCK_BYTES:
        return _span_hashes(data, starts, ends)
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):  # a long text goes slice by slice
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, "right")))
        low = starts[i]
        out[i:j] = _span_hashes(data[low : ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(words: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one text, and the index of each text's first run.

    A text with fewer words, but some, has its whole sequence as its one run.
    """
    counts = np.diff(firsts)
    n = len(words)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - firsts[owner] if n else np.zeros(0, np.int64)
    whole = place + k <= counts[owner] if n else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(3) + words[at + j], j)
    runs = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        own = np.array([int(_chain(words[firsts[i] : firsts[i + 1]], k)) for i in short], np.uint64)
        before = np.concatenate(([0], np.cumsum(runs)))[short]
        h = np.insert(h, before, own)
        runs[short] = 1
    return h, np.concatenate(([0], np.cumsum(runs)))


def _chain(words: np.ndarray, k: int) -> np.uint64:
    h = np.zeros(1, np.uint64)
    for j, w in enumerate(words):
        h = mix(h * np.uint64(3) + w, j + 1000 * k)
    return h[0]
