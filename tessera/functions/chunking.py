"""Chunking: one text to several chunks.  Sizes are bytes of UTF-8 unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.workspace import give_back, small_batches

from .text import detect_strategy

MIN, MAX, SIMILARITY = 150, 1200, 0.75


def _size(s: str) -> int:
    return len(s.encode())


def _lines(text: str) -> list[str]:
    return [x.removesuffix("\r") for x in (text.removesuffix("\n")).split("\n")] if text else []


def sentences(text: str) -> list[str]:
    """Trimmed lines of texts with short lines; of prose, sentences of more than 20 bytes."""
    lines = _lines(text)
    if len(lines) > 3 and sum(map(_size, lines)) // len(lines) < 150:
        return [s for x in lines if (s := x.strip())]
    out, start, at = [], 0, 0
    for m in re.finditer(r"[.!?](?=[ \n])|\n(?=\n)", text):
        if m.start() < at or _size(text[start : m.end()].strip()) <= 20:
            continue
        out.append(text[start : m.end()].strip())
        start = at = m.end() + (m[0] == "\n")
    rest = text[start:].strip()
    return [*out, rest] if rest else out


def fixed(text: str, most: int = MAX) -> list[str]:
    """Pieces of up to ``most`` characters, cut at white space where there is some."""
    if _size(text) <= most:
        return [text]
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(at + most, n)
        if end < n:
            back = next((i for i in range(end, at, -1) if text[i].isspace()), end)
            end = back
        out.append(text[at:end].strip())
        at = end
        while at < n and text[at].isspace():
            at += 1
    return [x for x in out if x]


def merged(units: Iterable[str], least: int = MIN, most: int = MAX) -> list[str]:
    """Units joined by line breaks to chunks of at least ``least`` and, where that allows, at most ``most``."""
    out: list[str] = []
    held = ""
    for unit in units:
        joined = unit if not held else held + ("" if held.endswith("\n") else "\n") + unit
        if held and _size(joined) > most and _size(held) >= least:
            out.append(held)
            held = unit
        else:
            held = joined
        if _size(held) > most:
            out += fixed(held, most)
            held = ""
    if held.strip():
        if out and _size(out[-1]) + _size(held) + 1 <= most:
            out[-1] += "\n" + held
        else:
            out.append(held)
    return [x for x in out if _size(x.strip()) >= 10]


def _opens_entry(line: str) -> bool:
    letters = [c for c in line if c.isalpha()]
    numbered = line[0] in "0123456789" and (". " in line or ") " in line)
    return numbered or line.startswith(("##", "---", "===")) or len(letters) >= 4 and all(c.isupper() for c in letters)


def structural(text: str, least: int = MIN, most: int = MAX) -> list[str]:
    """Blocks that start at numbered, headed or upper-case lines, merged."""
    blocks, held = [], ""
    for line in map(str.strip, _lines(text)):
        if not line:
            held += "\n" if held else ""
            continue
        if _opens_entry(line) and _size(held.strip()) >= least:
            blocks.append(held.strip())
            held = ""
        held += ("\n" if held else "") + line
    return merged([*blocks, held.strip()] if held.strip() else blocks, least, most)


def by_sentence(text: str, least: int = MIN, most: int = MAX) -> list[str]:
    return merged(sentences(text), least, most)


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = min(len(a), len(b))
    size = float(np.sqrt(a @ a) * np.sqrt(b @ b))
    return float(a[:n] @ b[:n]) / size if size else 0.0


def semantic(text: str, embed, threshold: float = SIMILARITY, least: int = MIN, most: int = MAX) -> list[str]:
    """Sentences grouped while neighbours' vectors are alike; groups gathered up to ``least``, long ones cut every ``most`` characters."""
    units = sentences(text)
    if len(units) <= 2 or _size(text) < 2 * least:
        return [text]
    vectors = [np.asarray(embed(u), np.float32) for u in units]
    groups = [[units[0]]]
    for u, a, b in zip(units[1:], vectors, vectors[1:]):
        if cosine(a, b) < threshold:
            groups.append([])
        groups[-1].append(u)
    out: list[str] = []
    held = ""
    for g in map(" ".join, groups):
        held = f"{held} {g}" if held else g
        if _size(held) >= least:
            out += [held[i : i + most] for i in range(0, len(held), most)] if _size(held) > most else [held]
            held = ""
    if held:
        if out and _size(out[-1]) + _size(held) <= most:
            out[-1] += " " + held
        else:
            out.append(held)
    return out or [text]


# Offline pipeline: headings, then percentile breaks, then a recursive splitter ---


def by_heading(markdown: str) -> list[tuple[str, tuple[str, str, str]]]:
    """(text, (chapter, subchapter, section)) between headings of the first three levels."""
    out, path, held = [], ["", "", ""], []

    def close():
        body = "\n".join(held).strip()
        if body:
            out.append((body, tuple(path)))
        held.clear()

    fenced = False
    for line in markdown.split("\n"):
        fenced ^= line.strip().startswith("```")
        m = None if fenced else re.fullmatch(r"(#{1,3}) +(.*\S)\s*", line.strip())
        if m:
            close()
            level = len(m[1]) - 1
            path[level:] = [m[2], *[""] * (2 - level)]
        else:
            held.append(line.strip())
    close()
    return out


def at_percentile(text: str, embed, percentile: float = 95.0) -> list[str]:
    """Sentences broken where the distance to the next is above this percentile of all distances."""
    units = [u for u in re.split(r"(?<=[.?!])\s+", text) if u]
    if len(units) < 2:
        return units or [text]
    near = [np.asarray(embed(" ".join(units[max(0, i - 1) : i + 2])), np.float32) for i in range(len(units))]
    far = [1 - cosine(a, b) for a, b in zip(near, near[1:])]
    limit = np.percentile(far, percentile)
    cuts = [i + 1 for i, d in enumerate(far) if d > limit]
    return [" ".join(units[a:b]) for a, b in zip([0, *cuts], [*cuts, len(units)])]


def recursive(text: str, size: int = 1500, overlap: int = 150, separators: Sequence[str] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of up to ``size`` characters, cut at the coarsest separator that does, each repeating up to ``overlap`` characters."""
    if len(text) <= size:
        return [text] if text.strip() else []
    at = next(i for i, s in enumerate(separators) if s in text)
    sep, finer = separators[at], separators[at + 1 :]
    parts = [x for x in (text.split(sep) if sep else list(text)) if x]
    out: list[str] = []
    held: list[str] = []
    for part in parts:
        if len(part) > size and finer:
            if held:
                out.append(sep.join(held))
                held = []
            out += recursive(part, size, overlap, finer)
            continue
        if held and len(sep.join([*held, part])) > size:
            out.append(sep.join(held))
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    if held:
        out.append(sep.join(held))
    return [x.strip() for x in out if x.strip()]


def offline(markdown: str, embed) -> list[tuple[str, tuple[str, str, str]]]:
    return [(piece, path) for body, path in by_heading(markdown) for chunk in at_percentile(body, embed) for piece in (recursive(chunk) if len(chunk) > 1500 else [chunk])]


def headed(embed=None):
    """A column function: an array of (chunk, path of three headings); without an embedder headed sections are cut by size alone."""

    @F.arrow_udf("array<struct<chunk: string, path: array<string>>>")
    def run(texts: pa.Array) -> pa.Array:
        def cut(t):
            if embed:
                return offline(t, embed)
            return [(piece, path) for body, path in by_heading(t) for piece in recursive(body)]

        kind = pa.list_(pa.struct([("chunk", pa.string()), ("path", pa.list_(pa.string()))]))
        return pa.array([None if t is None else [{"chunk": c, "path": list(p)} for c, p in cut(t)] for t in texts.to_pylist()], kind)

    return run


# DataFrames ---------------------------------------------------------------------

STRATEGIES = {"sentence": by_sentence, "structural": structural, "fixed": lambda text, least=MIN, most=MAX: fixed(text, most)}


def chunked(text: Column, strategy: str | Column = "auto", least: int = MIN, most: int = MAX, embed=None, threshold: float = SIMILARITY) -> Column:
    """An array of chunks.  ``auto`` decides per text; ``semantic`` needs an embedder's function."""
    if isinstance(strategy, str):
        strategy = detect_strategy(text) if strategy == "auto" else F.lit(strategy)

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array, names: pa.Array) -> pa.Array:
        def one(t, name):
            return semantic(t, embed, threshold, least, most) if name == "semantic" and embed else STRATEGIES.get(name, by_sentence)(t, least, most)

        out = pa.array([one(t.as_py(), n.as_py()) if t.is_valid else None for t, n in zip(texts, names)], pa.list_(pa.string()))
        give_back()
        return out

    return run(text, strategy)


def explode_chunks(docs: DataFrame, chunks: Column, min_chars: int = 0) -> DataFrame:
    """A row per chunk with chunk_index; chunks under ``min_chars`` characters go, and leave a gap in the index."""
    # Texts and their chunks stand side by side in a worker, so a batch holds few of them.
    small_batches(docs.sparkSession, 500, 8 << 20)
    out = docs.select("*", F.posexplode(chunks).alias("chunk_index", "chunk"))
    return out.where(F.char_length(F.trim("chunk")) >= min_chars) if min_chars else out


def semantic_segments(vectors: DataFrame, group: str, order: str, vector: str = "embedding", threshold: float = SIMILARITY) -> DataFrame:
    """Rows with ``segment``: a new one wherever neighbouring vectors are less alike than the threshold."""
    from pyspark.sql import Window

    from .vectors import cosine as alike

    w = Window.partitionBy(group).orderBy(order)
    near = F.round(alike(F.lag(vector).over(w), F.col(vector)), 6)
    return vectors.withColumn("_near", near).withColumn("segment", F.sum(F.when(F.col("_near") < threshold, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_near")
