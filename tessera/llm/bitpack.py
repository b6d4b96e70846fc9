"""Token ids in fixed-width bit-packed files with block offsets.

A file image holds consecutive documents.  Every id takes the minimum bits for
the vocabulary (16 for 50,257 ids).  Ids are packed in blocks of ``BLOCK`` ids,
each starting on a byte boundary and found through a table of block offsets; a
table of document offsets gives random access to any document.  Packing and
unpacking are whole-array numpy operations.

Layout, little-endian:
    magic ``TBP2`` | bits u32 | block u32 | documents u64 | ids u64 | nameless u64
    doc_id      i64 x documents
    doc offsets u64 x (documents + 1), in ids from the start of the file
    block offsets u64 x (blocks + 1), in bytes from the start of the payload
    payload

Images are stored as rows of a Parquet table (``first_doc``, ``content``, ...),
so any store that Spark reaches can hold them; ``content`` alone is a complete
file.

Rows: a null or empty text has the end id alone; rows without doc_id come first
(the first ``nameless`` documents of an image, whose doc_id entries are 0) and
are read back with a null id; rows of one doc_id stand side by side, ordered by a
hash of their text, so that offsets are the same in every run; an empty table
gives empty files.  Other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, lean, small_batches
from .wordhash import blocks, mix, span_hashes

MAGIC = b"TBP2"
BLOCK = 4096
#: Ids of one file image; a longer document has an image of its own.
IMAGE_IDS = 1 << 20
#: Documents, and bytes of texts, in one partition of the sort, on average.
PART_ROWS = 1 << 15
PART_BYTES = 1 << 27
#: Bytes of texts that are encoded together.
TEXT_BYTES = 1 << 21
_HEAD = struct.Struct("<4sIIQQQ")


# The format ---------------------------------------------------------------


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first, each id in ``bits`` bits; padded to whole bytes."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.frombuffer(data, np.uint8)
    raw = np.concatenate((raw, np.zeros(8, np.uint8)))
    at = np.arange(n, dtype=np.int64) * bits
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= raw[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def write_image(doc_ids, lengths, ids: np.ndarray, bits: int) -> bytes:
    offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.uint64))).astype("<u8")
    parts = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    blocks = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.uint64))).astype("<u8")
    nameless = sum(x is None for x in doc_ids)
    head = _HEAD.pack(MAGIC, bits, BLOCK, len(doc_ids), len(ids), nameless)
    names = np.array([0] * nameless + list(doc_ids[nameless:]), "<i8")
    return b"".join([head, names.tobytes(), offsets.tobytes(), blocks.tobytes(), *parts])


class Image:
    """A file image; documents and ranges are unpacked on demand."""

    def __init__(self, content):
        magic, self.bits, self.block, n, self.n_ids, self.nameless = _HEAD.unpack_from(content, 0)
        if magic != MAGIC:
            raise ValueError("not a packed token file")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(content, "<i8", n, at)
        self.offsets = np.frombuffer(content, "<u8", n + 1, at := at + 8 * n).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block)
        self.blocks = np.frombuffer(content, "<u8", n_blocks + 1, at := at + 8 * (n + 1)).astype(np.int64)
        self.payload = memoryview(content)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; only the blocks that hold them are read."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack(self.payload[self.blocks[b] : self.blocks[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.offsets[i]), int(self.offsets[i + 1]))


# Encoding -----------------------------------------------------------------


@lru_cache(4)
def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from public_tokenizers import path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


@lru_cache(4)
def _model(name: str):
    """The tokenizer's model alone."""
    from tokenizers import Tokenizer

    return Tokenizer(_tokenizer(name).model)


@lru_cache(1)
def _alphabet() -> dict[int, str]:
    """The byte alphabet: printable Latin-1 bytes stand for themselves, the others for characters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Never part of a contraction and never joined with a letter or digit before it.
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?*#$%&|<>()")] = True
LINE, SPACE = 0, 1
#: ASCII letters, and digits; first bytes of letters of two bytes: Latin, Cyrillic.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PAIR = np.zeros(256, bool)
_PAIR[[0xC3, 0xC4, 0xC5, 0xD0, 0xD1]] = True


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether two bytes are a letter; not all letters of two bytes are found."""
    return _PAIR[first] & ((first != 0xC3) | ((second != 0x97) & (second != 0xB7)))  # the signs of product and quotient


def _lettered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each span is not empty and holds letters only; not all spans of letters are found."""
    fine = _LETTER[data]
    pair = np.flatnonzero(_pairs(data[:-1], data[1:]))
    fine[pair] = fine[pair + 1] = True
    other = np.concatenate(([0], np.cumsum(~fine, dtype=np.int32)))
    return (ends > starts) & (other[starts] == other[ends])


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all members of runs, one run after another."""
    total = np.cumsum(sizes)
    return np.repeat(starts - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


class Encoder:
    """Ids of whole texts as the tokenizers library gives them, with a memory of words.

    A byte-level vocabulary never joins a word with what precedes the single
    space or line break before it, nor a word with marks behind it.  So a text
    whose words are parted by single spaces or line breaks is the sequence of
    the ids of its words and of the marks behind them.  Both are found, hashed
    and looked up as arrays; new ones go to the library together and are then
    remembered, about ``most`` of them, as runs of one array of ids.  A text of
    any other form goes to the library whole.
    """

    def __init__(self, name: str, most: int = 2_000_000):
        self.tokenizer, self.model, self.most = _tokenizer(name), _model(name), most
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        alphabet = _alphabet()
        self.codes = np.array([ord(alphabet[b]) for b in range(256)], "<u4")
        #: Ids that start with a space, and that of the line break.
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.leads[[self.line, *(i for w, i in self.tokenizer.get_vocab().items() if w.startswith(alphabet[32]))]] = True
        self.forget()

    def forget(self) -> None:
        """keys, slots: an open table of hashes (0: free place) and their words' numbers; a word's run in pool ends where the next one's starts (empty: no plain word)."""
        self.keys, self.slots = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.int32)
        self.starts, self.pool, self.known = np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers; -1: unknown."""
        last = np.uint64(len(self.keys) - 1)
        at = (hashes & last).astype(np.int64)
        keys = self.keys[at]
        out = np.where(keys == hashes, self.slots[at], -1)
        left = np.flatnonzero((keys != hashes) & (keys != 0))
        at = at[left]
        while len(left):
            at = (at + 1) & int(last)
            keys = self.keys[at]
            hit = keys == hashes[left]
            out[left[hit]] = self.slots[at[hit]]
            on = ~hit & (keys != 0)
            left, at = left[on], at[on]
        return out

    def _enter(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        last = np.uint64(len(self.keys) - 1)
        at = (hashes & last).astype(np.int64)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]  # of those that meet at one place, one stays
            on = self.keys[at] != hashes
            self.slots[at[~on]] = slots[~on]
            hashes, slots, at = hashes[on], slots[on], (at[on] + 1) & int(last)

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember new words whose runs stand one after another in ids."""
        n, m = self.known, self.known + len(hashes)
        used = int(self.starts[n])
        while len(self.starts) <= m:
            self.starts = np.resize(self.starts, 2 * len(self.starts))
        while len(self.pool) < used + len(ids):
            self.pool = np.resize(self.pool, 2 * len(self.pool))
        self.pool[used : used + len(ids)] = ids
        self.starts[n + 1 : m + 1] = used + np.cumsum(lengths)
        self.known = m
        if 2 * m > len(self.keys):
            full = np.flatnonzero(self.keys)
            keys, slots, size = self.keys[full], self.slots[full], len(self.keys)
            while 2 * m > size:
                size *= 2
            self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._enter(keys, slots)
        self._enter(hashes, np.arange(n, m))

    @staticmethod
    def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.maximum(mix(span_hashes(data, starts, ends) + kind.astype(np.uint64), 7), np.uint64(1))

    def _letters(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their numbers, of words of letters only.

        The library's pre-tokenizer takes such a word whole, with a space before
        it, so its model gets it directly, in the byte alphabet; the space, or
        the line break as a word of its own, then shows where each word's ids start.
        """
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(starts), 20_000):
            a, n, k = starts[i : i + 20_000], sizes[i : i + 20_000], kind[i : i + 20_000]
            lead = np.where(k == SPACE, 2, 3)
            ends = np.cumsum(lead + n)
            text = np.full(ends[-1], 32, "<u4")
            text[ends - n - lead + 1] = self.codes[np.where(k == SPACE, 32, 10)]
            text[_places(ends - n, n)] = self.codes[raw[_places(a, n)]]
            (e,) = self.model.encode_batch_fast([text[1:].tobytes().decode("utf-32-le").split(" ")], is_pretokenized=True, add_special_tokens=False)
            got = np.array(e.ids, np.uint32)
            first = np.flatnonzero(self.leads[got])
            if len(first) == len(a):
                ids.append(got), lengths.append(np.diff(np.append(first, len(got))))
            else:
                each = [self.whole((" " if s else "\n") + raw[x : x + y].tobytes().decode()) for x, y, s in zip(a.tolist(), n.tolist(), k.tolist())]
                ids.append(np.concatenate(each)), lengths.append(np.array([len(x) for x in each]))
        return np.concatenate(ids), np.concatenate(lengths)

    def _lines(self, words: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their numbers, of any words, given with what they follow; one a line for the library."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            # After a space a word's line break is behind it, else in front.
            (e,) = self.tokenizer.encode_batch_fast(["".join([f" {w}\n" if k else f"\n{w}\n" for w, k in part])], add_special_tokens=False)
            got, lead = np.array(e.ids, np.uint32), np.array([1 - k for _, k in part])
            ends = np.flatnonzero(got == self.line)
            if len(ends) == len(part) + lead.sum():
                last = ends[np.cumsum(1 + lead) - 1]
                n = np.diff(np.append(-1, last)) - 1
                keep = np.ones(len(got), bool)
                keep[last] = False
                got = got[keep]
            else:
                each = [self.whole((" " if k else "\n") + w) for w, k in part]
                got, n = np.concatenate(each), np.array([len(x) for x in each])
            ids.append(got), lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> None:
        """Remember new words that follow a space or a line break (whose id is then part of their run)."""
        sizes = ends - starts
        raw = data[_places(starts, sizes)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        letters = _lettered(raw, starts, ends)
        other, words, bad = [], [], []
        for n in np.flatnonzero(~letters).tolist():
            w = raw[starts[n] : ends[n]].tobytes().decode()
            if w.isalpha():
                letters[n] = True
            elif w[0].isspace() or w[-1].isspace():
                bad.append(n)
            else:
                other.append(n), words.append((w, int(kind[n])))
        self._keep(hashes[letters], *self._letters(raw, starts[letters], sizes[letters], kind[letters]))
        self._keep(hashes[other], *self._lines(words))
        self._keep(hashes[bad], np.zeros(0, np.uint32), np.zeros(len(bad), np.int64))

    def _parts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the marks behind each word start; its end, if it has none or they may not stand alone."""
        at = ends.copy()
        left = np.flatnonzero(_MARK[data[at - 1]])
        marked = left
        while len(left):
            at[left] -= 1
            left = left[at[left] > starts[left]]
            left = left[_MARK[data[at[left] - 1]]]
        # Marks stand alone only behind a letter or digit; other characters join them, white space parts the word.
        a = at[marked]
        last = data[a - 1]
        apart = (a > starts[marked]) & (_LETTER[last] | _DIGIT[last] | ((last >= 0x80) & _pairs(data[a - 2], last)))
        at[marked[~apart]] = ends[marked[~apart]]
        raw = data.tobytes() if self.special else b""
        for x in self.special:
            k = raw.find(x)
            while k >= 0:
                n = max(0, int(np.searchsorted(starts, k, "right")) - 1)
                at[n] = ends[n]
                k = raw.find(x, k + 1)
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        import pandas as pd

        out: list[np.ndarray] = []
        for i, j, data, offs in blocks(texts, TEXT_BYTES):
            if self.known > self.most:
                self.forget()
            rows = [np.zeros(0, np.uint32)] * (j - i)
            cut = np.flatnonzero((data == 32) | (data == 10))
            counts = np.diff(np.searchsorted(cut, offs))
            owner = np.repeat(np.arange(j - i), counts)
            # Texts with a space or line break at an end, or two side by side.
            odd = np.zeros(j - i, bool)
            odd[owner[(cut == offs[owner]) | (cut == offs[owner + 1] - 1)]] = True
            odd[owner[1:][np.diff(cut) == 1]] = True
            plain = ~odd & (offs[1:] > offs[:-1])
            cut, at, counts = cut[plain[owner]], np.flatnonzero(plain), counts[plain]
            if len(at):
                # A text counts as following a line break, whose id is then taken off.
                firsts = np.cumsum(counts + 1) - counts - 1
                later = np.ones(len(cut) + len(at), bool)
                later[firsts] = False
                starts, kind = np.empty(len(later), np.int64), np.full(len(later), LINE, np.int8)
                starts[firsts], starts[later], kind[later] = offs[at], cut + 1, data[cut] == 32
                ends = np.append(starts[1:] - 1, 0)
                ends[firsts + counts] = offs[at + 1]
                # Marks apart from their word count as following a line break, too.
                marks = self._parts(data, starts, ends)
                apart = np.flatnonzero(marks < ends)
                place = np.arange(len(starts)) + np.cumsum(marks < ends) - (marks < ends)
                behind, firsts = place[apart] + 1, place[firsts]
                units = np.zeros((2, len(starts) + len(apart)), np.int64)
                units[0, place], units[1, place], units[0, behind], units[1, behind] = starts, marks, marks[apart], ends[apart]
                (starts, ends), kinds = units, np.full(units.shape[1], LINE, np.int8)
                kinds[place] = kind
                hashes = self.hashes(data, starts, ends, kinds)
                slot = self._find(hashes)
                new = np.flatnonzero(slot < 0)
                if len(new):
                    codes, unique = pd.factorize(hashes[new])
                    one = np.zeros(len(unique), np.int64)
                    one[codes[::-1]] = new[::-1]
                    self.learn(unique, data, starts[one], ends[one], kinds[one])
                    slot[new] = self._find(unique)[codes]
                first = self.starts[slot]
                length = self.starts[slot + 1] - first
                odd[at[np.searchsorted(firsts, np.flatnonzero(length == 0), "right") - 1]] = True
                for x in (firsts, behind):
                    first[x] += 1
                    length[x] = np.maximum(length[x] - 1, 0)
                ids = self.pool[_places(first, length)]
                bounds = np.append(0, np.cumsum(length))[np.append(firsts, len(length))].tolist()
                for n, a, b in zip(at.tolist(), bounds[:-1], bounds[1:]):
                    rows[n] = ids[a:b]
            for n in np.flatnonzero(odd).tolist():
                rows[n] = self.whole(data[offs[n] : offs[n + 1]].tobytes().decode())
            out += rows
        return out


_encoders: dict[str, Encoder] = {}


def write_packed(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", vocabulary: int = 50_257, end: int = 0, bits: int | None = None) -> None:
    """Encode every whole text (null: empty), append ``end``, and write images in ascending doc_id order.

    Columns: part, image, before (ids of the part's earlier images), n_ids, content.
    """
    bits = bits or max(1, (vocabulary - 1).bit_length())

    def run(batches):
        enc = _encoders.setdefault(tokenizer, Encoder(tokenizer))
        part, image, before = -1, 0, 0
        ids, keys, size = [], [], 0

        def flush():
            every = np.concatenate(ids)
            return pa.RecordBatch.from_pylist([{"part": part, "image": image, "before": before, "n_ids": len(every), "content": write_image(keys, [len(x) for x in ids], every, bits)}], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2)[0].as_py()
            for key, one in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                one = np.append(one, np.uint32(end))
                if ids and size + len(one) > IMAGE_IDS:
                    yield flush()
                    image, before = image + 1, before + size
                    ids, keys, size = [], [], 0
                ids.append(one), keys.append(key)
                size += len(one)
        if ids:
            yield flush()

    schema = pa.schema([("part", pa.int32()), ("image", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("content", pa.binary())])
    spark = docs.sparkSession
    small_batches(spark)
    # Partitions grow with the documents and their texts; rows of one doc_id, or of none, are split by a hash of the text.
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // PART_ROWS, size // PART_BYTES)
    order = F.asc_nulls_first("doc_id"), F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(lean(run), "part int, image int, before long, n_ids long, content binary").write.mode("overwrite").option("compression", "lz4_raw").parquet(path)


def read_packed(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files.

    start: ids of all documents before it.  Only the number of ids of each part
    (one row per written partition) is summed up outside the files.
    """

    def run(batches):
        for b in batches:
            for content, before in zip(b.column(0), b.column(1).to_pylist()):
                image = Image(content.as_buffer())
                every = image.ids(0, image.n_ids).astype("<u4")
                data = memoryview(every.tobytes())
                at = image.offsets
                crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
                names = pa.array(image.doc_ids, mask=np.arange(len(image.doc_ids)) < image.nameless)
                yield pa.RecordBatch.from_arrays([names, pa.array(at[:-1] + before), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path)
    sums, total = {}, 0
    for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").toLocalIterator():
        sums[r.part] = total
        total += r.n
    starts = spark.createDataFrame(sorted(sums.items()), "part int, offset long")
    return files.join(F.broadcast(starts) if len(sums) <= 100_000 else starts, "part").select("content", (F.col("before") + F.col("offset")).alias("before")).mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **kw) -> DataFrame:
    """Write the files to the shared folder and read every document back from them."""
    s = Scratch(docs.sparkSession, "packed")
    write_packed(docs, s.path("files"), **kw)
    return read_packed(docs.sparkSession, s.path("files"))
