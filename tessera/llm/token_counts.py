"""Exact token counts by byte-pair merging with a heap and a linked list.

The characters of a segment are a doubly linked list; a heap holds the adjacent
pairs that the vocabulary can merge.  The best pair (highest score, then
leftmost) is popped and merged until none is left.  The count is the initial
symbols less the merges; no identifiers are made.  A character that the
vocabulary lacks is as many symbols as it has UTF-8 bytes.

Counts of segments are remembered, up to a fixed number, since words recur.

Rows: null and empty texts have no tokens; repeated rows are counted alike; a
text of any length is counted whole; other columns are ignored.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import BAR, SEGMENTS, load
from .scratch import lean, small_batches

#: Remembered words of one Python worker.
MOST = 400_000


def merged_count(segment: str, score: dict[str, float]) -> int:
    """Tokens of one segment."""
    symbols = list(segment)
    n = len(symbols)
    count = sum(1 if c in score else len(c.encode()) for c in symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    for i in range(n - 1):
        pair = symbols[i] + symbols[i + 1]
        if pair in score:
            heap.append((-score[pair], i, i + 1, len(pair)))
    heapify(heap)
    while heap:
        _, i, j, size = heappop(heap)
        if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
            continue
        symbols[i] += symbols[j]
        symbols[j] = ""
        count -= 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            pair = symbols[i] + symbols[k]
            if pair in score:
                heappush(heap, (-score[pair], i, k, len(pair)))
        k = before[i]
        if k >= 0:
            pair = symbols[k] + symbols[i]
            if pair in score:
                heappush(heap, (-score[pair], k, i, len(pair)))
    return count


class Counter(dict):
    """Tokens of a word that stands after one space."""

    def __init__(self, model: str):
        super().__init__()
        self.score = load(model).score

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST:
            self.clear()
        n = self[word] = self.whole(BAR + word)
        return n

    def whole(self, escaped: str) -> int:
        return sum(merged_count(s, self.score) for s in SEGMENTS.findall(escaped))

    def text(self, text: str) -> int:
        if not text:
            return 0
        words = text.split(" ")
        if "" in words or BAR in text:  # runs of spaces: words are not apart
            return self.whole(BAR + text.replace(" ", BAR))
        return sum(map(self.__getitem__, words))


_counters: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""

    def run(batches):
        count = _counters.setdefault(model, Counter(model))
        for b in batches:
            sizes, counts = [], []
            for i in range(0, b.num_rows, 256):
                for t in b.column(1).slice(i, 256).to_pylist():
                    sizes.append(len((t or "").encode()))
                    counts.append(count.text(t or ""))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
