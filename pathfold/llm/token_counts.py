"""Token counts by byte-pair merging on a heap of pairs over a linked list of symbols.

No merge crosses the border of two segments, so a text's count is the sum of theirs, and
the count of a segment is its initial symbols less its merges. No identifiers are made. Segments
repeat, so each worker keeps the counts of up to twice ``CACHE`` of them.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame

from pathfold.llm.batches import add_columns
from pathfold.llm.pieces import Pieces, Segments, load

CACHE = 1 << 19


def merge_count(text: str, pieces: Pieces) -> int:
    """Tokens of one marked segment.

    A symbol with a piece is one token, another one its UTF-8 bytes. The adjacent pair whose joined
    piece has the best score, leftmost first, is merged until none is left.
    """
    scores = pieces.scores
    n = len(text)
    cost = [1 if c in scores else len(c.encode()) for c in text]
    total = sum(cost)
    if n == 1:
        return total
    symbols = list(text)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = text[i : i + 2]
        if pair in scores:
            heap.append((-scores[pair], i, i + 1, 2))
    heapify(heap)
    while heap:
        _, left, right, size = heappop(heap)
        if symbols[left] is None or symbols[right] is None or after[left] != right:
            continue
        joined = symbols[left] + symbols[right]
        if len(joined) != size:  # one side has grown since
            continue
        total -= cost[left] + cost[right] - 1
        cost[left] = 1
        symbols[left], symbols[right] = joined, None
        nxt = after[left] = after[right]
        if nxt < n:
            before[nxt] = left
            pair = joined + symbols[nxt]
            if pair in scores:
                heappush(heap, (-scores[pair], left, nxt, len(pair)))
        prev = before[left]
        if prev >= 0:
            pair = symbols[prev] + joined
            if pair in scores:
                heappush(heap, (-scores[pair], prev, left, len(pair)))
    return total


class SegmentCounts(dict):
    """Counts by segment in two generations: when the younger is full, it becomes the older."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.older: dict[str, int] = {}

    def __missing__(self, segment: str) -> int:
        out = self.older.get(segment)
        if out is None:
            out = merge_count(segment, self.pieces)
        if len(segment) <= 64:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[segment] = out
        return out


@lru_cache(maxsize=1)
def segment_counts(model_path: str) -> SegmentCounts:
    """The worker's counts: they outlive the task."""
    return SegmentCounts(load(model_path))


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` (long) and ``over_limit`` (n_tokens > limit).

    The count is that of the library's plain encoding: no begin, end or other special tokens, and
    strings of special tokens in a text are ordinary text. Null and empty texts have no bytes and
    no tokens. Whole texts are counted, whatever their length; repeated rows are counted each.
    Input columns with the added names are replaced, others are kept (or those named in ``keep``).
    """

    def make():
        pieces = load(model_path)
        counts = segment_counts(model_path)

        def compute(texts):
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            cut = Segments(texts, pieces)
            each = np.array([counts[s] for s in cut.distinct], np.int64)
            below = np.concatenate([[0], np.cumsum(each[cut.index])])
            tokens = below[cut.first[1:]] - below[cut.first[:-1]]
            return [sizes, pa.array(tokens), pa.array(tokens > limit)]

        return compute

    return add_columns(docs, make, "n_bytes long, n_tokens long, over_limit boolean", [text], keep)
