"""SentencePiece encoding by n-best search, and decoding.

The lattice of a text is a chain of segments that no piece crosses. In each segment a forward
Viterbi pass gives the best score of every prefix; these scores are the exact heuristic of an A*
search that walks back from the end, so complete paths leave its agenda best first. The texts'
n best segmentations combine those of their segments, again best first, by the loss against the
best. Only segments whose second path may be among a text's next ones are searched by A*; of the
others the forward pass alone tells the best path and what the second loses. Segments repeat, so
each worker keeps the results of a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from heapq import heappop, heappush
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pathfold.llm.batches import add_columns, lists, spread, unused
from pathfold.llm.pieces import Pieces, Segments, load

CACHE = 400_000
BLOCK_BYTES = 1 << 20
KEPT_USES = 3
RECENT = 1 << 12
LONGEST = 64
IDS_PER_ROW = 8
NEAR = 1e-9
UNKNOWN_PENALTY = 10.0


def n_best(text: str, pieces: Pieces, n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best segmentations of one marked segment: (score, ids), best first.

    A character without a piece is an arc of the lowest score less a penalty, spelt in byte pieces.
    An agenda entry takes an arc and stands for the worse arcs into the same position, so a step
    pushes two entries at most. Among equal scores the search goes
    on where it is, so that ties of a long text do not make it wide.
    """
    get, ids, size, absent = pieces.begins.get, pieces.ids, len(text), ()
    lowest = pieces.lowest - UNKNOWN_PENALTY
    if not size:
        return [(0.0, [])]
    # Arcs into each position: (cost of the best path that ends in the arc, start). Sorted when
    # the pass gets there, they give the position's best score.
    arcs: list[list[tuple[float, int]]] = [[] for _ in range(size + 1)]
    arcs[0].append((0.0, -1))
    best = [0.0] * (size + 1)
    for i in range(size):
        into = arcs[i]
        into.sort()
        best[i] = here = into[0][0]
        if text[i] not in ids:  # spelt in bytes
            arcs[i + 1].append((here - lowest, i))
        for j in range(i + 1, size + 1):
            s = get(text[i:j], absent)
            if s is absent:
                break
            if s is not None:
                arcs[j].append((here - s, i))
    arcs[size].sort()
    # An agenda entry stands for one arc into ``at`` and for all arcs ranked after it; ``tail`` is
    # the cost of what follows.
    agenda = [(arcs[size][0][0], 0, size, 0, 0.0, None)]
    out, met = [], 0
    while agenda:
        _, _, at, rank, tail, path = heappop(agenda)
        into = arcs[at]
        cost, i = into[rank]
        rank += 1
        if rank < len(into):
            met -= 1
            heappush(agenda, (into[rank][0] + tail, met, at, rank, tail, path))
        tail += cost - best[i]
        if i:
            met -= 1
            heappush(agenda, (arcs[i][0][0] + tail, met, i, 0, tail, (i, at, path)))
            continue
        found, path = [], (0, at, path)
        while path is not None:
            i, j, path = path
            known = ids.get(text[i:j])
            if known is None:
                found.extend(pieces.byte_ids[b] for b in text[i:j].encode())
            else:
                found.append(known)
        out.append((-tail, found))
        if len(out) == n:
            break
    return out


def best_path(text: str, pieces: Pieces) -> tuple[float, list[int], float]:
    """(score, ids, loss of the second) of a segment's best path, by the forward pass alone.

    Another path leaves the best one, from its end, at some position by an arc that is not the best
    into it; the least that such an arc loses is what the second path loses, up to rounding.
    """
    get, ids, size, absent = pieces.begins.get, pieces.ids, len(text), ()
    lowest = pieces.lowest - UNKNOWN_PENALTY
    best, second, back = [inf] * (size + 1), [inf] * (size + 1), [0] * (size + 1)
    best[0] = 0.0
    for i in range(size):
        here = best[i]
        if text[i] not in ids:  # spelt in bytes
            cost, j = here - lowest, i + 1
            if cost < best[j]:
                best[j], second[j], back[j] = cost, best[j], i
            elif cost < second[j]:
                second[j] = cost
        for j in range(i + 1, size + 1):
            s = get(text[i:j], absent)
            if s is absent:
                break
            if s is not None:
                cost = here - s
                if cost < best[j]:
                    best[j], second[j], back[j] = cost, best[j], i
                elif cost < second[j]:
                    second[j] = cost
    tail, loss, at, found = 0.0, inf, size, []
    while at:
        i = back[at]
        loss = min(loss, second[at] - best[at])
        tail += best[at] - best[i]
        known = ids.get(text[i:at])
        if known is None:
            found.extend(pieces.byte_ids[b] for b in reversed(text[i:at].encode()))
        else:
            found.append(known)
        at = i
    found.reverse()
    return -tail, found, loss


class SegmentTable(dict):
    """Segment -> row of growing arrays: ids of the best path, its score, losses of the next ones.

    The losses are those of the forward pass until a text needs them all. When the table is full, in
    rows or ids, only segments of up to ``LONGEST`` characters seen ``KEPT_USES`` times or more stay.
    """

    def __init__(self, pieces: Pieces, n: int, cache: int = CACHE):
        super().__init__()
        self.pieces, self.n, self.cache = pieces, n, cache
        self.fresh: list[tuple[list[int], float, list[float]]] = []
        self.rows = 0
        self.ids = np.empty(0, np.int32)
        self.start = self.count = self.uses = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.loss = np.empty((0, n - 1))
        self.searched = np.empty(0, bool)
        self.recent: dict[str, list[tuple[float, list[int]]]] = {}
        self.here: dict[str, list[tuple[float, list[int]]]] = {}

    def __missing__(self, segment: str) -> int:
        score, ids, loss = best_path(segment, self.pieces)
        losses = [loss] + [inf] * (self.n - 2)
        if loss < NEAR:  # equal paths are in the order of the search
            (score, ids), losses = self.search(segment)
        self.fresh.append((ids, score, losses, loss < NEAR))
        self[segment] = row = self.rows
        self.rows += 1
        return row

    def search(self, segment: str) -> tuple[tuple[float, list[int]], list[float]]:
        """The best path and the losses of the next ones, by A*; kept for the block."""
        found = self.here[segment] = n_best(segment, self.pieces, self.n)
        losses = [found[0][0] - s for s, _ in found[1:]]
        return found[0], losses + [inf] * (self.n - 1 - len(losses))

    def complete(self, segment: Callable[[int], str], rows: np.ndarray) -> None:
        """Search the segments of a text that may be among the n-1 with the smallest losses."""
        first = self.loss[rows, 0]
        bound = np.partition(first, self.n - 2)[self.n - 2] if len(first) > self.n - 1 else inf
        for k in np.flatnonzero((first <= bound + NEAR) & ~self.searched[rows] & np.isfinite(first)).tolist():
            row = rows[k]
            if not self.searched[row]:
                self.loss[row] = self.search(segment(k))[1]
                self.searched[row] = True

    def settle(self) -> None:
        """Move the new segments to the arrays."""
        if not self.fresh:
            return
        counts = np.array([len(f[0]) for f in self.fresh], np.int64)
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(counts) - counts])
        self.ids = np.concatenate([self.ids, np.array([i for f in self.fresh for i in f[0]], np.int32)])
        self.count = np.concatenate([self.count, counts])
        self.uses = np.concatenate([self.uses, np.zeros(len(counts), np.int64)])
        self.score = np.concatenate([self.score, np.array([f[1] for f in self.fresh])])
        self.loss = np.concatenate([self.loss, np.array([f[2] for f in self.fresh]).reshape(len(counts), self.n - 1)])
        self.searched = np.concatenate([self.searched, np.array([f[3] for f in self.fresh])])
        self.fresh = []

    def shrink(self) -> None:
        self.here.clear()
        if self.rows <= self.cache and len(self.ids) <= IDS_PER_ROW * self.cache:
            return
        short = np.zeros(self.rows, bool)
        short[[r for s, r in self.items() if len(s) <= LONGEST]] = True
        stay = np.flatnonzero(short & (self.uses >= KEPT_USES))[: self.cache // 2]
        number = np.full(self.rows, -1, np.int64)
        number[stay] = np.arange(len(stay))
        kept = {s: int(number[r]) for s, r in self.items() if number[r] >= 0}
        self.clear()
        self.update(kept)
        self.ids = self.ids[spread(self.start[stay], self.count[stay])]
        self.count = self.count[stay]
        self.start = np.cumsum(self.count) - self.count
        self.uses, self.score, self.loss, self.rows = self.uses[stay] // 2, self.score[stay], self.loss[stay], len(stay)
        self.searched = self.searched[stay]

    def path(self, segment: str, rank: int) -> list[int]:
        """The ids of a segment's path of this rank; few are asked for, so they are searched anew."""
        found = self.here.get(segment) or self.recent.get(segment)
        if found is None:
            found = n_best(segment, self.pieces, self.n)
            if len(self.recent) >= RECENT:
                self.recent.clear()
            (self.recent if len(segment) <= LONGEST else self.here)[segment] = found
        return found[rank][1]


@lru_cache(maxsize=1)
def segment_table(model_path: str, n: int, cache: int) -> SegmentTable:
    """The worker's table: it outlives the task."""
    return SegmentTable(load(model_path), n, cache)


def combine(rows: np.ndarray, table: SegmentTable) -> list[tuple[float, list[tuple[int, int]]]]:
    """The n best choices over a text's segments: (loss, [(segment, rank), ...]), best first.

    A choice among the n best changes only segments whose smallest loss is among the n-1 smallest.
    """
    n = table.n
    first = table.loss[rows, 0]
    if len(first) > n - 1:
        bound = np.partition(first, n - 2)[n - 2]
        near = np.concatenate([np.flatnonzero(first < bound), np.flatnonzero(first == bound)])[: n - 1]
    else:
        near = np.arange(len(first))
    near = near[np.isfinite(first[near])]
    near.sort()
    losses = table.loss[rows[near]].tolist()
    places = near.tolist()
    heap, out = [(0.0, (), 0)], []
    while heap and len(out) < n:
        loss, choice, start = heappop(heap)
        out.append((loss, [(places[k], r) for k, r in choice]))
        if choice:  # the last change takes its next rank
            k, r = choice[-1]
            if r < n - 1 and np.isfinite(losses[k][r]):
                heappush(heap, (loss - losses[k][r - 1] + losses[k][r], (*choice[:-1], (k, r + 1)), start))
        for k in range(start, len(places)):
            heappush(heap, (loss + losses[k][0], (*choice, (k, 1)), k + 1))
    return out


EDIT = pa.struct([("at", pa.int32()), ("n_old", pa.int32()), ("ids", pa.list_(pa.int32()))])
NEXT = pa.list_(pa.struct([("score", pa.float64()), ("n_pieces", pa.int32()), ("edits", pa.list_(EDIT))]))
ENCODED = (
    "ids array<int>, n_pieces int, score double, "
    "next_best array<struct<score: double, n_pieces: int, edits: array<struct<at: int, n_old: int, ids: array<int>>>>>"
)


def encode(
    docs: DataFrame,
    model_path: str,
    n: int = 4,
    text: str = "text",
    keep: list[str] | None = None,
    decoded: bool = False,
    cache: int = CACHE,
) -> DataFrame:
    """Add ``ids``, ``n_pieces``, ``score`` of the best segmentation and ``next_best``.

    With ``decoded``, also the text that the ids spell, as :func:`decode` gives it, in the same pass.
    ``cache`` bounds the segments a worker keeps, about 400 bytes each; it changes no result.

    The score of a segmentation is the sum of its pieces' scores. ``next_best`` holds the second
    to n-th best; each gives its score, its number of pieces and, against ``ids``, its edits:
    ``n_old`` ids from position ``at`` (0-based) are replaced by the edit's ids. A text with fewer
    segmentations has fewer entries. Null and empty texts have no ids, score 0 and no next ones.
    Equal texts have equal results. Input columns with the added names are replaced.
    """
    if n < 2:
        raise ValueError("n must be 2 or more")

    def make():
        pieces = load(model_path)
        table = segment_table(model_path, n, cache)

        def compute(texts):
            table.shrink()
            cut = Segments(texts, pieces)
            row_of = np.array([table[x] for x in cut.distinct], np.int64)
            table.settle()
            every = row_of[cut.index] if len(row_of) else np.empty(0, np.int64)
            np.add.at(table.uses, every, 1)
            counts = table.count[every]
            ids = table.ids[spread(table.start[every], counts)]
            at = np.concatenate([[0], np.cumsum(counts)])
            first, last = cut.first[:-1], cut.first[1:]
            totals = at[last] - at[first]
            scores = [float(table.score[every[a:b]].sum()) for a, b in zip(first.tolist(), last.tolist())]
            after = []
            for d, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
                entries = []
                if b > a:
                    table.complete(lambda k: cut.distinct[cut.index[a + k]], every[a:b])
                for loss, choice in combine(every[a:b], table)[1:] if b > a else ():
                    edits = [(int(at[a + k] - at[a]), int(counts[a + k]), table.path(cut.distinct[cut.index[a + k]], rank)) for k, rank in choice]
                    entries.append(
                        {
                            "score": scores[d] - loss,
                            "n_pieces": int(totals[d]) + sum(len(new) - old for _, old, new in edits),
                            "edits": [{"at": x, "n_old": old, "ids": new} for x, old, new in edits],
                        }
                    )
                after.append(entries)
            listed = lists(ids, totals, pa.int32())
            out = [listed, pa.array(totals, pa.int32()), pa.array(scores, pa.float64()), pa.array(after, NEXT)]
            return [*out, decode_block(listed, pieces)] if decoded else out

        return compute

    return add_columns(docs, make, ENCODED + (", decoded string" if decoded else ""), [text], keep, BLOCK_BYTES)


def apply_edits(ids: list[int], edits: list) -> list[int]:
    """The ids of one entry of ``next_best``."""
    out = list(ids)
    for edit in sorted(edits, key=lambda e: -e["at"]):
        out[edit["at"] : edit["at"] + edit["n_old"]] = edit["ids"]
    return out


def decode_ids(ids: list[int], raw: list[bytes]) -> str:
    """The text of piece ids: the leading space goes, bytes that are no UTF-8 become U+FFFD."""
    return b"".join([raw[i] for i in ids]).removeprefix(b" ").decode("utf-8", "replace")


def decode_block(ids: pa.ListArray, pieces: Pieces) -> pa.Array:
    """The texts of lists of ids, gathered from one buffer of all pieces' bytes."""
    flat = ids.flatten().to_numpy().astype(np.int64)
    counts = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy().astype(np.int64)
    start, size = pieces.raw_start[flat], pieces.raw_size[flat]
    text = pieces.raw_bytes[spread(start, size)]
    borders = np.concatenate([[0], np.cumsum(size)])
    offsets = borders[np.concatenate([[0], np.cumsum(counts)])]
    head = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep = np.ones(len(text) + 1, bool)
    keep[head[text[head] == 32]] = False
    offsets = offsets - np.concatenate([[0], np.cumsum(~keep)])[offsets]
    text = text[keep[:-1]]
    data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text)])
    try:
        out = data.cast(pa.string())
    except pa.ArrowInvalid:
        out = pa.array([x.decode("utf-8", "replace") for x in data.to_pylist()], pa.string())
    return pa.compute.if_else(ids.is_valid(), out, pa.scalar(None, pa.string())) if ids.null_count else out


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded``: the text that the ids spell.

    Control pieces spell nothing. Null ids give a null text, no ids the empty text. A literal
    space mark (U+2581) in the encoded text comes back as a space, as in the library.
    """
    kept = [c for c in (encoded.columns if keep is None else keep) if c.lower() != "decoded"]
    out = StructType([encoded.schema[c] for c in kept] + [StructField("decoded", StringType())])
    source = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").alias(unused(kept, "__ids")[0]))
    names = out.names

    def run(batches):
        pieces = load(model_path)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], decode_block(part.column(len(names) - 1), pieces)], names=names)

    return source.mapInArrow(run, out)
