"""Arrow batches of texts as numpy arrays: words, word hashes, n-gram hashes.

All functions see whole texts. A batch is cut into blocks of about ``BLOCK_BYTES`` at document
borders, so the working arrays stay small whatever the batch size; a single longer text makes a
block of its own and its bytes are hashed in segments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK_BYTES = 1 << 21
SEGMENT = 1 << 16
U = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240229))
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
LOWER_CODES = CODES.copy()
LOWER_CODES[65:91] = CODES[97:123]
BASE = 0x9E3779B97F4A7C13  # odd and 3 mod 8
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = _powers(BASE, SEGMENT)
INVERSE = pow(BASE, -1, 1 << 64)
INVERSES = _powers(INVERSE, SEGMENT)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(symbols: np.ndarray, codes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of symbols: a polynomial of their codes, then mixed with the length.

    ``codes`` is a table of random codes by symbol, or a function that gives them.
 Prefix sums are made a segment at a time and read at the borders of spans only.
    """
    at_start = np.empty(len(starts), np.uint64)
    at_end = np.empty(len(starts), np.uint64)
    base, scale = U(0), U(1)
    turn = U(pow(BASE, SEGMENT, 1 << 64))
    with np.errstate(over="ignore"):
        for s in range(0, len(symbols), SEGMENT):
            seg = symbols[s : s + SEGMENT]
            local = np.empty(len(seg) + 1, np.uint64)
            local[0] = 0
            np.cumsum((codes(seg) if callable(codes) else codes[seg]) * POWERS[: len(seg)], out=local[1:])
            lo, hi = np.searchsorted(starts, (s, s + len(seg)))
            at_start[lo:hi] = base + scale * local[starts[lo:hi] - s]
            lo, hi = np.searchsorted(ends, (s + 1, s + len(seg) + 1))
            at_end[lo:hi] = base + scale * local[ends[lo:hi] - s]
            base, scale = base + scale * local[-1], scale * turn
        back = INVERSES[starts % SEGMENT]
        rounds = starts // SEGMENT
        if len(rounds) and rounds[-1]:
            back = back * _powers(pow(INVERSE, SEGMENT, 1 << 64), int(rounds[-1]) + 1)[rounds]
        return mix((at_end - at_start) * back + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions start[i], start[i]+1, ..., ``count[i]`` of them, for each i, one after the other."""
    first = np.cumsum(count) - count
    return np.repeat(start - first, count) + np.arange(int(count.sum()))


class Texts:
    """A block of texts: one byte buffer, document offsets, word spans and hashes."""

    def __init__(self, texts: pa.Array):
        if not pa.types.is_string(texts.type):
            texts = texts.cast(pa.string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
        self.bytes = raw[at[0] : at[-1]]
        self.offsets = at - at[0]
        self.n = n

    def spans(self) -> None:
        """Word borders (byte offsets) and ``first``: the index of each document's first word."""
        b = self.bytes
        word = IS_WORD[b] if len(b) else np.empty(0, bool)
        edge = np.zeros(len(b) + 1, dtype=bool)
        if len(b):
            edge[1:-1] = word[1:] != word[:-1]
            edge[self.offsets] = True
            left = edge[:-1] & word
            right = edge[1:] & word
            self.starts = np.flatnonzero(left)
            self.ends = np.flatnonzero(right) + 1
        else:
            self.starts = self.ends = np.empty(0, np.int64)
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())

    def word_hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial of random byte codes, then mixed."""
        return span_hashes(self.bytes, LOWER_CODES if lower else CODES, self.starts, self.ends)

    def ngrams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows and their document.

        A document of fewer words has its whole sequence as its one n-gram; without words it has none.
        """
        counts = self.counts()
        doc = self.doc_of_words()
        total = len(words)
        with np.errstate(over="ignore"):
            gram = np.zeros(total, np.uint64)
            for j in range(n):
                gram[: total - j] += mix(words[j:] + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if total > j else U(0)
            left = self.first[1:][doc] - np.arange(total)  # words from here to the document's end
            full = left >= n
            short = np.flatnonzero((counts > 0) & (counts < n))
            out, owner = mix(gram[full]), doc[full]
            if len(short):
                whole = np.array([self._whole(words[self.first[d] : self.first[d + 1]]) for d in short], dtype=np.uint64)
                out, owner = np.concatenate([out, whole]), np.concatenate([owner, short])
        return out, owner

    @staticmethod
    def _whole(words: np.ndarray) -> int:
        acc = 0
        for j, w in enumerate(words.tolist()):
            acc = (acc * 0x100000001B3 + w + j + 1) & (1 << 64) - 1
        return int(mix(np.array([acc], np.uint64))[0])

    def text(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def distinct_in_docs(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs, sorted by document, then hash."""
    order = np.argsort(hashes)
    hashes, doc = hashes[order], doc[order]
    order = np.argsort(doc.astype(np.uint16 if len(doc) == 0 or doc.max() < 65536 else np.int64), kind="stable")
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], doc[new]


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one text."""
    n = len(texts)
    if not n:
        return
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < n:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        stop = min(stop, start + 60_000)
        yield start, stop
        start = stop


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened where the columns have them (Spark does not tell case apart)."""
    taken = {c.lower() for c in columns}
    tail = ""
    while any((n + tail).lower() in taken for n in names):
        tail += "_"
    return [n + tail for n in names]


def ddl(schema: str | StructType) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> None:
    """Texts are long, so at most ``BATCH_ROWS`` of them go to a Python worker at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, BATCH_ROWS)


def add_columns(
    df: DataFrame,
    make: Callable[[], Callable[..., list[pa.Array]]],
    added: str,
    inputs: list[Column | str],
    keep: list[str] | None = None,
    limit: int = BLOCK_BYTES,
) -> DataFrame:
    """``keep`` columns (all by default) and the ``added`` ones that ``make()`` computes per block.

    ``inputs`` go to the function, the first being the text that sizes the blocks. A kept column
    with the name of an added one is replaced.
    """
    small_batches(df)
    new = ddl(added)
    added_names = {c.lower() for c in new.names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added_names]
    schema = StructType([df.schema[c] for c in kept] + new.fields)
    names = schema.names
    width = len(kept)
    given = [F.col(f"`{c}`") if isinstance(c, str) else c for c in inputs]
    inner = unused(kept, *[f"__in{i}" for i in range(len(given))])
    source = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(x) for x, c in zip(inner, given)])
    columns = range(width, width + len(given))

    def run(batches):
        compute = make()
        for batch in batches:
            for a, b in blocks(batch.column(width), limit):
                part = batch.slice(a, b - a)
                out = compute(*[part.column(i) for i in columns])
                yield pa.RecordBatch.from_arrays([*part.columns[:width], *out], names=names)

    return source.mapInArrow(run, schema)


def expand(
    df: DataFrame, make: Callable[[], Callable[..., dict[str, pa.Array] | None]], schema: str, inputs: list[Column | str]
) -> DataFrame:
    """Any number of rows from each block of texts."""
    small_batches(df)
    out_schema = ddl(schema)
    names = out_schema.names
    given = [F.col(f"`{c}`") if isinstance(c, str) else c for c in inputs]
    source = df.select(*[c.alias(f"__in{i}") for i, c in enumerate(given)])

    def run(batches):
        compute = make()
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                part = batch.slice(a, b - a)
                out = compute(*part.columns)
                if out is not None:
                    yield pa.RecordBatch.from_arrays([out[n] for n in names], names=names)

    return source.mapInArrow(run, out_schema)
