"""Short codes of vectors: four codebook indexes each, fitted and assigned in whole numbers.

Parts and codebook entries, padded with zeros to a power of two W, go through the integer
Walsh-Hadamard transform. The squared differences of two transforms add up to W times the squared
distance, so their sums over the first coefficients, in sequency order, are lower bounds of it: an
entry whose sum passes the whole distance of another one is out. All numbers are integers, of 64
bits where a block's values allow it, else Python's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathfold.llm.batches import unused

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
STEP = 4
BLOCK_ROWS = 1024
WIDEST = 10.0**27  # larger components count as this; sums of them fit a decimal(38)
LONGEST = (1 << 63) - 1

Codebooks = list[list[list[int]]]


def sequency(width: int) -> np.ndarray:
    """Rows of the transform by their number of sign changes: bit-reversed Gray codes."""
    bits = width.bit_length() - 1
    at = np.arange(width)
    gray = at ^ (at >> 1)
    return sum((((gray >> b) & 1) << (bits - 1 - b) for b in range(bits)), np.zeros(width, np.int64))


def walsh(rows: np.ndarray) -> np.ndarray:
    """The integer Walsh-Hadamard transform of zero-padded rows, coefficients in sequency order."""
    n, w = rows.shape
    width = 1 << max(0, w - 1).bit_length()
    out = np.zeros((n, width), rows.dtype)
    out[:, :w] = rows
    half = 1
    while half < width:
        pairs = out.reshape(n, width // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        half *= 2
    return out.reshape(n, width)[:, sequency(width)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index, squared distance) of each part's nearest entry, the lower index on ties.

    Also the number of squared differences that elimination saved.
    """
    a, b = walsh(parts), walsh(entries)
    n, width = a.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, parts.dtype), 0

    def whole(candidate: np.ndarray) -> np.ndarray:
        gap = a - b[candidate]
        return (gap * gap).sum(axis=1)

    sums = np.zeros((n, len(b)), a.dtype)
    for c in range(min(STEP, width)):
        gap = a[:, c, None] - b[None, :, c]
        sums += gap * gap
    bound = whole(sums.argmin(axis=1))
    row, entry = np.nonzero(sums <= bound[:, None])
    left = sums[row, entry]
    saved = 0
    for start in range(STEP, width, STEP):
        saved += (n * len(b) - len(row)) * min(STEP, width - start)
        gap = a[row, start : start + STEP] - b[entry, start : start + STEP]
        left = left + (gap * gap).sum(axis=1)
        at = np.flatnonzero(np.diff(row, prepend=-1))  # every row keeps one entry or more
        least = np.minimum.reduceat(left, at)
        hit = np.flatnonzero(left == least[row])
        bound = np.minimum(bound, whole(entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]]))
        stay = left <= bound[row]
        row, entry, left = row[stay], entry[stay], left[stay]
    # What is left has the least distance; entries of a row are in ascending order.
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return entry[first], left[first] // width, saved


def scaled(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x), as 64-bit numbers or Python's."""
    x = np.floor(np.clip(values.astype(np.float64), -WIDEST, WIDEST) * SCALE)
    x = np.clip(x, -WIDEST, WIDEST)
    if not x.size or np.abs(x).max() < 2.0**40:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def fitting(parts: np.ndarray, entries: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit numbers if no scaled distance of the padded width can pass them."""
    if parts.dtype == np.int64:
        reach = max((abs(v) for e in entries for v in e), default=0) + (int(np.abs(parts).max()) if parts.size else 0)
        wide = 1 << max(0, width - 1).bit_length()
        if reach * reach * wide * max(1, width) < 1 << 62:
            return parts, np.array(entries, np.int64).reshape(len(entries), width)
    return parts.astype(object), np.array(entries, object).reshape(len(entries), width)


def cut(batch: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of vectors (first row, integers (n, PARTS, width)), short ones filled with zeros."""
    for start in range(0, len(batch), BLOCK_ROWS):
        block = batch.slice(start, BLOCK_ROWS)
        sizes = block.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = block.flatten().to_numpy(zero_copy_only=False)
        out = np.zeros((len(block), PARTS * width))
        out[np.arange(PARTS * width) < sizes[:, None]] = flat
        yield start, scaled(out).reshape(len(block), PARTS, width)


def finite(vector: Column | str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    inside = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return F.coalesce(inside, F.lit(False))


def _sums(vectors: DataFrame, vector: str, books: Codebooks, width: int) -> DataFrame:
    """(part, entry, n, sums): a row for each entry that a task's vectors are nearest to."""
    entries = len(books[0])

    def run(batches):
        n = np.zeros((PARTS, entries), np.int64)
        total = np.zeros((PARTS, entries, width), object)
        for batch in batches:
            for _, block in cut(batch.column(0), width):
                for p in range(PARTS):
                    parts, book = fitting(block[:, p], books[p], width)
                    index, _, _ = nearest(parts, book)
                    n[p] += np.bincount(index, minlength=entries)
                    here = np.zeros((entries, width), parts.dtype)
                    np.add.at(here, index, parts)
                    total[p] += here.astype(object)
        part, entry = np.nonzero(n)
        if len(part):
            rows = [[Decimal(int(v)) for v in total[p, e]] for p, e in zip(part, entry)]
            kinds = pa.list_(pa.decimal128(38, 0))
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry], pa.int64()), pa.array(rows, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    return vectors.select(vector).mapInArrow(run, "part int, entry int, n long, sums array<decimal(38,0)>")


def fit_codebooks(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[Codebooks, int]:
    """(codebooks, width of a part) of the finite vectors.

    The first codebooks are the parts of the ``ENTRIES`` vectors with the smallest ids (null last,
    ties by the vector). In each of ``ROUNDS`` rounds every part goes to its nearest entry, and
    each entry becomes the componentwise floor of its parts' mean; one without parts stays. Tasks
    return sums, which Spark adds up; the driver holds the codebooks alone, ``ENTRIES`` vectors.
    Fewer vectors make smaller codebooks, none makes empty ones.
    """
    kept = vectors.select(vec_id, vector).filter(finite(vector))
    width = -(-(kept.agg(F.max(F.size(vector))).first()[0] or 0) // PARTS)
    seeds = kept.orderBy(F.col(vec_id).asc_nulls_last(), vector).limit(ENTRIES).collect()
    books: Codebooks = [[] for _ in range(PARTS)]
    for _, block in cut(pa.array([r[1] for r in seeds], pa.list_(pa.float64())), width):
        for p in range(PARTS):
            books[p] += [[int(v) for v in row] for row in block[:, p]]
    for _ in range(ROUNDS if seeds and width else 0):
        sums = _sums(kept, vector, books, width).select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
        total = sums.groupBy("part", "entry", "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
        means = {(r.part, r.entry, r.place): int(r.value) // r.n for r in total.collect()}  # as large as the codebooks
        books = [[[means.get((p, e, i), v) for i, v in enumerate(old)] for e, old in enumerate(book)] for p, book in enumerate(books)]
    return books, width


def encode_vectors(
    vectors: DataFrame, books: Codebooks, width: int, vector: str = "embedding", keep: list[str] | None = None
) -> DataFrame:
    """``keep`` columns (all by default) of the finite vectors with their ``code`` and ``error``.

    ``code`` holds the indexes of the nearest entries, two hex digits for each part; ``error`` is
    the sum of their squared distances (at most that of a long). Vectors that are null, or hold
    null or non-finite components, drop out. A vector shorter than others counts as filled with
    zeros, an empty one too; if no vector has a component, all have code 00000000 and error 0.
    Components beyond 10 ** 27 / 1024 count as that. Repeated rows come out as often as they come
    in, an empty table gives an empty one, and columns named code or error are replaced.
    """
    kept = [c for c in (vectors.columns if keep is None else keep) if c.lower() not in ("code", "error")]
    schema = StructType([vectors.schema[c] for c in kept]).add("code", "string").add("error", "long")
    names = schema.names
    (inner,) = unused(kept, "__vector")
    source = vectors.filter(finite(f"`{vector}`")).select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vector}`").alias(inner))

    def run(batches):
        for batch in batches:
            for start, block in cut(batch.column(len(kept)), width):
                index = np.zeros((len(block), PARTS), np.int64)
                error = np.zeros(len(block), object)
                for p in range(PARTS):
                    parts, book = fitting(block[:, p], books[p], width)
                    index[:, p], far, _ = nearest(parts, book)
                    error += far.astype(object)
                codes = ["%02x" * PARTS % tuple(row) for row in index.tolist()]
                added = [pa.array(codes, pa.string()), pa.array([min(int(e), LONGEST) for e in error], pa.int64())]
                same = batch.slice(start, len(block)).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*same, *added], names=names)

    return source.mapInArrow(run, schema)


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """The coded rows with ``label_error``, the error summed over equal labels (nulls together).

    Sums are made before the rows meet them, so a label of many rows is one row of the other side.
    """
    own, total = unused(coded.columns, "__label", "__total")
    sums = coded.groupBy(F.col(f"`{label}`").alias(own)).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias(total))
    joined = coded.join(sums, F.col(f"`{label}`").eqNullSafe(F.col(own)))
    return joined.withColumn("label_error", F.least(total, F.lit(LONGEST)).cast("long")).drop(own, total)


def codebooks_sha256(books: Codebooks) -> str:
    """Digest of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
