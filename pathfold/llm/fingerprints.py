"""Bottom-k sketches of word shingles: resemblance, containment and distinct counts.

A sketch holds the ``k`` smallest 48-bit hashes of a text's distinct shingles, packed in order and
written in base64. A text of at most ``k`` shingles has them all, and its estimates are exact.
Sketches of parts merge into that of the whole: the ``k`` smallest of their union.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm.batches import Texts, add_columns, blocks, distinct_in_docs

K = 128
WORDS = 5
TOP = float(1 << 48)


def sketch_block(texts: pa.Array, k: int = K, n: int = WORDS) -> list[np.ndarray]:
    """The sorted k smallest hashes of each text; A-Z count as a-z."""
    block = Texts(texts)
    block.spans()
    grams, doc = block.ngrams(block.word_hashes(lower=True), n)
    grams, doc = distinct_in_docs(grams >> np.uint64(16), doc)
    first = np.searchsorted(doc, np.arange(block.n + 1))
    return [grams[a : min(b, a + k)] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def pack(hashes: np.ndarray) -> str:
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return base64.b64encode(raw.tobytes()).decode()


def unpack(sketch: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(sketch), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity. Two texts without words are alike, one without is unlike any other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)
    if max(len(a), len(b)) >= k:
        both = both[:k]
    common = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(common, both[-1], side="right")) / len(both)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / TOP)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has; 1 for a text without any."""
    if not len(a):
        return 1.0
    if max(len(a), len(b)) < k:  # both are known whole
        return len(np.intersect1d(a, b, assume_unique=True)) / len(a)
    joint = np.union1d(a, b)[:k]
    return min(1.0, resemblance(a, b, k) * distinct(joint, k) / distinct(a, k))


def fingerprint(docs: DataFrame, k: int = K, n: int = WORDS, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``fingerprint``.

    Shingles are ``n`` consecutive words, A-Z lower-cased; a text of fewer words has its whole
    sequence as its one shingle. Null, empty and blank texts have the empty fingerprint. Equal
    texts have equal fingerprints. An input column named fingerprint is replaced.
    """

    def make():
        return lambda texts: [pa.array([pack(s) for s in sketch_block(texts, k, n)], pa.string())]

    return add_columns(docs, make, "fingerprint string", [text], keep)


def merge_fingerprints(parts: DataFrame, key: str, k: int = K, column: str = "fingerprint") -> DataFrame:
    """(key, fingerprint) of the union of each key's parts.

    Parts are merged within each input partition first, then within and at last across buckets of
    a key, so a key may have any number of parts. Null fingerprints count as empty; a null key is
    a key of its own.
    """
    schema = parts.select(F.col(f"`{key}`").alias("key")).schema.add("fingerprint", "string")

    def union(sketches: list[str | None]) -> str:
        some = [unpack(s) for s in sketches if s]
        return pack(np.unique(np.concatenate(some))[:k]) if some else ""

    def local(batches):
        held: dict = {}
        for batch in batches:
            groups: dict = {}
            for x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                groups.setdefault(x, []).append(s)
            for x, sketches in groups.items():
                held[x] = union([held.get(x), *sketches])
            if len(held) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.column(0).type), pa.array(list(held.values()))], names=["key", "fingerprint"])
                held = {}
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), batch.column(0).type), pa.array(list(held.values()))], names=["key", "fingerprint"])

    def group(table: pa.Table) -> pa.Table:
        return pa.table([table["key"].slice(0, 1), pa.array([union(table["fingerprint"].to_pylist())])], names=["key", "fingerprint"])

    first = parts.select(F.col(f"`{key}`").alias("key"), F.col(f"`{column}`").alias("fingerprint")).mapInArrow(local, schema)
    # A key has at most one row or so a task by now; 64 buckets bound what meets in one group.
    salted = first.withColumn("salt", F.pmod(F.xxhash64("fingerprint"), F.lit(64)))
    merged = salted.groupBy("key", "salt").applyInArrow(group, schema).groupBy("key").applyInArrow(group, schema)
    return merged.select(F.col("key").alias(key), "fingerprint")


def bounds(docs: DataFrame, parts: int) -> list[int]:
    """At most ``parts`` - 1 rising ids that cut the documents into ranges of about equal numbers."""
    if parts < 2:
        return []
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(cuts or []))


def range_of(column, cuts: list[int]):
    """Number of cuts not above the column: a look-up in two levels, not a scan of all cuts."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    at = F.size(F.filter(heads, lambda b: b <= column))
    rows = F.array(*[F.array(*[F.lit(c).cast("long") for c in g]) for g in groups])
    inside = F.size(F.filter(F.get(rows, at - 1), lambda b: b <= column))
    return F.when(column.isNull() | (at == 0), 0).otherwise((at - 1) * width + inside)


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_shingles_est double, in_edited double, in_next double"
)

NAMES = [field.split()[0] for field in EDITED.split(", ")]


def compare_with_next(docs: DataFrame, k: int = K, n: int = WORDS, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how near it is to both that and the next.

    In the edited text the last floor(n_chars / 2) code points give way to the first as many (or
    all) of the next document by doc_id; the first follows the last. Texts move once, to the range
    of ids of their document; a range's first document goes to the range before it as well.
    Beside resemblance (near_edited, near_next) come the estimated number of distinct shingles and
    the estimated share of them that the edited and the next text have (in_edited, in_next).

    Null texts count as empty. Rows with one doc_id follow each other by text; a null doc_id comes
    first. The only document of a table is its own next. Extra columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = bounds(docs.select("doc_id"), parts)
    at = range_of(F.col("doc_id"), cuts)
    lowest = docs.select("doc_id").groupBy(at.alias("part")).agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("empty")).collect()  # a row a range
    order = sorted(((r["part"], None if r["empty"] else r["low"]) for r in lowest), key=lambda x: x[0])
    # By range: its first id, and the range before it, which gets the first document as its tail.
    lows = {part: low for part, low in order}
    previous = {part: order[i - 1][0] for i, (part, _) in enumerate(order)}
    low = F.array(*[F.lit(lows.get(i)).cast("long") for i in range(len(cuts) + 1)])
    prior = F.array(*[F.lit(previous.get(i)).cast("int") for i in range(len(cuts) + 1)])
    extra = F.when(F.col("doc_id").eqNullSafe(F.get(low, at)), F.get(prior, at))
    copies = F.filter(
        F.array(F.struct(at.cast("int").alias("part"), F.lit(0).alias("tail")), F.struct(extra.alias("part"), F.lit(1).alias("tail"))),
        lambda s: s["part"].isNotNull(),
    )
    placed = rows.select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.part", "at.tail")
    sorted_rows = placed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), "text")

    def digest(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
        edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, after)]
        own = sketch_block(pa.array(texts, pa.string()), k, n)
        cut = sketch_block(pa.array(edited, pa.string()), k, n)
        following = [*own[1:], *sketch_block(pa.array(after[-1:], pa.string()), k, n)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([pack(s) for s in own]),
                pa.array([pack(s) for s in cut]),
                pa.array([resemblance(a, b, k) for a, b in zip(own, cut)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, following)], pa.float64()),
                pa.array([distinct(a, k) for a in own], pa.float64()),
                pa.array([containment(a, b, k) for a, b in zip(own, cut)], pa.float64()),
                pa.array([containment(a, b, k) for a, b in zip(own, following)], pa.float64()),
            ],
            names=NAMES,
        )

    def run(batches):
        held = None  # the last document, waiting for the next; tails end a range
        for batch in batches:
            tails = batch.column(3).to_pylist()
            for a, b in blocks(batch.column(1)):
                ids = batch.column(0).slice(a, b - a).to_pylist()
                texts = batch.column(1).slice(a, b - a).to_pylist()
                real = tails[a:b].count(0)
                if held is not None:
                    ids, texts, real = [held[0], *ids], [held[1], *texts], real + 1
                held = None
                if real < len(texts):  # the first tail follows the last document of the range
                    if real:
                        yield digest(ids[:real], texts[:real], texts[1 : real + 1])
                else:
                    held = ids[-1], texts[-1]
                    if real > 1:
                        yield digest(ids[:-1], texts[:-1], texts[1:])
        if held is not None:
            raise AssertionError("a range without the document after it")

    return sorted_rows.mapInArrow(run, EDITED)
