"""Line deduplication by probing a sharded minimal perfect hash.

1. Every document yields its distinct line keys as 128-bit hashes with the line positions.
2. Keys are counted (documents, largest document id) with map-side combining, and each shard of
   the key space gets an index: a minimal perfect hash over its distinct keys, addressing compact
   arrays of 32-bit fingerprints, saturating counts and last document ids.
3. Documents send their hashes, not their lines, to the shards and probe the arrays there.
   Keys that hold more than one in ``HOT`` of all entries, hence at most ``HOT`` keys, are answered
   from a broadcast part of the index, so a shard never meets a hot key.
4. The positions to drop go back to the documents.

The number of shards follows the number of entries; a shard's index and probes stay near
``SHARD_ENTRIES`` rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathfold.llm.batches import Texts, expand, lists, unused
from pathfold.session import cut_lineage

HOT = 2000
SHARD_ENTRIES = 250_000
BLANK = b" \t\n\x0b\x0c\r"
LAST_LEVEL = 48


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys: one bit array a level, ranked.

    A key sits at the first level where no other remaining key shares its bit; its index is the
    rank of that bit over all levels. Keys still colliding after the last level are kept sorted.
    """

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks, total = [], 0
        for bits in levels:
            below = np.zeros(len(bits) + 1, np.int64)
            np.cumsum(np.bitwise_count(bits), out=below[1:])
            self.ranks.append(below[:-1] + total)
            total += int(below[-1])
        self.size = total + len(rest)

    @staticmethod
    def slot(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
        return ((x >> np.uint64(33)) % np.uint64(bits)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.unique(keys)
        while len(left) and len(levels) < LAST_LEVEL:
            words = (2 * len(left) + 63) // 64
            at = cls.slot(left, len(levels), words * 64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels, np.sort(left))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; a key that was not built in gets any index, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self.slot(keys[open_], level, len(bits) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            below = np.bitwise_count(bits[w] & ((np.uint64(1) << b) - np.uint64(1)))
            out[open_[hit]] = self.ranks[level][w] + below
            open_ = open_[~hit]
        if len(self.rest) and len(open_):
            at = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            found = self.rest[at] == keys[open_]
            out[open_[found]] = self.size - len(self.rest) + at[found]
        return out

    def dump(self) -> tuple[list[int], bytes, bytes]:
        return [len(x) for x in self.levels], b"".join(x.tobytes() for x in self.levels), self.rest.tobytes()

    @classmethod
    def load(cls, sizes: list[int], bits: bytes, rest: bytes) -> PerfectHash:
        flat, at, levels = np.frombuffer(bits, np.uint64), 0, []
        for n in sizes:
            levels.append(flat[at : at + n])
            at += n
        return cls(levels, np.frombuffer(rest, np.uint64))


def line_entries(docs: DataFrame, min_chars: int) -> DataFrame:
    """A row for each document and distinct key: doc_id, text_key, h1, h2, positions."""

    def make():
        def compute(texts, ids, keys):
            block = Texts(texts)
            digests, owner, counts, positions = [], [], [], []
            for d in range(block.n):
                seen: dict[bytes, list[int]] = {}
                for i, line in enumerate(block.text(d).split(b"\n")):
                    key = line.strip(BLANK).lower()  # of bytes: A-Z only
                    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                        continue
                    seen.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                digests.extend(seen)
                owner.extend([d] * len(seen))
                for found in seen.values():
                    counts.append(len(found))
                    positions.extend(found)
            if not digests:
                return None
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(owner, pa.int32())
            return {
                "doc_id": ids.take(at),
                "text_key": keys.take(at),
                "h1": pa.array(np.ascontiguousarray(both[:, 0])),
                "h2": pa.array(np.ascontiguousarray(both[:, 1])),
                "positions": lists(np.array(positions, np.int32), np.array(counts), pa.int32()),
            }

        return compute

    return expand(
        docs, make, "doc_id long, text_key long, h1 long, h2 long, positions array<int>", ["text", "doc_id", F.xxhash64("text")]
    )


INDEX = "shard int, sizes array<int>, bits binary, rest binary, prints binary, counts binary, last binary"


def build_index(stats: DataFrame) -> DataFrame:
    """One row a shard from (shard, h1, h2, n, last_doc): the perfect hash and its arrays."""

    def build(table: pa.Table) -> pa.Table:
        h1 = table["h1"].to_numpy().view(np.uint64)
        h2 = table["h2"].to_numpy().view(np.uint64)
        keys = h1 ^ (h2 << np.uint64(1) | h2 >> np.uint64(63))
        hashed = PerfectHash.build(keys)
        at = hashed.index(keys)
        prints = np.zeros(hashed.size, np.uint32)
        counts = np.zeros(hashed.size, np.uint8)
        last = np.zeros(hashed.size, np.int64)
        prints[at] = (h2 >> np.uint64(32)).astype(np.uint32)
        counts[at] = np.minimum(table["n"].to_numpy(), 255)
        last[at] = table["last_doc"].to_numpy()
        sizes, bits, rest = hashed.dump()
        row = [table["shard"][0].as_py()], [sizes], [bits], [rest], [prints.tobytes()], [counts.tobytes()], [last.tobytes()]
        return pa.table([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.list_(pa.int32()), *[pa.binary()] * 5))], names=["shard", "sizes", "bits", "rest", "prints", "counts", "last"])

    return stats.groupBy("shard").applyInArrow(build, INDEX)


def probe_index(entries: DataFrame, index: DataFrame, min_docs: int) -> DataFrame:
    """Entries (with a shard) whose key is in enough documents and which are not in the last one."""

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = ["doc_id", "text_key", "positions"]
        if not len(left) or not len(right):
            return left.select(wanted).slice(0, 0)
        row = {c: right[c][0].as_py() for c in ("sizes", "bits", "rest", "prints", "counts", "last")}
        hashed = PerfectHash.load(row["sizes"], row["bits"], row["rest"])
        h1 = left["h1"].to_numpy().view(np.uint64)
        h2 = left["h2"].to_numpy().view(np.uint64)
        at = hashed.index(h1 ^ (h2 << np.uint64(1) | h2 >> np.uint64(63)))
        known = at >= 0
        at = np.maximum(at, 0)
        known &= np.frombuffer(row["prints"], np.uint32)[at] == (h2 >> np.uint64(32)).astype(np.uint32)
        docs = left["doc_id"].fill_null(NO_ID).to_numpy()
        drop = known & (np.frombuffer(row["counts"], np.uint8)[at] >= min_docs) & (np.frombuffer(row["last"], np.int64)[at] != docs)
        return left.select(wanted).take(pa.array(np.flatnonzero(drop)))

    return (
        entries.groupBy("shard")
        .cogroup(index.groupBy("shard"))
        .applyInArrow(probe, "doc_id long, text_key long, positions array<int>")
    )


NO_ID = -(1 << 63)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with shortened ``text`` and added ``n_lines``, ``n_dropped``.

    Lines are split at \\n. A line's key is the line without blanks at its ends, A-Z lower-cased.
    Keys of ``min_chars`` code points or more that are in ``min_docs`` (at most 255) documents or
    more lose all their lines but those in the largest doc_id that holds them; the other lines
    stay, joined by \\n.

    Null text: one empty line, stays null. Empty text: one empty line. Each row is a document: rows
    repeated with one doc_id count each, and all of them keep their lines when that id is the
    largest. A null doc_id is smaller than all others. An empty table gives an empty table. Columns
    named n_lines or n_dropped are replaced, other extra columns stay.
    """
    if not 1 <= min_docs <= 255:
        raise ValueError("min_docs must be from 1 to 255")
    entries = cut_lineage(line_entries(docs, min_chars))
    total = entries.count()
    shards = max(16, -(-total // SHARD_ENTRIES))
    by_shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int")
    stats = cut_lineage(
        entries.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max(F.coalesce("doc_id", F.lit(NO_ID))).alias("last_doc"))
    )
    hot = F.broadcast(stats.filter(F.col("n") * HOT > total))  # at most HOT rows
    index = build_index(stats.withColumn("shard", by_shard))
    cold = entries.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").withColumn("shard", by_shard)
    dropped = probe_index(cold, index, min_docs).unionByName(
        entries.join(hot.filter(F.col("n") >= min_docs), ["h1", "h2"])
        .filter(F.coalesce("doc_id", F.lit(NO_ID)) != F.col("last_doc"))
        .select("doc_id", "text_key", "positions")
    )
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    own_id, own_key, drop = unused(kept, "__id", "__key", "__drop")
    drops = dropped.groupBy(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).agg(
        F.array_distinct(F.flatten(F.collect_list("positions"))).alias(drop)
    )
    joined = docs.select(*[F.col(f"`{c}`") for c in kept]).join(
        drops, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key)), "left"
    )
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    # The lines are bound to a lambda variable, so they are split once and picked in linear time.
    pick = F.transform(
        F.array(F.struct(lines.alias("lines"), F.col(drop).alias("drop"))),
        lambda s: F.concat_ws(
            "\n",
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(s["lines"]) - 1), s["drop"]), lambda i: s["lines"][i]),
        ),
    )[0]
    return joined.select(
        *[F.when(F.col(drop).isNull(), F.col("text")).otherwise(pick).alias("text") if c == "text" else F.col(f"`{c}`") for c in kept],
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias("n_dropped"),
    )
