"""Near duplicates by HyperMinHash sketches: banded registers, corrected estimates, then full sets.

*Registers.* Hash functions deal a set's n-grams to buckets; a bucket's register is its least hash
value, kept as the count of its leading zeros and the ``MANTISSA`` bits after the first one. A set of
size n uses the largest power of two of buckets, up to 2 ** ``TOP``, that leaves 8 n-grams or more
to a bucket, and as many hash functions as make ``REGISTERS`` in all. Sets of two such classes cannot
be compared, so a set whose partners may be of the class below has registers for that one, too.

*Candidates.* ``ROWS`` registers are a band, and sets that agree in a band may link. Of a band's sets
the densest (whose bands hold most sets) meets all others first: sets in one group of copies so
become connected by a star. Bands with one head are one group, and only sets that those links left
apart meet the others of their group afterwards, in tiles that return the links they find.

*Estimates.* Equal registers of different values are expected at a rate that follows from the sizes;
the share of equal registers less that rate estimates the Jaccard similarity. Pairs estimated
``MARGIN`` below the bound drop out; all others are confirmed on their full sets.

Two sets of similarity 0.8 share no band with probability (1 - 0.8 ** 5) ** 48 = 5e-9, and are
estimated below 0.64 with about 2e-9; pairs of 0.85 with less than 1e-12. Nothing is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfold.llm.batches import blocks, mix
from pathfold.llm.graph import components
from pathfold.llm.ngram_join import gram_sets, set_ids
from pathfold.session import stored

BANDS = 48
ROWS = 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
VALUE_BITS = 52
PER_BUCKET = 8
EMPTY = np.uint16(0xFFFF)
MARGIN = 0.16
TOP = 4
SHARE = 256
HEAD_SHARE = 512
TILE_GRAMS = 1 << 20
SLAB = 2048
U = np.uint64


def size_class(size: np.ndarray) -> np.ndarray:
    """log2 of the buckets of sets of these sizes."""
    _, exponent = np.frexp(np.maximum(size, 1) // PER_BUCKET)
    return np.clip(exponent - 1, 0, TOP)


def least_partner(size: np.ndarray, percent: int) -> np.ndarray:
    """The size of the smallest set that a set of this size can link with."""
    return -(-percent * np.asarray(size, np.int64) // 100)


def compress(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa bits of 52-bit values, which a double holds exactly."""
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.where(least == 0, VALUE_BITS, VALUE_BITS - exponent)
    bits = np.where(least == 0, 0, (fraction - 0.5) * (2 << MANTISSA))
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | bits.astype(np.uint16)


def registers(grams: np.ndarray, doc: np.ndarray, n: int, cls: int) -> np.ndarray:
    """The registers (n, REGISTERS) of sets in one class; register h * buckets + b is bucket b of hash h."""
    buckets = 1 << cls
    hashes = REGISTERS // buckets
    none = U((1 << 64) - 1)
    out = np.empty((n, hashes, buckets), np.uint16)
    base = doc * buckets
    with np.errstate(over="ignore"):
        for h in range(hashes):
            value = mix(grams ^ mix(np.array([h * 0x9E3779B97F4A7C15 + cls + 1 & (1 << 64) - 1], np.uint64)))
            least = np.full(n * buckets, none)
            np.minimum.at(least, base + (value & U(buckets - 1)).astype(np.int64), value >> U(64 - VALUE_BITS))
            out[:, h] = np.where(least == none, EMPTY, compress(np.where(least == none, U(1), least))).reshape(n, buckets)
    return out.reshape(n, REGISTERS)


def band_keys(regs: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, class) of each band; register i is in band i modulo BANDS. Empty bands have none."""
    bands = regs.reshape(len(regs), ROWS, BANDS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = mix(cls.astype(np.uint64)[:, None] * U(BANDS) + np.arange(BANDS, dtype=np.uint64)[None, :] + U(1))
        for i in range(ROWS):
            key = mix(key ^ (bands[:, i] + U(1)) * U(0x9FB21C651E98DF25))
    row, band = np.nonzero((bands != U(int(EMPTY))).any(axis=1))
    return key[row, band], row, cls[row]


def collision_rate(a: np.ndarray, b: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """How often registers of different values are equal, for sets of sizes a and b.

    A bucket's least value is about exponential with the rate of its n-grams; both values lie in one
    cell, of the width that zeros and mantissa leave, with the integral of one density times
    the other times that width.
    """
    x, y = a / 2.0**cls, b / 2.0**cls
    total = np.zeros(np.broadcast(x, y).shape)
    for zeros in range(VALUE_BITS - MANTISSA):
        high, low = 2.0**-zeros, 2.0 ** -(zeros + 1)
        total += low / (1 << MANTISSA) * (np.exp(-(x + y) * low) - np.exp(-(x + y) * high))
    return total * x * y / (x + y)


def estimate(equal: np.ndarray, a: np.ndarray, b: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that a share of equal registers tells."""
    chance = np.minimum(collision_rate(a, b, cls), 0.5)
    return (equal - chance) / (1 - chance)


def sketches(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, node, size, regs, low) of every row; copies within a task have no registers.

    ``node`` numbers the set, ``regs`` are its registers, ``low`` those in the class below if a
    partner may be of that class.
    """
    names = ["doc_id", "node", "size", "regs", "low"]

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for start, stop in blocks(batch.column(0)):
                texts, ids = batch.slice(start, stop - start).columns
                grams, doc, first = gram_sets(texts, n)
                size = np.diff(first)
                node = set_ids(grams, doc, stop - start).view(np.int64)
                fresh = np.zeros(len(size), bool)
                for i, x in enumerate(node.tolist()):
                    if size[i] and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                own = size_class(size)
                below = size_class(least_partner(size, percent))
                made: list[list[bytes | None]] = []
                for cls, wanted in ((own, fresh), (below, fresh & (below < own))):
                    found: list[bytes | None] = [None] * len(size)
                    for c in np.unique(cls[wanted]).tolist():
                        pick = np.flatnonzero(wanted & (cls == c))
                        number = np.full(len(size), -1)
                        number[pick] = np.arange(len(pick))
                        use = number[doc] >= 0
                        regs = registers(grams[use], number[doc[use]], len(pick), c)
                        for i, row in zip(pick.tolist(), regs):
                            found[i] = row.tobytes()
                    made.append(found)
                columns = [ids, pa.array(node), pa.array(size, pa.int32()), *[pa.array(m, pa.binary()) for m in made]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("text", "doc_id").mapInArrow(run, "doc_id long, node long, size int, regs binary, low binary")


def as_registers(column: pa.Array) -> np.ndarray:
    """Rows of registers; a missing one is empty."""
    blank = bytes(EMPTY.tobytes() * REGISTERS)
    return np.frombuffer(b"".join(v if v is not None else blank for v in column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def band_marks(nodes: DataFrame) -> DataFrame:
    """(key, node, size, cls) of each band of each set, in each of its classes."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                node, size, regs, low = batch.slice(start, 1024).columns
                node, size = node.to_numpy(), size.to_numpy()
                lower = np.flatnonzero(low.is_valid().to_numpy(zero_copy_only=False))
                own = size_class(size)
                for rows, cls, column in ((np.arange(len(node)), own, regs), (lower, own[lower] - 1, low.take(pa.array(lower)))):
                    key, row, kind = band_keys(as_registers(column), cls)
                    out = [pa.array(key.view(np.int64)), pa.array(node[rows[row]]), pa.array(size[rows[row]], pa.int32()), pa.array(kind, pa.int32())]
                    yield pa.RecordBatch.from_arrays(out, names=["key", "node", "size", "cls"])

    return nodes.select("node", "size", "regs", "low").mapInArrow(run, "key long, node long, size int, cls int")


def fits(a: Column | str, b: Column | str, percent: int) -> Column:
    """Whether sets of these sizes can link at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose registers do not rule a link out."""
    bound = percent / 100 - MARGIN
    sides = [
        nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("regs").alias(f"regs_{x}"), F.col("low").alias(f"low_{x}"))
        for x in ("a", "b")
    ]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    columns = ["a", "b", *[f"{c}_{x}" for c in ("size", "regs", "low") for x in ("a", "b")]]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                size_a, size_b = part.column(2).to_numpy(), part.column(3).to_numpy()
                cls = size_class(np.minimum(size_a, size_b))
                equal = [
                    np.where((size_class(size) == cls)[:, None], as_registers(part.column(own)), as_registers(part.column(low)))
                    for size, own, low in ((size_a, 4, 6), (size_b, 5, 7))
                ]
                share = (equal[0] == equal[1]).mean(axis=1)
                stay = pa.array(estimate(share, size_a, size_b, cls) >= bound)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(stay), part.column(1).filter(stay)], names=["a", "b"])

    return both.select(*columns).mapInArrow(run, "a long, b long")


def gram_table(docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, grams) of these sets, made anew from the texts.

    A bit for each of 16 times the sets, up to 2 ** 27, keeps most others from being moved; a join
    leaves out the rest.
    """
    count = nodes.count()
    bits = 1 << min(27, max(16, (16 * count).bit_length()))
    place = F.pmod(F.col("node"), F.lit(bits))
    words = nodes.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")
    )
    found = words.toArrow()  # at most 2 ** 21 rows
    field = np.zeros(bits // 64, np.uint64)
    field[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for start, stop in blocks(batch.column(0)):
                grams, doc, first = gram_sets(batch.column(0).slice(start, stop - start), n)
                node = set_ids(grams, doc, stop - start)
                at = (node.view(np.int64) % bits).astype(np.int64)
                use = (np.diff(first) > 0) & ((field[at >> 6] >> (at & 63).astype(np.uint64)) & U(1)).astype(bool)
                out_nodes, out = [], []
                for i in np.flatnonzero(use).tolist():
                    x = int(node.view(np.int64)[i])
                    if x not in seen:
                        seen.add(x)
                        out_nodes.append(x)
                        out.append(grams[first[i] : first[i + 1]].tobytes())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out_nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", "grams"])

    made = docs.select("text").mapInArrow(run, "node long, grams binary").dropDuplicates(["node"])
    return stored(made.join(nodes, "node", "left_semi"))


def confirmed(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link by their full sets.

    b's set meets its partners in shares of about ``HEAD_SHARE``, each of which has it once.
    """
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / HEAD_SHARE).cast("int").alias("shares"))
    dealt = pairs.join(many, "b").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int")).select("a", "b", "share")
    dealt = stored(dealt)
    heads = dealt.select("b", "share").distinct().select("b", "share", F.lit(0).alias("late"), F.col("b").alias("node"))
    partners = dealt.select("b", "share", F.lit(1).alias("late"), F.col("a").alias("node"))
    tested = partners.union(heads).join(grams, "node").repartition("b", "share").sortWithinPartitions("b", "share", "late")

    def run(batches):
        head = np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for own, late, node, data in zip(*[c.to_pylist() for c in batch.columns]):
                grams = np.frombuffer(data, np.uint64)
                if not late:
                    head = grams
                    continue
                at = np.searchsorted(head, grams)
                at[at == len(head)] = 0
                common = int((head[at] == grams).sum())
                if 100 * common >= percent * (len(grams) + len(head) - common):
                    a.append(node)
                    b.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tested.select("b", "late", "node", "grams").mapInArrow(run, "a long, b long")


def by_groups(batches, width: int):
    """Tables of equal values in the first ``width`` columns, from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy() for i in range(width)]
        edge = np.zeros(batch.num_rows, bool)
        for k in keys:
            edge[1:] |= k[1:] != k[:-1]
        starts = [0, *np.flatnonzero(edge).tolist(), batch.num_rows]
        if held and any(held[-1].column(i)[-1].as_py() != k[0] for i, k in enumerate(keys)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for start, stop in zip(starts, starts[1:]):
            held.append(batch.slice(start, stop - start))
            if stop < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, a slab of n-grams at a time."""
    every = np.unique(np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    sides = []
    for sets in (left, right):
        grams, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(every, grams)
        at[at == len(every)] = 0
        shared = every[at] == grams
        order = np.argsort(at[shared], kind="stable")
        sides.append((at[shared][order], row[shared][order], len(sets)))
    for start in range(0, len(every), SLAB):
        slabs = []
        for at, row, n in sides:
            lo, hi = np.searchsorted(at, (start, start + SLAB))
            slab = np.zeros((n, SLAB), np.float32)
            slab[row[lo:hi], at[lo:hi] - start] = 1
            slabs.append(slab)
        out += slabs[0] @ slabs[1].T
    return out


def tile_links(size: np.ndarray, root: np.ndarray, side: np.ndarray, regs: np.ndarray, low: np.ndarray, sets: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Links of a tile's two sides between sets of different roots, enough to connect what they connect.

    The sides may hold the same sets. Pairs are estimated by their registers, and only those that may
    link are counted on their full sets.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    own = size_class(size)
    may = np.zeros((len(left), len(right)), bool)
    for at, i in enumerate(left.tolist()):
        fit = np.flatnonzero((root[right] != root[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i])))
        cls = size_class(np.minimum(size[right[fit]], size[i]))
        for c in np.unique(cls).tolist():
            cols = fit[cls == c]
            other = right[cols]
            theirs = np.where((own[other] == c)[:, None], regs[other], low[other])
            equal = (theirs == (regs if own[i] == c else low)[i]).mean(axis=1)
            kinds = np.full(len(other), c)
            may[at, cols] = estimate(equal, np.full(len(other), size[i]), size[other], kinds) >= percent / 100 - MARGIN
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(rows):
        return []
    left, right = left[rows], right[cols]
    grams = {i: np.frombuffer(sets[i], np.uint64) for i in {*left.tolist(), *right.tolist()}}
    common = overlaps([grams[i] for i in left.tolist()], [grams[i] for i in right.tolist()])
    union = size[left][:, None] + size[right][None, :] - common
    parent = {r: r for r in root[np.concatenate([left, right])].tolist()}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(may[np.ix_(rows, cols)] & (100 * common >= percent * union))):
        x, y = find(int(root[left[i]])), find(int(root[right[j]]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(left[i]), int(right[j])))
    return out


def open_links(groups: DataFrame, nodes: DataFrame, linked: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets of one (head, node) group that no link has connected so far.

    ``linked`` has the (node, root) of connected sets. Links with the head are known, and any other
    has an end that is not connected with the head. So groups whose sets are all connected drop out,
    and in the others the sets apart from the head, dealt into shares, meet shares of all sets.
    Each pair of shares is a tile, which returns links and not pairs.
    """
    heads = linked.select(F.col("node").alias("head"), F.col("root").alias("head_root"))
    placed = groups.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).join(heads, "head", "left")
    placed = placed.withColumn("apart", F.col("root") != F.coalesce("head_root", "head"))

    def shares(which: Column) -> Column:
        rows = F.ceil(F.count_if(which) / SHARE)
        return F.greatest(rows, F.ceil(F.sum(F.when(which, F.col("size"))) / TILE_GRAMS)).cast("int")

    still = placed.groupBy("head").agg(
        F.min("root").alias("low_root"), F.max("root").alias("high_root"), shares(F.lit(True)).alias("xs"), shares(F.col("apart")).alias("ys")
    )
    here = placed.join(still.filter("low_root <> high_root").select("head", "xs", "ys"), "head")
    whole = here.join(nodes.select("node", "regs", "low"), "node").join(grams, "node")
    own = ["node", "size", "root", "regs", "low", "grams"]
    share = {x: F.pmod(F.xxhash64("node", F.lit(x)), F.col(f"{x}s")).cast("int") for x in ("x", "y")}
    sides = F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda y: F.struct(share["x"].alias("x"), y.alias("y"), F.lit(0).alias("side")))
    others = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda x: F.struct(x.alias("x"), share["y"].alias("y"), F.lit(1).alias("side")))
    places = F.when(F.col("apart"), F.concat(sides, others)).otherwise(sides)
    tiles = whole.select("head", F.explode(places).alias("at"), *own).select("head", "at.x", "at.y", "at.side", *own)
    ordered = tiles.repartition("head", "x", "y").sortWithinPartitions("head", "x", "y")

    def run(batches):
        for table in by_groups(batches, 3):
            size, root, side = (table[c].to_numpy() for c in ("size", "root", "side"))
            links = tile_links(size, root, side, as_registers(table["regs"]), as_registers(table["low"]), table["grams"].to_pylist(), percent)
            if links:
                node = table["node"].to_numpy()
                a, b = np.array(links).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of (doc_id, text).

    A text's set is its distinct n-grams of words, A-Z lower-cased; a text of fewer words has its
    whole sequence as its one n-gram. Two texts link when 100 times their overlap is at least
    ``percent`` (80 or more) times their union; ``component_id`` is the smallest doc_id that links
    reach, the own one included, and ``kept`` says that it is the own one.

    Texts without words, empty and null ones have 0 n-grams, link with nothing and are kept. Equal
    sets are one node. Repeated rows come out as often as they come in, all alike. A null doc_id
    counts as larger than all others; a component of null ids only has a null component_id and
    its rows are kept. An empty table gives an empty table, extra columns are ignored. Sets and
    n-grams are told apart by 64-bit hashes.
    """
    if percent < 80:
        raise ValueError("bands and margin hold for a similarity of 0.8 or more")
    rows = stored(sketches(docs, n, percent))
    nodes = stored(rows.filter(F.col("regs").isNotNull()).select("node", "size", "regs", "low").dropDuplicates(["node"]))
    crowds = band_marks(nodes).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = stored(band_marks(nodes).join(crowds, "key"))
    density = met.groupBy("node").agg(F.sum("n").alias("density"))
    tops = met.join(density, "node").groupBy("key").agg(F.max(F.struct("density", "node", "size")).alias("top"))
    heads = tops.select("key", F.col("top.node").alias("head"), F.col("top.size").alias("head_size"))
    groups = met.join(heads, "key").filter(F.col("node") != F.col("head")).select("head", "node", "size", "head_size").distinct()
    groups = stored(groups)

    grams = gram_table(docs, met.select("node").distinct(), n)
    pairs = groups.filter(fits("size", "head_size", percent)).select(F.col("node").alias("a"), F.col("head").alias("b"))
    stars = stored(confirmed(likely(pairs, nodes, percent), grams, percent))
    linked = stored(components(stars))
    links = stored(open_links(groups.drop("head_size"), nodes, linked, grams, percent))
    joined = stored(components(links.union(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))))

    least = rows.filter("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = least.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id", F.lit(True).alias("known"))
    out = rows.select("doc_id", "node", "size").join(named, "node", "left")
    component = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    out = out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), component)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
