"""N-gram Jaccard join as a blocked sparse matrix product, and the classes that its links make.

The matrix has a row for each distinct n-gram set and a column for each n-gram. Rows that may link
are gathered in blocks; in a block the product of the matrix with its transpose accumulates the
overlap counts, a slice of columns at a time, and drops pairs whose overlap can no longer reach the
bound that their sizes give.

*Which rows share a block.* Two sets of Jaccard similarity t or more differ in at most
H = (1 - t) / (1 + t) (|x| + |y|) n-grams. Cut into K > H parts by a hash, at least K - H of their
parts are equal. So each set registers a signature of every part; sets that agree in ``SHARED`` of
them are candidates, and the connected candidates are a block. K depends on the size class of the
smaller set, so a set registers for its own class and, if it may be the larger one of a pair, for
the one below. N-grams of crowded hash buckets (a boilerplate passage) count for no part; a set
that so has many empty parts registers whole parts as well. Nothing is dropped: every pair that
links is in one block.

*Blocks of any size.* A block of more than ``TILE_ROWS`` rows or ``TILE_GRAMS`` n-grams is dealt
into shares, and each pair of shares is a tile of its own, multiplied ``PRODUCT_ROWS`` rows at a time. A
product returns a spanning forest of its links, not all of them.

*Signatures.* Nearly all are of one set only. They are first told apart by 44 of their bits, packed, so that
those which occur again leave their bits in a filter, and only signatures that meet it are moved with their sets.

*Copies.* One row of each set, told by a filter of fixed size, stands for all of its copies, so that
what is moved follows the number of sets, not of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm.batches import Texts, blocks, distinct_in_docs, expand, mix, small_batches, unused
from pathfold.llm.graph import components
from pathfold.session import cut_lineage, release, stored

BUCKETS = 1 << 18
SLICES = 64
CROWDED = 4.0  # times the mean of the buckets
TILE_ROWS = 2048
PRODUCT_ROWS = 512
TILE_GRAMS = 1 << 21
COLUMNS = 2048
FILTER_BITS = 1 << 24
HEAD_BITS = 1 << 27
HELD = 1 << 22  # signatures that are packed at a time
PACKS = 1 << 12
SHARED = 3
FEW = 16
U = np.uint64


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of a block of texts: hashes, documents (sorted), and borders."""
    block = Texts(texts)
    block.spans()
    grams, doc = distinct_in_docs(*block.ngrams(block.word_hashes(lower=True), n))
    return grams, doc, np.searchsorted(doc, np.arange(block.n + 1))


def set_sums(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    np.add.at(out, doc, values)
    return out


def set_ids(grams: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit id of each set: the mixed sum of its mixed n-grams."""
    with np.errstate(over="ignore"):
        return mix(set_sums(mix(grams ^ U(0xA0761D6478BD642F)), doc, n))


def size_class(size: int) -> int:
    """Classes of sizes, each root two times the one before: the largest c with 2 ** (c / 2) <= size."""
    c = int(2 * math.log2(size)) + 2
    while 2 ** (c / 2) > size:
        c -= 1
    return c


def parts_of(cls: int, t: float) -> tuple[int, int]:
    """(K, spare) for pairs whose smaller set is of this class.

    At least ``spare`` + 1 of the K parts of a linked pair are equal, so a set with at most
    ``spare`` + 1 - ``SHARED`` empty parts has ``SHARED`` equal ones that are not empty.
    """
    small = math.ceil(2 ** ((cls + 1) / 2)) - 1  # the largest size of the class
    large = math.floor(small / t + 1e-9)
    differ = math.floor((1 - t) / (1 + t) * (small + large) + 1e-9)
    if not differ:
        return 0, 0  # only equal sets link, and those are one row
    spare = math.ceil(0.15 * differ) + 2
    return differ + 1 + spare, spare


def registrations(size: int, t: float) -> list[int]:
    """Classes in which a set of this size registers: its own, and those of smaller partners."""
    if size == 0:
        return []
    own, least = size_class(size), max(1, math.ceil(t * size - 1e-9))
    return list(range(size_class(least), own + 1))


def signatures(grams: np.ndarray, doc: np.ndarray, first: np.ndarray, t: float, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the parts of each set, and the sets they are of."""
    sizes = np.diff(first)
    rare = ~((crowded[(grams & U(BUCKETS - 1)).astype(np.int64) >> 3] >> (grams & U(7)).astype(np.uint8)) & 1).astype(bool)
    classes = {int(s): registrations(int(s), t) for s in np.unique(sizes)}
    depth = max(map(len, classes.values()), default=0)
    sigs, owners = [], []
    with np.errstate(over="ignore"):
        value = mix(grams * U(0x9FB21C651E98DF25) + U(0xD6E8FEB86659FD93))
        for k in range(depth):
            cls = np.array([classes[int(s)][k] if k < len(classes[int(s)]) else -1 for s in sizes])
            plans = {c: parts_of(int(c), t) for c in np.unique(cls) if c >= 0}
            width = np.array([plans[c][0] if c >= 0 else 0 for c in cls], np.int64)
            spare = np.array([plans[c][1] if c >= 0 else 0 for c in cls], np.int64)
            start = np.cumsum(width) - width
            owner = np.repeat(np.arange(len(sizes)), width)
            part = np.arange(len(owner)) - start[owner]
            place = ((value >> U(32)) * width[doc].astype(np.uint64) >> U(32)).astype(np.int64) + start[doc]
            use = width[doc] > 0
            label = mix(part.astype(np.uint64) + (cls[owner].astype(np.uint64) << U(32)))
            for scheme in (0, 1):  # parts of rare n-grams; whole parts
                chosen = use & rare if scheme == 0 else use
                total = np.zeros(len(owner), np.uint64)
                np.add.at(total, place[chosen], mix(value[chosen] ^ U(0x2545F4914F6CDD1D)))
                filled = np.zeros(len(owner), bool)
                filled[place[chosen]] = True
                if scheme == 0:
                    empty = np.zeros(len(sizes), np.int64)
                    np.add.at(empty, owner, ~filled)
                    sparse = empty > spare + 1 - SHARED  # such sets find each other by whole parts
                    keep = filled
                else:
                    if not sparse.any():
                        break
                    keep = sparse[owner]
                    label = mix(label + U(1))
                sigs.append(mix(total + label)[keep])
                owners.append(owner[keep])
    if not sigs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def bound(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """The least overlap of two sets of these sizes with a Jaccard similarity of t."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-6)


def product_links(sets: list[np.ndarray], t: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of rows that link (a spanning forest of them), by the product in slices of columns.

    ``side``: with 0 and 1, only pairs across the two sides are asked for.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    every = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes.astype(np.int64))
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = times[column] > 1  # other columns add to no pair
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((m, m), np.float32)
    need = bound(sizes[:, None], sizes[None, :], t)
    alive = np.minimum(sizes[:, None], sizes[None, :]) >= need
    alive &= np.tri(m, k=-1, dtype=bool)
    if side is not None:
        alive &= side[:, None] != side[None, :]
    left = np.bincount(row, minlength=m).astype(np.float32)
    n = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, n, COLUMNS):
        lo, hi = np.searchsorted(column, (start, start + COLUMNS))
        open_rows = alive.any(axis=0) | alive.any(axis=1)
        if not open_rows.any():
            return []
        r, c = row[lo:hi], column[lo:hi] - start
        left -= np.bincount(r, minlength=m).astype(np.float32)
        use = open_rows[r]
        at = np.flatnonzero(open_rows)
        renumber = np.zeros(m, np.int64)
        renumber[at] = np.arange(len(at))
        slab = np.zeros((len(at), min(COLUMNS, n - start)), np.float32)
        slab[renumber[r[use]], c[use]] = 1
        overlap[np.ix_(at, at)] += slab @ slab.T
        # What is left of the smaller remainder cannot lift the pair to its bound.
        alive &= overlap + np.minimum(left[:, None], left[None, :]) >= need
    hit = alive & (overlap >= need)
    parent = list(range(m))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(v.tolist() for v in np.nonzero(hit))):
        x, y = find(i), find(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def link_classes(docs: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, root), a row for each row of (doc_id, text).

    A text's set is its distinct n-grams of words, A-Z lower-cased; a text of fewer words has its
    whole sequence as its one n-gram. Two texts link when the Jaccard similarity of their sets is
    at least ``t`` (below 1); ``component_id`` is the smallest doc_id that links reach, the own one
    included. ``text_key`` is the xxhash64 of the text, ``root`` numbers the component.

    Texts without words, empty and null ones have 0 n-grams, link with nothing and have no root. Equal sets are
    one row of the matrix, so copies cost no more than their count. Repeated rows come out as often
    as they come in. A null doc_id counts as larger than all others; a component of null ids only
    has a null component_id. An empty table gives an empty table. Extra columns are ignored. Sets
    and n-grams are told apart by 64-bit hashes.
    """
    names = ["doc_id", "text_key", "size", "node", "slice", "counts"]

    def read(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                texts, ids, keys = batch.slice(a, b - a).columns
                grams, doc, first = gram_sets(texts, n)
                counts += np.bincount((grams & U(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                none = pa.nulls(b - a)
                columns = [ids, keys, pa.array(np.diff(first), pa.int32()), pa.array(set_ids(grams, doc, b - a).view(np.int64))]
                yield pa.RecordBatch.from_arrays([*columns, none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        if counts.any():  # the task's bucket counts, in slices that are summed apart
            cut = [x.tobytes() for x in np.split(counts, SLICES)]
            none = [pa.nulls(SLICES).cast(k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(cut, pa.binary())], names=names)

    given = docs.select("text", "doc_id", F.xxhash64("text").alias("text_key"))
    sets = cut_lineage(given.mapInArrow(read, "doc_id long, text_key long, size int, node long, slice int, counts binary"))
    crowded = crowded_buckets(sets.filter("slice IS NOT NULL").select("slice", "counts"))
    rows = sets.filter("slice IS NULL").select("doc_id", "text_key", "size", "node")
    nodes = cut_lineage(
        rows.filter("size > 0").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.first("size").alias("size"), F.min(row_key()).alias("row")
        )
    )
    standing = bit_filter(nodes, "row")

    def registered():
        """A function for the signatures of a block of texts, and the nodes they are of."""
        seen: set[int] = set()

        def compute(texts, keys):
            grams, doc, first = gram_sets(texts, n)
            nodes = set_ids(grams, doc, len(texts)).view(np.int64)
            fresh = np.zeros(len(texts), bool)  # one row of a set registers, copies within a task once
            stands = in_filter(standing, keys.to_numpy().view(np.uint64))
            for i, x in enumerate(nodes.tolist()):
                if stands[i] and x not in seen:
                    seen.add(x)
                    fresh[i] = True
            use = fresh[doc]
            sizes = np.diff(first) * fresh
            edges = np.zeros(len(sizes) + 1, np.int64)
            np.cumsum(sizes, out=edges[1:])
            sigs, owner = signatures(grams[use], doc[use], edges, t, crowded)
            return sigs, nodes[owner]

        return compute

    def pack(batches):
        compute, held = registered(), []
        for batch in batches:
            for a, b in blocks(batch.column(0)):
                held.append(compute(*batch.slice(a, b - a).columns)[0] >> U(20))
                if sum(map(len, held)) >= HELD:
                    yield packs(np.concatenate(held))
                    held = []
        if held:
            yield packs(np.concatenate(held))

    texts = docs.select("text", row_key(F.xxhash64("text")).alias("row"))
    small_batches(texts)
    repeated = texts.mapInArrow(pack, "pack int, heads binary").groupBy("pack").applyInArrow(heads_again, "head long")
    again = bit_filter(repeated, "head", HEAD_BITS)
    release(docs.sparkSession)

    def make_signatures():
        compute = registered()

        def met(texts, keys):
            sigs, nodes = compute(texts, keys)
            use = in_filter(again, sigs >> U(20))
            return {"sig": pa.array(sigs[use].view(np.int64)), "node": pa.array(nodes[use])} if use.any() else None

        return met

    marks = expand(texts, make_signatures, "sig long, node long", ["text", "row"])
    blocks_of = cut_lineage(components(candidate_edges(marks)))
    release(docs.sparkSession)
    links = cut_lineage(block_links(docs, nodes, blocks_of, n, t, standing))
    release(docs.sparkSession)
    rooted = nodes.select("node", "least", "size").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("node", "component_id", "root")
    out = rows.join(named, "node", "left")
    return out.select(
        "doc_id", "text_key", F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root",
    )


def keep_one(docs: DataFrame, n: int = 5, t: float = 0.8) -> DataFrame:
    """The rows of ``docs`` less all but one of each component of :func:`link_classes`.

    The one with the smallest doc_id stays, null last; of texts with one doc_id that of the
    smallest hash, of equal rows any one. Texts without words stay, all of them. Columns stay as
    they are.
    """
    linked = cut_lineage(link_classes(docs, n, t).filter(F.col("root").isNotNull()).select("root", "doc_id", "text_key"))
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")).alias("best"))
    best = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key"))
    lost = linked.join(first, "root").filter(~best).select("doc_id", "text_key").distinct()
    again = linked.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")
    own_id, own_key = unused(docs.columns, "__id", "__key")
    lost, again = (stored(x.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))) for x in (lost, again))
    match = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(own_key))
    left = docs.join(lost, match, "left_anti")
    single = left.join(again, match, "left_anti")
    return single.unionByName(left.join(again, match, "left_semi").dropDuplicates(["doc_id", "text"]))


def candidate_edges(marks: DataFrame) -> DataFrame:
    """(a, b): edges that connect all sets that may link, from (sig, node).

    Two sets that link agree in ``SHARED`` signatures or more. A signature of few sets gives its
    pairs, which count; one of many sets ties all of them to the first. So a pair that links is
    counted often enough, or is tied, and sets that agree by chance in one part stay apart.
    """
    same = Window.partitionBy("sig")
    inside = same.orderBy("node")
    met = marks.withColumn("n", F.count(F.lit(1)).over(same)).filter("n > 1")
    met = met.withColumn("head", F.first("node").over(inside)).withColumn(
        "before", F.collect_list("node").over(inside.rowsBetween(1 - FEW, -1))
    )
    met = cut_lineage(met.select("n", "node", "head", "before"))  # few of the signatures, sorted once
    tied = met.filter(F.col("n") > FEW).select(F.col("node").alias("a"), F.col("head").alias("b"))
    pairs = met.filter(F.col("n") <= FEW).select(F.col("node").alias("a"), F.explode("before").alias("b"))
    counted = pairs.filter("a <> b").groupBy("a", "b").count().filter(F.col("count") >= SHARED).select("a", "b")
    return tied.filter("a <> b").distinct().union(counted)


def crowded_buckets(counts: DataFrame) -> np.ndarray:
    """A bit for each bucket that holds more than ``CROWDED`` times the mean: a fixed 32 KB."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table["counts"].to_pylist())
        return pa.table([table["slice"].slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])

    summed = counts.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect()  # SLICES rows
    total = np.zeros(BUCKETS, np.int64)
    width = BUCKETS // SLICES
    for row in summed:
        total[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(row["counts"], np.int64)
    return np.packbits(total > np.maximum(CROWDED * total.mean(), 8), bitorder="little")


def packs(heads: np.ndarray) -> pa.RecordBatch:
    """44-bit heads in ``PACKS`` packs of their upper bits: the differences of the lower ones, byte by byte."""
    heads = np.sort(heads)
    edges = np.searchsorted(heads, np.arange(PACKS + 1).astype(U) << U(32))
    rows = []
    for i in np.flatnonzero(np.diff(edges)).tolist():
        low = heads[edges[i] : edges[i + 1]].astype(np.uint32)
        steps = np.diff(low, prepend=np.uint32(0)).astype("<u4")
        rows.append((i, steps.view(np.uint8).reshape(-1, 4).T.tobytes()))  # the upper bytes are zeros and pack well
    columns = [pa.array([i for i, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["pack", "heads"])


def heads_again(table: pa.Table) -> pa.Table:
    """The heads of a pack that occur more than once."""
    low = [np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for x in table["heads"].to_pylist()]
    low = np.sort(np.concatenate([np.cumsum(x, dtype=np.uint32) for x in low]))
    twice = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.int64)
    return pa.table([pa.array(twice + (table["pack"][0].as_py() << 32))], names=["head"])


def row_key(text_key="text_key"):
    """A hash of (doc_id, text)."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_key)


def bit_filter(rows: DataFrame, column: str, size: int = FILTER_BITS) -> np.ndarray:
    """A bit array of fixed size with the bits of all values of a column set."""
    place = F.pmod(F.col(column), F.lit(size))
    words = rows.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("bits")
    )
    found = words.toArrow()  # at most size / 64 rows
    out = np.zeros(size // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def in_filter(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bits of unsigned values are set: of all that the filter was made of, and a few others."""
    at = (values % U(len(bits) * 64)).astype(np.int64)
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & U(1)).astype(bool)


def tile_links(sets: list[np.ndarray], t: float, side: np.ndarray | None) -> list[tuple[int, int]]:
    """``product_links`` of a tile, ``PRODUCT_ROWS`` rows at a time."""
    if len(sets) <= PRODUCT_ROWS:
        return product_links(sets, t, side) if len(sets) > 1 else []

    def runs(at: np.ndarray) -> list[np.ndarray]:
        return [at[i : i + PRODUCT_ROWS] for i in range(0, len(at), PRODUCT_ROWS)]

    if side is None:
        cut = runs(np.arange(len(sets)))
        pairs = [(a, cut[j]) for i, a in enumerate(cut) for j in range(i, len(cut))]
    else:
        pairs = [(a, b) for a in runs(np.flatnonzero(side == 0)) for b in runs(np.flatnonzero(side == 1))]
    out = []
    for a, b in pairs:
        both = a if a is b else np.concatenate([a, b])
        across = None if a is b else (np.arange(len(both)) >= len(a)).astype(np.int8)
        if len(both) > 1:
            out += [(both[i], both[j]) for i, j in product_links([sets[k] for k in both], t, across)]
    return out


def block_links(
    docs: DataFrame, nodes: DataFrame, blocks_of: DataFrame, n: int, t: float, standing: np.ndarray
) -> DataFrame:
    """(a, b): linked sets, enough of them to connect all that links connect.

    The sets are made anew from the texts; a filter of fixed size keeps most of those that no
    block needs from being moved, the join on the node leaves out the others.
    """
    members = cut_lineage(nodes.select("node", "size").join(blocks_of, "node"))
    bits = bit_filter(members, "node")
    widths = members.groupBy("root").agg(
        F.greatest(F.ceil(F.count("*") / TILE_ROWS), F.ceil(F.sum("size") / TILE_GRAMS)).cast("int").alias("shares")
    )
    placed = members.join(widths, "root").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("shares") - 1), lambda j: F.struct(F.least(j, "share").alias("x"), F.greatest(j, "share").alias("y"))
    )
    dealt = placed.select("node", "root", "share", F.explode(pairs).alias("tile"))

    def make():
        seen: set[int] = set()

        def compute(texts, keys):
            grams, doc, first = gram_sets(texts, n)
            found = set_ids(grams, doc, len(texts))
            use = (np.diff(first) > 0) & in_filter(bits, found) & in_filter(standing, keys.to_numpy().view(np.uint64))
            out_nodes, out = [], []
            for i in np.flatnonzero(use).tolist():
                x = int(found[i])
                if x not in seen:  # a set's copies within a task are sent once
                    seen.add(x)
                    out_nodes.append(x)
                    out.append(grams[first[i] : first[i + 1]].tobytes())
            if not out:
                return None
            return {"node": pa.array(np.array(out_nodes, np.uint64).view(np.int64)), "grams": pa.array(out, pa.binary())}

        return compute

    texts = docs.select("text", row_key(F.xxhash64("text")).alias("row"))
    sets = expand(texts, make, "node long, grams binary", ["text", "row"]).dropDuplicates(["node"])
    tiles = dealt.join(sets, "node")

    def multiply(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(x, np.uint64) for x in table["grams"].to_pylist()]
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        side = None if x == y else (table["share"].to_numpy() == y).astype(np.int8)
        links = tile_links(own, t, side)
        nodes = table["node"].to_numpy()
        i = np.array([p for p, _ in links], np.int64)
        j = np.array([q for _, q in links], np.int64)
        return pa.table([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

    return (
        tiles.select("root", F.col("tile.x").alias("x"), F.col("tile.y").alias("y"), "share", "node", "grams")
        .groupBy("root", "x", "y")
        .applyInArrow(multiply, "a long, b long")
    )
