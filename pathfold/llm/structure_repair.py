"""Cheapest repair of the turn structure of conversations, by weighted interval parsing.

The roles of a conversation's rows, by their initials, are to read ``(s?(ua)+)?``. Its automaton has
the states 0 (nothing yet), 1 (after s), 2 (after u) and 3 (after a). The repair grammar, in Chomsky
normal form, has a nonterminal for each pair of states: (p, q) yields the spans of rows that some
edits turn into a string from p to q.

    (p, q) -> (p, r) (r, q)                       a span is two shorter ones
    (p, p) -> row                                 Delete, 2
    (p, q) -> row                                 Keep, 0, or Rerole to user or assistant, 1
    (p, q) -> nothing                             Insert user or assistant, 5 each: the closure

A cell holds, for each nonterminal, the least (cost, audit), audit being the initials of the edits.
The closure is part of every row's cell, so it is part of all. Audits of one span and cost are never
beginnings of one another (that would take further inserts, at further cost), so the least audit of
two spans is that of their parts. Cells are made bottom-up by span length: all spans of up to
``LEAF`` rows over all their splits, then whole leaves by twos.

No group of rows goes to one task. Rows are ranged by conversation and turn; each range packs its
rows in blocks with their cells, and only cells and audits, a byte for each row, meet by
conversation.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathfold.session import stored

LEAF = 16
BLOCK = 512
MEMO = 1 << 15
FLUSH = 2048
BLANKS = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5

PAIRS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
PLACE = {pair: i for i, pair in enumerate(PAIRS)}
RULES = [[(PLACE[p, r], PLACE[r, q]) for r in range(4) if (p, r) in PLACE and (r, q) in PLACE] for p, q in PAIRS]
STEPS = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
LEGAL = ("su", "ua", "au")

Cell = tuple[tuple[int, str] | None, ...]


def _cell(options: list[tuple[tuple[int, int], int, str]]) -> Cell:
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for pair, cost, audit in options:
        if pair not in best or (cost, audit) < best[pair]:
            best[pair] = (cost, audit)
    return tuple(best.get(pair) for pair in PAIRS)


def joined(a: Cell, b: Cell) -> Cell:
    """The binary rules: the cell of a span of which ``a`` and ``b`` are the two parts."""
    out = []
    for splits in RULES:
        best = None
        for i, j in splits:
            x, y = a[i], b[j]
            if x is not None and y is not None:
                cost = x[0] + y[0]
                if best is None or cost < best[0] or (cost == best[0] and x[1] + y[1] < best[1]):
                    best = (cost, x[1] + y[1])
        out.append(best)
    return tuple(out)


_still = [((p, p), 0, "") for p in range(4)]
_once = [(step, INSERT, "I") for role in "ua" for step in STEPS[role]]
# Two inserts lead from the start or from s to a whole pair; more of them repeat it.
CLOSURE = _cell([*_still, *_once, ((0, 3), 2 * INSERT, "II"), ((1, 3), 2 * INSERT, "II")])


def row_cell(symbol: str) -> Cell:
    """The cell of one row: x must go; u, a, s and o (another initial) may stay, capitals are truncated."""
    options = [((p, p), DELETE, "D") for p in range(4)]
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        options += [(step, extra, "K") for step in STEPS.get(symbol.lower(), [])]
        options += [(step, REROLE + extra, "R") for role in "ua" for step in STEPS[role]]
    return joined(joined(CLOSURE, _cell(options)), CLOSURE)


def leaf_cell(symbols: str, memo: dict[str, Cell]) -> Cell:
    """The chart of a short span: every span of it, bottom-up by length, over all its splits."""
    n = len(symbols)
    chart: dict[tuple[int, int], Cell] = {}
    for length in range(1, n + 1):
        for i in range(n - length + 1):
            span = symbols[i : i + length]
            cell = memo.get(span)
            if cell is None:
                if length == 1:
                    cell = row_cell(span)
                else:
                    splits = [joined(chart[i, k], chart[i + k, length - k]) for k in range(1, length)]
                    cell = tuple(min((c for c in options if c is not None), default=None) for options in zip(*splits))
                memo[span] = cell
            chart[i, length] = cell
    return chart[0, n] if n else CLOSURE


def span_cell(symbols: str, memo: dict[str, Cell]) -> Cell:
    """The cell of any span: its leaves, then spans of two, four, ... leaves."""
    if len(memo) > MEMO:
        memo.clear()
    cells = [leaf_cell(symbols[i : i + LEAF], memo) for i in range(0, len(symbols), LEAF)] or [CLOSURE]
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def whole_parse(cells: list[Cell]) -> tuple[int, list[tuple[int, str]]]:
    """(cost, (first state, audit) of each cell) of the cheapest parse of cells in a row."""
    front: list[tuple[int, str] | None] = [(0, ""), None, None, None]
    back: list[list[int]] = []
    for cell in cells:
        step: list[tuple[int, str] | None] = [None] * 4
        came = [0] * 4
        for (p, q), found in zip(PAIRS, cell):
            if found is not None and front[p] is not None:
                option = (front[p][0] + found[0], front[p][1] + found[1])
                if step[q] is None or option < step[q]:
                    step[q], came[q] = option, p
        front = step
        back.append(came)
    cost, _, q = min((*front[q], q) for q in (0, 3) if front[q] is not None)
    path = []
    for cell, came in zip(reversed(cells), reversed(back)):
        p = came[q]
        path.append((p, cell[PLACE[p, q]][1]))
        q = p
    return cost, path[::-1]


def initial(role: Column | str) -> Column:
    return F.substring(role, 1, 1)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, key, text, blank, cut): nulls of role and text count as one space."""
    space = F.lit(" ")
    given = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    end = F.rtrim("text", F.lit(BLANKS))
    last = F.right(end, F.lit(1))
    return given.withColumns({"key": F.md5("text"), "blank": end == "", "cut": ~last.isin(".", "!", "?")})


def marked_rows(rows: DataFrame) -> DataFrame:
    """A light row for each (conv_id, turn, role, key): its symbol, how often it is there, its faults."""
    light = rows.groupBy("conv_id", "turn", "role", "key", "blank", "cut").count()
    seen = light.filter(~F.col("blank")).groupBy("conv_id", "role", "key").agg(
        F.max(F.col("turn").isNull()).alias("open"), F.min("turn").alias("least")
    )
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "open", "least")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("key") == F.col("k"))
    first = F.when(F.col("open"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("least"))
    both = light.join(seen, same, "left").withColumn("first", ~F.col("blank") & F.coalesce(first, F.lit(False)))
    name = F.when(initial("role").isin("u", "a", "s"), initial("role")).otherwise("o")
    return both.select(
        "conv_id", "turn", "role", "key", "count",
        F.when(~F.col("first"), "x").when(F.col("cut"), F.upper(name)).otherwise(name).alias("symbol"),
        F.when(F.col("blank"), F.col("count")).otherwise(0).alias("blank"),
        F.when(F.col("blank"), 0).otherwise(F.col("count") - F.col("first").cast("long")).alias("duplicate"),
        (F.col("first") & F.col("cut")).cast("long").alias("truncated"),
    )


BLOCKS = (
    "conv_id {id}, range int, block int, symbols string, roles array<string>, keys array<string>, "
    "costs array<long>, audits array<string>, illegal long, head string, tail string"
)


def packed(marked: DataFrame) -> DataFrame:
    """Blocks of a conversation's rows in order, with the cells of their spans.

    Ranges are numbered in order, as are the blocks of a conversation in a range. ``roles`` and
    ``keys`` are those of the rows that need not go.
    """
    order = ["conv_id", "turn", "role", "key"]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "key", "symbol", "count")
    schema = BLOCKS.format(id=marked.schema["conv_id"].dataType.simpleString())
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        at = TaskContext.get().partitionId()
        memo: dict[str, Cell] = {}
        done: list[list] = []
        conv, block, count = object(), 0, 0
        symbols: list[str] = []
        roles: list[str] = []
        keys: list[str] = []
        illegal, head, tail = 0, None, None

        def close():
            nonlocal symbols, roles, keys, illegal, head, count
            if symbols:
                text = "".join(symbols)
                cell = span_cell(text, memo)
                costs, audits = [c and c[0] for c in cell], [c and c[1] for c in cell]
                done.append([conv, at, block, text, roles, keys, costs, audits, illegal, head, tail])
            symbols, roles, keys, illegal, head, count = [], [], [], 0, None, 0

        def ready():
            columns = [pa.array(c, t) for c, t in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        text = pa.string()
        for batch in batches:
            kinds = [batch.column(0).type, pa.int32(), pa.int32(), text, pa.list_(text), pa.list_(text), pa.list_(pa.int64()), pa.list_(text), pa.int64(), text, text]
            for now, role, key, symbol, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if now != conv:
                    close()
                    conv, block = now, 0
                while copies:
                    if count >= BLOCK:
                        close()
                        block += 1
                    take = min(copies, BLOCK - count)
                    if head is None:
                        head = role[:1]
                    else:
                        illegal += tail + role[:1] not in LEGAL
                    illegal += take - 1  # a role never follows itself
                    symbols.append(symbol + "x" * (take - 1))
                    if symbol != "x":
                        roles.append(role)
                        keys.append(key)
                    tail, symbol = role[:1], "x"
                    count, copies = count + take, copies - take
                if len(done) >= FLUSH:
                    yield ready()
        close()
        if done:
            yield ready()

    return ranged.mapInArrow(run, schema)


def parsed(blocks: DataFrame) -> DataFrame:
    """Each block's edits in its conversation's cheapest repair; with ``block`` -1 the conversation's.

    ``state`` is where the block starts and ``place`` how many rows the repair has before it.
    """
    light = blocks.select("conv_id", "range", "block", "costs", "audits", "illegal", "head", "tail")
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", "range", "block")
    schema = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, range int, block int, state int, place long, cost long, illegal long, edits string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        conv = object()
        rows: list[tuple] = []
        done: list[list] = []

        def close():
            if not rows:
                return
            cells = [tuple(None if c is None else (c, a) for c, a in zip(r[3], r[4])) for r in rows]
            cost, path = whole_parse(cells)
            illegal = sum(r[5] for r in rows) + sum(a[7] + b[6] not in LEGAL for a, b in zip(rows, rows[1:]))
            place = 0
            for r, (state, edits) in zip(rows, path):
                done.append([conv, r[1], r[2], state, place, None, None, edits])
                place += len(edits) - edits.count("D")
            done.append([conv, -1, -1, 0, place, cost, illegal, "".join(edits for _, edits in path)])
            rows.clear()

        def ready():
            columns = [pa.array(c, t) for c, t in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            kinds = [batch.column(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if row[0] != conv:
                    close()
                    conv = row[0]
                rows.append(row)
                if len(done) >= FLUSH:
                    yield ready()
        close()
        if done:
            yield ready()

    return ordered.mapInArrow(run, schema)


def edited(blocks: DataFrame, parse: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, was, key) of the rows that a repair keeps, reroles or inserts."""
    own = parse.filter("block >= 0").select(F.col("conv_id").alias("c"), F.col("range").alias("g"), F.col("block").alias("b"), "state", "place", "edits")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("g")) & (F.col("block") == F.col("b"))
    both = blocks.join(own, same).select("conv_id", "symbols", "roles", "keys", "state", "place", "edits")
    schema = f"conv_id {blocks.schema['conv_id'].dataType.simpleString()}, place long, edit string, role string, was string, key string"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for conv, symbols, roles, keys, state, place, edits in zip(*[c.to_pylist() for c in batch.columns]):
                at = nth = 0  # of all rows, of those that need not go
                for edit in edits:
                    was = key = None
                    if edit != "I":
                        if symbols[at] != "x":
                            was, key = roles[nth], keys[nth]
                            nth += 1
                        at += 1
                    if edit == "D":
                        continue
                    role = was if edit == "K" else "assistant" if state == 2 else "user"
                    state = {"s": 1, "u": 2, "a": 3}[role[0]]
                    out.append((conv, place, edit, role, was, key))
                    place += 1
            if out:
                text = pa.string()
                kinds = [batch.column(0).type, pa.int64(), text, text, text, text]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return both.mapInArrow(run, schema)


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired rows) of conversations (conv_id, turn, role, text); other columns are ignored.

    Rows are taken by turn, null first; rows of one turn by role, then the md5 of the text, so
    that equal rows are neighbours. A null role or text is one space, null conv_ids are one
    conversation. A row's fault is the first of: blank (nothing but white space), duplicate (role
    and text seen earlier), truncated (the last other character is none of ``.!?``). Blank and
    duplicate rows must be deleted; what stays truncated costs 5 more.

    ``report`` has a row for each conversation: gaps in its turn numbers (0 if all are null), its
    faults, ``illegal`` neighbours (role initials other than su, ua, au), the cost of the cheapest
    repair, and its ``audit`` (K, R, D or I for each edit; the ASCII-least of the cheapest ones).
    ``rows`` are (conv_id, place, edit, role, text), ``place`` counting from 0; a conversation of
    which nothing stays has none. An empty table gives two empty ones. Texts move once, and only
    those that are neither blank nor duplicate.
    """
    rows = turn_rows(conversations)
    marked = stored(marked_rows(rows.drop("text")))
    by_turn = marked.groupBy("conv_id", "turn").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    faults = by_turn.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    )
    blocks = stored(packed(marked))
    parse = stored(parsed(blocks))
    found = parse.filter("block < 0").select(F.col("conv_id").alias("c"), "illegal", "cost", F.col("edits").alias("audit"))
    report = faults.join(found, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")

    texts = rows.filter(~F.col("blank")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("key").alias("k"), "text")
    texts = texts.dropDuplicates(["c", "r", "k"])
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("was") == F.col("r")) & (F.col("key") == F.col("k"))
    out = edited(blocks, parse).join(texts, same, "left")
    return report, out.select("conv_id", "place", "edit", "role", F.coalesce("text", F.lit("")).alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256 of the repaired ``role:text``, newline-joined) of repaired rows.

    A digest runs over a conversation's rows in order, one batch at a time, and holds none.
    """
    line = F.concat("role", F.lit(":"), "text").alias("line")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", line)
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, running = object(), None
        for batch in batches:
            done: list[tuple] = []
            for now, text in zip(*[c.to_pylist() for c in batch.columns]):
                if now != conv:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    conv, running = now, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(text.encode())
            id_type = batch.column(0).type
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (id_type, pa.string()))], names=["conv_id", "repaired_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], id_type), pa.array([running.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults, dealt by crc32(``conv_id:turn``) modulo 20; nulls in the name, role and text are one space.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role user.
    """
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    part = F.pmod(F.crc32(name), F.lit(20))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), part.alias("part")).filter("part <> 0")
    rows = rows.withColumns({
        "text": F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        "role": F.when(F.col("part") == 4, "user").otherwise(F.col("role")),
        "copy": F.explode(F.when(F.col("part") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
    })
    return rows.select("conv_id", "turn", "role", "text")
