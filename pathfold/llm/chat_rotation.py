"""Dialogues from every participant's point of view, with masks of what that participant says.

A dialogue is cut into parts of ``BLOCK`` turn numbers, and a part with more than ``CROWD`` rows (many
rows of one turn) into slices of ``CROWD`` rows in the order of the rows, so no slice grows with the
dialogue. Each slice meets each participant of its dialogue once, and ``offset`` says where it lies in
the text of the whole dialogue.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathfold.session import cut_lineage

BLOCK = 256
CROWD = 4096
HEAD, TAIL = "<|im_start|>", "<|im_end|>"
MARKS = len(HEAD) + len(TAIL) + 2  # a turn's marks and line breaks


def render(turns: list[tuple[str | None, str | None]], me: str, system: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The turns as ``me`` sees them, and the spans to learn from: own texts with their end mark."""
    out, masks, at = [], [], 0
    for role, text in turns:
        text = text or ""
        if role == me:
            head = f"{HEAD}assistant\n"
            masks.append((at + len(head), at + len(head) + len(text) + len(TAIL)))
        elif role in system:
            head = f"{HEAD}system\n"
        else:
            head = f"{HEAD}user\n" if role is None else f"{HEAD}user name={role}\n"
        part = f"{head}{text}{TAIL}\n"
        out.append(part)
        at += len(part)
    return "".join(out), masks


def slices(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, part, late, turn, role, text) of crowded parts, each with its ``slice`` and number ``n`` there.

    Equal rows are one with a count, so ranges of the distinct rows are of any size; running counts
    within range partitions and the totals before each give every row its place in its part.
    """
    order = ["conv_id", "part", "late", "turn", "role", "text"]
    placed = running(rows.groupBy(*order).count(), order, "count")
    starts = placed.groupBy("conv_id", "part").agg(F.min("before").alias("start")).select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "start")
    placed = placed.join(starts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    first = F.col("before") - F.col("start")
    last = first + F.col("count") - 1
    cut = placed.select(*order, first.alias("first"), last.alias("last"), F.explode(F.sequence(F.floor(first / CROWD), F.floor(last / CROWD))).alias("slice"))
    n = F.least("last", F.col("slice") * CROWD + CROWD - 1) - F.greatest("first", F.col("slice") * CROWD) + 1
    return cut.select(*order, "slice", n.cast("int").alias("n"))


def running(rows: DataFrame, order: list[str], size: str) -> DataFrame:
    """Add ``before``, the sum of ``size`` over all rows that come earlier in the whole table.

    Sums run within range partitions; the totals of the ranges before are one row a range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid_out = cut_lineage(ranged.withColumn("at", F.monotonically_increasing_id())).withColumn("range", F.shiftright("at", 33))
    earlier = Window.unboundedPreceding, -1
    so_far = Window.partitionBy("range").orderBy("at").rowsBetween(*earlier)
    ranges = laid_out.groupBy("range").agg(F.sum(size).alias("total"))
    ranges = ranges.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    placed = laid_out.withColumn("inside", F.coalesce(F.sum(size).over(so_far), F.lit(0))).join(F.broadcast(ranges), "range")  # a row a range
    return placed.withColumn("before", F.col("inside") + F.col("base")).drop("at", "range", "inside", "base")


def seats(told: DataFrame, speakers: DataFrame, system: tuple[str, ...]) -> DataFrame:
    """(c, p, s, participant, offset): where each slice starts in the text that a participant sees.

    ``told`` has conv_id, part, slice, role, text and the number ``n`` of such rows. All see the same
    text but for the heads of their own turns, so lengths come from sums by role; no text is rendered.
    """
    role = F.col("role")
    name = F.when(role.isNull(), len("user")).when(role.isin(*system), len("system")).otherwise(len("user name=") + F.length(role))
    by_role = told.groupBy("conv_id", "part", "slice", "role").agg(
        F.sum(F.col("n") * (MARKS + name + F.length("text"))).alias("chars"), F.sum("n").alias("own")
    )
    whole = by_role.groupBy("conv_id", "part", "slice").agg(F.sum("chars").alias("chars"))
    own = by_role.select(F.col("conv_id").alias("oc"), F.col("part").alias("op"), F.col("slice").alias("os"), F.col("role").alias("who"), "own")
    mine = F.col("conv_id").eqNullSafe(F.col("oc")) & (F.col("part") == F.col("op")) & (F.col("slice") == F.col("os")) & (F.col("participant") == F.col("who"))
    saved = F.coalesce("own", F.lit(0)) * (len("user name=") + F.length("participant") - len("assistant"))
    key = ["conv_id", "participant"]
    sized = whole.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).join(own, mine, "left").select(*key, "part", "slice", (F.col("chars") - saved).alias("chars"))
    placed = running(sized, [*key, "part", "slice"], "chars")
    starts = placed.groupBy(*key).agg(F.min("before").alias("start")).select(F.col("conv_id").alias("c"), F.col("participant").alias("who"), "start")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("who"))
    return placed.join(starts, same).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("slice").alias("s"), "participant", (F.col("before") - F.col("start")).alias("offset")
    )


def rotate(turns: DataFrame, system: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, participant, part, slice, offset, n_turns, text, masks) from (conv_id, turn, role, text).

    A participant is a role that speaks in the dialogue and is no system role. Its own turns are
    the assistant's, other roles' are users' with the role as name, system roles' stay system.
    ``masks`` are code point ranges of ``text``, end exclusive, of the assistant's contents with
    the end mark. A dialogue's text is that of its parts, by part, then slice; nearly all have one.
    A part has one slice, 0, unless it has more than ``CROWD`` rows; masks count from the slice, which
    starts ``offset`` code points into the dialogue's text.

    Turns come by turn number, null last; rows of one turn by role, null first, then text. A null
    role speaks as a user without name and is no participant. Null texts are empty. A null conv_id
    is a dialogue of its own. Repeated rows are repeated turns. A dialogue of system turns alone
    has no rows. Extra columns are ignored.
    """
    block = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(1 << 54))
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), block.alias("part"))
    sizes = rows.groupBy("conv_id", "part").count().filter(F.col("count") > CROWD)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("part").alias("p"))
    marked = rows.withColumn("late", F.col("turn").isNull()).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    crowded = marked.filter(F.col("p").isNotNull()).drop("c", "p")
    plain = marked.filter(F.col("p").isNull()).select("conv_id", "part", "late", "turn", "role", "text", F.lit(0).cast("long").alias("slice"), F.lit(1).alias("n"))
    told = F.sort_array(F.collect_list(F.struct("late", "turn", "role", "text", "n")))
    told = F.flatten(F.transform(told, lambda t: F.array_repeat(t, t["n"])))
    dealt = plain.unionByName(slices(crowded))
    parts = dealt.groupBy("conv_id", "part", "slice").agg(told.alias("told"))
    speakers = rows.filter(F.col("role").isNotNull() & ~F.col("role").isin(*system)).select(F.col("conv_id").alias("c"), F.col("role").alias("participant")).distinct()
    here = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("slice") == F.col("s"))
    views = parts.join(seats(dealt, speakers, system), here).select(
        "conv_id", "participant",
        (F.col("part") * BLOCK).cast("long").alias("part"),
        F.col("slice").cast("int").alias("slice"),
        "offset",
        F.transform("told", lambda t: t["role"]).alias("roles"),
        F.transform("told", lambda t: t["text"]).alias("texts"),
    )
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = ["conv_id", "participant", "part", "slice", "offset", "n_turns", "text", "masks"]

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                piece = batch.slice(a, 256)
                me, roles, texts = (piece.column(i).to_pylist() for i in (1, 5, 6))
                done = [render(list(zip(r, t)), m, system) for m, r, t in zip(me, roles, texts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *piece.columns[:5],
                        pa.array([len(r) for r in roles], pa.int32()),
                        pa.array([t for t, _ in done], pa.string()),
                        pa.array([[{"start": x, "end": y} for x, y in m] for _, m in done], span),
                    ],
                    names=names,
                )

    kind = turns.schema["conv_id"].dataType.simpleString()
    return views.mapInArrow(
        run, f"conv_id {kind}, participant string, part long, slice int, offset long, n_turns int, text string, masks array<struct<start: int, end: int>>"
    )
