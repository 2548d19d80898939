"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame expressions only.

Every document of a source has the same expected number of copies, target / source size. Its whole
part is given; the fractions play in duels. A duel moves words, fraction times size, from one
document to the other until a fraction becomes 0 or 1; the direction is drawn by chances that
leave each expectation as it was, and the words of the two together stay the same. Duels run in a
tree of rounds: a round deals the open documents of a source to groups of about ``GROUP``, each
folded from its largest document to its smallest, so that the one that stays open, if any, is
small. The one document of a source that is open in the end goes to the nearer side, which is all
that its source's words move.

All draws are hashes of document keys, the seed and the round: reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathfold.llm.batches import unused
from pathfold.session import cut_lineage, stored

GROUP = 64
RUN = 4096  # equal rows that one row stands for until the end
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def source_targets(units: DataFrame, weights: tuple[int, ...], cap: float) -> DataFrame:
    """(nosource, src, source_size, target) from units with nosource, src, words.

    The weights repeat over the sources by code point, null last. Targets share all words by
    weight, at most ``cap`` times their source's; what is above goes to the others by weight. In
    the order of cap over weight, the capped sources come first, so one pass finds the level.
    """
    sizes = units.groupBy("nosource", "src").agg(F.sum("words").alias("source_size"))
    nth = F.row_number().over(Window.orderBy("nosource", "src")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("weight", F.get(cycle, F.pmod(nth, F.lit(len(weights)))))
    s = s.withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("key", F.col("most") / F.col("weight"))
    earlier = Window.orderBy("key", "nosource", "src").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    level = left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("nth", F.row_number().over(Window.orderBy("key", "nosource", "src")))
    fits = F.min(F.when(F.col("key") >= F.col("level"), F.struct("nth", "level"))).over(whole)
    s = s.withColumn("share", fits["level"])
    target = F.when(F.col("share").isNull(), F.col("most")).otherwise(F.least("most", F.col("share") * F.col("weight")))
    return s.select("nosource", "src", "source_size", target.alias("target"))


def draw(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


FIELDS = ("size", "doc_id", "key", "n", "base")


def member(x: Column, p: Column) -> Column:
    return F.struct(*[x[f].alias(f) for f in FIELDS], p.alias("p"))


def settled(x: Column, p: Column) -> Column:
    return F.struct(*[x[f].alias(f) for f in FIELDS], F.when(p < 0.5, 0).otherwise(1).alias("bit"))


def duel(items: Column, seed: Column) -> Column:
    """Fold an array of open documents: (held: the one still open, or null, done: the settled ones)."""
    unit = "struct<size:bigint,doc_id:bigint,key:bigint,n:bigint,base:bigint,p:double>"
    done = "array<struct<size:bigint,doc_id:bigint,key:bigint,n:bigint,base:bigint,bit:int>>"
    start = F.struct(F.lit(None).cast(unit).alias("held"), F.array().cast(done).alias("done"))
    one = F.lit(1.0)

    def step(acc: Column, x: Column) -> Column:
        a = acc["held"]
        # How far a may rise (x falls), and fall (x rises); a step of 1 moves size(a) * size(x) words.
        rise_a, rise_x = (one - a["p"]) / x["size"], x["p"] / a["size"]
        fall_a, fall_x = a["p"] / x["size"], (one - x["p"]) / a["size"]
        rise, fall = F.least(rise_a, rise_x), F.least(fall_a, fall_x)
        up = draw(seed, a["doc_id"], a["key"], x["doc_id"], x["key"]) * (rise + fall) < fall
        pa = F.when(up, a["p"] + rise * x["size"]).otherwise(a["p"] - fall * x["size"])
        px = F.when(up, x["p"] - rise * a["size"]).otherwise(x["p"] + fall * a["size"])
        # Bound once, so that the draw and the new fractions are not worked out again and again.
        return F.transform(
            F.array(F.struct(pa.alias("a"), px.alias("x"))),
            lambda q: F.when(a.isNull(), F.struct(member(x, x["p"]).alias("held"), acc["done"].alias("done"))).otherwise(
                F.struct(
                    F.when(is_open(q["a"]), member(a, q["a"])).when(is_open(q["x"]), member(x, q["x"])).alias("held"),
                    F.concat(
                        acc["done"],
                        F.when(is_open(q["a"]), F.array(settled(x, q["x"])))
                        .when(is_open(q["x"]), F.array(settled(a, q["a"])))
                        .otherwise(F.array(settled(a, q["a"]), settled(x, q["x"]))),
                    ).alias("done"),
                )
            ),
        )[0]

    return F.aggregate(items, start, step)


def is_open(p: Column) -> Column:
    return (p > EPS) & (p < 1 - EPS)


SOURCE = ["nosource", "src", "source_size", "target"]


def plan_documents(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 0
) -> DataFrame:
    """(doc_id, text_key, source, size, n_rows, source_size, target, copies), a row a document.

    A document's size is its number of words; null and empty texts have none. Equal rows (doc_id,
    source, text) are one document of ``n_rows`` rows, whose size counts that often. The sources'
    targets are those of :func:`source_targets`; copies times size, summed over a source, comes
    near its target, and no document has more than ``cap`` copies a row. A null source is a source
    of its own, the last one. A source without words has target 0 and no copies. An empty table
    gives an empty table. Extra columns are ignored.
    """
    one = docs.select(
        "doc_id",
        F.xxhash64("text").alias("key"),
        F.col("source").isNull().alias("nosource"),
        F.coalesce("source", F.lit("")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    units = cut_lineage(one.groupBy("doc_id", "key", "nosource", "src", "size").agg(F.count("*").alias("n")))
    targets = source_targets(units.withColumn("words", F.col("size") * F.col("n")), weights, cap)
    members = units.groupBy("nosource", "src").agg(F.count("*").alias("width"))
    shares = stored(members.join(targets, ["nosource", "src"]))  # a row a source
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(cap)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    expected = ratio * F.col("n")
    base = F.floor(expected + EPS).cast("long")
    placed = units.join(shares, ["nosource", "src"]).select(
        *SOURCE, "width", "size", "doc_id", "key", "n", base.alias("base"), F.greatest(F.lit(0.0), expected - base).alias("p")
    )
    # Without a fraction there is nothing to round, without words nothing to move.
    flat = F.col("size") == 0
    lone = (draw(F.lit(seed * 1000 + 998), F.col("doc_id"), F.col("key")) < F.col("p")).cast("int")
    fixed = placed.filter(flat | (F.col("p") <= EPS)).select(*SOURCE, *FIELDS, F.when(flat, lone).otherwise(0).alias("bit"))
    open_ = placed.filter(~flat & (F.col("p") > EPS)).select(*SOURCE, "width", *FIELDS, "p")
    largest = shares.agg(F.max("width")).first()[0] or 0
    outcomes = [fixed]
    level = 0

    def settle(rows: DataFrame, by: list[str], label: int) -> DataFrame:
        """A round: fold each group; its settled documents go to the outcomes, the open ones remain."""
        items = F.sort_array(F.collect_list(F.struct(*FIELDS, "p")), asc=False)
        folded = cut_lineage(
            rows.groupBy(*by).agg(items.alias("items")).select(*by, duel(F.col("items"), F.lit(seed * 1000 + label)).alias("end"))
        )
        outcomes.append(folded.select(*SOURCE, F.explode("end.done").alias("d")).select(*SOURCE, "d.*"))
        return folded.filter(F.col("end.held").isNotNull()).select(*by, "end.held.*")

    while largest > 1:
        dealt = open_.withColumn("width", F.ceil(F.col("width") / GROUP)).withColumn(
            "group", F.pmod(F.xxhash64(F.lit(seed * 1000 + level), "doc_id", "key"), F.col("width"))
        )
        open_ = settle(dealt, [*SOURCE, "width", "group"], level).drop("group")
        largest = 1 if largest <= GROUP else -(-largest // GROUP)
        level += 1
    outcomes.append(open_.select(*SOURCE, *FIELDS, F.when(F.col("p") < 0.5, 0).otherwise(1).alias("bit")))
    every = outcomes[0]
    for more in outcomes[1:]:
        every = every.unionByName(more)
    return every.select(
        "doc_id",
        F.col("key").alias("text_key"),
        F.when(~F.col("nosource"), F.col("src")).alias("source"),
        "size",
        F.col("n").alias("n_rows"),
        "source_size",
        "target",
        (F.col("base") + F.col("bit")).alias("copies"),
    )


def plan_mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 0
) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies), a row for each row of ``docs``.

    The copies of :func:`plan_documents`, dealt evenly to the rows of a document: its equal rows
    differ by one copy at most, and none has more than ``cap`` copies. Odd rows are those of
    :func:`plan_documents`.
    """
    plan = plan_documents(docs, weights, cap, seed)
    each, more = F.floor(F.col("copies") / F.col("n_rows")), F.col("copies") % F.col("n_rows")
    # Two numbers of copies, each with its number of rows; these in runs, so that many equal rows are made by many tasks.
    kinds = F.array(
        F.struct((each + 1).alias("copies"), more.alias("rows")), F.struct(each.alias("copies"), (F.col("n_rows") - more).alias("rows"))
    )
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("kind.rows") - 1) / RUN))).alias("run")
    rest = ["doc_id", "text_key", "source", "size", "source_size", "target"]
    dealt = plan.select(*rest, "n_rows", F.explode(kinds).alias("kind")).filter("kind.rows > 0").select(*rest, "n_rows", "kind", start)
    length = F.least(F.lit(RUN), F.col("kind.rows") - F.col("run") * RUN).cast("int")
    few = dealt.filter(F.col("n_rows") <= RUN)
    many = dealt.filter(F.col("n_rows") > RUN).repartition("doc_id", "text_key", "kind.copies", "run")
    return few.unionByName(many).select(*rest, F.col("kind.copies").alias("copies"), F.explode(F.array_repeat(F.lit(0), length)).alias("row")).drop("row")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 0) -> DataFrame:
    """The rows of ``docs``, each as often as the plan of :func:`plan_documents` takes its document.

    Of several equal rows (doc_id, source, text) any one stands for all; their extra columns may
    differ, and one of them is repeated. Columns stay as they are.
    """
    names = unused(docs.columns, "__id", "__key", "__source", "__rows", "__copies", "__copy")
    own_id, own_key, own_source, n_rows, copies, copy = names
    plan = plan_documents(docs, weights, cap, seed).filter("copies > 0")
    taken = plan.select(*[F.col(c).alias(x) for c, x in zip(("doc_id", "text_key", "source", "n_rows", "copies"), names)])
    match = (
        F.col("doc_id").eqNullSafe(F.col(own_id))
        & (F.xxhash64("text") == F.col(own_key))
        & F.col("source").eqNullSafe(F.col(own_source))
    )
    found = docs.join(taken, match)
    single = found.filter(F.col(n_rows) == 1)
    several = found.filter(F.col(n_rows) > 1).dropDuplicates([own_id, own_key, own_source])
    rows = single.unionByName(several)
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)).drop(copy)
