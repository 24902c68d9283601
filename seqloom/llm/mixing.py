"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Targets: source weights share the words of all documents; a source's target stops at `most` times
its own words, and the excess goes to the others by weight until no target is above (water-filling).

Rates: among document rates r in (0, most], those nearest to 1 in relative entropy that meet
sum(size * r) = target for each source. A document's divergence counts size / tilt: one of a larger tilt
gives way more easily. The dual is convex and separates by source; its solution tilts exponentially,
r = min(most, exp(lambda * tilt)). Newton steps on the lambdas, from 0 on, need two sums per source and
step, which are aggregated over all documents; a step that leaves the interval known to hold the solution is
replaced by its middle, and while that interval is open on a side, steps there at most triple. Lambdas are
sought in units of a source's largest tilt, so tilts of any scale reach their targets. Unless a tilt is named, it falls from 1.5 to 0.5 as documents grow, so that short
ones are dropped or repeated first and long ones stay near one copy.

Copies: every document gets floor(r) copies; what that leaves of the target is handed out in an order that
a hash of the document draws by what floor(r) cuts off: first those whose draw lies under that fraction, then
the others. A document that does not fit what is left is passed over; after the last one, further copies go
out in the same order, until no document with fewer than `most` copies fits. Each round sums words per
(source, stretch of the order) and orders by row the stretch where what is left runs out; nothing limits
the rounds. The stretches grow in number with the root of the documents, and no window spans more than one
of them, or more than the stretches of a source.

Documents with a null text have size 0, take part and take nothing. A null source is a source of its
own, last in order. Repeated rows count as often as they occur, get equal copies, and must fit together.
An empty table gives an empty result. Columns that the input has beside id, text and source are
ignored. A named tilt that is null, not finite or not positive counts as 1. The sums of a step are sums of
integers (whole words, and the rest in units of 2^-26 words), which don't depend on the order of rows, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import checkpointed, scratch

#: The least number of stretches that either half of a source's order is cut into.
BUCKETS = 4_096
#: Sources up to which per-source rows are broadcast; the count is taken first, and beyond it they are shuffled.
BROADCAST_SOURCES = 50_000
#: Parts of a word that sums of doubles are taken to.
UNIT = float(1 << 26)


def word_count(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+, 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def _small(by_source: DataFrame, count: int) -> DataFrame:
    return F.broadcast(by_source) if count <= BROADCAST_SOURCES else by_source


def targets(sources: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources(source, source_size, ...) with `weight` and `target`.

    Weights repeat over the sources in code-point order, null last. The order needs one window over
    the sources, not over documents. Each round of the water-filling reads two sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.array(*[F.lit(w) for w in weights])
    ranked = checkpointed(sources.withColumn("weight", F.element_at(pick, ((F.row_number().over(order) - 1) % len(weights)) + 1)))
    total = ranked.agg(F.sum("source_size").alias("s")).first().s or 0
    level = 0.0
    while True:
        capped = F.col("source_size") * most <= F.lit(level) * F.col("weight")
        row = ranked.agg(F.sum(F.when(~capped, F.col("weight"))).alias("w"), F.sum(F.when(capped, F.col("source_size") * most)).alias("c")).first()
        if not row.w:
            break
        following = (total - (row.c or 0)) / row.w
        if following <= level:
            break
        level = following
    return ranked.withColumn("target", F.least(F.lit(float(level)) * F.col("weight"), (F.col("source_size") * most).cast("double")))


def exact_sum(x: Column) -> Column:
    """The sum of a column of non-negative doubles, each taken to 2^-26: a sum of integers, alike in any order of rows."""
    whole = F.floor(x)
    return F.sum(whole) + F.sum(F.round((x - whole) * UNIT).cast("bigint")) / UNIT


def rates(docs: DataFrame, balanced: DataFrame, most: int = 3) -> DataFrame:
    """balanced(source, source_size, target, widest) with `lam`, the dual solution; docs holds source, size and tilt (positive), widest is a source's largest tilt.

    Steps end when sources meet their targets to a billionth, or when doubles hold no lambda between the two that are known.
    """
    f = F.col("tilt") / F.col("widest")
    rate = F.least(F.lit(float(most)), F.exp(F.col("lam") * f))
    start = {"lam": F.lit(0.0), "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "off": F.lit(1.0)}
    lam = checkpointed(balanced.withColumns(start))
    count, kept = lam.count(), [c for c in balanced.columns if c != "source"]
    step = 0
    while not lam.where("off > 0").isEmpty():
        step += 1
        # a source's row goes along with its sums, so that a step needs no join but the one with the documents
        current = _small(lam.withColumnRenamed("source", "of"), count)
        free = F.when(rate < most, F.col("size") * f * rate).otherwise(0.0)
        met = docs.select("source", "size", "tilt").join(current, F.col("source").eqNullSafe(F.col("of")))
        sums = met.groupBy(F.col("of").alias("source"), *kept, "lam", "lo", "hi", "off").agg(exact_sum(F.col("size") * rate).alias("got"), exact_sum(free).alias("slope"))
        gap, at = F.col("target") - F.col("got"), F.col("lam")
        low, high = F.when(gap > 0, at).otherwise(F.col("lo")), F.when(gap < 0, at).otherwise(F.col("hi"))
        below, above = F.coalesce(low, -3 * F.abs(at) - 1), F.coalesce(high, 3 * F.abs(at) + 1)
        newton = F.when(F.col("slope") > 0, at + gap / F.col("slope"))
        middle = F.when(low.isNull(), below).when(high.isNull(), above).otherwise((low + high) / 2)
        # every eighth step halves what is known, so that no shape of rates makes Newton steps creep
        following = F.when((newton > below) & (newton < above) & F.lit(step % 8 != 0), newton).otherwise(middle)
        reachable = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * (most * (1 - 1e-12)))
        open_ = (F.col("off") > 0) & (F.abs(gap) > 1e-9 * F.col("target") + 1e-6) & reachable & (following != at)
        lam = checkpointed(sums.select("source", *kept, F.when(open_, following).otherwise(at).alias("lam"), low.alias("lo"), high.alias("hi"), F.when(open_, 1.0).otherwise(0.0).alias("off")))
    return lam.select(*balanced.columns, (F.round("lam", 9) / F.col("widest")).alias("lam"))


def identity(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col))


class Mix:
    """What decides copies: tables of sources, rules of handing out, and repeated rows, all far smaller than the documents."""

    def __init__(self, docs: DataFrame, most: int, weights: tuple[int, ...], tilt: Column | None):
        """docs(source, size, h) and what tilt needs."""
        self.most = most
        row = docs.agg(F.count("*").alias("n"), F.sum("size").alias("s")).first()
        mean = max(1.0, (row.s or 0) / max(1, row.n))
        given = tilt.cast("double") if tilt is not None else None
        self.tilt = F.when((given > 0) & (given < float("inf")), given).otherwise(1.0) if tilt is not None else 0.5 + 1 / (1 + F.col("size") / mean)
        self.buckets = max(BUCKETS, int(row.n**0.5))
        spark = docs.sparkSession
        with scratch(spark) as keep:
            sized = docs.withColumn("tilt", self.tilt)
            widest = F.coalesce(F.max(F.when(F.col("size") > 0, F.col("tilt"))), F.lit(1.0))
            balanced = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), widest.alias("widest")), most, weights)
            solved = keep(checkpointed(rates(sized, balanced, most)))
            self.count = solved.count()
            self.by = solved.select(F.col("source").alias("of"), "source_size", "target", "lam")
            rated = checkpointed(self.rated(docs))
            left = rated.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("size"))).alias("left"))
            units = checkpointed(rated.where(F.col("whole") < most).groupBy("source", "b", "h", "whole").agg(F.sum("size").alias("cost"), F.count("*").alias("n")).where("cost > 0"))
            self.rules = keep(checkpointed(handed_out(units.drop("n"), left, most, self.count).withColumnRenamed("source", "rs")))
            self.tables = [solved]
            self.several = keep(checkpointed(units.where("n > 1").select(F.col("source").alias("us"), F.col("h").alias("uh"), F.col("whole").alias("uw"), F.col("cost").alias("together"))))
            self.tables += [self.rules, self.several]

    def rated(self, docs: DataFrame) -> DataFrame:
        """docs with source_size, target, rate, whole (its floor) and b, its stretch of the order."""
        out = docs.join(_small(self.by, self.count), F.col("source").eqNullSafe(F.col("of")))
        full = F.col("target") >= F.col("source_size") * (self.most * (1 - 1e-12))
        rate = F.when(full, F.lit(float(self.most))).otherwise(F.least(F.lit(float(self.most)), F.exp(F.col("lam") * self.tilt)))
        out = out.withColumn("rate", F.when(F.col("target") > 0, rate).otherwise(0.0))
        out = out.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.col("rate"))).withColumn("whole", F.floor("rate"))
        draw, cut = (F.pmod("h", F.lit(1 << 52)) + 0.5) / float(1 << 52), F.col("rate") - F.col("whole")
        order = F.when(draw < cut, draw / cut).otherwise(1 + (draw - cut) / (1 - cut))
        return out.withColumn("b", F.floor(order * self.buckets)).drop("of", "lam")

    def copied(self, docs: DataFrame) -> DataFrame:
        """docs with rate and copies."""
        ruled = self.rated(docs).join(_small(self.rules, self.count), F.col("source").eqNullSafe(F.col("rs")))
        ruled = ruled.join(self.several, F.col("source").eqNullSafe(F.col("us")) & (F.col("h") == F.col("uh")) & (F.col("whole") == F.col("uw")), "left")
        cost, place = F.coalesce("together", "size"), F.struct("b", "h", "whole")

        def holds(rule: Column) -> Column:
            after = rule["lo"].isNull() | (place > rule["lo"])
            return (F.col("whole") + rule["turn"] <= self.most) & (cost <= rule["limit"]) & ((cost > 0) | rule["first"]) & after & (rule["hi"].isNull() | (place < rule["hi"]))

        return ruled.withColumn("copies", (F.col("whole") + F.size(F.filter("rules", holds))).cast("int"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, weights: tuple[int, ...] = (1, 2, 3), tilt: str | None = None) -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken = copies * size."""
    columns = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), identity(id_col, text_col).alias("h")]
    docs = checkpointed(df.select(*columns, *([F.col(tilt).alias("given")] if tilt else [])))
    out = Mix(docs, most, weights, F.col("given") if tilt else None).copied(docs)
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"))


def handed_out(units: DataFrame, left: DataFrame, most: int, count: int) -> DataFrame:
    """(source, rules): which of units(source, b, h, whole, cost) get a further copy, as stretches of hash order.

    The order of places is (turn, b, h, whole), where each turn is one more copy; a unit that does not fit
    what is left is passed over, and as less and less is left it never fits again. So a round takes all
    that fit the start of it, up to the first place where they do not fit together; the next round starts
    behind that place with what is left then. Rounds end when no unit below `most` copies fits.
    """
    place = F.struct("b", "h", "whole")
    shape = "struct<b:bigint,h:bigint,whole:bigint>"
    rule = f"struct<turn:int,lo:{shape},hi:{shape},limit:double,first:boolean>"
    least = units.groupBy("source").agg(F.min("cost").alias("least")).withColumnRenamed("source", "of")
    state = left.join(least, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "left", "least", F.lit(1).alias("turn"), F.lit(None).cast(shape).alias("lo"), F.array().cast(f"array<{rule}>").alias("rules"))
    state = checkpointed(state)
    active = (F.col("left") >= F.col("least")) & (F.col("turn") <= most)
    while not state.where(active).isEmpty():
        now = state.where(active).select(F.col("source").alias("of"), "left", "turn", "lo")
        room = units.join(_small(now, count), F.col("source").eqNullSafe(F.col("of")))
        room = room.where((F.col("whole") + F.col("turn") <= most) & (F.col("cost") <= F.col("left")) & (F.col("lo").isNull() | (place > F.col("lo")))).drop("of")
        sums = room.groupBy("source", "b").agg(F.sum("cost").alias("words"), F.max("left").alias("left"))
        running = sums.withColumn("through", F.sum("words").over(Window.partitionBy("source").orderBy("b")))
        stop = F.min(F.when(F.col("through") > F.col("left"), F.struct("b", (F.col("through") - F.col("words")).alias("before"))))
        reach = checkpointed(running.groupBy("source").agg(F.max("through").alias("all"), stop.alias("x")).select(F.col("source").alias("of"), "all", F.col("x.b").alias("cut"), F.col("x.before").alias("before")))
        edge = room.join(_small(reach.where("cut is not null"), count), F.col("source").eqNullSafe(F.col("of")) & (F.col("b") == F.col("cut")))
        edge = edge.withColumn("through", F.col("before") + F.sum("cost").over(Window.partitionBy("source", "b").orderBy("h", "whole")))
        stops = edge.where(F.col("through") > F.col("left")).groupBy("source").agg(F.min(F.struct("b", "h", "whole", (F.col("through") - F.col("cost")).alias("took"))).alias("x"))
        stops = stops.select(F.col("source").alias("ss"), F.struct("x.b", "x.h", "x.whole").cast(shape).alias("hi"), F.col("x.took").alias("took"))
        found = state.join(_small(reach, count), F.col("source").eqNullSafe(F.col("of")), "left").join(_small(stops, count), F.col("source").eqNullSafe(F.col("ss")), "left")
        made = F.struct("turn", "lo", "hi", F.col("left").alias("limit"), (F.size("rules") == 0).alias("first")).cast(rule)
        ends = active & F.col("hi").isNull()
        state = checkpointed(
            found.select(
                "source",
                F.when(active, F.col("left") - F.coalesce("took", "all", F.lit(0))).otherwise(F.col("left")).alias("left"),
                "least",
                F.when(ends, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"),
                F.when(active, F.col("hi")).otherwise(F.col("lo")).alias("lo"),
                F.when(active, F.concat("rules", F.array(made))).otherwise(F.col("rules")).alias("rules"),
            )
        )
    return state.select("source", "rules")


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, weights: tuple[int, ...] = (1, 2, 3), tilt: str | None = None) -> DataFrame:
    """The rows of df, all columns, each as often as the mix takes it.

    Rows stay where they are: sources and rules, which are small, come to them. A row travels as one
    column, so its names meet no others.
    """
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    columns = [F.col(f"row.{source_col}").alias("source"), word_count(F.col(f"row.{text_col}")).alias("size"), identity(f"row.{id_col}", f"row.{text_col}").alias("h")]
    given = [F.col(f"row.{tilt}").alias("given")] if tilt else []
    with scratch(df.sparkSession) as keep:
        docs = checkpointed(row.select(*columns, *given))
        plan = Mix(docs, most, weights, F.col("given") if tilt else None)
        for table in plan.tables:
            keep(table)
    taken = plan.copied(row.select("row", *columns, *given)).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
