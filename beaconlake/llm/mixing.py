"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share is above ``max_epochs`` times its
size is clamped there, and what it leaves is shared among the others by weight, until none is above.
Each document is then taken whole as often as its source's target holds whole epochs. What is left of the
target is filled by one more copy of some documents, first fit in order of a seeded hash: a document is taken
if it fits into what is still missing. Rounds do this without putting rows in order. A round takes the
documents that are no larger than what is missing, up to the one at which their running total passes it; the
next round goes on after that one with what is missing then. Rounds end where a source has nothing left that
fits, or misses no more than ``TOLERANCE`` of its target; at last one more document is taken if that comes
nearer. So a source is off its target by ``TOLERANCE`` of it or by less than half of the smallest document
that was not taken.

Where a running total passes is found by lanes: words are summed by ``2 ** LANE_BITS`` ranges of the hash per
source, the range that holds the place is split anew, and so on until it has ``FEW`` documents or is one
hash. No task orders more than a source's ranges or these few documents, however many rows a source has.

Defined cases: a null or blank text has size 0; the null source is a source of its own and the last
in the order; sources without words get target 0; rows that agree in doc_id and text share a hash and
are taken alike; an empty table gives an empty result; extra columns of any name stay in :func:`mixed` and are
left out by :func:`planned`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm.common import discard, materialize, n_words_of, of

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2.0
SEED = 20_24
#: Up to so many sources are sent to every executor; more go through a shuffled join.
BROADCAST_SOURCES = 10_000
#: Part of a target that may be missing; bits of the hash of a lane; documents that one task may put in order.
TOLERANCE = 1e-4
LANE_BITS, FEW = 10, 4096


def _ranked(sources: DataFrame) -> DataFrame:
    """sources and place, from 0 in code-point order with null last; each task orders a range of them."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(F.broadcast(offsets), "part").select(  # a row a partition
        "source", "source_size", (F.col("own") + F.col("offset")).alias("place")
    )


def targets(
    sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS
) -> DataFrame:
    """sizes has source and source_size, a row a source. Adds target, the source's words in the mix.

    The water level only rises, so a round needs no more than the level: it sums the weights that are
    still free and the caps of the clamped, and the driver sees these sums alone.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = _ranked(sizes).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap"))
    ranked = materialize(ranked, "weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, clamped = 0.0, -1
    while True:
        above = F.col("cap") <= F.col("weight") * F.lit(level)
        got = ranked.agg(
            F.sum(F.when(above, F.col("cap"))).alias("caps"),
            F.sum(F.when(~above, F.col("weight"))).alias("weights"),
            F.sum(above.cast("long")).alias("n"),
        ).first()
        if (got["n"] or 0) == clamped:
            break
        clamped = got["n"] or 0
        if not got["weights"]:
            break
        level = max(level, (budget * total - (got["caps"] or 0.0)) / got["weights"])
    return ranked.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.lit(level)).alias("target"))


def sized(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> DataFrame:
    """doc (the input's row), source, size and key, the seeded hash."""
    key = F.xxhash64(F.lit(seed), of(doc_id), F.coalesce(of(text).cast("string"), F.lit("")))
    rows = docs.select(F.struct("*").alias("doc"))
    return rows.select("doc", of(source).alias("source"), n_words_of(of(text).cast("string")).alias("size"), key.alias("key"))


def _side(table: DataFrame) -> DataFrame:
    """A table of a row a source, sent to all executors if it is small."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def passing(rows: DataFrame, few: int = FEW) -> DataFrame:
    """Per source (column of): hi, the hash at which the running total of size passes missing, null where it doesn't,
    and got, the total before it. rows has of, missing (of its source), key and size.
    """
    shift, found, done = 64 - LANE_BITS, None, []
    while True:
        lane = F.shiftright("key", shift) if shift else F.col("key")
        here = rows
        if found is not None:
            at = found.select(F.col("of").alias("at"), "prefix", "before")
            here = rows.join(_side(at), rows["of"].eqNullSafe(F.col("at")) & (F.shiftright("key", last) == F.col("prefix")))
        here = here.withColumn("before", F.lit(0).cast("long")) if found is None else here
        sums = here.groupBy("of", "missing", "before", lane.alias("lane")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        upto = Window.partitionBy("of").orderBy("lane").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(upto))  # of 2 ** LANE_BITS rows a source, or FEW
        over = F.when(F.col("upto") > F.col("missing"), F.struct("lane", (F.col("upto") - F.col("words")).alias("before"), "docs"))
        found = sums.groupBy("of").agg(F.min(over).alias("over"), F.max("upto").alias("all"))
        found = materialize(found.select("of", F.col("over.lane").alias("prefix"), F.coalesce("over.before", "all").alias("before"), "over.docs"), "lanes")
        if shift == 0:
            done.append(found.select("of", F.col("prefix").alias("hi"), F.col("before").alias("got")))
            break
        none = found.filter("prefix is null").select("of", F.lit(None).cast("long").alias("hi"), F.col("before").alias("got"))
        done.append(none)
        found_more = found.filter("prefix is not null")
        most = found_more.agg(F.max("docs")).first()[0]
        if most is None:
            break
        found, last = found_more, shift
        shift = 0 if most <= few else max(0, shift - LANE_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _fits(rules: str, key: str = "key", size: str = "size") -> Column:
    """Whether a round took a document."""
    k, n = F.col(key), F.col(size)
    return F.exists(rules, lambda r: (k >= r["lo"]) & (r["hi"].isNull() | (k < r["hi"])) & (n <= r["fit"]))


def filled(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source of goal (source, target, rest): rules, the rounds that take documents once more, and one, a further hash.

    rows has source, size and key.
    """
    rule = "array<struct<lo: bigint, hi: bigint, fit: bigint>>"
    now = goal.select(
        F.col("source").alias("of"), "target", F.floor(F.col("rest") + 1e-6).cast("long").alias("missing"),
        F.lit(-(1 << 63)).cast("long").alias("lo"), F.expr(f"cast(array() as {rule})").alias("rules"), F.lit(False).alias("closed"),
    )
    now = materialize(now, "fill")
    while True:
        open_ = now.filter(~F.col("closed") & (F.col("missing") > TOLERANCE * F.col("target")))
        if open_.isEmpty():
            break
        side = _side(open_.select("of", "missing", "lo"))
        fits = rows.join(side, rows["source"].eqNullSafe(side["of"])).filter("size > 0 and size <= missing and key >= lo")
        got = passing(fits.select("of", "missing", "key", "size")).withColumnRenamed("of", "got_of")
        step = now.join(got, F.col("of").eqNullSafe(F.col("got_of")) & ~F.col("closed"), "left")
        ran = F.col("got").isNotNull()
        new = F.array(F.struct(F.col("lo").alias("lo"), F.col("hi").alias("hi"), F.col("missing").alias("fit"))).cast(rule)
        # A source in which nothing fitted any more, or all of it did, is closed.
        after = step.select(
            "of", "target", F.when(ran, F.col("missing") - F.col("got")).otherwise(F.col("missing")).alias("missing"),
            F.when(ran & F.col("hi").isNotNull() & (F.col("hi") < F.lit((1 << 63) - 1)), F.col("hi") + 1).otherwise(F.col("lo")).alias("lo"),
            F.when(ran, F.concat("rules", new)).otherwise(F.col("rules")).alias("rules"),
            (F.col("closed") | ~ran | F.col("hi").isNull() | (F.col("hi") == F.lit((1 << 63) - 1))).alias("closed"),
        )
        later = materialize(after, "fill")
        discard(now)
        now = later
    # One more, if that comes nearer than to leave the rest out.
    side = _side(now)
    near = rows.join(side, rows["source"].eqNullSafe(side["of"])).filter("size > missing and size < 2 * missing").filter(~_fits("rules"))
    units = near.groupBy("of", "missing", "key").agg(F.sum("size").alias("words")).filter("words < 2 * missing")
    one = units.groupBy(F.col("of").alias("one_of")).agg(F.min(F.struct((F.col("words") - F.col("missing")).alias("off"), "key")).alias("best"))
    return now.join(one, F.col("of").eqNullSafe(F.col("one_of")), "left").select("of", "rules", F.col("best.key").alias("one"))


def _plan(
    rows: DataFrame, weights: tuple[float, ...], budget: float, max_epochs: float
) -> DataFrame:
    """Per source: of (its name), source_size, target, epochs, rules and one."""
    narrow = materialize(rows.select("source", "size", "key"), "sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights, budget, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("epochs", F.floor(rate + 1e-12).cast("long"))
    goal = materialize(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")
    extra = filled(narrow, goal)
    plan = goal.join(extra, F.col("source").eqNullSafe(F.col("of")), "left").select(
        F.col("source").alias("of"), "source_size", "target", "epochs", "rules", "one"
    )
    plan = materialize(plan, "mix")
    discard(narrow, goal)
    return plan


def _planned(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows of :func:`sized` and source_size, target and copies."""
    side = _side(plan)
    more = _fits("rules") | F.coalesce(F.col("key") == F.col("one"), F.lit(False))
    told = rows.join(side, rows["source"].eqNullSafe(side["of"]))
    return told.select("doc", "size", "source_size", "target", (F.col("epochs") + more.cast("long")).alias("copies"))


def planned(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken."""
    rows = sized(docs, text, source, doc_id, seed)
    told = _planned(rows, _plan(rows, weights, budget, max_epochs))
    return told.select(of(doc_id).alias("doc_id"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(
    docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET, max_epochs: float = MAX_EPOCHS, seed: int = SEED,
) -> DataFrame:
    """The mix: each row of docs as often as it is taken, with the columns of docs."""
    rows = sized(docs, text, source, doc_id, seed)
    told = _planned(rows, _plan(rows, weights, budget, max_epochs)).filter("copies > 0")
    return told.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
