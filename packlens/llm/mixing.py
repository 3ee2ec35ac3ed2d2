"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each source gets a word target. Its documents are taken whole-number times plus
once more for those whose hash lies under a threshold; the threshold comes from
histograms of words by hash bucket, refined level by level inside the one bucket
where the budget ends. Of the few documents on either side of the threshold those
are then taken or left that bring the source nearest its target, all combinations
considered. No document is sorted and no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_words, materialize, shuffle_partitions

#: Bits of a histogram level, and levels: 40 bits of hash are told apart.
LEVEL_BITS, LEVELS = 10, 4
#: A source is repeated at most so often.
MAX_REPEATS = 3
#: Documents around a threshold that are considered once more, and parts in which those of a source are looked for.
BORDER, PARTS = 12, 64


def number_in_order(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in the global order ``by`` without a single-task window.

    Rows are dealt by range and written; each range is numbered on its own and
    shifted by the count of the ranges before it (one row per range).
    """
    n = shuffle_partitions(df.sparkSession)
    dealt = materialize(df.repartitionByRange(n, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(*by)
    return dealt.join(starts, "_range").withColumn(name, F.row_number().over(inside) - 1 + F.col("_start")).drop("_range", "_start")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0) -> DataFrame:
    """Targets by source of ``sizes(source, size)``: source, source_size, weight, target.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all words. No target exceeds ``MAX_REPEATS`` times its source's
    words; what is above is shared again by weight until none is. Each round is
    one aggregate over one row per source; two numbers reach the driver.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    ranked = number_in_order(totals, [F.col("source").asc_nulls_last()], "rank")
    options = F.array(*[F.lit(float(w)) for w in weights])
    ranked = materialize(ranked.withColumn("weight", F.get(options, (F.col("rank") % len(weights)).cast("int"))), "source-weights")
    budget = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = F.col("source_size") * float(MAX_REPEATS)
    level, capped_before = 0.0, -1
    while True:
        capped = cap <= F.col("weight") * F.lit(level)
        n, held, weight = ranked.agg(F.count_if(capped), F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if n == capped_before:
            break
        capped_before = n
        level = (budget - (held or 0.0)) / weight if weight else float("inf")
    return ranked.select("source", "source_size", "weight", F.least(cap, F.col("weight") * F.lit(level)).alias("target"))


def slot_of() -> Column:
    """A document's place on the hash line of its source."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "source"), 64 - LEVEL_BITS * LEVELS)


def mix_plan(slim: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0) -> DataFrame:
    """How often documents come, by source, for ``slim(source, size, slot)``: source, source_size, target, repeats, cut, flips.

    All documents come ``repeats`` times, those with a slot below ``cut`` once more, but
    for those whose slot is among the ``flips``: with these it is the other way round.
    """
    goals = source_targets(slim.select("source", "size"), weights, share)
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_REPEATS))).otherwise(F.lit(0)).cast("int")
    goals = goals.withColumn("repeats", repeats).withColumn("left", F.greatest(F.col("target") - F.col("repeats") * F.col("source_size"), F.lit(0.0)))
    goals = materialize(goals, "mix-goals")
    cuts = materialize(hash_cuts(slim, goals.select("source", "left")), "mix-cuts")
    flips = border_flips(slim, cuts)
    held = goals.alias("g").join(cuts.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.source", "g.source_size", "g.target", "g.repeats", "c.cut")
    joined = held.alias("g").join(flips.alias("f"), F.col("g.source").eqNullSafe(F.col("f.source")), "left")
    return materialize(joined.select("g.source", "g.source_size", "g.target", "g.repeats", "g.cut", "f.flips"), "mix-plan")


def border_flips(slim: DataFrame, cuts: DataFrame) -> DataFrame:
    """``source, flips``: which slots near each source's cut to take or leave against it, so that least is missed of ``cuts(source, cut, left)``.

    The ``BORDER`` slots nearest to the cut are tried in all combinations, one row a source;
    of equally near ones the first in order of their numbers counts. Rows of one slot go together.
    """
    units = slim.where("size > 0").groupBy("source", "slot").agg(F.sum("size").alias("size"))
    held = units.alias("u").join(cuts.alias("c"), F.col("u.source").eqNullSafe(F.col("c.source"))).select("u.source", "u.slot", "u.size", "c.left", (F.col("u.slot") < F.col("c.cut")).alias("taken"), F.abs(F.col("u.slot") - F.col("c.cut")).alias("far"))
    part = Window.partitionBy("source", "taken", F.pmod(F.col("slot"), F.lit(PARTS))).orderBy("far", "slot")
    near = held.withColumn("_no", F.row_number().over(part)).where(F.col("_no") <= BORDER)
    whole = Window.partitionBy("source", "taken").orderBy("far", "slot")  # PARTS * BORDER rows at most
    near = near.withColumn("_no", F.row_number().over(whole)).where(F.col("_no") <= BORDER)
    unit = F.struct("_no", "slot", F.when(F.col("taken"), -F.col("size")).otherwise(F.col("size")).alias("change"))
    sides = near.groupBy("source").agg(F.first("left").alias("left"), *[F.array_sort(F.collect_list(F.when(F.col("taken") == side, unit))).alias(name) for name, side in (("below", True), ("above", False))])
    first = F.least(F.size("below"), F.greatest(F.lit(BORDER // 2), BORDER - F.size("above")))
    sides = sides.select("source", "left", F.concat(F.slice("below", F.lit(1), first), F.slice("above", F.lit(1), BORDER - first)).alias("units"))

    def in_choice(choice: Column, i: Column) -> Column:
        return F.getbit(choice, i) == 1

    def missed(choice: Column) -> Column:
        steps = F.transform("units", lambda u, i: F.when(in_choice(choice, i), u["change"]).otherwise(F.lit(0)))
        return F.abs(F.col("left") - F.aggregate(steps, F.lit(0).cast("long"), lambda total, x: total + x))

    every = F.expr("sequence(0L, shiftleft(1L, size(units)) - 1)")
    choices = F.transform(every, lambda c: F.struct(missed(c).alias("missed"), c.alias("choice")))
    best = sides.withColumn("best", F.array_min(choices)["choice"])
    flips = F.transform(F.filter(F.transform("units", lambda u, i: F.struct(u["slot"].alias("slot"), in_choice(F.col("best"), i).alias("on"))), lambda x: x["on"]), lambda x: x["slot"])
    return best.select("source", flips.alias("flips"))


def copies_of(repeats: Column, cut: Column, flips: Column, slot: Column) -> Column:
    """How often a document comes, given its source's row of the plan."""
    once_more = F.coalesce(slot < cut, F.lit(False)) != F.coalesce(F.array_contains(flips, slot), F.lit(False))
    return repeats + once_more.cast("int")


def sized(docs: DataFrame) -> DataFrame:
    return materialize(docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), slot_of().alias("slot")), "mix-sizes")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0) -> DataFrame:
    """Which documents a mix takes: doc_id, source, size, source_size, target, copies, taken.

    ``docs`` has doc_id, source and text; other columns are ignored. ``size`` is
    the text's word count (null text: 0). ``copies`` is how often the mix takes
    the document, ``taken`` copies times size. The choice depends on doc_id and
    source only, so reruns agree; rows equal in both are taken together. A null
    source is a source of its own (last), a null doc_id hashes like any value.
    An empty table gives no rows; a source without words has target 0.
    """
    slim = sized(docs)
    plan = mix_plan(slim, weights, share)
    joined = slim.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    copies = copies_of(F.col("p.repeats"), F.col("p.cut"), F.col("p.flips"), F.col("d.slot"))
    return joined.select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def hash_cuts(slim: DataFrame, budgets: DataFrame) -> DataFrame:
    """``source, cut, left``: the slot under which a source's documents still fit its ``left`` words, and what remains of these.

    At each level words are summed by (source, bucket) among the documents of the
    source's open bucket only; the bucket in which the running sum passes the
    budget is open at the next level. After the last level the open bucket is
    taken if all of it fits.
    """
    state = budgets.where(F.col("left") > 0).select("source", F.lit(0).cast("long").alias("prefix"), "left")
    for level in range(1, LEVELS + 1):
        bits = LEVEL_BITS * (LEVELS - level)
        bucket = F.shiftrightunsigned("d.slot", bits)
        inside = F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftrightunsigned("d.slot", bits + LEVEL_BITS) == F.col("s.prefix"))
        words = slim.alias("d").join(state.alias("s"), inside).groupBy("d.source", bucket.alias("prefix")).agg(F.sum("d.size").alias("words"), F.first("s.left").alias("left"))
        order = Window.partitionBy("source").orderBy("prefix")  # at most 2**LEVEL_BITS rows a source
        run = words.withColumn("before", F.sum("words").over(order) - F.col("words"))
        last = F.row_number().over(Window.partitionBy("source").orderBy(F.col("prefix").desc())) == 1
        open_ = run.withColumn("last", last).where((F.col("before") <= F.col("left")) & ((F.col("before") + F.col("words") > F.col("left")) | F.col("last")))
        first = F.row_number().over(Window.partitionBy("source").orderBy("prefix")) == 1
        state = materialize(open_.withColumn("first", first).where("first").select("source", "prefix", (F.col("left") - F.col("before")).alias("left"), "words"), f"mix-level{level}")
    fits = F.col("words") <= F.col("left")
    return state.select("source", (F.col("prefix") + fits.cast("long")).alias("cut"), (F.col("left") - F.when(fits, F.col("words")).otherwise(0)).alias("left"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0) -> DataFrame:
    """``docs`` as the mix has them: each row as often as the mix takes it; rows that it doesn't take go.

    Only one row per source is joined to the texts.
    """
    plan = mix_plan(sized(docs), weights, share).select(F.col("source").alias("_packlens_source"), "repeats", "cut", "flips")
    held = docs.withColumn("_packlens_slot", slot_of()).alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p._packlens_source")))
    copies = copies_of(F.col("p.repeats"), F.col("p.cut"), F.col("p.flips"), F.col("d._packlens_slot"))
    kept = held.select("d.*", copies.alias("_packlens_copies")).where("_packlens_copies > 0")
    return kept.withColumn("_packlens_copy", F.explode(F.sequence(F.lit(1), F.col("_packlens_copies")))).drop("_packlens_slot", "_packlens_copies", "_packlens_copy")


def mix_query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``mix_sources`` of all documents; its docstring states what null, empty and repeated rows give."""
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
