"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Words in a block. A source's words taken are within a few blocks of its target.
BLOCK = 128

#: Rows in a range whose rows one task numbers or sums up.
RANGE = 4_000

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)

#: Share of all words that the mix has, and how often at most a source goes through it.
SHARE, REPEATS = 1.5, 2

#: The golden ratio's fraction, as a number of 128 bits: slot i has the point frac(i * GOLDEN / 2 ** 128).
GOLDEN = (math.isqrt(5 << 256) - (1 << 128)) >> 1


def point(slot: Column) -> Column:
    """The golden-ratio point of a slot below 2 ** 63, off by at most 2 ** -34: i * GOLDEN in doubles would have 16 bits
    of its fraction left at 10 ** 11 slots, so each 16 bits of the slot are multiplied by a fraction of their own."""
    out = F.lit(0.0)
    for k in range(0, 64, 16):
        fraction = ((GOLDEN << k) % (1 << 128)) / (1 << 128)
        out = out + F.shiftrightunsigned(slot, k).bitwiseAND(0xFFFF) * F.lit(fraction) % 1.0
    return out % 1.0


def n_words(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null has none."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "x")
    return F.length(F.regexp_replace(spaced, "[\\x20\\x09-\\x0D]+", "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources in code point order, null last, get the weights in turn. A target is weight * level but at most repeats *
    size; the level is where all targets add up to share * all sizes. Sorted by size / weight, the sources below the
    level come first, so the level is the one quotient that fits, which running sums give for every place at once.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    named = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", repeats * F.col("source_size").cast("double"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    up_to, before = by_ratio.rowsBetween(Window.unboundedPreceding, 0), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * share
    capped, open_weight = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = named.withColumn("level", (total - capped) / open_weight)
    # the first place whose own cap is not below the level
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    levelled = levels.withColumn("level", F.first(fits, ignorenulls=True).over(up_to)).withColumn("level", F.max("level").over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return levelled.select("source", "source_size", target.alias("target"))


def _numbered(df: DataFrame, group: list[str], rough: str, order: list[str], amount: str, out: str) -> DataFrame:
    """df with `out`: the sum of `amount` over the rows of the same group before each row, ordered by (rough, order).

    rough is a number of ranges within a group: a range's rows are summed in one window each, and the ranges' own sums
    are summed up apart, so that no task holds a hot group.
    """
    inner = Window.partitionBy(*group, rough).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(rough).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*group, rough).agg(F.sum(amount).alias("_sum"))
    offsets = sums.select(*group, rough, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_offset"))
    within = df.withColumn("_within", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    keys = [*group, rough]
    joined = within.join(offsets.select(*(F.col(k).alias(f"_{k}") for k in keys), "_offset"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_within")).alias(out))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, schedule, takes).

    documents: (row, id, text_hash, source, size, source_size, target), row being a number of its own for every row;
    takes: (slot, source, row, id, text_hash, pass, first_word, n_words), the mix in the order of its slots. schedule: (slot, source, rank). A source's words, its documents in an order shuffled by hash,
    form blocks of `block` words; after the last the source starts again, at most `repeats` times in all. Slot i has the
    golden-ratio point i, mapped through the targets' cumulative shares to a source; it takes the source's block of
    the slot's rank. Equal input and seed give an equal mix. Null texts and texts without words have size 0 and are
    never taken; the null source is one source; null and repeated ids are rows like others, and rows of equal id and
    text are taken as often as rows of different ones; a text of any length is one document; an empty table gives
    empty results; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    docs = cut(docs.withColumn("row", F.monotonically_increasing_id()))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goals = cut(targets(sizes.select("source", "source_size"), weights, share, repeats).join(sizes.select(F.col("source").alias("_s"), "n_docs"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))

    total = goals.agg(F.sum("target")).first()[0] or 0.0
    slots = int(total / block + 0.5)
    bounds = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    cumulative = goals.withColumn("upper", F.sum("target").over(bounds) / F.lit(total or 1.0)).select("source", "source_size", "n_docs", "target", "upper", (F.col("upper") - F.col("target") / F.lit(total or 1.0)).alias("lower"))
    arcs = cumulative.filter("target > 0").select("source", "source_size", "lower", "upper")
    schedule = _schedule(docs, arcs, slots)
    schedule = _numbered(schedule.withColumn("one", F.lit(1)).withColumn("part", F.floor(F.col("slot") / RANGE)), ["source"], "part", ["slot"], "one", "rank").select("slot", "source", "source_size", "rank")

    hashed = docs.filter("size > 0").join(goals.select(F.col("source").alias("_s"), "n_docs", "source_size"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    hashed = hashed.withColumn("shuffled", F.xxhash64("id", "text_hash", F.lit(seed))).withColumn("part", F.pmod(F.xxhash64("shuffled", F.lit(1)), F.ceil(F.col("n_docs") / RANGE)))
    laid = _numbered(hashed, ["source"], "part", ["shuffled", "id", "row"], "size", "start")

    # what each document gives to the blocks of each pass
    passes = laid.withColumn("pass", F.explode(F.array(*(F.lit(i) for i in range(repeats))))).withColumn("begin", F.col("start") + F.col("pass") * F.col("source_size"))
    touched = passes.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
    low = F.greatest(F.col("begin"), F.col("rank") * block)
    high = F.least(F.col("begin") + F.col("size"), (F.col("rank") + 1) * block)
    shares = touched.select("row", "id", "text_hash", "source", "pass", "rank", (low - F.col("begin")).alias("first_word"), (high - low).alias("n_words"))
    used = schedule.select(F.col("source").alias("_s"), F.col("rank").alias("_r"), "slot")
    takes = shares.join(used, F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r"))).select("slot", "source", "row", "id", "text_hash", "pass", "first_word", "n_words")

    described = docs.join(goals.select(F.col("source").alias("_s"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_s")), "left")
    named = lambda frame: frame.withColumnRenamed("id", id_col)
    return named(described.select("row", "id", "text_hash", "source", "size", "source_size", "target")), schedule.select("slot", "source", "rank"), named(takes)


def _schedule(docs: DataFrame, arcs: DataFrame, slots: int) -> DataFrame:
    """(slot, source, source_size): the arc that holds each slot's point.

    Points and arcs meet in cells of the unit interval: an arc is entered in each of the cells that it touches, the
    cells being a few times as many as the arcs, so the join is on equal cells and not a product.
    """
    spark = docs.sparkSession
    n = max(1, arcs.count())
    cells = 8 * n
    points = spark.range(slots).withColumnRenamed("id", "slot")
    points = points.withColumn("point", point(F.col("slot"))).withColumn("cell", F.least(F.floor(F.col("point") * cells), F.lit(cells - 1)))
    entered = arcs.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") * cells), F.least(F.floor(F.col("upper") * cells), F.lit(cells - 1)))))
    highest = arcs.agg(F.max("upper")).first()[0]
    inside = (F.col("point") >= F.col("lower")) & ((F.col("point") < F.col("upper")) | (F.col("upper") == F.lit(highest or 1.0)))
    return points.join(entered, "cell").filter(inside).select("slot", "source", "source_size")
