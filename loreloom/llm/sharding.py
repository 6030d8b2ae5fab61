"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters are good enough."""

from __future__ import annotations

from bisect import bisect_right
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The sort key is (crc32 of the text, id), so equal texts lie together and yet can be split. As one number it has 96
#: bits: 32 of the checksum, and 64 of the id with its sign turned, which keeps the order.
KEY_BITS = 96

#: A round refines each open splitter by this many bits at most, to 1,024 new probes each, and by fewer where there are
#: many splitters: the driver gets at most 2 ** PROBE_BITS counts a round.
ROUND_BITS, PROBE_BITS = 10, 18

#: Each shard is exchanged and sorted in so many ranges at least, and in more where one would hold over RANGE_ROWS rows.
FINE, RANGE_ROWS = 16, 2_000_000

#: How far a splitter may be off, as a share of a range.
TOLERANCE = 0.02

#: Texts of one checksum are kept together if they are at most this share of a range.
WHOLE = 0.5


def _add(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def _digits(level: int, bits: int) -> Column:
    """The key's `bits` bits from bit `level` (from the top) on, as a long; levels don't straddle checksum and id."""
    if level < 32:
        return F.shiftrightunsigned("text_crc32", 32 - level - bits).bitwiseAND((1 << bits) - 1)
    turned = F.coalesce(F.col("id"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63)))
    return F.shiftrightunsigned(turned, KEY_BITS - level - bits).bitwiseAND((1 << bits) - 1)


def _steps(wanted: int) -> list[tuple[int, int]]:
    """(level, bits) of the rounds for so many ranges."""
    most = max(1, min(ROUND_BITS, PROBE_BITS - wanted.bit_length()))
    out = []
    for start, end in ((0, 32), (32, KEY_BITS)):
        while start < end:
            bits = min(most, end - start)
            out.append((start, bits))
            start += bits
    return out


def splitters(keys: DataFrame, wanted: int) -> list[int]:
    """wanted - 1 keys that cut the bytes of `keys` (id, size, text_crc32) into near equal ranges.

    Each splitter is known to lie under a prefix of the key. A round counts the exact bytes of each prefix that holds
    an open splitter, one digit deeper, by a grouped sum with partial sums on the tasks; the driver gets at most 1,024
    rows a splitter. A splitter closes once a probe beside it is within the tolerance, and at a border of a checksum's
    texts if these are at most the share WHOLE of a range.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    slack, whole = TOLERANCE * total / wanted, WHOLE * total / wanted
    found: dict[int, int] = {}
    # prefix (as a number of `level` bits) -> (bytes below it, splitters under it)
    opened: dict[int, tuple[int, list[int]]] = {0: (0, [*range(1, wanted)])}
    for level, bits in _steps(wanted):
        if level:
            # the open prefixes, at most wanted - 1, in two longs
            rows = [(k >> (level - 32) if level > 32 else k, (k & ((1 << (level - 32)) - 1)) if level > 32 else 0, k) for k in opened]
            numbered = keys.sparkSession.createDataFrame([(a, b, i) for i, (a, b, _) in enumerate(rows)], "p long, q long, which int")
            names = [k for *_, k in rows]
            p = F.shiftrightunsigned("text_crc32", max(0, 32 - level))
            q = F.shiftrightunsigned(F.coalesce(F.col("id"), F.lit(-(1 << 63))).bitwiseXOR(F.lit(-(1 << 63))), KEY_BITS - level) if level > 32 else F.lit(0).cast("long")
            inside = keys.withColumns({"p": p, "q": q}).join(F.broadcast(numbered), ["p", "q"])
        else:
            inside, names = keys.withColumn("which", F.lit(0)), [0]
        counted = inside.groupBy("which", _digits(level, bits).alias("digit")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
        by_prefix: dict[int, list] = {}
        for r in counted:
            by_prefix.setdefault(names[r["which"]], []).append((r["digit"], r["bytes"], r["n"]))
        after: dict[int, tuple[int, list[int]]] = {}
        for prefix, (below, which) in opened.items():
            cells = sorted(by_prefix.get(prefix, []))
            ends, sums = [], below
            for _, b, _ in cells:
                sums += b
                ends.append(sums)
            rest = KEY_BITS - level - bits
            for j in which:
                goal = j * total / wanted
                i = min(bisect_right(ends, goal), len(cells) - 1)
                low, high = (ends[i - 1] if i else below), ends[i]
                digit, _, n = cells[i]
                start = ((prefix << bits) | digit) << rest
                one = n == 1 or level + bits == 32 and high - low <= whole
                if goal - low <= slack or one and goal - low <= high - goal:
                    found[j] = start
                elif high - goal <= slack or one:
                    found[j] = start + (1 << rest)
                else:
                    after.setdefault((prefix << bits) | digit, (low, []))[1].append(j)
        if not (opened := after):
            break
    for prefix, (_, which) in opened.items():  # rows of one key: they can't be split
        found |= dict.fromkeys(which, prefix)
    return [found[j] for j in sorted(found)]


def _range(keys: DataFrame, cuts: list[int]) -> DataFrame:
    """keys with `fine`: how many of the splitters are at or below the key.

    A cell is the top bits of the checksum. The table of cells is broadcast: one row a cell, at most 4,096, that holds
    the number of splitters before the cell and those inside it.
    """
    bits = 12
    cells: dict[int, list[int]] = {}
    for c in cuts:
        cells.setdefault(c >> (KEY_BITS - bits), []).append(c)
    rows, before = [], 0
    for cell in range(1 << bits):
        own = cells.get(cell, [])
        rows.append((cell, before, [(c >> 64, (c & ((1 << 64) - 1)) - (1 << 63)) for c in own]))
        before += len(own)
    table = keys.sparkSession.createDataFrame(rows, "cell long, before int, cuts array<struct<c: long, d: long>>")
    own = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    inside = F.size(F.filter("cuts", lambda x: (x["c"] < F.col("text_crc32")) | ((x["c"] == F.col("text_crc32")) & (x["d"] <= own))))
    joined = keys.withColumn("cell", F.shiftrightunsigned("text_crc32", 32 - bits)).join(F.broadcast(table), "cell")
    return joined.select("id", "size", "text_crc32", (F.col("before") + inside).alias("fine"))


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row: shards of near equal bytes, in order of (text_crc32, id).

    size is the text's UTF-8 length plus 1; null texts count as empty. Splitters are found for `FINE` ranges a shard;
    the rows are then exchanged once, by range, and numbered within their shard from 0 without gaps. A group of equal
    texts stays together unless it is larger than half a range. Null ids come first; every row gives one row, and rows
    with the same text and id share a range, in any order; texts of any length are taken whole; an empty table gives an
    empty result; other columns are ignored.
    """
    from pyspark.sql import Window

    keys = cut(_add(df, id_col, text_col))
    fine = max(FINE, math.ceil(keys.count() / shards / RANGE_ROWS))
    cuts = splitters(keys, shards * fine)
    ranged = _range(keys, cuts)
    counted = {r["fine"]: r["count"] for r in ranged.groupBy("fine").count().collect()}  # at most shards * fine rows
    offsets, rows = 0, []
    for i in range(shards * fine):
        offsets = 0 if i % fine == 0 else offsets
        rows.append((i, offsets))
        offsets += counted.get(i, 0)
    starts = df.sparkSession.createDataFrame(rows, "fine int, start long")
    placed = ranged.join(F.broadcast(starts), "fine")
    order = Window.partitionBy("fine").orderBy("text_crc32", "id")
    return placed.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.floor(F.col("fine") / fine).cast("int").alias("shard"),
        (F.col("start") + F.row_number().over(order) - 1).alias("slot"),
    )


def spread(sizes: list[int]) -> float:
    """Largest size against the mean."""
    return max(sizes) / (math.fsum(sizes) / len(sizes)) if sizes and sum(sizes) else 1.0
