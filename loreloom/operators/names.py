"""Identity of names: similarity, best matches, duplicates, aliases, merges."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import text as T

from .graph import canonical_pair, collapse_edges
from .scopes import check_scope, live

#: From this similarity on two names are taken for one, and from the lower one on they are suggested.
SAME, SUGGEST = 0.90, 0.72

#: A name whose words are all in another one gets at least this much.
CONTAINED = 0.75


def numbered_trigrams(key: Column) -> Column:
    """The key's trigrams with the number of each repeat, so that a set of them is the multiset."""
    return T.let(F.sort_array(T.trigrams(key)), lambda ordered: F.transform(ordered, lambda x, i: F.concat(x, (i - F.array_position(ordered, x) + 1).cast("string"))))


def _measured(a: Column, b: Column, x: Column, y: Column, u: Column, v: Column) -> Column:
    """Similarity of the keys a and b with the trigrams x and y and the words u and v."""
    inside = (F.size(F.array_except(u, v)) == 0) | (F.size(F.array_except(v, u)) == 0)
    lifted = lambda dice: F.when(inside, F.greatest(dice, CONTAINED + (1 - CONTAINED) * dice)).otherwise(dice)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(T.let(2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y)), lifted))


def similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of two keys' trigrams, more if all words of one are in the other; empty keys are like nothing."""
    parts = F.struct(numbered_trigrams(a).alias("x"), numbered_trigrams(b).alias("y"), F.split(a, " ").alias("u"), F.split(b, " ").alias("v"))
    return T.let(parts, lambda p: _measured(a, b, p["x"], p["y"], p["u"], p["v"]))


#: At most so many of the most frequent trigrams are sent to the tasks that order those of keys; all others count as rare.
HEAD = 1 << 17

#: From this threshold on, pairs differ by few trigrams and meet by several of their rarest ones.
STRICT = 0.85

#: Keys of a side that a task compares at a time, and how many meetings of keys it counts at a time.
TILE, MEETINGS = 1 << 14, 1 << 17


def _numbered(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many trigrams each key has, and for all of them, key by key, the key's place, the trigram as a number (21 bits a
    character) and how often the key has had it before."""
    n = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
    points = np.frombuffer("".join(f"  {k} " for k in keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(keys)), n)
    at = np.arange(len(row)) + 2 * row
    gram = points[at] << 42 | points[at + 1] << 21 | points[at + 2] if len(row) else points
    order = np.lexsort((gram, row))
    gram = gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    here = np.arange(len(gram))
    return n, row, gram, here - np.maximum.accumulate(np.where(new, here, 0))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The numbers, hashed."""
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(by)
    return (x ^ x >> np.uint64(31)).view(np.int64)


def _coded(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many trigrams each key has, and for all of them, key by key, the key's place and one number for the numbered
    trigram: itself the first time, a hash for repeats."""
    n, row, gram, again = _numbered(keys)
    return n, row, np.where(again > 0, _mixed(gram + again * 0x1E3779B97F4A7C15) | -(1 << 63), gram)


def _frequent(keys: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent numbered trigrams in order, and how many of the keys have each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, n = np.unique(_coded(batch.column(0).to_pylist())[2], return_counts=True)
            yield pa.record_batch([pa.array(grams), pa.array(n.astype(np.int64))], ["gram", "n"])

    counted = keys.select("key").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    most = counted.orderBy(F.col("n").desc(), "gram").limit(head).toArrow().sort_by("gram")
    return most["gram"].to_numpy(), most["n"].to_numpy()


def _least(n: np.ndarray | int, m: np.ndarray | int, threshold: float) -> np.ndarray:
    """How many trigrams keys of n and m must share to reach the threshold."""
    return np.ceil((n + m) * (threshold / 2) - 1e-9).astype(np.int64)


def _signed(keys: DataFrame, block: list[str], threshold: float, frequent) -> DataFrame:
    """(block, key, s0, s1, part) of keys (block, key, sizes): 128 bits for the key's trigrams, and a row for each signature.

    Two keys of n and m trigrams that share o of them have k in common among the n - o + k rarest of one and the m - o + k
    rarest of the other. A signature is k of these together, for each of the sizes that the other side's keys have in the
    block; k is larger where few may differ, so that what meets is nearly a pair and their number grows with the keys.
    """
    kinds = {f.name: f.dataType.simpleString() for f in keys.schema if f.name != "sizes"}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for batch in batches:
            n, row, code = _coded(batch.column("key").to_pylist())
            at = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
            often = np.where(known[at] == code, counts[at], 0) if len(known) else np.zeros(len(code), np.int64)
            hashed = _mixed(code)
            bit = hashed & 127
            signs = np.zeros((2, len(batch)), np.uint64)
            for i in range(2):
                np.bitwise_or.at(signs[i], row, np.where(bit >> 6 == i, np.uint64(1) << (bit & 63).astype(np.uint64), np.uint64(0)))
            ordered = hashed[np.lexsort((code, often, row))]
            ends = np.cumsum(n)
            parts, ofs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            sizes = batch.column("sizes").to_pylist()
            groups: dict[tuple[int, int], list[int]] = {}
            for i, (size, others) in enumerate(zip(n.tolist(), sizes)):
                for m in others:
                    groups.setdefault((size, m), []).append(i)
            for (size, m), rows in groups.items():
                shared = int(_least(size, m, threshold))
                if shared > min(size, m):
                    continue
                apart = max(size, m) - shared
                k = min(shared, 3 if apart <= 1 else 2 if apart <= 4 else 1)
                of = np.array(rows)
                rare = ordered[(ends - n)[of][:, None] + np.arange(size - shared + k)]
                for chosen in combinations(range(rare.shape[1]), k):
                    made = np.full(len(of), max(size, m) << 32 | min(size, m), np.int64)
                    for c in chosen:
                        made = _mixed(made + rare[:, c])
                    parts.append(made)
                    ofs.append(of)
            part, of = np.concatenate(parts), np.concatenate(ofs)
            order = np.argsort(of, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(batch)))]).astype(np.int32)
            own = [batch.column(c) for c in kinds]
            yield pa.record_batch([*own, *(pa.array(x.view(np.int64)) for x in signs), pa.ListArray.from_arrays(pa.array(ends), pa.array(part[order]))], [*kinds, "s0", "s1", "parts"])

    made = keys.mapInArrow(sign, ", ".join([*(f"`{c}` {kind}" for c, kind in kinds.items()), "s0 long, s1 long, parts array<long>"]))
    return made.select(*kinds, "s0", "s1", F.explode("parts").alias("part"))


def _strict(keys: dict[str, DataFrame], block: list[str], threshold: float, head: int, dealt: int) -> DataFrame:
    """(block, a, b, similarity) of similar_keys for high thresholds: by signatures, and where one key's words are all in the
    other, by its rarest word."""
    spark = keys["a"].sparkSession
    frequent = spark.sparkContext.broadcast(_frequent(keys["a"].select("key").union(keys["b"].select("key")), head))
    sizes = {s: k.groupBy(*block).agg(F.collect_set(F.length("key") + 1).alias("sizes")) for s, k in keys.items()}

    def signed(s: str, other: str) -> DataFrame:
        rows = _signed(keys[s].join(sizes[other], block), block, threshold, frequent)
        return rows.repartition(dealt, "part", *block).select(*block, "part", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "s0", "s1")))

    n, m = F.length("key_a") + 1, F.length("key_b") + 1
    missed = lambda x, y: sum(F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(f"{c}_{y}"))) for c in ("s0", "s1"))
    least = (n + m) * (threshold / 2) - 1e-9
    met = signed("a", "b").join(signed("b", "a"), ["part", *block]).filter("key_a <> key_b")
    met = met.filter((n - missed("a", "b") >= least) & (m - missed("b", "a") >= least)).select(*block, F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()
    same = (keys["a"] if keys["a"] is keys["b"] else keys["a"].join(keys["b"], ["key", *block])).select(*block, F.col("key").alias("a"), F.col("key").alias("b"))

    words = {s: k.select(*block, "key", F.explode(F.array_distinct(F.split("key", " "))).alias("part")) for s, k in keys.items()}
    counts = words["a"].union(words["b"]).groupBy(*block, "part").agg(F.count("*").alias("freq"))
    rarest = lambda s: words[s].join(counts, [*block, "part"]).groupBy(*block, "key").agg(F.min(F.struct("freq", "part")).alias("r")).select(*block, F.col("r.part").alias("part"), F.col("key").alias(s))
    side = lambda s: words[s].select(*block, "part", F.col("key").alias(s))
    u, v = F.split("a", " "), F.split("b", " ")
    in_b, in_a = F.size(F.array_except(u, v)) == 0, F.size(F.array_except(v, u)) == 0
    held = rarest("a").join(side("b"), [*block, "part"]).filter("a <> b").filter(in_b).unionByName(side("a").join(rarest("b"), [*block, "part"]).filter("a <> b").filter(in_a & ~in_b))
    kinds = {f.name: f.dataType.simpleString() for f in keys["a"].schema}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measured = pa.array(_similarities(*(batch.column(c).to_pylist() for c in ("a", "b"))))
            yield pa.record_batch([*batch.columns, measured], [*batch.schema.names, "similarity"])

    pairs = met.unionByName(held.select(*block, "a", "b")).distinct()
    measured = pairs.mapInArrow(measure, ", ".join([*(f"`{c}` {kinds[c]}" for c in block), "a string, b string, similarity double"]))
    return same.withColumn("similarity", F.lit(1.0)).unionByName(measured.filter(F.col("similarity") >= threshold - 1e-12))


def _similarities(a: list[str], b: list[str]) -> np.ndarray:
    """The similarity of each key of a, none of them empty, with that of b at its place."""
    n, row, gram, again = _numbered(a + b)
    column = np.unique(gram, return_inverse=True)[1] * (again.max(initial=0) + 1) + again
    met = np.sort(row % max(1, len(a)) * (column.max(initial=0) + 1) + column)
    twice = met[1:][met[1:] == met[:-1]] // (column.max(initial=0) + 1)
    dice = 2.0 * np.bincount(twice, minlength=len(a)) / (n[: len(a)] + n[len(a) :])
    words = ((set(x.split(" ")), set(y.split(" "))) for x, y in zip(a, b))
    inside = np.fromiter((u <= v or v <= u for u, v in words), bool, len(a))
    return np.where(inside, np.maximum(dice, CONTAINED + (1 - CONTAINED) * dice), dice)


def _gathered(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts, starts + 1, … of each run, one run after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _postings(row: np.ndarray, column: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that have each column: where they start, how many they are, and all of them."""
    counts = np.bincount(column, minlength=columns)
    return np.cumsum(counts) - counts, counts, row[np.argsort(column, kind="stable")]


def _contained(left: list[str], right: list[str]) -> np.ndarray:
    """The pairs left * len(right) + right of keys of which one's words are all in the other, in order. A key meets those
    that have its rarest word, and these are looked at for the others."""
    ids: dict[str, int] = {}
    sides = []
    for keys in (left, right):
        words = [[ids.setdefault(w, len(ids)) for w in dict.fromkeys(key.split(" "))] for key in keys]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        sides.append((counts, np.repeat(np.arange(len(keys)), counts), np.fromiter((w for own in words for w in own), np.int64, counts.sum())))
    found = [np.zeros(0, np.int64)]
    for (counts, row, word), (_, other_row, other_word), turned in ((*sides, False), (*sides[::-1], True)):
        starts, n, rows = _postings(other_row, other_word, len(ids))
        order = np.lexsort((n[word], row))
        first = np.cumsum(counts) - counts
        rarest = word[order][first] if len(row) else word
        having = np.sort(other_row * len(ids) + other_word)
        ends = np.cumsum(n[rarest])
        a = 0
        while a < len(counts):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MEETINGS, "right")))
            asked = np.repeat(np.arange(a, b), n[rarest[a:b]])
            met = rows[_gathered(starts[rarest[a:b]], n[rarest[a:b]])]
            looked = np.repeat(np.arange(len(asked)), counts[asked])
            wanted = met[looked] * len(ids) + word[_gathered(first[asked], counts[asked])]
            at = np.minimum(np.searchsorted(having, wanted), max(0, len(having) - 1))
            all_in = np.bincount(looked, having[at] == wanted, len(asked)) == counts[asked] if len(asked) else np.zeros(0, bool)
            asked, met = asked[all_in], met[all_in]
            found.append(met * len(right) + asked if turned else asked * len(right) + met)
            a = b
    return np.unique(np.concatenate(found))


def _compared(left: list[str], right: list[str], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in left, places in right, similarities) of all pairs that reach the threshold, some at a time.

    A key of left meets those of right once for each trigram that they share, but for the most frequent ones, 64 at most:
    these are bits of a number, counted for what has met. A key for which these alone can do meets all.
    """
    n, row, gram, again = _numbered(left + right)
    column = np.unique(gram, return_inverse=True)[1] * (again.max(initial=0) + 1) + again
    column = np.unique(column, return_inverse=True)[1]
    mine, columns = row < len(left), int(column.max(initial=-1)) + 1
    n, m = n[: len(left)], n[len(left) :]
    starts, counts, rows = _postings(row[~mine] - len(left), column[~mine], columns)
    least = _least(n, m.min(initial=1 << 30), threshold)
    order = np.empty(columns, np.int64)
    order[np.argsort(-counts, kind="stable")] = np.arange(columns)

    def meetings(most: int) -> int:
        """How often keys meet if so many trigrams are bits."""
        common = order[column[mine]] < most
        alone = np.bincount(row[mine], common, len(left)) >= least
        return int(counts[column[mine]][~common].sum() + alone.sum() * len(right))

    place = np.where(order < min((0, 2, 4, 8, 12, 16, 24, 32, 48, 64), key=meetings), order, -1)
    bits = np.zeros(len(left) + len(right), np.uint64)
    at = np.flatnonzero(place[column] >= 0)
    np.bitwise_or.at(bits, row[at], np.uint64(1) << place[column[at]].astype(np.uint64))
    x, y = bits[: len(left)], bits[len(left) :]
    # what is left of the keys' trigrams, and for keys that the frequent ones alone can bring to the threshold a meeting with all
    rare = mine & (place[column] < 0)
    own_row, own_column = row[rare], column[rare]
    every = np.flatnonzero(np.bitwise_count(x) >= least)
    starts, counts, rows = np.append(starts, len(rows)), np.append(counts, len(right)), np.append(rows, np.arange(len(right)))
    own_row, own_column = np.append(own_row, every), np.append(own_column, np.full(len(every), columns))
    order = np.argsort(own_row, kind="stable")
    own_row, own_column = own_row[order], own_column[order]
    extra = np.zeros(len(left), np.int64)
    extra[every] = 1
    held = _contained(left, right)
    met_by = np.bincount(own_row, counts[own_column], len(left)).astype(np.int64)
    ends, edges = np.cumsum(met_by), np.append(0, np.cumsum(np.bincount(own_row, minlength=len(left))))
    width, a = len(right), 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MEETINGS, "right")))
        part = slice(edges[a], edges[b])
        flat = np.repeat(own_row[part] * width, counts[own_column[part]]) + rows[_gathered(starts[own_column[part]], counts[own_column[part]])]
        low, high = np.searchsorted(held, [a * width, b * width])
        flat = np.sort(np.concatenate([flat, held[low:high]]))
        new = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, np.int64)
        times, flat = np.diff(np.append(new, len(flat))), flat[new]
        i, j = flat // width, flat % width
        inside = np.zeros(len(flat), bool)
        inside[np.searchsorted(flat, held[low:high])] = True
        shared = times - inside - extra[i] + np.bitwise_count(x[i] & y[j])
        dice = 2.0 * shared / (n[i] + m[j])
        measured = np.where(inside, np.maximum(dice, CONTAINED + (1 - CONTAINED) * dice), dice)
        good = np.flatnonzero(measured >= threshold - 1e-12)
        yield i[good], j[good], measured[good]
        a = b


def _tiled(keys: dict[str, DataFrame], block: list[str], threshold: float, dealt: int, tile: int) -> DataFrame:
    """(block, a, b, similarity) of similar_keys for low thresholds, which far more pairs reach than share a rare part: the
    keys of a block are dealt out to tiles, in each of which a task compares all keys of one part with all of another.
    Of a table with itself only half of the tiles are made, and their pairs come out both ways."""
    same = keys["a"] is keys["b"]
    counted = keys["a"].groupBy(*block).agg(F.ceil(F.count("*") / tile).cast("int").alias("of_a"))
    if same:
        counted = counted.withColumn("of_b", F.col("of_a"))
    else:
        counted = counted.join(keys["b"].groupBy(*block).agg(F.ceil(F.count("*") / tile).cast("int").alias("of_b")), block)
    own = lambda of: F.pmod(F.xxhash64("key"), F.col(of)).cast("int")
    upto = lambda first, of: F.explode(F.sequence(first, of - 1))
    whole = keys["a"].join(counted, block)
    rows = whole.withColumn("i", own("of_a")).select(*block, "i", upto(F.col("i") if same else F.lit(0), F.col("of_b")).alias("j"), F.lit(0).alias("side"), "key")
    whole = keys["b"].join(counted, block).withColumn("j", own("of_b"))
    rows = rows.unionByName(whole.select(*block, upto(F.lit(0), F.col("j") + 1 if same else F.col("of_a")).alias("i"), "j", F.lit(1).alias("side"), "key"))
    # a number first, as texts that begin alike are slow to sort
    rows = rows.withColumn("tile", F.xxhash64(*block, "i", "j")).repartition(dealt, "tile").sortWithinPartitions("tile", *block, "i", "j", "side").drop("tile")
    kinds = {f.name: f.dataType.simpleString() for f in keys["a"].schema}

    def compare(key: tuple, sides: tuple[list[str], list[str]], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        left, right = (pa.array(side, pa.string()) for side in sides)
        heads = [pa.array([k], t) for k, t in zip(key, types[: len(block)])]
        mirrored = same and key[-2] != key[-1]
        for i, j, measured in _compared(*sides, threshold):
            for at in range(0, len(i), 1 << 17):
                x, y = left.take(pa.array(i[at : at + (1 << 17)])), right.take(pa.array(j[at : at + (1 << 17)]))
                zeros = pa.array(np.zeros(len(x), np.int64))
                own = [h.take(zeros) for h in heads]
                value = pa.array(measured[at : at + (1 << 17)])
                yield pa.record_batch([*own, x, y, value], [*block, "a", "b", "similarity"])
                if mirrored:
                    yield pa.record_batch([*own, y, x, value], [*block, "a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sides = None, ([], [])
        for batch in batches:
            types = [f.type for f in batch.schema]
            heads = [*batch.columns[: len(block) + 2]]
            new = np.zeros(len(batch), bool)
            for c in heads:
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            if len(batch):
                new[0] = True
            starts = np.flatnonzero(new).tolist()
            for a, b in zip(starts, [*starts[1:], len(batch)]):
                key = tuple(c[a].as_py() for c in heads)
                if key != here:
                    if here is not None and all(sides):
                        yield from compare(here, sides, types)
                    here, sides = key, ([], [])
                second = batch.column(len(block) + 2)[a:b].to_numpy(zero_copy_only=False)
                texts = batch.column(len(block) + 3)[a:b].to_pylist()
                cut = int(np.searchsorted(second, 1))
                sides[0].extend(texts[:cut])
                sides[1].extend(texts[cut:])
        if here is not None and all(sides):
            yield from compare(here, sides, types)

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in block), "a string, b string, similarity double"]))


def similar_keys(left: DataFrame, right: DataFrame, block: list[str], threshold: float, head: int = HEAD, tile: int = TILE) -> DataFrame:
    """(block, a, b, similarity): all pairs of distinct keys of left and right (block, key) that reach the threshold.

    High thresholds go by signatures of rare trigrams, whose meetings grow with the keys; low ones, which a fair share of
    all pairs can reach, by tiles of each block, in which tasks count common trigrams. No pair is missed by either.
    """
    # the work is in the pairs that meet, not in the rows, so the sizes that adaptive execution goes by don't tell it
    spark = left.sparkSession
    dealt = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = lambda df: df.select(*block, "key").filter("key <> ''").dropna(subset=block).distinct()
    keys = {"a": parts(left)}
    keys["b"] = keys["a"] if right is left else parts(right)
    return _strict(keys, block, threshold, head, dealt) if threshold >= STRICT else _tiled(keys, block, threshold, dealt, tile)


def best_match(needles: DataFrame, names: DataFrame, block: list[str], threshold: float = SAME) -> DataFrame:
    """needles (block, needle) with the outcome: none, unique or ambiguous, the candidates (similarity, id, name) and how
    many they are, `n`.

    Only names are compared, not aliases. Candidates come by falling similarity, then by id. They are collected for keys,
    of which there are fewer than names, and not at all where only n or the outcome is asked for.
    """
    # keys are made of distinct names, once these are dealt out, and a number comes first, as texts that begin alike are slow to sort
    own = names.groupBy(*block, "name").agg(F.count("*").alias("n"), F.collect_list("id").alias("ids")).withColumn("b", T.name_key(F.col("name")))
    asked = needles.select(*block, "needle").distinct().withColumn("a", T.name_key(F.col("needle")))
    near = similar_keys(asked.select(*block, F.col("a").alias("key")), own.select(*block, F.col("b").alias("key")), block, threshold)
    numbered = lambda df: df.withColumn("h", F.xxhash64("b", *block))
    named = numbered(own).groupBy("h", *block, "b").agg(F.sum("n").alias("n"), F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(i.alias("id"), F.col("name").alias("name"))))).alias("of"))
    order = F.transform("of", lambda x: F.struct((-F.col("similarity")).alias("down"), x["id"].alias("id"), x["name"].alias("name")))
    found = numbered(near).join(named, ["h", "b", *block]).groupBy(*block, "a").agg(F.sum("n").alias("n"), F.sort_array(F.flatten(F.collect_list(order))).alias("c"))
    found = found.select(*block, "a", "n", F.transform("c", lambda x: F.struct((-x["down"]).alias("similarity"), x["id"].alias("id"), x["name"].alias("name"))).alias("candidates"))
    out = asked.join(found, [*block, "a"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*block, "needle", "candidates", "n", F.when(F.col("n") <= 0, "none").when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("outcome"))


def duplicate_entities(entities: DataFrame, scope: str = "collection_id", threshold: float = SAME) -> DataFrame:
    """(scope, kind, a, b, similarity): live entities of a kind and scope whose names are one, a before b.

    Entities of one key are a class; each of them is paired with the class's first entity. Classes of similar keys are
    paired by their first ones. So all that are one are connected, with as many pairs as entities and similar keys, not
    as the square of a class.
    """
    block = [scope, "kind"]
    own = live(entities).filter(F.col(scope).isNotNull()).select(*block, "name", "id")
    # keys are made of distinct names, once these are dealt out; one value holds key and entity, so that the classes are made once
    named = own.select(*block, "name").distinct().withColumn("key", T.name_key(F.col("name"))).filter("key <> ''")
    lowest = own.groupBy(*block, "name").agg(F.min("id").alias("id")).withColumn("key", T.name_key(F.col("name"))).filter("key <> ''")
    first = lowest.groupBy(*block, "key").agg(F.min(F.struct("id", "key")).alias("f")).select(*block, F.col("f.key").alias("key"), F.col("f.id").alias("first"))
    of_name = named.join(first, ["key", *block]).select(*block, "name", "first")
    same = own.join(of_name, ["name", *block]).filter("id <> first").select(*block, F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    near = similar_keys(named, named, block, threshold).filter("a < b")
    of = lambda k: first.select(*block, F.col("key").alias(k), F.col("first").alias(f"first_{k}"))
    across = near.join(of("a"), [*block, "a"]).join(of("b"), [*block, "b"])
    return same.unionByName(across.select(*block, F.least("first_a", "first_b").alias("a"), F.greatest("first_a", "first_b").alias("b"), "similarity"))


def claims(entities: DataFrame) -> DataFrame:
    """entities with one row for each name that they answer to: `alias`, its `key`, and whether it is the name itself."""
    names = F.array_union(F.array(F.struct(F.col("name").alias("alias"), F.lit(True).alias("is_name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("alias"), F.lit(False).alias("is_name"))))
    exploded = entities.select("*", F.explode(names).alias("n")).select(*entities.columns, "n.alias", "n.is_name")
    return exploded.withColumn("key", T.name_key(F.col("alias"))).filter("key <> ''")


def alias_collisions(entities: DataFrame, scope: str = "collection_id") -> DataFrame:
    """(scope, a, b, alias): live entities of a scope that claim one key, each with the key's first claimant; the smallest
    of their names for it, over all keys that the two share so."""
    own = claims(live(entities).filter(F.col(scope).isNotNull()).select(scope, "id", "name", "aliases"))
    own = own.groupBy(scope, "key", "id").agg(F.min("alias").alias("alias"))
    first = own.groupBy(scope, "key").agg(F.min(F.struct("id", "alias")).alias("first"))
    pairs = own.join(first, [scope, "key"]).filter("id <> first.id")
    return pairs.groupBy(scope, F.col("first.id").alias("a"), F.col("id").alias("b")).agg(F.min(F.least("alias", "first.alias")).alias("alias"))


def add_aliases(entities: DataFrame, requests: DataFrame, scope: str = "collection_id") -> tuple[DataFrame, DataFrame]:
    """(entities with the aliases added, refused requests with a reason) for requests (id, alias).

    An alias whose key is another entity's in the scope is refused. Of requests of several entities for one key, those of
    the smallest id win. An alias that the entity has already changes nothing.
    """
    own = live(entities)
    taken = claims(own.select(scope, "id", "name", "aliases")).groupBy(scope, "key").agg(F.min("id").alias("owner"), F.max("id").alias("other"))
    asked = requests.select("id", F.trim("alias").alias("alias")).distinct().join(own.select("id", scope), "id", "left").withColumn("key", T.name_key(F.col("alias")))
    first = Window.partitionBy(scope, "key")
    judged = asked.withColumn("winner", F.min("id").over(first)).join(taken, [scope, "key"], "left")
    foreign = F.col("owner").isNotNull() & ((F.col("owner") != F.col("id")) | (F.col("other") != F.col("id")))
    known = asked.join(own.select("id"), "id", "left_anti").select("id", "alias", F.lit("not found").alias("reason"))
    judged = judged.filter(F.col(scope).isNotNull()).withColumn("reason", F.when(F.col("key") == "", "blank").when(foreign, "taken").when(F.col("winner") != F.col("id"), "claimed"))
    won = judged.filter("reason is null").groupBy("id").agg(F.sort_array(F.collect_set("alias")).alias("added"))
    merged = entities.join(won, "id", "left").withColumn("aliases", F.when(F.col("added").isNotNull(), F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array_except("added", F.array("name")))).otherwise(F.col("aliases")))
    return merged.select(entities.columns), judged.filter("reason is not null").select("id", "alias", "reason").union(known)


def remove_aliases(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """entities without the aliases of requests (id, alias), compared without regard to case."""
    gone = requests.groupBy("id").agg(F.collect_set(F.lower("alias")).alias("gone"))
    kept = F.filter("aliases", lambda a: ~F.array_contains(F.coalesce("gone", F.array().cast("array<string>")), F.lower(a)))
    return entities.join(gone, "id", "left").withColumn("aliases", kept).select(entities.columns)


def apply_alias_decisions(entities: DataFrame, findings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, findings, refused) for decisions (finding_id, accept, id, alias): an accepted suggestion adds the alias,
    a refused automatic one removes it; both close the finding."""
    added, refused = add_aliases(entities, decisions.filter("accept").select("id", "alias"))
    changed = remove_aliases(added, decisions.filter("not accept").select("id", "alias"))
    done = decisions.join(refused.select("id", "alias"), ["id", "alias"], "left_anti").select(F.col("finding_id").alias("id"), F.lit(True).alias("done"))
    closed = findings.join(done.distinct(), "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("done", F.lit(False))).select(findings.columns)
    return changed, closed, refused


def final_survivors(merges: DataFrame) -> DataFrame:
    """(loser, survivor) of merges (loser, survivor) with chains followed to their ends; a loop has no end and is left out."""
    steps = merges.select("loser", "survivor").filter("loser <> survivor").groupBy("loser").agg(F.min("survivor").alias("survivor")).checkpoint()
    n, done = steps.count(), 0
    # a step doubles the way that each merge has gone, until none goes further or only loops are left
    while (1 << done) <= n:
        nxt = steps.select(F.col("loser").alias("survivor"), F.col("survivor").alias("next"))
        if steps.join(nxt, "survivor", "left_semi").isEmpty():
            break
        steps = steps.join(nxt, "survivor", "left").select("loser", F.coalesce("next", "survivor").alias("survivor")).checkpoint()
        done += 1
    losers = steps.select(F.col("loser").alias("survivor"))
    return steps.join(losers, "survivor", "left_anti").select("loser", "survivor")


def merge_entities(entities: DataFrame, edges: DataFrame, findings: DataFrame, merges: DataFrame, collections: DataFrame, subs: DataFrame) -> dict[str, DataFrame]:
    """entities, edges, findings and rejected after merges (loser, survivor).

    Rejected are merges into oneself, of different kinds, and of missing or deleted entities. A survivor gets the loser's
    name and aliases, and its summary and notes if it has none of its own, or both under a heading; it turns stale. Edges
    of the loser move to the survivor, less loops, edges to deleted entities and edges out of scope, and are collapsed.
    The loser is marked as deleted, and findings that name it are closed.
    """
    alive = live(entities).select("id", "kind")
    judged = final_survivors(merges).unionByName(merges.filter("loser = survivor").select("loser", "survivor"))
    judged = judged.join(alive.select(F.col("id").alias("loser"), F.col("kind").alias("k1")), "loser", "left").join(alive.select(F.col("id").alias("survivor"), F.col("kind").alias("k2")), "survivor", "left")
    judged = judged.withColumn("reason", F.when(F.col("loser") == F.col("survivor"), "same entity").when(F.col("k1").isNull() | F.col("k2").isNull(), "not found").when(F.col("k1") != F.col("k2"), "different kinds"))
    moves = judged.filter("reason is null").select("loser", "survivor")
    lost = entities.join(moves, entities["id"] == moves["loser"]).select("survivor", "id", "name", "aliases", "summary", "notes")
    none = F.array().cast("array<string>")
    gained = lost.groupBy(F.col("survivor").alias("id")).agg(F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.concat(F.array("name"), F.coalesce("aliases", none)))))).alias("names"), F.sort_array(F.collect_list(F.struct("id", "name", "summary", "notes"))).alias("parts"))
    both = lambda c: F.when(T.nonblank(F.col(c)).isNull(), F.array_join(F.filter(F.transform("parts", lambda p: p[c]), lambda x: T.strip(x) != ""), "\n\n")).otherwise(F.concat(F.col(c), F.array_join(F.transform(F.filter("parts", lambda p: T.strip(p[c]) != ""), lambda p: F.concat(F.lit("\n\n## "), p["name"], F.lit("\n\n"), p[c])), "")))
    merged = entities.join(gained, "id", "left").join(moves.select(F.col("loser").alias("id"), F.lit(True).alias("lost")), "id", "left")
    hit = F.col("parts").isNotNull()
    merged = merged.withColumns({
        "aliases": F.when(hit, F.array_except(F.array_union(F.coalesce("aliases", none), "names"), F.array("name"))).otherwise(F.col("aliases")),
        "summary": F.when(hit, T.nonblank(both("summary"))).otherwise(F.col("summary")),
        "notes": F.when(hit, T.nonblank(both("notes"))).otherwise(F.col("notes")),
        "codex_stale": F.when(hit, True).otherwise(F.col("codex_stale")),
        "vault_deleted": F.when(F.coalesce("lost", F.lit(False)), True).otherwise(F.col("vault_deleted")),
    }).select(entities.columns)

    to = lambda c: moves.select(F.col("loser").alias(c), F.col("survivor").alias(f"new_{c}"))
    moved = edges.join(to("from_id"), "from_id", "left").join(to("to_id"), "to_id", "left")
    touched = moved.filter("new_from_id is not null or new_to_id is not null").withColumns({"from_id": F.coalesce("new_from_id", "from_id"), "to_id": F.coalesce("new_to_id", "to_id")}).select(edges.columns).filter("from_id <> to_id")
    rest = moved.filter("new_from_id is null and new_to_id is null").select(edges.columns)
    for c in ("from_id", "to_id"):
        touched = touched.join(live(merged).select(F.col("id").alias(c)), c, "left_semi")
    touched = check_scope(touched, merged, collections, subs).filter("allowed").select(edges.columns)
    pairs = touched.select(canonical_pair().alias("pair")).distinct()
    beside = rest.withColumn("pair", canonical_pair()).join(pairs, "pair", "left_semi").select(edges.columns)
    alone = rest.withColumn("pair", canonical_pair()).join(pairs, "pair", "left_anti").select(edges.columns)
    closed = findings.select("id", F.explode("parties").alias("loser")).join(moves.select("loser"), "loser", "left_semi").select("id", F.lit(True).alias("done")).distinct()
    after = findings.join(closed, "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("done", F.lit(False))).select(findings.columns)
    return {"entities": merged, "edges": alone.unionByName(collapse_edges(beside.unionByName(touched))), "findings": after, "rejected": judged.filter("reason is not null").select("loser", "survivor", "reason")}


