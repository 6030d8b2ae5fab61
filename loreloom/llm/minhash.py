"""Near-duplicate removal with HyperMinHash sketches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, chunks, codes, combine, components, cut, map_texts, mix, run_lengths, shingles, text_bytes, words

#: A sketch has 2 ** BUCKET_BITS registers of a leading-zero count and MANTISSA_BITS bits after it.
BUCKET_BITS, MANTISSA_BITS = 8, 10
REGISTERS, VALUE_BITS = 1 << BUCKET_BITS, 64 - BUCKET_BITS
EMPTY = np.uint16(0xFFFF)

#: Registers in a band. 51 bands of 5 find a pair of similarity 0.75 but for one chance in a million.
BAND = 5
BANDS = REGISTERS // BAND

#: How far the estimated similarity of a pair may lie below the limit: seven standard deviations at 0.75.
SLACK = 0.2

#: Classes in a block of sets that are compared with one another, and the shingles that close a block before.
BLOCK, BLOCK_SHINGLES = 512, 300_000

#: Buckets of more classes than this are compared in blocks, smaller ones pair by pair.
SMALL = 16


def _order() -> np.ndarray:
    """For each register, at which step it asks each bucket: a fixed random order of the buckets."""
    seeds = mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64).reshape(REGISTERS, REGISTERS) + np.uint64(0x51ED2701))
    return np.argsort(np.argsort(seeds, axis=1), axis=1).astype(np.int16)


ORDER = _order()


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers of sorted 64-bit hashes: the top bits choose the bucket, the smallest rest in it gives the register."""
    bucket, value = (hashes >> np.uint64(VALUE_BITS)).astype(np.int64), hashes & np.uint64((1 << VALUE_BITS) - 1)
    first, _ = run_lengths(bucket)
    bucket, value = bucket[first], value[first]
    length = np.frexp(value.astype(np.float64))[1].astype(np.int64)  # bits from the leading one on; 0 for value 0
    zeros = np.clip(VALUE_BITS - length, 0, VALUE_BITS)
    rest = (value << (zeros + 1).astype(np.uint64)) & np.uint64((1 << VALUE_BITS) - 1)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[bucket] = (zeros << MANTISSA_BITS).astype(np.uint16) | (rest >> np.uint64(VALUE_BITS - MANTISSA_BITS)).astype(np.uint16)
    if len(bucket) < REGISTERS:
        # an empty register takes over the first filled one in its own order, so that small sets can be compared too
        missing = np.flatnonzero(out == EMPTY)
        out[missing] = out[bucket[ORDER[missing][:, bucket].argmin(axis=1)]]
    return out


def document_shingles(column: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For chunks of texts: first row, number of words of each text, and rows and hashes of the distinct shingles of k words, sorted."""
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, rows = words(own, at)
        hashes = RollingHash(own, codes(fold=True)).ranges(starts, ends)
        counts = np.bincount(rows, minlength=b - a)
        found, first = shingles(hashes, rows, k)
        parts, owners = [found], [rows[first]]
        begins = np.cumsum(counts) - counts
        for n in range(1, k):  # fewer words: all of them are one shingle
            short = np.flatnonzero(counts == n)
            if len(short):
                parts.append(combine([hashes[begins[short] + i] for i in range(n)]))
                owners.append(short)
        found, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.lexsort((found, owner))
        found, owner = found[order], owner[order]
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        yield a, counts, owner[new], found[new]


def sketches(df: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, sketch) of (doc_id, text_hash, text): set_key is 16 bytes that stand for
    the set; without words it and the sketch are null."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, counts, owner, found in document_shingles(batch.column(2)):
            sizes = np.bincount(owner, minlength=len(counts))
            begins = np.cumsum(sizes) - sizes
            keys, sketch = [], []
            for start, size in zip(begins.tolist(), sizes.tolist()):
                own = found[start : start + size]
                keys.append(digest(own) if size else None)
                sketch.append(registers(own).tobytes() if size else None)
            part = batch.slice(a, len(counts))
            columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketch, pa.binary())]
            yield pa.record_batch(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "sketch"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return map_texts(df.select("doc_id", "text_hash", "text"), run, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, sketch binary")


def digest(found: np.ndarray) -> bytes:
    """16 bytes for a set of hashes."""
    with np.errstate(over="ignore"):
        other = mix(found ^ np.uint64(0x6A09E667F3BCC909))
        return np.array([found.sum(dtype=np.uint64), other.sum(dtype=np.uint64)]).tobytes()


def bands(sketched: DataFrame) -> DataFrame:
    """(band, class_id): a hash for each band of the compressed registers, with the class that has it."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(batch), 2000):
            part = batch.slice(a, 2000)
            own = _matrix(part.column(1))[:, : BANDS * BAND].reshape(-1, BANDS, BAND).astype(np.uint64)
            parts = [own[:, :, i].ravel() for i in range(BAND)]
            band = combine([*parts, np.tile(np.arange(BANDS, dtype=np.uint64), len(own))])
            yield pa.record_batch([pa.array(band.view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(), BANDS))], ["band", "class_id"])

    return map_texts(sketched.select("class_id", "sketch"), run, "band long, class_id long")


def corrected(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, corrected for registers that agree by chance."""
    ratio = np.maximum(n, m) / np.maximum(1, np.minimum(n, m))
    # fixed values: the published approximation of the expected collisions per bucket
    chance = 0.169919487159739093975315012348 * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (1 - chance)


def estimate(left: np.ndarray, right: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity of sets by their registers and sizes, row by row."""
    return corrected((left == right).mean(axis=1), n, m)


def class_sets(docs: DataFrame) -> DataFrame:
    """(class_id, n_shingles, sketch, grams) of (class_id, n_shingles, sketch, text): grams are the sorted hashes of the set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, counts, owner, found in document_shingles(batch.column(3)):
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64) * 8
            grams = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(found)]).cast(pa.binary())
            part = batch.slice(a, len(counts))
            yield pa.record_batch([*part.columns[:3], grams], ["class_id", "n_shingles", "sketch", "grams"])

    return map_texts(docs.select("class_id", "n_shingles", "sketch", "text"), run, "class_id long, n_shingles long, sketch binary, grams binary")


def _matrix(sketches_of: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sketches_of.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _verified(pairs: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough: an estimate by the sketches first, then the sets.

    pool: (class_id, n_shingles, sketch, grams) of all classes that share a bucket with another.
    """
    side = lambda x: pool.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    # a set can't be similar to one that is much larger
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(_sizes("n_a", "n_b", percent))

    def guess(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(batch), 5000):
            part = batch.slice(start, 5000)
            near = estimate(_matrix(part.column(4)), _matrix(part.column(5)), part.column(2).to_numpy(), part.column(3).to_numpy()) >= percent / 100 - SLACK
            yield part.select([0, 1]).filter(pa.array(near))

    likely = map_texts(sized.select("a", "b", "n_a", "n_b", "s_a", "s_b"), guess, "a long, b long")
    grams = lambda x: pool.select(F.col("class_id").alias(x), F.col("grams").alias(f"g_{x}"))

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        same = []
        for left, right in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            same.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return map_texts(likely.join(grams("b"), "b").join(grams("a"), "a").select("a", "b", "g_a", "g_b"), check, "a long, b long")


def _sizes(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


#: Links (a, b) between the classes of two blocks of (class_id, c, ...), or of one if they are the same, by their sets.
Links = Callable[[pa.StructArray, pa.StructArray, bool, int], list[tuple[int, int]]]


class _Block:
    """The classes of one block, in arrays."""

    def __init__(self, rows: pa.StructArray):
        self.ids, self.labels, self.sizes = (rows.field(k).to_numpy() for k in ("class_id", "c", "n_shingles"))
        self.registers = _matrix(rows.field("sketch"))
        self.grams = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.field("grams")]


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set on the left shares with each on the right: a product of their 0-1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(x, y)
    placed = []
    for flat, sets in ((x, left), (y, right)):
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        at, row = at[hit], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(at, kind="stable")
        placed.append((at[order], row[order]))
    for low in range(0, len(shared), 4096):
        parts = []
        for (at, row), n in zip(placed, out.shape):
            a, b = np.searchsorted(at, [low, low + 4096])
            matrix = np.zeros((n, min(4096, len(shared) - low)), np.float32)
            matrix[row[a:b], at[a:b] - low] = 1
            parts.append(matrix)
        out += parts[0] @ parts[1].T
    return out


def _links(left: pa.StructArray, right: pa.StructArray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between classes of two blocks (or of one, if they are the same), one for each two components joined."""
    x, y = _Block(left), _Block(right)
    equal = np.zeros((len(x.ids), len(y.ids)), np.int32)
    for r in range(REGISTERS):
        equal += x.registers[:, r, None] == y.registers[None, :, r]
    n, m = np.broadcast_arrays(x.sizes[:, None], y.sizes[None, :])
    likely = (corrected(equal / REGISTERS, n, m) >= percent / 100 - SLACK) & (x.labels[:, None] != y.labels[None, :]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
    if same:
        likely &= np.arange(len(x.ids))[:, None] < np.arange(len(y.ids))[None, :]
    left, right = np.flatnonzero(likely.any(axis=1)), np.flatnonzero(likely.any(axis=0))
    if not len(left):
        return []
    common = _common([x.grams[i] for i in left], [y.grams[j] for j in right])
    n, m = x.sizes[left, None], y.sizes[None, right]
    linked = likely[np.ix_(left, right)] & (100 * common >= percent * (n + m - common))
    i, j = np.nonzero(linked)
    return joining(x.ids[left[i]], y.ids[right[j]], x.labels[left[i]], y.labels[right[j]])


def joining(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
    """Of the links (a, b) between classes of labels c and d, one for each two components of labels joined."""
    labels, place = np.unique(np.concatenate([c, d]), return_inverse=True)
    _, first = np.unique(place[: len(c)] * len(labels) + place[len(c) :], return_index=True)
    parent, out = [*range(len(labels))], []

    def top(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for k in first:
        one, other = top(int(place[k])), top(int(place[len(c) + k]))
        if one != other:
            parent[other] = one
            out.append((int(a[k]), int(b[k])))
    return out


def _within_groups(groups: DataFrame, pool: DataFrame, percent: int, links: Links, rows: int) -> DataFrame:
    """Links (a, b) between classes of one group that have different labels, of groups (class_id, grp, c).

    A group's classes are dealt into blocks of about BLOCK classes of like set size, those of its commonest label apart.
    Blocks meet blocks whose sizes allow a link, unless both hold the commonest label; a task compares all classes of
    two blocks in matrices and returns links that join labels, fewer than the classes it has. rows: how many groups has
    at most.
    """
    most = groups.groupBy("grp", "c").count().groupBy("grp").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    level = F.floor(F.log("n_shingles") / math.log(100 / min(percent, 99))).cast("int")
    placed = groups.join(most, "grp").select("class_id", "grp", "c", (F.col("c") == F.col("main")).alias("main"))
    placed = cut(placed.join(pool.select("class_id", "n_shingles"), "class_id").withColumn("level", level), rows)
    keys = ["grp", "level", "main"]
    counted = placed.groupBy(*keys).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    dealt = placed.join(counted, keys).withColumn("part", F.pmod(F.xxhash64("class_id"), "parts")).drop("parts", "n_shingles")
    member = F.struct("class_id", "c", *(x for x in pool.columns if x != "class_id"))
    blocks = dealt.join(pool, "class_id").groupBy(*keys, "part").agg(F.collect_list(member).alias("members"))  # bounded by parts
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))
    x = blocks.select("grp", F.col("main").alias("main_x"), F.col("block").alias("x"), "level", F.explode(F.array("level", F.col("level") + 1)).alias("level_y"))
    y = blocks.select("grp", F.col("level").alias("level_y"), F.col("main").alias("main_y"), F.col("block").alias("y"))
    meet = ((F.col("level_y") > F.col("level")) | (F.col("y") >= F.col("x"))) & ~(F.col("main_x") & F.col("main_y"))
    pairs = x.join(y, ["grp", "level_y"]).filter(meet).select("x", "y")
    loaded = pairs.join(blocks.select(F.col("block").alias("x"), F.col("members").alias("left")), "x").join(blocks.select(F.col("block").alias("y"), F.col("members").alias("right")), "y")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i in range(len(batch)):
            same = batch.column(0)[i] == batch.column(1)[i]
            found = links(batch.column(2)[i].values, batch.column(3)[i].values, same, percent)
            yield pa.record_batch([pa.array([k[n] for k in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    return map_texts(loaded.select("x", "y", "left", "right"), run, "a long, b long")


def link_classes(buckets: DataFrame, scores: DataFrame, pool: DataFrame, percent: int, verified: Callable[[DataFrame, DataFrame, int], DataFrame] = _verified, within: Links = _links) -> DataFrame:
    """(class_id, component) of the classes that links join, of buckets (band, class_id, n) of n classes.

    scores: (class_id, score), how central a class is. pool: (class_id, n_shingles, ..., grams) of all classes in
    buckets. A class has a row in each of its buckets, so no table of labels or groups has more rows than buckets.
    verified gives those pairs (a, b) whose sets agree, within the links between two blocks of classes.
    """
    rows = buckets.count()
    scored = buckets.join(scores, "class_id")
    centres = scored.groupBy("band").agg(F.max_by("class_id", F.struct("score", -F.col("class_id"))).alias("a"), F.max("score").alias("s"))
    spokes = buckets.join(centres, "band").filter("class_id <> a").groupBy(F.col("class_id").alias("b")).agg(F.max_by("a", F.struct("s", -F.col("a"))).alias("a"))
    links = cut(verified(spokes.select("a", "b"), pool, percent))

    # a link leads from each class to a more central one: two jumps give labels that joined classes share, mostly all
    up = lambda x: links.select(F.col("b").alias(x), F.col("a").alias(f"{x}_up"))
    jump = links.join(up("a"), "a", "left").select("b", F.coalesce("a_up", "a").alias("a"))
    label = cut(jump.join(jump.select(F.col("b").alias("a"), F.col("a").alias("a_up")), "a", "left").select(F.col("b").alias("class_id"), F.coalesce("a_up", "a").alias("label")), rows)

    named = buckets.join(label, "class_id", "left").select("band", "class_id", "n", F.coalesce("label", "class_id").alias("c"))
    hub = centres.join(label.withColumnRenamed("class_id", "a"), "a", "left").select("band", F.coalesce("label", "a").alias("grp"))
    mixed = named.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").join(hub, "band").select("band", "grp")
    named = cut(named.join(mixed, "band"), rows)

    groups = cut(named.filter(F.col("n") > SMALL).select("class_id", "grp", "c").distinct(), rows)
    in_groups = _within_groups(groups, pool, percent, within, rows)

    own = groups.groupBy("class_id").agg(F.min("grp").alias("grp"))
    few = named.filter(F.col("n") <= SMALL).select("band", "class_id", "c").join(own, "class_id", "left")
    x, y = few.select("band", F.col("class_id").alias("a"), "c", "grp"), few.select("band", F.col("class_id").alias("b"), F.col("c").alias("d"), F.col("grp").alias("other"))
    apart = (F.col("a") < F.col("b")) & (F.col("c") != F.col("d")) & F.coalesce(F.col("grp") != F.col("other"), F.lit(True))
    in_pairs = verified(x.join(y, "band").filter(apart).select("a", "b").distinct(), pool, percent)

    # the components of the labels are those of the classes
    of = lambda x: label.select(F.col("class_id").alias(x), F.col("label").alias(f"c_{x}"))
    joined = links.union(in_groups).union(in_pairs).join(of("a"), "a", "left").join(of("b"), "b", "left")
    joined = joined.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).filter("a <> b")
    component = components(joined, rows)
    label = label.join(component.withColumnRenamed("id", "label"), "label", "left").select("class_id", F.coalesce("component", "label").alias("component"))
    return cut(label.union(component.join(label.select(F.col("class_id").alias("id")), "id", "left_anti").select("id", "component")), rows)


def by_component(rows: DataFrame, classes: DataFrame, label: DataFrame, id_col: str) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash, stays) of rows, by the components of their classes."""
    named = classes.select("class_id", "set_key", "one").join(label, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    placed = named.join(named.groupBy("component").agg(F.min("one").alias("first")), "component").select("set_key", "first.doc_id", "first.text_hash")
    placed = placed.select("set_key", F.col("doc_id").alias("first_id"), F.col("text_hash").alias("first_hash"))
    out = rows.select("doc_id", "text_hash", "n_shingles", "set_key").join(placed, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
    stays = F.col("kept") & F.coalesce(F.col("first_hash") == F.col("text_hash"), F.lit(True))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "kept", "text_hash", stays.alias("stays"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash, stays) of every row: components of rows whose 5-word shingle sets agree.

    Two sets are linked where 100 * intersection >= percent * union. Rows with equal sets fall into one class. Banded
    sketches bring classes into buckets. First each class meets the most central one that it shares a bucket with, the
    centre of a bucket being its class that shares the largest buckets; a group of thousands of copies of one text
    costs about one link a member. Then all classes that this left in different components and that share a bucket are
    compared: in buckets of up to SMALL classes pair by pair; larger buckets whose centres are linked form a group, compared
    in blocks without a row for each pair. So no link between components is lost.

    component_id is the smallest id of the component, kept says that the row's id is that; text_hash is xxhash64 of the
    text, which tells rows of one id apart, and stays marks one such row of each component (several only if they have
    the same id and text). Texts without words have an empty set, are linked with nothing and kept.
    Every row gives one row: repeated rows are in one component, null ids take part, and where a component has only null
    ids its component_id is null and all its rows are kept. Texts of any length are taken whole. An empty table gives an
    empty result; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = cut(sketches(docs))
    filled = rows.filter("n_shingles > 0")
    by_set = filled.groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = cut(by_set.withColumn("class_id", F.monotonically_increasing_id()))

    banded = bands(classes)
    shared = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = cut(banded.join(shared, "band"), BANDS * classes.count())
    scores = buckets.groupBy("class_id").agg(F.sum("n").alias("score"))

    # one text of each class in a bucket
    wanted = classes.join(scores.select("class_id"), "class_id").select("class_id", "n_shingles", "sketch", F.col("one.doc_id").alias("own_id"), F.col("one.text_hash").alias("own_hash"))
    pool = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    if rows.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        pool = pool.dropDuplicates(["class_id"])
    pool = cut(class_sets(pool))

    label = link_classes(buckets, scores, pool, percent)
    return by_component(rows, classes, label, id_col)
