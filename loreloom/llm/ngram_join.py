"""Exact Jaccard self-join of texts by a blocked product of their n-gram incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import combine, cut, map_texts, mix, stored
from .minhash import by_component, digest, document_shingles, joining, link_classes

#: Words of an n-gram.
WORDS = 3

#: Columns of the matrix that a product takes at a time; after each such block, pairs that can't reach their bound go.
COLUMNS = 2048

#: Rows of one side that a product takes at a time.
SIDE = 256

#: A part of a row that has at most so many n-grams is weak: it says little, and many rows may share it.
WEAK = 2

#: Bytes of a signature. Two signatures that agree by chance only cost a comparison.
SIGN_BYTES = 6


class Levels:
    """Ranges of set sizes and, for each, the parts into which the columns are cut.

    Two sets of n <= m n-grams with similarity t have m <= n / t, and differ in at most (n + m) * (1 - t) / (1 + t)
    n-grams. Cut into more parts than that, two similar rows agree in a whole part. A few parts more make up for the
    weak ones: rows with no more weak parts than these need only their other parts.
    """

    def __init__(self, percent: int):
        low, self.starts, self.reach, self.parts, self.spare = 1, [], [], [], []
        while low < 1 << 40:
            high = max(low + 1, low * max(150, 10000 // percent + 1) // 100) - 1
            most = high * 100 // percent
            apart = (100 - percent) * (high + most) // (100 + percent)
            spare = apart // 8 + 1 if apart else 0
            self.starts.append(low)
            self.reach.append(most)
            self.parts.append(apart + 1 + spare if apart else 0)  # sets that can't differ are one class already
            self.spare.append(spare)
            low = high + 1
        self.starts, self.reach, self.parts, self.spare = (np.array(x, np.int64) for x in (self.starts, self.reach, self.parts, self.spare))

    def of(self, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """The level of each size, and then the one below where it has sets small enough to be similar; else -1."""
        own = np.searchsorted(self.starts, sizes, "right") - 1
        yield np.where(sizes > 0, own, -1)
        yield np.where((own > 0) & (sizes <= self.reach[own - 1]), own - 1, -1)


def signatures(levels: Levels, sizes: np.ndarray, owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, signatures): the row's parts that it may share with a similar one, by level.

    owner and found are rows and n-grams, sorted; the part of an n-gram is its place among so many equal ranges of
    hashes.
    """
    rows, signs = [], []
    for level in levels.of(sizes):
        parts = np.where(level >= 0, levels.parts[level], 0)
        keep = parts[owner] > 0
        own, grams = owner[keep], found[keep]
        if not len(own):
            continue
        part = ((grams >> np.uint64(32)) * parts[own].astype(np.uint64)) >> np.uint64(32)
        begins = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (part[1:] != part[:-1])]))
        lengths = np.diff(np.concatenate([begins, [len(own)]]))
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix(grams ^ np.uint64(0x3C6EF372FE94F82B)), begins)
        own, part, level_of = own[begins], part[begins], level[own[begins]].astype(np.uint64)
        sign = combine([total, level_of << np.uint64(40) | part])
        strong = lengths > WEAK
        # rows with more weak parts than are spare need these too, empty ones among them
        weak = parts - np.bincount(own[strong], minlength=len(sizes))
        needy = (parts > 0) & (weak > levels.spare[level])
        chosen = strong | needy[own]
        rows.append(own[chosen])
        signs.append(sign[chosen])
        for row in np.flatnonzero(needy):
            missing = np.setdiff1d(np.arange(parts[row], dtype=np.uint64), part[own == row])
            rows.append(np.full(len(missing), row))
            signs.append(combine([np.zeros(len(missing), np.uint64), np.uint64(level[row]) << np.uint64(40) | missing]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none.astype(np.uint64), *signs])


def half(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def described(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, key, signs) of (doc_id, text_hash, text): set_key is 16 bytes that stand
    for the set, key the first half of them, both null without words; signs are its signatures, end to end."""
    levels = Levels(percent)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, counts, owner, found in document_shingles(batch.column(2), WORDS):
            sizes = np.bincount(owner, minlength=len(counts))
            ends = np.cumsum(sizes)
            keys = [digest(found[e - n : e]) if n else None for e, n in zip(ends.tolist(), sizes.tolist())]
            rows, signs = signatures(levels, sizes, owner, found)
            order = np.argsort(rows, kind="stable")
            packed = signs[order].view(np.uint8).reshape(-1, 8)[:, :SIGN_BYTES].ravel()
            edges = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(counts)))]) * SIGN_BYTES
            own = [packed[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]
            part = batch.slice(a, len(counts))
            yield pa.record_batch([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array([k and half(k) for k in keys], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_key", "key", "signs"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text_hash", "text"), run, f"doc_id {kind}, text_hash long, n_shingles long, set_key binary, key long, signs binary")


def signed(rows: DataFrame) -> DataFrame:
    """(band, key): each signature with the first half of the set's key; equal sets of a batch come once."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        keys, size, held = [], 0, []
        for i, (key, signs) in enumerate(seen.items()):
            keys.append(half(key))
            held.append(signs)
            size += len(signs)
            if size > SIGN_BYTES * 200_000 or i == len(seen) - 1:
                flat = np.frombuffer(b"".join(held), np.uint8).reshape(-1, SIGN_BYTES)
                wide = np.zeros((len(flat), 8), np.uint8)
                wide[:, :SIGN_BYTES] = flat
                of = np.repeat(np.array(keys, np.int64), [len(x) // SIGN_BYTES for x in held])
                yield pa.record_batch([pa.array(wide.view(np.int64).ravel()), pa.array(of)], ["band", "key"])
                keys, size, held = [], 0, []

    return map_texts(rows.filter("n_shingles > 0").select("set_key", "signs"), run, "band long, key long")


def incidence(docs: DataFrame) -> DataFrame:
    """(class_id, n_shingles, grams) of (class_id, n_shingles, text): the row of the matrix as its sorted columns."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, counts, owner, found in document_shingles(batch.column(2), WORDS):
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(counts)))]).astype(np.int64) * 8
            grams = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(found)]).cast(pa.binary())
            part = batch.slice(a, len(counts))
            yield pa.record_batch([*part.columns[:2], grams], ["class_id", "n_shingles", "grams"])

    return map_texts(docs.select("class_id", "n_shingles", "text"), run, "class_id long, n_shingles long, grams binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], need: np.ndarray) -> np.ndarray:
    """Which cells of the product of two sets of matrix rows reach the overlap that they need.

    Columns that only one side has can't count. The others are taken block by block: the counts grow by the product of
    the sides' blocks, and a cell goes as soon as its count and what is left of either row don't reach the need; rows
    without cells take no further part.
    """
    x, y = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(x, y)
    alive, count = np.ones(need.shape, bool), np.zeros(need.shape, np.float32)
    entries, rest = [], []
    for flat, rows in ((x, left), (y, right)):
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        at, row = at[hit], np.repeat(np.arange(len(rows)), [len(r) for r in rows])[hit]
        order = np.argsort(at, kind="stable")
        entries.append((at[order], row[order]))
        rest.append(np.bincount(row, minlength=len(rows)))
    for low in range(0, len(shared), COLUMNS):
        alive &= count + np.minimum(rest[0][:, None], rest[1][None, :]) >= need
        sides = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(sides[0]):
            return alive
        blocks = []
        for i, ((at, row), own) in enumerate(zip(entries, sides)):
            a, b = np.searchsorted(at, [low, low + COLUMNS])
            block = np.zeros((need.shape[i], min(COLUMNS, len(shared) - low)), np.float32)
            block[row[a:b], at[a:b] - low] = 1
            rest[i] = rest[i] - np.bincount(row[a:b], minlength=need.shape[i])
            blocks.append(block[own])
        count[np.ix_(*sides)] += blocks[0] @ blocks[1].T
    return alive & (count >= need)


def _need(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of n and m n-grams that are similar; more than either has where none is enough."""
    least = -(-percent * (n + m) // (100 + percent))
    return np.where(100 * np.minimum(n, m) >= percent * np.maximum(n, m), least, n + m + 1)


def _grams(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def verified(pairs: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar: products of one row a with all rows b that it came with."""
    side = lambda x: pool.select(F.col("class_id").alias(x), F.col("n_shingles").alias(f"n_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    grams = lambda x: pool.select(F.col("class_id").alias(x), F.col("grams").alias(f"g_{x}"))

    def check(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not len(batch):
            return
        first = batch.column(0).to_numpy()
        order = np.argsort(first, kind="stable")
        edges = np.flatnonzero(np.diff(first[order], prepend=first[order[0]] - 1, append=first[order[-1]] + 1))
        good = np.zeros(len(batch), bool)
        for low, high in zip(edges[:-1], edges[1:]):
            for start in range(low, high, SIDE):
                own = order[start : min(start + SIDE, high)]
                left = _grams(batch.column(2).take(pa.array(own[:1])))
                right = _grams(batch.column(3).take(pa.array(own)))
                good[own] = overlaps(left, right, _need(len(left[0]), np.array([[len(r) for r in right]]), percent))[0]
        yield batch.select([0, 1]).filter(pa.array(good))

    return map_texts(sized.select("a", "b").join(grams("b"), "b").join(grams("a"), "a").select("a", "b", "g_a", "g_b"), check, "a long, b long")


def within(left: pa.StructArray, right: pa.StructArray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between classes of two blocks (or of one, if they are the same), one for each two components joined."""
    sides = [[rows.field(k).to_numpy() for k in ("class_id", "c", "n_shingles")] for rows in (left, right)]
    grams = [_grams(rows.field("grams")) for rows in (left, right)]
    (ids, labels, n), (other_ids, other_labels, m) = sides
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(ids), SIDE):
        for j in range(i if same else 0, len(other_ids), SIDE):
            a, b = slice(i, i + SIDE), slice(j, j + SIDE)
            need = _need(n[a, None], m[None, b], percent)
            apart = labels[a, None] != other_labels[None, b]
            if same:
                apart &= np.arange(len(ids))[a, None] < np.arange(len(ids))[None, b]
            need = np.where(apart, need, n[a, None] + m[None, b] + 1)
            x, y = np.nonzero(overlaps(grams[0][a], grams[1][b], need))
            found.append((x + i, y + j))
    x, y = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    return joining(ids[x], other_ids[y], labels[x], other_labels[y])


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90) -> DataFrame:
    """(id, n_shingles, component_id, kept, text_hash, stays) of every row: components of rows whose 3-word shingle sets
    agree, 100 * intersection >= percent * union.

    Rows of the incidence matrix that are equal are one class. The product of the matrix with itself is made only in
    blocks that can hold a similar pair. Set sizes bound how far similar rows can differ, so two similar rows must agree
    in a whole one of more parts of the columns than that; classes that share such a part form a bucket. No pair above
    the limit is missed, and n-grams that many texts share bring no texts together by themselves. In the buckets first
    each class meets the most central one, then those that this leaves apart: pair by pair in buckets of few classes,
    else by blocks of rows. A product takes the columns by blocks, accumulates overlaps and drops cells that can't reach
    the overlap that their sizes ask for; it returns links that join components, never a group's pairs.

    component_id is the smallest id of the component, kept says that the row's id is that; text_hash is xxhash64 of the
    text, which tells rows of one id apart, and stays marks one such row of each component (several only if they have
    the same id and text). Texts with fewer words than 3 are one shingle; those without words, and null ones, have an
    empty set and are linked with nothing. Every row gives one row: repeated rows are in one component, null ids take
    part, and where a component has only null ids its component_id is null. Texts of any length are taken whole. An
    empty table gives an empty result; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = stored(described(docs, percent))
    by_set = rows.filter("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")).alias("one"), F.first("n_shingles").alias("n_shingles"), F.first("key").alias("key"))
    classes = cut(by_set.withColumn("class_id", F.monotonically_increasing_id()))

    signs = signed(rows)
    shared = signs.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    met = cut(signs.join(shared, "band").distinct().join(classes.select("key", "class_id"), "key").select("band", "class_id"))
    buckets = cut(met.join(met.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "band"))
    scores = buckets.groupBy("class_id").agg(F.sum("n").alias("score"))

    wanted = classes.join(scores.select("class_id"), "class_id").select("class_id", "n_shingles", F.col("one.doc_id").alias("own_id"), F.col("one.text_hash").alias("own_hash"))
    pool = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash")))
    if rows.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():
        pool = pool.dropDuplicates(["class_id"])
    pool = stored(incidence(pool))
    return by_component(rows, classes, link_classes(buckets, scores, pool, percent, verified, within), id_col)
