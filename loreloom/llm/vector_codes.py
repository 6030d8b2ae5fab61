"""Product codes of vectors, with codebooks from Lloyd rounds in which parts stay where their entry is kept."""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Parts of a vector, entries of a part's codebook, and rounds of assigning and replacing.
PARTS, ENTRIES, ROUNDS = 16, 64, 2

#: A component becomes floor(SCALE * x), and counts as MOST where it is larger, so that distances fit 64 bits.
SCALE, MOST = 256, 1 << 27

#: A block has so many vectors at most, and so many components.
BLOCK, BLOCK_COMPONENTS = 1 << 15, 1 << 21

#: Vectors for each salt: a part position's entry that all vectors share has owners of about so many members.
OWNED = 1 << 18

MEMBERS = "pos int, entry int, salt int, block long, rows binary, parts binary"


def whole(values: np.ndarray) -> np.ndarray:
    """Components as integers; all floors go down."""
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -MOST, MOST).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest entry of the book, the lower one of equals, and their squared distance."""
    best, least = np.zeros(len(x), np.uint8), np.full(len(x), np.iinfo(np.int64).max)
    for i, entry in enumerate(book):
        apart = x - entry
        distance = np.einsum("ij,ij->i", apart, apart)
        near = distance < least
        best[near], least[near] = i, distance[near]
    return best, least


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.size(vector) > 0) & (F.size(vector) % PARTS == 0)


def _blocks(kept: DataFrame) -> DataFrame:
    """(block, ids, labels, parts) of (id, label, vector): blocks of vectors, their components as integers."""
    types = {c: kept.schema[c].dataType.simpleString() for c in ("id", "label")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lists = batch.column(2)
            width = len(lists[0])
            step = max(1, min(BLOCK, BLOCK_COMPONENTS // width))
            for a in range(0, len(batch), step):
                own = batch.slice(a, step)
                parts = whole(own.column(2).flatten().to_numpy(zero_copy_only=False)).astype(np.int32)
                one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                yield pa.record_batch([pa.array([task + n], pa.int64()), one(own.column(0)), one(own.column(1)), pa.array([parts.tobytes()])], ["block", "ids", "labels", "parts"])
                n += 1

    return stored(kept.select("id", "label", "vector").mapInArrow(run, f"block long, ids array<{types['id']}>, labels array<{types['label']}>, parts binary"))


def _members(pos: int, entry: np.ndarray, salt: np.ndarray, block: np.ndarray, rows: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
    """A row of members for each block and entry, of parts of one position."""
    order = np.lexsort((entry, block))
    entry, salt, block, rows, x = entry[order], salt[order], block[order], rows[order].astype(np.uint32), x[order].astype(np.int32)
    edges = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (entry[1:] != entry[:-1])) + 1, [len(block)]]).tolist()
    for a, b in zip(edges[:-1], edges[1:]):
        yield pos, int(entry[a]), int(salt[a]), int(block[a]), rows[a:b].tobytes(), x[a:b].tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("pos", pa.int32()), ("entry", pa.int32()), ("salt", pa.int32()), ("block", pa.int64()), ("rows", pa.binary()), ("parts", pa.binary())]
    return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds)], [name for name, _ in kinds])


def _owned(members: DataFrame) -> DataFrame:
    """The members at their owners, partitions by (position, entry, salt), where they stay."""
    return stored(members.repartition("pos", "entry", "salt"))


def _first(blocks: DataFrame, book: np.ndarray, salts: int) -> DataFrame:
    """The parts of all blocks as members of their nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = book.shape[2]
        for batch in batches:
            for block, parts in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(parts.as_buffer(), np.int32).reshape(-1, PARTS, width).astype(np.int64)
                of = np.full(len(x), block)
                salt = np.full(len(x), (block * 0x9E3779B1 >> 7) % salts)
                for pos in range(PARTS):
                    own = np.ascontiguousarray(x[:, pos])
                    yield _batch([*_members(pos, nearest(own, book[pos])[0], salt, of, np.arange(len(x)), own)])

    return _owned(blocks.select("block", "parts").mapInArrow(run, MEMBERS))


def _residents(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(pos, entries, salts, blocks, rows, parts) of the members that keep their entry under each of the books: those of
    one position in a batch together."""
    for batch in batches:
        at = batch.column(0).to_numpy()
        for pos in np.unique(at).tolist():
            own = batch.take(pa.array(np.flatnonzero(at == pos)))
            rows = np.frombuffer(b"".join(own.column(4).to_pylist()), np.uint32)
            x = np.frombuffer(b"".join(own.column(5).to_pylist()), np.int32).reshape(len(rows), -1).astype(np.int64)
            n = [len(r.as_buffer()) // 4 for r in own.column(4)]
            entry, salt, block = (np.repeat(own.column(i).to_numpy(), n) for i in (1, 2, 3))
            for book in books:
                stays = nearest(x, book[pos])[0] == entry
                entry, salt, block, rows, x = entry[stays], salt[stays], block[stays], rows[stays], x[stays]
            if len(rows):
                yield pos, entry, salt, block, rows, x


def _sums(members: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(pos, entry, at, n, total): each owner's count and componentwise sums of its resident members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], tuple[int, np.ndarray]] = {}
        for pos, entry, _, _, _, x in _residents(batches, books):
            for k in np.unique(entry).tolist():
                n, total = found.get((pos, k), (0, 0))
                found[pos, k] = (n + int((entry == k).sum()), total + x[entry == k].sum(0))
        flat = [(pos, entry, at, n, int(v)) for (pos, entry), (n, total) in found.items() for at, v in enumerate(total)]
        if flat:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array([r[i] for r in flat], kind) for i, kind in enumerate(kinds)], ["pos", "entry", "at", "n", "total"])

    return members.mapInArrow(run, "pos int, entry int, at int, n long, total long")


def _migrants(members: DataFrame, books: list[np.ndarray], book: np.ndarray) -> DataFrame:
    """The resident members that change their entry under the book, as members of the new one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pos, entry, salt, block, rows, x in _residents(batches, books):
            near = nearest(x, book[pos])[0]
            moves = near != entry
            if moves.any():
                yield _batch([*_members(pos, near[moves], salt[moves], block[moves], rows[moves], x[moves])])

    return members.mapInArrow(run, MEMBERS)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.union(frame)
    return out


def codebooks(blocks: DataFrame, book: np.ndarray, n: int, rounds: int = ROUNDS) -> tuple[list[DataFrame], list[np.ndarray]]:
    """The layers of members, and the codebooks before each round and after the last.

    A layer has the parts that came to their owners in one round: first all, then those that changed their entry. Layers
    are tables dealt out by (position, entry, salt) and never rewritten: who stays is found again, at the owner, from
    the books that came since. Only migrants are shuffled, and only entries' sums come to the driver, which are as many
    as the entries' components.
    """
    books, layers = [book], [_first(blocks, book, -(-n // OWNED))]
    for k in range(rounds):
        if k:
            layers.append(_owned(_union([_migrants(layer, books[i + 1 : k], books[k]) for i, layer in enumerate(layers)])))
        sums = _union([_sums(layer, books[i + 1 : k + 1]) for i, layer in enumerate(layers)])
        after = books[k].copy()
        for r in sums.groupBy("pos", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():  # an entry of each position
            after[r["pos"], r["entry"], r["at"]] = r["total"] // r["n"]
        books.append(after)
    return layers, books


def _coded(blocks: DataFrame, layers: list[DataFrame], books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every vector: each part's final assignment, gathered by blocks."""
    ids, labels = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
    found = "block long, pos int, rows binary, entries binary, errors binary"

    def final(seen: list[np.ndarray], book: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pos, _, _, block, rows, x in _residents(batches, seen):
                near, error = nearest(x, book[pos])
                order = np.argsort(block, kind="stable")
                edges = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(block)]]).tolist()
                cut = [[v[order[a:b]].tobytes() for a, b in zip(edges[:-1], edges[1:])] for v in (rows, near, error)]
                yield pa.record_batch([pa.array(block[order[edges[:-1]]]), pa.array([pos] * len(cut[0]), pa.int32()), *map(pa.array, cut)], ["block", "pos", "rows", "entries", "errors"])

        return run

    ends = [layer.mapInArrow(final(books[i + 1 : -1], books[-1]), found) for i, layer in enumerate(layers)]
    none = [F.lit(None).cast("binary").alias(c) for c in ("rows", "entries", "errors")]
    heads = blocks.select("block", F.lit(-1).alias("pos"), *none, "ids", "labels")
    parts = _union(ends).withColumns({"ids": F.lit(None).cast(f"array<{ids}>"), "labels": F.lit(None).cast(f"array<{labels}>")})

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        pos = table["pos"].to_pylist()
        head = pos.index(-1)
        own_ids, own_labels = (table[c].combine_chunks().slice(head, 1).flatten() for c in ("ids", "labels"))
        codes, errors = np.zeros((len(own_ids), PARTS), np.uint8), np.zeros(len(own_ids), np.int64)
        for i, at in enumerate(pos):
            if at >= 0:
                rows = np.frombuffer(table["rows"][i].as_buffer(), np.uint32)
                codes[rows, at] = np.frombuffer(table["entries"][i].as_buffer(), np.uint8)
                errors[rows] += np.frombuffer(table["errors"][i].as_buffer(), np.int64)
        text = codes.tobytes().hex()
        return pa.table({"id": own_ids, "label": own_labels, "code": [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], "error": errors})

    return heads.union(parts).groupBy("block").applyInArrow(gather, f"id {ids}, label {labels}, code string, error long")


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256) of every row whose vector is whole.

    Rows go whose vector is null, empty, or holds null or non-finite components, and those whose width isn't the
    table's: the commonest width among multiples of 16, the smaller of equals. Components become floor(256 * x), at most
    2 ** 27 in size. Vectors are cut into 16 equal parts; each position's codebook begins with that part of the 64
    vectors of the smallest ids (fewer where there are fewer; null ids last, equal ids by their vectors). Each round
    assigns parts to their nearest entries, ties to the lower one, and replaces each entry by the floor of its parts'
    mean; unused entries stay. code has the final entries as two hex digits each; error is the sum of the squared
    distances, label_error their sum over rows of equal labels, null ones together.

    Every row that stays gives one row, repeated ids and rows too; vectors that are all alike only make a large entry,
    which its salts split; a table without whole vectors gives an empty result; other columns are ignored.
    """
    given = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).filter(_valid(F.col("vector")))
    widths = given.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        empty = given.filter("false")
        return empty.select("id", "label", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")), F.lit("").alias("codebooks_sha256")).withColumnsRenamed({"id": id_col, "label": label_col})
    width, n = widths[0]["width"], widths[0]["count"]
    kept = given.filter(F.size("vector") == width)
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    book = whole(np.array([r["vector"] for r in first])).reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2)
    blocks = _blocks(kept)
    layers, books = codebooks(blocks, np.ascontiguousarray(book), n, rounds)
    coded = stored(_coded(blocks, layers, books))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books[-1].ravel().tolist())).encode()).hexdigest()
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return joined.select("id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")).withColumnsRenamed({"id": id_col, "label": label_col})
