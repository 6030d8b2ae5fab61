"""Audit of how filters on training text interact: who fails which filter, and what each filter removes in every order.

Four filters look at one text alone; the fifth, equality with a text of a smaller id, is found by tries of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: The filters in alphabetical order; filter i has bit 1 << i of a mask.
FILTERS = "ABCDE"
DUPLICATE = 1 << 4

#: Bytes of texts that a task's trie holds before it is traversed and passed on.
HELD = 32 << 20

#: A prefix whose texts have more bytes than this is split by a longer one, up to so many prefixes of one length.
CELL_BYTES, CELLS = 1 << 20, 1 << 20

#: Characters of the shortest prefix, and how many times longer each next one is.
FIRST, LONGER = 16, 4

#: Texts of more bytes are read word by word instead of being split at once.
LONG = 4 << 20

_UPPER, _SYMBOLS, _WORD = bytes(range(65, 91)), b"#$%&*|", re.compile(rb"[^\x20\x09-\x0D]+")


def mask_of(text: bytes) -> int:
    """The bits of the filters A to D that a text of UTF-8 bytes fails."""
    if len(text) > LONG:
        n, distinct = 0, set()
        for found in _WORD.finditer(text):
            n += 1
            distinct.add(found[0])
    else:
        own = text.split()  # at runs of the six ASCII white-space bytes
        n, distinct = len(own), set(own)
    few = n < 200
    repeated = 100 * len(distinct) < 50 * n
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > 2 * len(text.decode())
    marked = len(text.translate(None, _SYMBOLS)) < len(text)
    return few | repeated << 1 | loud << 2 | marked << 3


def _shared(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed trie of whole texts; a terminal holds the rows of the smallest id seen with its text.

    A node is [label, children by first byte, terminal]. Rows whose id is larger than another's with the same text are
    given back at once, so a text of any number of copies takes the room of one.
    """

    def __init__(self):
        self.root: list = [b"", {}, None]
        self.held = 0

    def _at(self, text: bytes) -> list:
        node, at, size = self.root, 0, len(text)
        while at < size:
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                self.held += size - at + 200
                return child
            label = child[0]
            if text.startswith(label, at):
                at += len(label)
                node = child
                continue
            k = _shared(label, text[at : at + len(label)])
            middle = [label[:k], {label[k]: child}, None]
            child[0] = label[k:]
            node[1][text[at]] = middle
            node, at = middle, at + k
            self.held += 200
        return node

    def insert(self, text: bytes, key: tuple, row: tuple, n: int) -> dict[tuple, int]:
        """Adds n rows with this id (key orders ids) and gives back those that a smaller id makes duplicates."""
        node = self._at(text)
        if node[2] is None:
            node[2] = [key, {row: n}]
            return {}
        least, rows = node[2]
        if key > least:
            return {row: n}
        if key < least:
            node[2] = [key, {row: n}]
            return rows
        rows[row] = rows.get(row, 0) + n
        return {}

    def terminals(self) -> Iterator[tuple[bytes, dict[tuple, int]]]:
        """Each text with the rows of its smallest id, in the order of bytes."""
        path = [(self.root, b"")]
        while path:
            node, before = path.pop()
            text = before + node[0]
            if node[2] is not None:
                yield text, node[2][1]
            path += [(node[1][k], text) for k in sorted(node[1], reverse=True)]


def _key(value) -> tuple:
    """Orders ids, null last."""
    return (value is None, 0 if value is None else value)


class _Rows:
    """Collects rows (id, part, mask, n, text) into Arrow batches; a row without text is decided."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.columns: list[list] = [[], [], [], [], []]
        self.size = 0

    def add(self, rows: dict[tuple, int], text: bytes | None, bits: int = 0) -> None:
        for (own, part, mask), n in rows.items():
            for column, value in zip(self.columns, (own, part, mask | bits, n, text)):
                column.append(value)
            self.size += 64 + len(text or b"")

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            *plain, text = self.columns
            arrays = [pa.array(x, f.type) for x, f in zip(plain, self.schema)]
            yield pa.record_batch([*arrays, pa.array(text, pa.binary()).cast(pa.string())], self.schema)
            self.columns, self.size = [[], [], [], [], []], 0


def _judged(df: DataFrame, first: bool) -> DataFrame:
    """(id, part, mask, n, text) of rows (id, part, text), or of rows that it gave before with their cell.

    The first time, each task judges its texts by filters A to D and inserts them into a trie, which shows the copies
    among its own rows; the rows of each text's smallest id come with the text. The second time rows come by cells, a
    cell's texts are inserted into a trie of their own, and no text remains open.
    """
    kind = df.schema["id"].dataType.simpleString()
    schema = f"id {kind}, part string, mask int, n long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, cell, out = Trie(), None, None

        def close() -> Iterator[pa.RecordBatch]:
            for text, rows in trie.terminals():
                out.add(rows, text if first else None)
                if out.size > 4 << 20:
                    yield from out.batch()

        for batch in batches:
            own = {k: batch.column(k) for k in batch.schema.names}
            out = out or _Rows(pa.schema([("id", own["id"].type), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.string())]))
            texts = own["text"].cast(pa.binary())
            for i in range(len(batch)):
                text, value, part = texts[i].as_py(), own["id"][i].as_py(), own["part"][i].as_py()
                if first:
                    mask, n = mask_of(text), 1
                else:
                    mask, n = own["mask"][i].as_py(), own["n"][i].as_py()
                    if cell != own["cell"][i]:
                        yield from close()
                        trie, cell = Trie(), own["cell"][i]
                out.add(trie.insert(text, _key(value), (value, part, mask), n), None, DUPLICATE)
                if first and trie.held > HELD:
                    yield from close()
                    trie = Trie()
            yield from out.batch()
        if out:
            yield from close()
            yield from out.batch()

    return df.mapInArrow(run, schema)


def cells(open_rows: DataFrame, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """open_rows with `cell`, the prefix of the text by which they are dealt out.

    All begin with FIRST characters. Prefixes that more bytes share than a cell may have are split by prefixes LONGER
    times longer, until none is too large or the texts end. A cell's limit grows with the input where there would be
    more than CELLS large prefixes of one length, so the broadcast ones are bounded.
    """
    size = F.octet_length("text") + 1
    total = open_rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(cell_bytes, total // CELLS)
    out, length = open_rows.withColumn("length", F.lit(FIRST)), FIRST
    while True:
        prefix = F.xxhash64(F.substring("text", 1, length))
        longer = out.filter((F.col("length") == length) & (F.length("text") > length))
        large = stored(longer.groupBy(prefix.alias("large")).agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > limit).select("large"))
        if not large.limit(1).count():
            return out.withColumn("cell", F.expr("substring(text, 1, length)")).drop("length")
        hit = F.col("large").isNotNull() & (F.col("length") == length) & (F.length("text") > length)
        out = out.join(F.broadcast(large), prefix == F.col("large"), "left").withColumn("length", F.when(hit, length * LONGER).otherwise(F.col("length"))).drop("large")
        length *= LONGER


def masks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask, n): how many rows of each id and part fail just the filters in mask.

    Filters: A under 200 words; B fewer than half as many distinct words as words; C more than 2 capitals A-Z in 100
    code points; D one of #$%&*|; E the text equals that of a row with a smaller id, anywhere in the table. Words are
    runs without the six ASCII white-space characters. Null texts count as empty and are equal to one another and to
    empty ones; the null part is the empty string. Rows that share an id and a text are not one another's duplicates;
    null ids are larger than all others. Texts of any length are taken whole; an empty table gives an empty result;
    other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    first = stored(_judged(docs, True))
    dealt = cells(first.filter("text IS NOT NULL")).repartitionByRange("cell").sortWithinPartitions("cell")
    found = first.filter("text IS NULL").drop("text").union(_judged(dealt, False).drop("text"))
    return found.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))


def outcomes() -> list[tuple[str, int, str, int, int, int, int, int]]:
    """(filter_order, step, filter, mask, kept, removed, redundant, unique_fails) of a document of each mask."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                out.append(("".join(order), step, letter, mask, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == bit)))
            before |= bit
    return out


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    masks() says who fails what. A document counts as good or toxic if any label row of its id has quality or toxic 1;
    null ids have no labels. The masks are reduced to counts per part first, at most 32 rows each, and only these meet
    the 19,200 fixed outcomes of a mask under an order and a step. shapley is the filter's removed, summed over all
    orders. An empty table gives an empty result.
    """
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    sums = [F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("good", "bad"))]
    reduced = stored(masks(df, id_col, text_col, part_col).join(marks, "id", "left").groupBy("part", "mask").agg(*sums))
    fixed = df.sparkSession.createDataFrame(outcomes(), "filter_order string, step int, filter string, mask int, kept long, removed long, redundant long, unique_fails long")
    met = reduced.join(F.broadcast(fixed), "mask")
    counted = [F.sum(F.col("n") * F.col(c)).alias(c) for c in ("kept", "removed", "redundant", "unique_fails")]
    lost = [F.sum(F.col(c) * F.col("removed")).alias(name) for c, name in (("good", "good_lost"), ("bad", "toxic_lost"))]
    steps = met.groupBy("part", "filter_order", "step", "filter").agg(*counted, *lost)
    of_filter = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", of_filter.alias("shapley"))
