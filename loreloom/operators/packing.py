"""Rows of a scope in order, packed up to a budget, without a scope being one task."""

from __future__ import annotations

from collections.abc import Iterator
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a batch of passages, and rows of a segment.
BATCH_BYTES, SEGMENT = 16_000, 4096

#: What an empty batch, which the next row joins without a separator, has packed.
EMPTY = -1


def _cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder; only a single machine gets a temporary one."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


class Segment:
    """Neighbouring rows of a scope. What is packed so far is a number of bytes, or EMPTY."""

    def __init__(self, sizes: np.ndarray, budget: int, gap: int):
        self.sizes, self.budget, self.gap = sizes, budget, gap
        self.sums = np.cumsum(sizes + gap)  # as if all rows followed others
        n, filled = len(sizes), np.flatnonzero(sizes > 0)
        # the first row of the batch after one that begins at each row; empty rows at its start take no room
        at = np.searchsorted(filled, np.arange(n))
        lead = np.append(filled, n)[at]
        last = np.append(self.sums, 0)[lead] - np.append(sizes, 0)[lead]
        self.next = np.maximum(np.searchsorted(self.sums, last + budget, "right"), np.minimum(lead + 1, n))
        self.left = np.where(lead < n, self.sums[-1] - last, EMPTY)  # what is packed at the end, if no batch begins after

    def enter(self, used: int) -> int:
        """The row that begins a new batch where so much is packed before the segment; the number of rows if none does."""
        if used == EMPTY:
            return int(self.next[0])
        return int(np.searchsorted(self.sums, self.budget - used, "right"))

    def begins(self, used: int) -> np.ndarray:
        """All rows that begin a batch."""
        out, at = [], self.enter(used)
        while at < len(self.sizes):
            out.append(at)
            at = int(self.next[at])
        return np.array(out, np.int64)

    def summary(self) -> tuple[list[int], list[int], list[int], int, int, int]:
        """Of the rows that can be the first to begin a batch: from which use on the row does, how many batches begin in
        the segment then, and what is packed at its end; and for an empty batch before it, the first row to begin one.

        Only rows within a budget of the segment's start can be first, so the lists don't grow with the segment.
        """
        count, end = np.zeros(len(self.sizes) + 1, np.int64), np.append(self.left, 0)
        for i in range(len(self.sizes) - 1, -1, -1):
            count[i] = 1 + count[self.next[i]]
            if self.next[i] < len(self.sizes):
                end[i] = end[self.next[i]]
        rows = np.arange(min(len(self.sizes), int(np.searchsorted(self.sums, self.budget, "right")) + 1))
        least = self.budget - self.sums[rows] + 1  # a use of so much or more passes the budget here
        first = self.enter(EMPTY)
        last = end[first] if first < len(self.sizes) else self.left[0]
        return least.tolist(), count[rows].tolist(), end[rows].tolist(), int(self.sums[-1]), int(count[first]), int(last)


def _segments(rows: DataFrame, names: list[str]) -> DataFrame:
    """(by, seq, columns as arrays): rows in order as segments of one scope, numbered along the order."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"`{names[0]}` {kinds[names[0]]}, seq long, " + ", ".join(f"`{c}` array<{kinds[c]}>" for c in names[1:])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        for batch in batches:
            scope = batch.column(0).to_pylist()
            start = 0
            while start < len(batch):
                end = start + 1
                while end < len(batch) and end - start < SEGMENT and scope[end] == scope[start]:
                    end += 1
                own = batch.slice(start, end - start)
                lists = [pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), c) for c in own.columns[1:]]
                yield pa.record_batch([own.column(0).slice(0, 1), pa.array([seq], pa.int64()), *lists], [names[0], "seq", *names[1:]])
                seq, start = seq + 1, end

    return rows.select(names).mapInArrow(pack, schema)


def batch_passages(passages: DataFrame, by: str = "collection_id", order: str = "place", text: str = "text", budget: int = BATCH_BYTES, separator: str = "\n\n") -> DataFrame:
    """passages with `batch`: packed in order, a new batch where the next one and its separator would pass the budget.

    Every row comes back once. Rows of one place are packed in the order of their texts' hashes, equal ones one after
    the other; null places come first, null texts are empty, and the null scope is one like others. A passage over the
    budget has a batch of its own.

    Which passages begin a batch depends on all before them. The rows' lengths, without the texts, are sorted over all
    tasks and packed into segments. A segment says for each use of the batch that enters it what comes out, which only
    the rows within its first budget decide. Folding these few numbers along a scope, one row a segment, gives what
    enters each segment, and all segments are then cut on their own.
    """
    gap = len(separator.encode())
    told = passages.withColumns({"_hash": F.xxhash64(text), "_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long")})
    told = told.withColumn("_n", F.row_number().over(Window.partitionBy(by, order, "_hash").orderBy("_bytes")))
    names = [by, order, "_hash", "_n", "_bytes"]
    place = [by, order, "_hash", "_n"]
    segments = _cut(_segments(told.select(names).repartitionByRange(*place).sortWithinPartitions(*place), names))
    kind = segments.schema[by].dataType.simpleString()

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Segment(np.array(sizes, np.int64), budget, gap).summary() for sizes in batch.column(2).to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in range(3)]
            yield pa.record_batch([batch.column(0), batch.column(1), *lists, *(pa.array([f[i] for f in found], pa.int64()) for i in range(3, 6))], [by, "seq", "least", "counts", "ends", "total", "empty_count", "empty_end"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, used, done, first = None, EMPTY, 0, True
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if first or row[by] != scope:
                    scope, used, done, first = row[by], EMPTY, 0, False
                out.append((used, done))
                if used == EMPTY:
                    done, used = done + row["empty_count"], row["empty_end"]
                    continue
                at = next((i for i, least in enumerate(row["least"]) if used >= least), None)
                done, used = (done, used + row["total"]) if at is None else (done + row["counts"][at], row["ends"][at])
            yield pa.record_batch([batch.column(1), *(pa.array([o[i] for o in out], pa.int64()) for i in range(2))], ["seq", "used", "done"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = [batch.column(k)[i].values for k in range(1, 5)]
                sizes = own[3].to_numpy().astype(np.int64)
                begins = Segment(sizes, budget, gap).begins(batch.column(5)[i].as_py())
                number = batch.column(6)[i].as_py() + np.searchsorted(begins, np.arange(len(sizes)), "right")
                scope = batch.column(0).take(pa.array(np.full(len(sizes), i)))
                yield pa.record_batch([scope, *own[:3], pa.array(number.astype(np.int32))], [*(f"_{c}" for c in (by, order)), "_h", "_k", "batch"])

    folded = segments.select(by, "seq", "_bytes").mapInArrow(summary, f"`{by}` {kind}, seq long, least array<long>, counts array<long>, ends array<long>, total long, empty_count long, empty_end long")
    entered = folded.repartition(by).sortWithinPartitions(by, "seq").mapInArrow(fold, "seq long, used long, done long")
    types = {f.name: f.dataType.simpleString() for f in told.select(names).schema}
    batches = segments.join(entered, "seq").select(by, order, "_hash", "_n", "_bytes", "used", "done").mapInArrow(cut, f"`_{by}` {types[by]}, `_{order}` {types[order]}, _h long, _k int, batch int")
    same = F.col(by).eqNullSafe(F.col(f"_{by}")) & F.col(order).eqNullSafe(F.col(f"_{order}")) & (F.col("_hash") == F.col("_h")) & (F.col("_n") == F.col("_k"))
    return told.join(batches, same).select(*passages.columns, "batch")
