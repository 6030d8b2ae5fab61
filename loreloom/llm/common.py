"""What the operators of this subpackage share: reading, checkpoints, word hashing, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the vectorised kernels handle at a time; one longer text is handled alone.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one on a single machine and an error elsewhere."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Rows of a few numbers that one partition may hold.
NARROW_ROWS = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Checkpoint to the shared folder, so that lost executors do not undo finished work.

    rows: how many rows df has at most, all of a few numbers; its partitions are then no more than they or the cluster's
    cores need, so that steps over few rows don't write files for every partition of the text that they came from.
    """
    spark = df.sparkSession
    shared_folder(spark)
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // NARROW_ROWS)))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as a compressed table in the shared folder: for rows that are many and read by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_texts(df: DataFrame, func: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply func to each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from func(batch)

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, end to end, and the offsets of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1)
        yield start, min(end, n)
        start = end


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def codes(fold: bool = False) -> np.ndarray:
    """A 64-bit number for each byte; fold: the same for A-Z as for a-z."""
    of = np.arange(256, dtype=np.uint64)
    if fold:
        of[65:91] += np.uint64(32)
    return mix((of + np.uint64(1)) * np.uint64(0xD1342543DE82EF95))


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _INVERSE)]))
    return up, down


class RollingHash:
    """Hashes of any byte range of one chunk: a polynomial over the ring of 64-bit numbers, then mixed."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        self.up, self.down = _powers(1 << max(12, int(len(data)).bit_length()))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data] * self.up[: len(data)])])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words `[^\\x20\\x09-\\x0D]+`; none crosses texts."""
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        first[edges] = solid[edges]
        edges = offsets[1:][offsets[1:] > 0] - 1
        last[edges] = solid[edges]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, where the text has them, and the positions of those first words."""
    n = max(0, len(hashes) - k + 1)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return combine([hashes[at + i] for i in range(k)]), at


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of hashes in order."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), len(parts), np.uint64)
        for part in parts:
            out = mix(out * np.uint64(0xA24BAED4963EE407) + part)
    return out


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else starts, lengths)
    return np.arange(total) + shift


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component): the smallest id that the undirected edges (a, b) reach from each id.

    Each round takes the smallest label among a node and its neighbours and then that label's own label, until no
    label changes. Edges and labels stay distributed; only the number of changes comes to the driver. rows: about how
    many edges there are, if that is known.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), rows and 2 * rows)
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component")), rows and 2 * rows)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("jumped"))
        after = cut(lower.join(jump, "next").select("id", F.col("component").alias("before"), F.least("next", "jumped").alias("component")), rows and 2 * rows)
        labels = after.select("id", "component")
        if not after.filter("before <> component").limit(1).count():
            return labels
