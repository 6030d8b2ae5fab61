"""Removal of long repeated byte strings by prefix-free parsing.

A rolling hash over every 16 bytes of a text sets triggers; they cut the text into overlapping phrases. Each start of
a window of `length` bytes belongs to one trigger, the one of least hash in the window's first 128 places, which the
window's own bytes decide. A phrase holds all windows of one trigger, so equal windows lie in phrases that agree from
the trigger on for at least `length` - 127 bytes: that stretch is the phrase's key. The dictionary is the distinct
phrases with their numbers of occurrences, the parse the documents' sequences of them. Suffixes of the dictionary's
phrases, cut to `length` bytes, are put in lexicographic order by prefix doubling; equal neighbours, and phrases that
the parse has twice, are the corpus's repeated windows, and the parse says where in the corpus they are.

Only phrases of one key can share windows, so the order is made for the keys of a task, not for all keys in one merge;
a key of one phrase needs none, as its windows are repeated where the phrase is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, chunks, codes, combine, cut, map_texts, ranges, run_lengths, text_bytes

#: Bytes that the rolling hash covers, and the most places of a window that its trigger is chosen from.
TRIGGER, PLACES = 16, 128

#: A key with more different phrases is not left to one task: its windows are dealt out by their hashes.
LOCAL = 4_000

#: Phrases whose suffixes are put in order at a time, besides those of the last key.
AT_ONCE = 2_000


def places(length: int) -> int:
    """How many places of a window its trigger is chosen from: a power of 2 for which the hash stays in the window."""
    if length <= TRIGGER:
        raise ValueError(f"strings must be longer than {TRIGGER} bytes")
    return min(PLACES, 1 << (length - TRIGGER + 1).bit_length() - 1)


def phrases(df: DataFrame, length: int) -> DataFrame:
    """(key, phrase, id, place) for each phrase of (id, text): place holds the first window's start and two more bytes,
    the number of further windows and the trigger's distance from the start."""
    chosen_from = places(length)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            sizes = np.maximum(np.diff(at) - length + 1, 0)
            if not sizes.sum():
                continue
            hashed = RollingHash(own, codes())
            every = np.arange(len(own) - TRIGGER + 1)
            # the hash above, the place below: the least is the leftmost trigger of least hash
            low = (hashed.ranges(every, every + TRIGGER) & np.uint64(0xFFFFFF0000000000 | 0xFF << 32)) | every.astype(np.uint64)
            step = 1
            while step < chosen_from:
                low = np.minimum(low[:-step], low[step:])
                step *= 2
            starts = ranges(at[:-1], sizes)  # of all windows that end in their text
            trigger = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            first, n = run_lengths(trigger)
            start, trigger = starts[first], trigger[first]
            row = np.searchsorted(at, start, "right") - 1
            key = hashed.ranges(trigger, trigger + length - chosen_from + 1)
            phrase = combine([hashed.ranges(start, start + n - 1 + length), (trigger - start).astype(np.uint64)])
            place = (start - at[row]) << 16 | (n - 1) << 8 | (trigger - start)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(phrase.view(np.int64)), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(place)], ["key", "phrase", "id", "place"])

    kind = df.schema["id"].dataType.simpleString()
    return map_texts(df.select("id", "text"), run, f"key long, phrase long, id {kind}, place long")


def _spans(texts: DataFrame, length: int) -> DataFrame:
    """(key, id, start, single, wide, span): the bytes of each phrase of (id, text, phrases)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(2)
        counts = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        place = flat.field("place").to_numpy()
        begins = np.cumsum(counts) - counts
        data, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            own, first = data[offsets[a] : offsets[b]], begins[a]
            many = int(begins[b - 1] + counts[b - 1] - first)
            row = np.repeat(np.arange(b - a), counts[a:b])
            start, n = place[first : first + many] >> 16, (place[first : first + many] >> 8 & 0xFF) + length
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            span = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(ends), pa.py_buffer(own[ranges(offsets[a:b][row] - offsets[a] + start, n)])])
            some = flat.slice(int(first), many)
            yield pa.record_batch([some.field("key"), batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(start), some.field("single"), some.field("wide"), span], ["key", "id", "start", "single", "wide", "span"])

    kind = texts.schema["id"].dataType.simpleString()
    return map_texts(texts.select("id", "text", "phrases"), run, f"key long, id {kind}, start long, single boolean, wide boolean, span binary")


def _windows(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start of each window in the spans that begin and end at `at`, with its span and its place in it."""
    n = np.diff(at) - length + 1
    start = ranges(at[:-1], n)
    row = np.repeat(np.arange(len(n)), n)
    return start, row, start - at[row]


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The place of each number among the distinct ones."""
    order = np.argsort(keys)
    sorted_keys = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def suffix_ranks(data: np.ndarray, length: int, start: np.ndarray) -> np.ndarray:
    """The rank of the `length` bytes from each start in their lexicographic order; equal bytes have equal ranks.

    Prefix doubling: the order of all places by twice as many bytes follows from two ranks by the bytes known so far.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(len(data), np.uint64)
    for i in range(8):
        first = first << np.uint64(8) | padded[i : i + len(data)]
    if length < 8:
        return _ranked(first[start] >> np.uint64(8 * (8 - length)))
    rank, depth = _ranked(first), 8
    while 2 * depth <= length:
        later = np.zeros(len(rank), np.int64)
        later[:-depth] = rank[depth:]
        rank, depth = _ranked(rank * (len(rank) + 1) + later), 2 * depth
    if depth == length:
        return _ranked(rank[start])
    return _ranked(rank[start] * (len(rank) + 1) + rank[start + length - depth])


def _equal_neighbours(spans: DataFrame, length: int) -> DataFrame:
    """(id, low, high): window starts of the single phrases that another phrase of the same key has too.

    Equal windows have equal keys, so each task orders the suffixes of its own keys and compares neighbours.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                table = pa.Table.from_batches([batch.slice(at, AT_ONCE)])
                held = table if held is None else pa.concat_tables([held, table])
                keys = held["key"].to_numpy()
                done = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next rows
                if done:
                    yield compare(held.slice(0, done))
                    held = held.slice(done)
        if held is not None:
            yield compare(held)

    def compare(table: pa.Table) -> pa.RecordBatch:
        data, at = text_bytes(table["span"])
        start, row, place = _windows(at, length)
        rank = suffix_ranks(data, length, start)
        twice = (np.bincount(rank) > 1)[rank] & table["single"].to_numpy()[row]
        row, start = row[twice], table["start"].to_numpy()[row[twice]] + place[twice]
        first, n = run_lengths(row * (1 << 40) + start - np.arange(len(start)))
        low = start[first]
        return pa.record_batch([table["id"].combine_chunks().take(pa.array(row[first])), pa.array(low), pa.array(low + n - 1)], ["id", "low", "high"])

    kind = spans.schema["id"].dataType.simpleString()
    dealt = spans.select("key", "id", "start", "single", "span").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"id {kind}, low long, high long")


def _equal_anywhere(spans: DataFrame, length: int) -> DataFrame:
    """The same for keys of very many phrases: the windows themselves are dealt out, told by 128 bits of key and hash."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(batch), AT_ONCE):
            part = batch.slice(a, AT_ONCE)
            data, at = text_bytes(part.column(4))
            start, row, place = _windows(at, length)
            window, row_of = RollingHash(data, codes()).ranges(start, start + length), pa.array(row)
            yield pa.record_batch([part.column(0).take(row_of), pa.array(window.view(np.int64)), part.column(1).take(row_of), pa.array(part.column(2).to_numpy()[row] + place), part.column(3).take(row_of)], ["key", "window", "id", "start", "single"])

    kind = spans.schema["id"].dataType.simpleString()
    windows = map_texts(spans.select("key", "id", "start", "single", "span"), run, f"key long, window long, id {kind}, start long, single boolean")
    twice = windows.groupBy("key", "window").agg(F.count("*").alias("n")).filter("n > 1").select("key", "window")
    return windows.filter("single").join(twice, ["key", "window"], "left_semi").select("id", F.col("start").alias("low"), F.col("start").alias("high"))


def _identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): id tells rows apart but for those of equal id and text, whose windows are all repeated anyway."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if docs.groupBy("id").count().filter("count > 1").limit(1).count():
        docs = docs.select(F.struct("id", F.xxhash64("text").alias("hash")).alias("id"), "text")
    return docs


def repeated_spans(docs: DataFrame, length: int = 200, local: int = LOCAL) -> DataFrame:
    """(id, starts): for each row of (id, text) with repeated strings, ranges of the starts, in bytes, of the windows of
    `length` bytes that also start elsewhere, in this text or another. Ids may be null, but must tell texts apart."""
    parsed = phrases(docs.filter(F.octet_length("text") >= length), length)
    keys = parsed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    shared = cut(parsed.join(keys, "key", "left_semi"))

    dictionary = shared.groupBy("key", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("first"))
    mixed = dictionary.groupBy("key").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    dictionary = cut(dictionary.join(mixed, "key", "left"))
    whole = shared.join(dictionary.filter("n > 1").select("key", "phrase"), ["key", "phrase"], "left_semi")
    whole = whole.select("id", F.shiftright("place", 16).alias("low"), (F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(0xFF)).alias("high"))

    apart = dictionary.filter("kinds > 1").select(F.col("first.id").alias("own_id"), F.struct("key", F.col("first.place").alias("place"), (F.col("n") == 1).alias("single"), (F.col("kinds") > local).alias("wide")).alias("p"))
    apart = apart.groupBy("own_id").agg(F.collect_list("p").alias("phrases"))  # as many as the text has triggers
    # the same exchange of the texts by id as that of the removal, so that Spark makes it once
    spans = _spans(docs.join(apart, F.col("id").eqNullSafe(F.col("own_id"))), length)
    found = whole.union(_equal_neighbours(spans.filter("not wide"), length))
    if dictionary.filter(F.col("kinds") > local).limit(1).count():
        found = found.union(_equal_anywhere(spans.filter("wide"), length))
    return found.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("starts"))


def remove_repeats(df: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept) of every row: the text without any byte that a repeated string covers.

    A string of `length` bytes is repeated if it starts at more than one place of all texts; matches don't cross texts
    and are judged on the input. spans are the maximal removed runs, as starts and ends in bytes; kept are the other
    bytes in order, which need not be UTF-8 at the cuts. Null texts count as empty. Every row gives one row: null and
    repeated ids are rows like others, and repeated rows remove each other's texts if long enough. Texts of any length
    are taken whole; an empty table gives an empty result; other columns are ignored.
    """
    docs = _identified(df, id_col, text_col)
    found = repeated_spans(docs, length).withColumnRenamed("id", "found_id")

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(1))
        for a, b in chunks(offsets):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i in range(a, b):
                own = data[offsets[i] : offsets[i + 1]].tobytes()
                runs = _merged(batch.column(2)[i], length)
                kept, at = [], 0
                for x, y in runs:
                    kept.append(own[at:x])
                    at = y
                kept.append(own[at:])
                for out, value in zip(rows, (len(own), sum(y - x for x, y in runs), len(runs), [{"start": x, "end": y} for x, y in runs], b"".join(kept))):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, t) for x, t in zip(rows, kinds))], [id_col, "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    kind = df.schema[id_col].dataType.simpleString()
    joined = docs.join(found, F.col("id").eqNullSafe(F.col("found_id")), "left")
    joined = joined.select("id.id" if kind != docs.schema["id"].dataType.simpleString() else "id", "text", "starts")
    return map_texts(joined, run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")


def _merged(starts: pa.Scalar, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows whose starts lie in the given ranges."""
    if not starts.is_valid or not len(starts.values):
        return []
    low, high = starts.values.field("low").to_numpy(), starts.values.field("high").to_numpy() + length
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    ends = reach[np.concatenate([new[1:] - 1, [len(low) - 1]])]
    return [*zip(low[new].tolist(), ends.tolist())]
