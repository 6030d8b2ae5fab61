"""BPE encoding and decoding: merges applied over all words of a partition at once, by an index from pairs to places."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
import heapq
from itertools import islice
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from . import pretokens
from .common import ranges

#: Distinct pieces that a task remembers; beyond, it starts afresh.
REMEMBERED = 400_000

#: Documents that are encoded at a time, and those whose ids are put together at a time.
SLICE, ROWS = 2048, 512


class Merges:
    """The merge rules of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.letters = byte_letters()
        self.of_byte = np.array([vocab[c] for c in self.letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.becomes = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols; the number of merges where there is none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], np.int32(len(self.ranks)))


@lru_cache(2)
def merges(path: str) -> Merges:
    return Merges(path)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, and where each id's bytes start and how many there are."""
    tokenizer = pretokens.load(path)
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    n = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    parts = [b""] * n
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        parts[i] = added[i].encode() if i in added else bytes(of_letter[c] for c in token)
    sizes = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def encode_words(words: list[str], rules: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words end to end, and how many each word has.

    All words' symbols stand in one array, linked to their neighbours. For each rank an index holds every place where
    its pair occurs. Ranks are taken in ascending order, which a heap of the active ones gives; a merge made at a rank
    only forms pairs of higher rank, as a pair's parts are older than the pair. Each merge removes two old pairs,
    whose entries go stale, and adds the places of the new pairs to their ranks' lists.
    """
    raw = [w.encode() for w in words]
    sizes = np.array([len(x) for x in raw], np.int64)
    symbols = rules.of_byte[np.frombuffer(b"".join(raw), np.uint8)]
    n, none = len(symbols), len(rules.ranks)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    edges = np.cumsum(sizes)
    filled = sizes > 0
    after[edges[filled] - 1] = -1
    before[(edges - sizes)[filled]] = -1
    rank = np.full(n, none, np.int32)
    at = np.flatnonzero(after >= 0)
    rank[at] = rules.rank(symbols[at], symbols[at + 1])
    alive, merged = np.ones(n, bool), np.zeros(n, bool)

    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def add(where: np.ndarray) -> None:
        """Enter the places into the lists of the ranks that they have now."""
        found = rank[where]
        where = where[found < none]
        if not len(where):
            return
        found = rank[where]
        order = np.argsort(found, kind="stable")
        found, where = found[order], where[order]
        starts = np.concatenate([[0], np.flatnonzero(found[1:] != found[:-1]) + 1, [len(found)]])
        for r, a, b in zip(found[starts[:-1]].tolist(), starts[:-1].tolist(), starts[1:].tolist()):
            if r not in places:
                places[r] = []
                heapq.heappush(active, r)
            places[r].append(where[a:b])

    add(at)
    while active:
        r = heapq.heappop(active)
        lists = places.pop(r)
        where = lists[0] if len(lists) == 1 else np.concatenate(lists)
        where = np.sort(where[alive[where] & (rank[where] == r)])
        if not len(where):
            continue
        if len(lists) > 1:  # a place may have had this rank before
            where = where[np.concatenate([[True], where[1:] != where[:-1]])]
        nxt = after[where]
        # of pairs that share a symbol, as in "aaa", the left one is merged: every other one of a chain of neighbours
        touching = np.concatenate([[False], nxt[:-1] == where[1:]])
        if touching.any():
            index = np.arange(len(where))
            start = np.maximum.accumulate(np.where(touching, 0, index))
            where = where[(index - start) % 2 == 0]
            nxt = after[where]
        symbols[where] = rules.becomes[r]
        beyond = after[nxt]
        alive[nxt] = False
        after[where] = beyond
        before[beyond[beyond >= 0]] = where[beyond >= 0]
        prior = before[where]
        prior = prior[prior >= 0]
        merged[where] = True
        changed = np.concatenate([where[beyond >= 0], prior[~merged[prior]]])
        merged[where] = False
        rank[where] = none
        rank[changed] = rules.rank(symbols[changed], symbols[after[changed]])
        add(changed)
    owner = np.repeat(np.arange(len(words)), sizes)[alive]
    return symbols[alive], np.bincount(owner, minlength=len(words))


class _Index(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class _Memory:
    """Pieces seen by a task with their ids, end to end."""

    def __init__(self, path: str):
        self.path, self.rules = path, merges(path)
        self.special = {t.content: i for i, t in pretokens.load(path).get_added_tokens_decoder().items()}
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.ids, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        """Encode the pieces that the index has numbered since the last call."""
        new = [*islice(self.index, len(self.sizes), None)]
        if not new:
            return
        words: dict[str, int] = {}
        of: list[int] = []
        counts = []
        for piece in new:
            if piece in self.special:
                counts.append(0)
                continue
            parts = pretokens.split(piece, self.path)
            counts.append(len(parts))
            of += [words.setdefault(w, len(words)) for w in parts]
        flat, lengths = encode_words([*words], self.rules) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        begins, of = np.cumsum(lengths) - lengths, np.array(of, np.int64)
        ids, per_word = flat[ranges(begins[of], lengths[of])], lengths[of]
        owner = np.repeat(np.arange(len(new)), counts)
        sizes = np.bincount(owner, per_word, len(new)).astype(np.int64)
        if self.special and any(p in self.special for p in new):
            whole = [ids[a : a + s] if p not in self.special else np.array([self.special[p]]) for p, a, s in zip(new, np.cumsum(sizes) - sizes, sizes)]
            ids, sizes = np.concatenate(whole), np.array([len(x) for x in whole], np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """df with the array column `ids_col`: the ids of the text by the byte-level BPE file at `path`, no specials added.

    With `decoded_col` also the text that the ids decode to, as decode() makes it, in the same task.

    A special token's string inside a text becomes that token, as the tokenizers library has it by default. Null and
    empty texts get an empty array; texts of any length are taken whole. Every row gives one row, repeated ones too, and
    ids play no part; an empty table gives an empty result. A column of the name `ids_col` is replaced; all others stay
    as they are.
    """
    kept = [c for c in df.columns if c not in (ids_col, decoded_col)]
    source = df.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + f", `{ids_col}` array<int>" + (f", `{decoded_col}` string" if decoded_col else "")
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(path)
        for batch in batches:
            for start in range(0, max(1, len(batch)), SLICE):
                if len(memory.index) > REMEMBERED:
                    memory.clear()
                look, part = memory.index.__getitem__, batch.slice(start, SLICE)
                found = [np.array([*map(look, pretokens.pieces(text.as_py(), path))], np.int32) for text in part.column(place)]
                memory.learn()
                for first in range(0, max(1, len(part)), ROWS):
                    yield lists(memory, part.slice(first, ROWS), found[first : first + ROWS])

    def lists(memory: _Memory, rows: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
        of = np.concatenate([*found, np.zeros(0, np.int32)])
        sizes = memory.sizes[of]
        ids = memory.ids[ranges(memory.starts[of], sizes)]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)]
        made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
        if not decoded_col:
            return pa.RecordBatch.from_arrays([*rows.columns, made], [*kept, ids_col])
        return pa.RecordBatch.from_arrays([*rows.columns, made, _texts(ids, ends, path)], [*kept, ids_col, decoded_col])

    return source.mapInArrow(run, schema)


def _texts(ids: np.ndarray, ends: np.ndarray, path: str) -> pa.Array:
    """The texts of lists of ids, end to end; a list ends where the next begins."""
    table, begins, lengths = token_bytes(path)
    ids = ids.astype(np.int64)
    data = table[ranges(begins[ids], lengths[ids])].tobytes()
    at = np.concatenate([[0], np.cumsum(lengths[ids])])[ends].tolist()
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])], pa.string())


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with the string column `text_col`: the text of the ids, special tokens written out.

    Bytes that are not UTF-8 become U+FFFD, null ids and empty lists the empty text; lists of any length are taken whole;
    ids beyond the vocabulary are an error. Every row gives one row, repeated ones too; an empty table gives an empty
    result; a column of the name `text_col` is replaced, all others stay as they are.
    """
    kept = [c for c in df.columns if c != text_col]
    source = df.select(*kept)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + f", `{text_col}` string"
    place = kept.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, max(1, len(batch)), ROWS):
                part = batch.slice(start, ROWS)
                lists = part.column(place)
                counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = _texts(ids, np.concatenate([[0], np.cumsum(counts)]), path)
                yield pa.RecordBatch.from_arrays([*part.columns, texts], [*kept, text_col])

    return source.mapInArrow(run, schema)
