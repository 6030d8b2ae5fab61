"""Embedding and exact nearest neighbours within scopes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
import regex

from .postings import containing
from .scopes import live

#: Width of the hashing embedder, and the default number of neighbours.
WIDTH, TOP = 256, 15

#: Texts that a model gets at a time.
MODEL_BATCH = 32

#: Document frequencies are counted for so many classes of words, so their table is bounded.
WORD_CLASSES = 1 << 18

#: A query table of at most so many numbers in all is broadcast, 64 MB; a larger one is joined by its scope keys.
BROADCAST_NUMBERS = 8_000_000

#: Queries of a scope that are compared at a time, and vectors of the index.
QUERY_BLOCK, ITEM_BLOCK = 256, 4096

#: Distances by a block product are off by less than this from sums in order, which decide.
SLACK = 1e-9

#: Distances that agree so far are equal, so that the order of a vector's sums doesn't decide between ids.
DIGITS = 12

#: An embedder makes an array<double> column of a text column.
Embedder = Callable[[Column], Column]

_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]+")

#: An embedder remembers so many words, some 15 MB; the frequent ones are soon known again once it forgets them.
_REMEMBERED = 50_000


def batch_embedder(encode: Callable[[list[str]], np.ndarray], batch: int = MODEL_BATCH) -> Embedder:
    """An embedder by a model: encode gets lists of texts and gives a row of numbers for each. Blank texts have no vector.

    Runs on Arrow batches in Python workers; encode is sent to them, so it should load its model when first called.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = [None] * len(texts)
        asked = [(i, t) for i, t in enumerate(texts.to_pylist()) if t and t.strip()]
        for a in range(0, len(asked), batch):
            part = asked[a : a + batch]
            for (i, _), row in zip(part, encode([t for _, t in part])):
                out[i] = np.asarray(row, np.float64)
        return pa.array(out, pa.list_(pa.float64()))

    return embed


class _Words(dict):
    """What the hashing embedder needs of each word, in one number: its class, its sign and its place, from its MD5."""

    def __init__(self, width: int):
        self.width = width

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        digest = int(hashlib.md5(word.encode()).hexdigest()[:17], 16)
        place, high, kind = (digest >> 36) % self.width, digest >> 32 & 8 == 0, (digest & 0xFFFFFFFF) % WORD_CLASSES
        found = self[word] = kind << 32 | high << 31 | place
        return found

    def of(self, word: str) -> tuple[int, int, int]:
        return tuple(x.item() for x in self.all_of([word]))

    def all_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places, signs and classes of words."""
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return found & 0x7FFFFFFF, np.where(found >> 31 & 1, 1, -1), found >> 32


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hash_embedder(width: int = WIDTH, weights: np.ndarray | None = None) -> Embedder:
    """An embedder without a model: counts of the words' hashes, scaled to length 1; blank texts have no vector.

    With weights, one for each class of words (word_weights), a word adds or takes away, by its own sign, its count
    times its weight, so that words that share a place cancel out instead of looking alike.
    """
    words = _Words(width)

    def vector(text: str) -> np.ndarray | None:
        found = words_of(text)
        if not found:
            return None
        place, sign, kind = words.all_of(found)
        value = None if weights is None else sign * weights[kind]
        made = np.bincount(place, value, width).astype(np.float64)
        norm = math.sqrt(float((made * made).sum()))
        return made / norm if norm else made

    @F.arrow_udf(ArrayType(DoubleType()))
    def embed(texts: pa.Array) -> pa.Array:
        # one text at a time, so that a batch is not held twice
        flat, ends, blank = np.empty((len(texts), width)), np.zeros(len(texts) + 1, np.int32), np.zeros(len(texts), bool)
        n = 0
        for i, value in enumerate(texts):
            made = vector(value.as_py() or "")
            blank[i] = made is None
            if made is not None:
                flat[n] = made
                n += 1
            ends[i + 1] = n * width
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[:n].ravel()), mask=pa.array(blank))

    return embed


def word_weights(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The inverse document frequency of each class of words, from a pass over all texts: log((1 + n) / (1 + n of the
    class)) + 1 of n texts. A task passes on one count for each class that it has seen."""
    words = _Words(1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(WORD_CLASSES, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                n += 1
                seen[np.unique(words.all_of(list(set(words_of(value.as_py() or ""))))[2])] += 1
        own = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(own, -1)), pa.array(np.append(seen[own], n))], ["kind", "n"])

    counted = docs.select(text).mapInArrow(count, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n")).toArrow()
    kind, n = (counted[c].to_numpy() for c in ("kind", "n"))  # at most WORD_CLASSES rows and the number of texts
    total, of = int(n[kind < 0].sum()), np.zeros(WORD_CLASSES)
    of[kind[kind >= 0]] = n[kind >= 0]
    return np.log((1 + total) / (1 + of)) + 1


def embed_documents(df: DataFrame, embedder: Embedder, text: str = "text", prefix: str = "search_document: ", model: str = "hash") -> DataFrame:
    """df with `embedding` and `embed_model`; the prefix tells a model that this is a document."""
    return df.withColumns({"embedding": embedder(F.concat(F.lit(prefix), text) if model != "hash" else F.col(text)), "embed_model": F.lit(model)})


def embed_queries(df: DataFrame, embedder: Embedder, text: str = "text", prefix: str = "search_query: ", model: str = "hash") -> DataFrame:
    return embed_documents(df, embedder, text, prefix, model)


def _packed(df: DataFrame, id_col: str, vector: str, keys: list[str], block: int) -> DataFrame:
    """(keys, width, ids, vectors): blocks of vectors of the same keys and width, packed where they are."""
    types = {c: df.schema[c].dataType.simpleString() for c in (id_col, *keys)}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "width int", f"ids array<{types[id_col]}>", "vectors binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            of: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(2 + j).to_pylist() for j in range(len(keys))), np.diff(ends).tolist())):
                of.setdefault(key, []).append(i)
            for key, rows in of.items():
                for a in range(0, len(rows), block):
                    own = np.array(rows[a : a + block])
                    vectors = flat[ends[own][:, None] + np.arange(key[-1])]
                    ids = batch.column(0).take(pa.array(own))
                    heads = [pa.array([k], batch.schema.field(2 + j).type) for j, k in enumerate(key[:-1])]
                    yield pa.record_batch([*heads, pa.array([key[-1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([vectors.tobytes()])], [*keys, "width", "ids", "vectors"])

    return df.select(id_col, F.col(vector).cast("array<double>").alias(vector), *keys).filter(F.size(vector) > 0).mapInArrow(run, schema)


def _in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of products in the order of the places, in doubles."""
    return np.cumsum(x * y, axis=-1)[..., -1]


def nearest(queries: np.ndarray, items: np.ndarray, ids: list, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest items as (distance, place), by cosine distance and then by id.

    A product of the two blocks finds those that can be among them; their distances are then summed in order, so that
    they don't depend on the blocks. What has no distance, for want of a length, comes last.
    """
    lengths = np.sqrt(_in_order(items, items))
    own = np.sqrt(_in_order(queries, queries))
    with np.errstate(divide="ignore", invalid="ignore"):
        rough = 1 - (items @ queries.T) / np.outer(lengths, own)
        rough[np.isnan(rough)] = np.inf
        limit = np.partition(rough, k - 1, axis=0)[k - 1] if len(items) > k else np.full(len(queries), np.inf)
        for q, most in enumerate(limit):
            near = np.flatnonzero(rough[:, q] <= most + SLACK)
            exact = 1 - _in_order(queries[q], items[near]) / (own[q] * lengths[near])
            exact = np.round(exact, DIGITS)
            exact[np.isnan(exact)] = np.inf
            yield q, sorted(zip(exact.tolist(), near.tolist()), key=lambda x: (x[0], ids[x[1]]))[:k]


def knn(queries: DataFrame, index: DataFrame, scopes: DataFrame, k: int = TOP, by: tuple[str, ...] = (), broadcast_numbers: int = BROADCAST_NUMBERS) -> DataFrame:
    """(query_id, [by], item_id, distance, rank): for each query the k nearest rows of the index in its scopes.

    queries: query_id, embedding; index: item_id, collection_id, embedding, [by]; scopes: query_id, collection_id. The
    scope is applied first, so a query gets min(k, rows in scope) of them; one without scopes gets none, and vectors of
    other widths than the query's are not in scope. by gives k rows for each value of more columns. Ties go to the
    smaller id. The index is packed into blocks where it is, without a shuffle; blocks meet the blocks of queries of the
    same scope, which are broadcast up to a checked size, and each pair passes on its own best k.
    """
    asked = queries.select("query_id", "embedding").filter("embedding is not null").join(scopes.select("query_id", "collection_id").distinct(), "query_id")
    held = asked.agg(F.sum(F.size("embedding") + 4)).first()[0] or 0
    blocks = _packed(asked, "query_id", "embedding", ["collection_id"], QUERY_BLOCK).select("collection_id", "width", F.col("ids").alias("asked"), F.col("vectors").alias("asked_vectors"))
    items = _packed(index.filter("embedding is not null"), "item_id", "embedding", ["collection_id", *by], ITEM_BLOCK)
    met = items.join(F.broadcast(blocks) if held <= broadcast_numbers else blocks, ["collection_id", "width"]).select("width", "ids", "vectors", "asked", "asked_vectors", *by)
    types = {"query_id": queries.schema["query_id"].dataType.simpleString(), "item_id": index.schema["item_id"].dataType.simpleString(), **{c: index.schema[c].dataType.simpleString() for c in by}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                width, ids, asked_ids = batch.column(0)[i].as_py(), batch.column(1)[i].values, batch.column(3)[i].values
                vectors, questions = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, width) for c in (2, 4))
                query, item, distance = [], [], []
                for q, found in nearest(questions, vectors, ids.to_pylist(), k):
                    query += [q] * len(found)
                    distance += [d for d, _ in found]
                    item += [at for _, at in found]
                own = [pa.array([batch.column(5 + j)[i].as_py()] * len(query), batch.schema.field(5 + j).type) for j in range(len(by))]
                yield pa.record_batch([asked_ids.take(pa.array(query, pa.int64())), *own, ids.take(pa.array(item, pa.int64())), pa.array(distance, pa.float64())], ["query_id", *by, "item_id", "distance"])

    near = met.mapInArrow(run, ", ".join([f"query_id {types['query_id']}", *(f"`{c}` {types[c]}" for c in by), f"item_id {types['item_id']}", "distance double"]))
    order = Window.partitionBy("query_id", *by).orderBy("distance", "item_id")
    return near.select("query_id", *by, "item_id", "distance", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k)


def knn_entities(queries: DataFrame, entities: DataFrame, scopes: DataFrame, k: int = TOP) -> DataFrame:
    """knn of the live entities, k for each kind. entities: item_id, collection_id, kind, embedding, vault_deleted."""
    return knn(queries, live(entities), scopes, k, ("kind",))


def knn_rules(queries: DataFrame, rules: DataFrame, scopes: DataFrame, k: int = TOP) -> DataFrame:
    """knn of the live rules. rules: item_id, collection_id, embedding, vault_deleted."""
    return knn(queries, live(rules), scopes, k)


def scan_entities(scopes: DataFrame, entities: DataFrame, n: int = 50) -> DataFrame:
    """(query_id, kind, item_id, rank): without vectors, the first n entities of each kind in scope, by id."""
    found = scopes.select("query_id", "collection_id").distinct().join(entities.select(F.col("id").alias("item_id"), "kind", "collection_id"), "collection_id")
    order = Window.partitionBy("query_id", "kind").orderBy("item_id")
    return found.select("query_id", "kind", "item_id", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= n)


def hybrid_passages(needles: DataFrame, semantic: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, place): the semantic hits by rank, then by id the chunks of the same collection whose text
    has the needle, each chunk once.

    needles: query_id, collection_id, needle; semantic: query_id, item_id, rank.
    """
    meant = semantic.select("query_id", F.col("item_id").alias("chunk_id"), F.lit(0).alias("way"), "rank")
    said = containing(needles, chunks).select("query_id", "chunk_id", F.lit(1).alias("way"), F.lit(0).alias("rank"))
    first = meant.union(said).groupBy("query_id", "chunk_id").agg(F.min(F.struct("way", "rank")).alias("o"))
    return first.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("o", "chunk_id")).alias("place"))


def apply_embeddings(df: DataFrame, vectors: DataFrame, model: str) -> DataFrame:
    """df (id, …) with the vectors of (id, embedding); an empty vector changes nothing, others stamp the model."""
    new = vectors.filter(F.size("embedding") > 0).select("id", F.col("embedding").alias("_v"))
    joined = df.join(new, "id", "left")
    return joined.withColumns({"embedding": F.coalesce("_v", "embedding"), "embed_model": F.when(F.col("_v").isNotNull(), model).otherwise(F.col("embed_model"))}).select(df.columns)


def model_mismatch(sources: DataFrame, active: str) -> DataFrame:
    """(embed_model, n): sources indexed with another model than the active one; a mock never mismatches."""
    if active == "mock":
        return sources.limit(0).groupBy("embed_model").agg(F.count("*").alias("n"))
    return sources.filter((F.col("embed_model") != active) & (F.col("embed_model") != "")).groupBy("embed_model").agg(F.count("*").alias("n")).orderBy("embed_model")


def recall_at_k(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, hit) for results (query_id, rank, text) and truth (query_id, marker): whether one of the first k texts
    has the marker, whatever the case."""
    found = results.filter(F.col("rank") <= k).join(truth, "query_id").groupBy("query_id").agg(F.max(F.contains(F.lower("text"), F.lower("marker"))).alias("hit"))
    return truth.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("hit"))


