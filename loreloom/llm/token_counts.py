"""Token counts without token ids: count the tokens of each distinct pre-token once, then add up per document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from .common import stored

#: Entries that a task collects before it passes them on, and documents that it counts at a time.
FLUSH, ROWS = 300_000, 1_000

#: The most pre-tokens that tasks hold in memory, and the most characters in one of these: a bound on the broadcast.
HEAD = 1 << 17


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of df, as the tokenizer file at path counts without added special tokens.

    The vocabulary of distinct pre-tokens is a distributed table with the corpus frequency and the token count of
    each. Of it, at most `head` short and frequent pre-tokens are broadcast and counted where the documents are read;
    this takes the hot keys away. The frequencies of all others are joined to the vocabulary and summed per document.
    Null and empty texts have 0 tokens. Every row gives one row, whatever its id: null and repeated ids are like
    others. Texts of any length are counted whole; an empty table gives an empty result; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = stored(_vocabulary(docs, path))
    known = docs.sparkSession.sparkContext.broadcast(_head(vocabulary, head))

    kind = docs.schema["doc_id"].dataType

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document a row of its own figures and a row for each piece that isn't known here."""
        table, row = known.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                rows: list[int] = []
                pieces: list[str] = []
                amounts: list[int] = []
                own: list[int | None] = []
                sizes: list[int | None] = []
                for i, text in enumerate(part.column(1)):
                    found = Counter(pretokens.pieces(text := text.as_py(), path))
                    total, row, first = 0, row + 1, len(pieces)
                    pieces.append(f"\0{row}")  # spreads these rows in the join; what it finds there doesn't count
                    amounts.append(0)
                    for piece, n in found.items():
                        tokens = table.get(piece)
                        if tokens is None:
                            pieces.append(piece)
                            amounts.append(n)
                        else:
                            total += tokens * n
                    amounts[first] = total
                    more = len(pieces) - first
                    rows += [row] * more
                    own += [i] + [None] * (more - 1)
                    sizes += [len(text.encode()) if text else 0] + [None] * (more - 1)
                ids = part.column(0).take(pa.array(own, pa.int64()))
                yield pa.record_batch([pa.array(rows, pa.int64()), pa.array(pieces, pa.string()), pa.array(amounts, pa.int64()), ids, pa.array(sizes, pa.int64())], ["row", "piece", "amount", "doc_id", "n_bytes"])

    read = docs.mapInArrow(counts, f"row long, piece string, amount long, doc_id {kind.simpleString()}, n_bytes long")
    joined = read.join(vocabulary.select("piece", "tokens"), "piece", "left")
    tokens = F.when(F.col("n_bytes").isNotNull(), F.col("amount")).otherwise(F.col("amount") * F.col("tokens"))
    summed = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(tokens).alias("n_tokens"))
    return summed.select(F.col("doc_id").alias(id_col), "n_bytes", "n_tokens")


def _vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(piece, frequency, tokens): each distinct pre-token, encoded once."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(pretokens.pieces(text.as_py(), path))
                if len(found) >= FLUSH:
                    yield _rows(found)
                    found = Counter()
        yield _rows(found)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = pretokens.load(path)
        for batch in batches:
            sizes = [len(x) for x in tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], ["piece", "frequency", "tokens"])

    counted = docs.select("text").mapInArrow(gather, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("frequency"))
    return counted.mapInArrow(encode, "piece string, frequency long, tokens long")


def _rows(found: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["piece", "n"])


def _head(vocabulary: DataFrame, most: int) -> dict[str, int]:
    """The most frequent short pre-tokens, by a frequency limit that at most `most` of them reach."""
    short = vocabulary.filter(F.length("piece") <= pretokens.LONG)
    level = F.floor(F.log2("frequency") * 4).cast("int")
    left, least = most, None
    for row in sorted(short.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        if row["count"] > left:
            break
        left, least = left - row["count"], row["level"]
    if least is None:
        return {}
    return {r["piece"]: r["tokens"] for r in short.filter(level >= least).select("piece", "tokens").toLocalIterator()}
