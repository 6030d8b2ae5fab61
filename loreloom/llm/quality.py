"""Quality rules, and the removal of lines that many documents of a host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, chunks, codes, combine, cut, map_texts, run_lengths, shingles, text_bytes, words

#: A line is boilerplate if more distinct documents of its host have it than this number, however large the host is.
LINE_DOCS = 20

#: A document is depleted if less than this share of its words is in lines that stay, or fewer words than this.
LEAST_SHARE, LEAST_WORDS = 0.5, 10

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True


def _line_hashes(hashes: np.ndarray, line: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of the words of each line in order, and its number of words; line is sorted."""
    counts = np.bincount(line, minlength=n_lines)
    begins = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - begins[line]
    placed = combine([hashes, place.astype(np.uint64)])
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed)])
        return sums[begins + counts] - sums[begins], counts


def _stats(df: DataFrame) -> DataFrame:
    """The rules' counts for each text, with the words and the hash of each distinct line that has words.

    Lines differ in the hash if their words, A-Z lower-cased, differ; digits are alike, so that counters and dates
    don't hide a repeated line.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = text_bytes(batch.column(2))
        for a, b in chunks(offsets):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            n = b - a
            starts, ends, rows = words(own, at)
            n_words = np.bincount(rows, minlength=n)
            lead = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            word_chars = np.bincount(rows, lead[ends] - lead[starts], n).astype(np.int64)
            marks = np.concatenate([[0], np.cumsum(SYMBOLS[own])])
            n_symbols = marks[at[1:]] - marks[at[:-1]]

            # repeated windows of five words: sort them within their text, then mark all words of those found twice
            exact = RollingHash(own, codes()).ranges(starts, ends)
            window, first = shingles(exact, rows)
            order = np.lexsort((window, rows[first]))
            window, first = window[order], first[order]
            run, length = run_lengths(combine([window, rows[first].astype(np.uint64)]))
            twice = first[np.repeat(length > 1, length)]
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, twice, 1)
            np.add.at(cover, np.minimum(twice + 5, len(starts)), -1)
            n_repeat = np.bincount(rows[np.cumsum(cover[:-1]) > 0], minlength=n)

            # a line is the bytes between two \n; two lines are equal if all their bytes are
            breaks = own == 10
            number = np.concatenate([[0], np.cumsum(breaks)])
            at_line = number[starts] + rows  # lines are numbered on over the texts
            lines, line = np.unique(at_line, return_inverse=True)
            line_row = rows[np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1])] if len(line) else np.zeros(0, np.int64)
            stops = np.sort(np.concatenate([np.flatnonzero(breaks), at[1:]]))  # ends of all lines, by their numbers
            begins = np.concatenate([[0], stops[:-1]])
            begins = begins + np.append(breaks, False)[begins]
            raw = RollingHash(own, codes()).ranges(begins[lines], stops[lines])
            key = combine([raw, line_row.astype(np.uint64)])
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            order = np.lexsort((np.arange(len(key)), back))
            later = np.ones(len(key), bool)
            later[order[np.cumsum(times) - times]] = False
            n_dup = np.bincount(line_row[later], minlength=n)

            folded = codes(fold=True)
            folded[48:58] = folded[48]
            shared, in_line = _line_hashes(RollingHash(own, folded).ranges(starts, ends), line, len(lines))
            ends_of = np.concatenate([[0], np.cumsum(np.bincount(line_row, minlength=n))]).astype(np.int32)
            # of lines of the same hash in one text, one row with all their words
            struct = pa.StructArray.from_arrays([pa.array(shared.view(np.int64)), pa.array(in_line.astype(np.int64))], ["line", "words"])
            lists = pa.ListArray.from_arrays(pa.array(ends_of), struct)
            with np.errstate(over="ignore"):
                total = np.zeros(n, np.uint64)
                np.add.at(total, rows, combine([exact, np.arange(len(exact), dtype=np.uint64) - (np.cumsum(n_words) - n_words)[rows].astype(np.uint64)]))
            figures = [n_words, word_chars, n_symbols, n_dup, n_repeat]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, n), batch.column(1).slice(a, n), *(pa.array(x.astype(np.int64)) for x in figures), pa.array(total.view(np.int64)), lists],
                ["id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content", "lines"],
            )

    kind = df.schema["id"].dataType.simpleString()
    return map_texts(df, run, f"id {kind}, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content long, lines array<struct<line: long, words: long>>")


def line_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_kept_words, base_failed, kept) of every row.

    base_failed: fewer than 10 words, or more than 20% of them in 5-word windows that the text repeats. Of the others,
    a document is rejected if it is depleted once the lines are gone that are in more than `line_docs` distinct
    documents of its host, whatever the host's size. Documents of equal words count as one, so exact copies don't
    turn their own lines into boilerplate. Null texts have no words; the null host is a host of its own, other than the empty
    one. Every row gives one row and is judged by itself, whatever its id: null and repeated ids are like others. Texts
    of any length are taken whole; an empty table gives an empty result; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host")).select("id", "host", "text")
    stats = cut(_stats(docs).withColumn("row", F.monotonically_increasing_id()))
    host = F.xxhash64(F.coalesce("host", F.lit("")), F.col("host").isNull())
    lines = stats.select("row", "content", host.alias("host"), F.explode("lines").alias("l")).select("row", "content", F.xxhash64("host", "l.line").alias("line"), "l.words")

    # lines of as many rows first: few are left for the exact count of distinct documents
    often = lines.groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") > line_docs).select("line")
    candidate = lines.join(often, "line", "left_semi")
    counted = candidate.select("line", "content").distinct().groupBy("line").agg(F.count("*").alias("n"))
    boilerplate = counted.filter(F.col("n") > line_docs).select("line")
    lost = lines.join(boilerplate, "line", "left_semi").groupBy("row").agg(F.sum("words").alias("lost"))

    joined = stats.drop("lines", "content", "host").join(lost, "row", "left").withColumn("n_kept_words", F.col("n_words") - F.coalesce("lost", F.lit(0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    enough = (F.col("n_kept_words") >= LEAST_WORDS) & (F.col("n_kept_words") >= LEAST_SHARE * F.col("n_words"))
    return joined.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", failed.alias("base_failed"), (~failed & enough).alias("kept"))
