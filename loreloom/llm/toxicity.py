"""Toxicity scores from Kneser-Ney models of toxic and of ordinary texts: n-grams of bytes over whole texts, and words.

The n-gram models give each byte its chance after the bytes before it, by backing off from context to shorter context;
a text's log-likelihoods by both are compared whole, by its length. A word is counted once a document. Each class has its
own counts; both back off to the same shared counts, so that rare expressions are smoothed alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RollingHash, chunks, codes, cut, map_texts, text_bytes, words

#: A text's log-likelihoods are compared over this many of its words, those that speak most for the toxic model.
STRONGEST = 2

#: Length of the n-grams, in bytes of the text with A-Z lower-cased and each run of white space as one space.
ORDER = 5

#: N-grams up to this length are the shared backoff: their counts are those of both classes together.
SHARED = 2

#: At most so many of the most frequent words, and of n-grams, are broadcast to the tasks that score; the others are joined.
HEAD = 1 << 20

#: Absolute discount of Kneser-Ney smoothing.
DISCOUNT = 0.75

#: Remainders of crc32(doc_id) mod 5: 0 is held out, rows of CALIBRATION set the threshold, all others give the counts.
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 1

#: The threshold is fitted on at most so many labelled rows of the calibration fold, those with the smallest hashes;
#: its other rows are counted like those of the other folds.
CALIBRATION_ROWS = 20_000

#: How far the weights of the score are kept near 0, so that separable rows have finite ones.
RIDGE = 1e-3

#: The classes' columns of counts.
CLASSES = ("toxic", "ordinary")

#: A task collects four times so many words or n-grams before it passes on the distinct ones, in batches of ROWS.
FLUSH, ROWS = 500_000, 100_000

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_CODES = codes(fold=True)
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _distinct_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of texts: first and last row, and the rows and 63-bit hashes of each text's distinct words, sorted.

    Words are runs without white space, A-Z as a-z, without the ASCII punctuation at their ends.
    """
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, rows = words(own, at)
        if len(starts):
            place = np.arange(len(own))
            sign = _SIGN[own]
            starts = np.minimum.accumulate(np.where(sign, len(own), place)[::-1])[::-1][starts]
            ends = np.maximum.accumulate(np.where(sign, -1, place))[ends - 1] + 1
            some = starts < ends
            starts, ends, rows = starts[some], ends[some], rows[some]
        grams = RollingHash(own, _CODES).ranges(starts, ends) >> np.uint64(1)
        order = np.lexsort((grams, rows))
        rows, grams = rows[order], grams[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])
        yield a, b, rows[new], grams[new]


def _ngrams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For chunks of texts: first and last row, each byte's row, and the ORDER bytes up to it as one number.

    Runs of white space are one byte; before a text's start there are spaces.
    """
    data, offsets = text_bytes(column)
    for a, b in chunks(offsets):
        own = _FOLD[data[offsets[a] : offsets[b]]]
        rows = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
        if len(own):
            keep = np.ones(len(own), bool)
            keep[1:] = (own[1:] != 32) | (own[:-1] != 32) | (rows[1:] != rows[:-1])
            own, rows = own[keep], rows[keep]
        # ORDER - 1 spaces stand before each text
        at = np.arange(len(own)) + (ORDER - 1) * (rows + 1)
        padded = np.full(len(own) + (ORDER - 1) * (b - a), 32, np.uint64)
        padded[at] = own
        grams = np.zeros(len(padded), np.uint64)
        for i in range(ORDER):
            grams[ORDER - 1 :] |= padded[ORDER - 1 - i : len(padded) - i] << np.uint64(8 * i)
        yield a, b, rows, grams[at]


def _counts(labelled: DataFrame, with_words: bool, with_ngrams: bool) -> DataFrame:
    """(gram, toxic, ordinary) of what is asked for, in one reading of (text, toxic); an n-gram is below 0, as ~gram."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [(cut_up, []) for cut_up, asked in ((_distinct_words, with_words), (_ngrams, with_ngrams)) if asked]
        sizes = {cut_up: 0 for cut_up, _ in kinds}
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
            for cut_up, held in kinds:
                for a, b, rows, grams in cut_up(batch.column(0)):
                    held.append(grams << np.uint64(1) | label[a:b][rows])
                    sizes[cut_up] += len(grams)
                    if sizes[cut_up] > 4 * FLUSH:
                        yield from _counted(held, cut_up is _ngrams)
                        sizes[cut_up] = 0
        for cut_up, held in kinds:
            if held:
                yield from _counted(held, cut_up is _ngrams)

    counted = labelled.select("text", "toxic").mapInArrow(gather, "gram long, toxic long, ordinary long")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _counted(held: list[np.ndarray], below: bool) -> Iterator[pa.RecordBatch]:
    keys, n = np.unique(np.concatenate(held), return_counts=True)
    toxic = (keys & np.uint64(1)).astype(bool)
    held.clear()
    for a in range(0, len(keys), ROWS):
        part, count = slice(a, a + ROWS), n[a : a + ROWS]
        gram = (keys[part] >> np.uint64(1)).astype(np.int64)
        yield pa.record_batch([pa.array(~gram if below else gram), pa.array(np.where(toxic[part], count, 0)), pa.array(np.where(toxic[part], 0, count))], ["gram", "toxic", "ordinary"])


def _of_ngrams(counts: DataFrame) -> DataFrame:
    return counts.filter("gram < 0").withColumn("gram", F.bitwise_not("gram"))


def word_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): in how many texts of either class of (text, toxic) each word occurs."""
    return _counts(labelled, True, False)


def ngram_counts(labelled: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary): how often each n-gram occurs in the texts of either class of (text, toxic)."""
    return _of_ngrams(_counts(labelled, False, True))


def _suffix(order: int) -> Column:
    return F.col("gram").bitwiseAND((1 << 8 * order) - 1)


def levels_of(counts: DataFrame) -> dict[int, DataFrame]:
    """For each order from SHARED on (gram, toxic, ordinary), each n-gram on its own; of SHARED itself (gram, n).

    The longest order has the corpus counts; a shorter one has the number of distinct bytes seen before the n-gram, in
    texts of the class, or of either class in the shared order.
    """
    levels = {ORDER: counts}
    for order in range(ORDER - 1, SHARED - 1, -1):
        seen = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in CLASSES] if order > SHARED else [F.count("*").alias("n")]
        levels[order] = cut(levels[order + 1].groupBy(_suffix(order).alias("gram")).agg(*seen))
    return levels


def _pairs(level: DataFrame) -> DataFrame:
    """(gram, chance): the shared chances of all 65,536 pairs of bytes, from the level of order 2; single bytes are
    smoothed to equal chances."""
    found = level.toArrow()  # at most 65,536 rows
    n = np.zeros(1 << 16)
    n[found["gram"].to_numpy()] = found["n"].to_numpy()
    n = n.reshape(256, 256)  # byte before, byte
    seen = (n > 0).sum(0)
    single = (np.maximum(seen - DISCOUNT, 0) + DISCOUNT * (seen > 0).sum() / 256) / seen.sum() if seen.any() else np.full(256, 1 / 256)
    total, spread = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    chance = np.maximum(n - DISCOUNT, 0) / np.maximum(total, 1) + np.where(total > 0, DISCOUNT * spread / np.maximum(total, 1), 1) * single
    return level.sparkSession.createDataFrame(pa.table({"gram": np.arange(1 << 16), "chance": chance.ravel()}))


def chances(wanted: DataFrame, levels: dict[int, DataFrame], order: int = ORDER) -> DataFrame:
    """(gram, toxic, ordinary): the chance of the last byte of each distinct n-gram wanted, given those before it; of the
    shared order, of all pairs of bytes.

    It is the n-gram's discounted share of its context's count, and the context's weight times the chance at the next
    shorter order; of a context that the class doesn't have, that chance alone. The n-grams wanted and the counted ones
    meet by their context, which has at most 256 of either, so one exchange gives an order both counts. All tables stay
    distributed but the pairs, which are broadcast.
    """
    if order == SHARED:
        return F.broadcast(_pairs(levels[SHARED])).select("gram", *(F.col("chance").alias(c) for c in CLASSES))
    shorter = chances(wanted.select(_suffix(order - 1).alias("gram")), levels, order - 1)
    shorter = shorter.select(F.col("gram").alias("suffix"), *(F.col(c).alias(f"{c}_below") for c in CLASSES))
    both = wanted.select("gram", F.lit(True).alias("asked"), *(F.lit(0).cast("long").alias(c) for c in CLASSES)).union(levels[order].select("gram", F.lit(False), *CLASSES))
    found = both.withColumn("context", F.shiftright("gram", 8)).repartition("context").groupBy("context", "gram").agg(F.max("asked").alias("asked"), *(F.sum(c).alias(c) for c in CLASSES))
    context = Window.partitionBy("context")
    sums = {f"{c}_total": F.sum(c).over(context) for c in CLASSES} | {f"{c}_spread": F.sum((F.col(c) > 0).cast("long")).over(context) for c in CLASSES}
    known = found.withColumns(sums).filter("asked").withColumn("suffix", _suffix(order - 1)).join(shorter, "suffix")

    def chance(c: str) -> Column:
        own = F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"{c}_spread") * F.col(f"{c}_below")
        return F.when(F.col(f"{c}_total") > 0, own / F.col(f"{c}_total")).otherwise(F.col(f"{c}_below")).alias(c)

    return known.select("gram", *(chance(c) for c in CLASSES))


def _ngram_ratios(wanted: DataFrame, levels: dict[int, DataFrame]) -> DataFrame:
    """(gram, ratio): log of the toxic over the ordinary chance of each distinct n-gram wanted."""
    return chances(wanted, levels).select("gram", (F.log("toxic") - F.log("ordinary")).alias("ratio"))


class Model:
    """Sums of the counts, which give every word its chances in the two classes."""

    def __init__(self, counts: DataFrame):
        sums = [f(c).alias(name) for c in CLASSES for f, name in ((F.sum, c), (lambda c: F.sum((F.col(c) > 0).cast("long")), f"{c}_words"))]
        found = counts.agg(*sums, F.count("*").alias("words")).first().asDict()
        self.of = {k: v or 0 for k, v in found.items()}

    def chance(self, of: str, toxic: Column, ordinary: Column) -> Column:
        """The chance that the class draws a word of these counts: its discounted share, and the discounts' weight times
        the shared chance, which is smoothed to equal ones in the same way."""
        n, share = self.of, F.greatest(toxic + ordinary - DISCOUNT, F.lit(0.0)) + DISCOUNT * self.of["words"] / (self.of["words"] + 1)
        share = share / max(1, n["toxic"] + n["ordinary"])
        own = F.greatest((toxic if of == "toxic" else ordinary) - DISCOUNT, F.lit(0.0)) + DISCOUNT * n[f"{of}_words"] * share
        return own / n[of] if n[of] else share

    def ratio(self, toxic: Column, ordinary: Column) -> Column:
        """Log of the toxic over the ordinary chance; 0 where there are no counts at all."""
        return F.log(self.chance("toxic", toxic, ordinary)) - F.log(self.chance("ordinary", toxic, ordinary)) if self.of["words"] else F.lit(0.0)


def _head(counted: DataFrame, most: int) -> DataFrame:
    """The most frequent rows of (gram, n, ...), at most so many: those from a level of log2(n) on."""
    level = F.floor(4 * F.log2("n"))
    least = None
    for row in sorted(counted.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        most -= row["rows"]
        if most < 0:
            break
        least = row["level"]
    return counted.filter(level >= least) if least is not None else counted.limit(0)


class Table:
    """Numbers of n-grams, found by open addressing; each n-gram has its own place."""

    NONE = np.uint64((1 << 64) - 1)

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(grams) - 1).bit_length())
        self.keys, self.values = np.full(1 << self.bits, self.NONE), np.zeros(1 << self.bits)
        at, left = self.places(grams), np.arange(len(grams))
        while len(left):
            free = left[self.keys[at[left]] == self.NONE]
            self.keys[at[free]] = grams[free]
            left = left[self.keys[at[left]] != grams[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        self.values[at] = values

    def places(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams' numbers, 0 of those that aren't in the table, and which aren't."""
        at = self.places(grams)
        missing = self.keys[at] != grams
        left = np.flatnonzero(missing)
        while len(left):
            left = left[self.keys[at[left]] != self.NONE]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[left]] == grams[left]
            missing[left[hit]] = False
            left = left[~hit]
        return np.where(missing, 0, self.values[at]), missing


def _broadcast(docs: DataFrame, ratios: DataFrame) -> Broadcast:
    found = ratios.select("gram", "ratio").toArrow()
    return docs.sparkSession.sparkContext.broadcast(Table(found["gram"].to_numpy().astype(np.uint64), found["ratio"].to_numpy()))


def _lists(rows: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    """The values of each of n rows, which are in order, as lists."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int32)), values)


def log_ratios(docs: DataFrame, counts: DataFrame, head: int = HEAD, ngrams: DataFrame | None = None) -> DataFrame:
    """(doc_id, text_hash, ratio) of every row of (doc_id, text): toxic minus ordinary log-likelihood of the STRONGEST
    words, by their number; 0 for a text without words, and for each word that a shorter text lacks.

    With ngrams, their counts, also `whole`: toxic minus ordinary log-likelihood of the whole text by the n-gram models,
    each byte given those before it, by the number of bytes; 0 for an empty text.

    The words that counts doesn't have get the ratio of unseen words. The most frequent words' and n-grams' ratios are
    broadcast, a text's others are joined; n-grams that neither class has back off.
    """
    model = Model(counts)
    n = [F.col(c) for c in CLASSES]
    rated = cut(counts.select("gram", (n[0] + n[1]).alias("n"), model.ratio(*n).alias("ratio")))
    table = _broadcast(docs, _head(rated, head))
    deep = ngrams is not None
    if deep:
        levels = levels_of(ngrams)
        grams = _broadcast(docs, _ngram_ratios(_head(ngrams.select("gram", (n[0] + n[1]).alias("n")), head).select("gram"), levels))

    def words_of(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b, rows, found in _distinct_words(texts):
            values, missing = table.value.find(found)
            row, value = rows[~missing], values[~missing]
            order = np.lexsort((-value, row))
            row, value = row[order], value[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < STRONGEST
            yield a, b, [_lists(row[near], pa.array(value[near]), b - a), _lists(rows[missing], pa.array(found[missing].astype(np.int64)), b - a)]

    def ngrams_of(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b, rows, found in _ngrams(texts):
            values, missing = grams.value.find(found)
            own, times = np.unique(rows[missing].astype(np.uint64) << np.uint64(8 * ORDER) | found[missing], return_counts=True)
            rare = pa.StructArray.from_arrays([pa.array((own & np.uint64((1 << 8 * ORDER) - 1)).astype(np.int64)), pa.array(times)], ["gram", "n"])
            yield a, b, [pa.array(np.bincount(rows, values, b - a).astype(float)), pa.array(np.bincount(rows, minlength=b - a)), _lists((own >> np.uint64(8 * ORDER)).astype(np.int64), rare, b - a)]

    def rate(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        # both are cut into the same chunks of texts
        parts = zip(words_of(batch.column(1)), ngrams_of(batch.column(1))) if deep else ((found, (0, 0, [])) for found in words_of(batch.column(1)))
        for (a, b, told), (_, _, more) in parts:
            part = batch.slice(a, b - a)
            yield pa.record_batch([part.column(0), part.column(2), *told, *more], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, known array<double>, rare array<long>" + (", common double, size long, rare_grams array<struct<gram: long, n: long>>" if deep else "")
    names = ["doc_id", "text_hash", "known", "rare", *(("common", "size", "rare_grams") if deep else ())]
    found = map_texts(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), rate, schema)
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    largest = lambda x: F.slice(F.sort_array(x, asc=False), 1, STRONGEST)
    rare = found.select("row", F.explode("rare").alias("gram")).join(rated.select("gram", "ratio"), "gram")
    rare = rare.groupBy("row").agg(largest(F.collect_list("ratio")).alias("others"), F.count("*").alias("n_others"))
    unseen = F.array_repeat(model.ratio(F.lit(0), F.lit(0)), F.least(F.lit(STRONGEST), F.size("rare") - F.coalesce("n_others", F.lit(0))).cast("int"))
    all_of = largest(F.concat("known", F.coalesce("others", F.array().cast("array<double>")), unseen))
    total = F.aggregate(all_of, F.lit(0.0), lambda x, y: x + y)
    columns = ["doc_id", "text_hash", (total / STRONGEST).alias("ratio")]
    if not deep:
        return found.join(rare, "row", "left").select(columns)
    seldom = found.select("row", F.explode("rare_grams").alias("x")).select("row", "x.gram", "x.n")
    # a sum of whole numbers, which doesn't depend on the order of the rows
    units = F.sum(F.col("n") * F.round(F.col("ratio") * 2**32).cast("long")) / 2**32
    seldom = seldom.join(_ngram_ratios(seldom.select("gram").distinct(), levels), "gram", "left").groupBy("row").agg(units.alias("seldom"))
    whole = (F.col("common") + F.coalesce("seldom", F.lit(0.0))) / F.greatest("size", F.lit(1))
    return found.join(rare, "row", "left").join(seldom, "row", "left").select(*columns, whole.alias("whole"))


def _fit_weights(told: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The weight of each column of told in the score: a logistic regression in which both classes weigh the same; none is
    below 0. Without rows of both classes the first column counts alone."""
    alone = np.eye(told.shape[1])[0]
    if not len(told) or toxic.all() or not toxic.any():
        return alone
    spread = told.std(0)
    spread[spread == 0] = 1
    x = np.column_stack([np.ones(len(told)), (told - told.mean(0)) / spread])
    share = np.where(toxic, 0.5 / toxic.sum(), 0.5 / (~toxic).sum())
    fitted = np.zeros(x.shape[1])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(x @ fitted, -30, 30)))
        slope = x.T @ (share * (chance - toxic)) + RIDGE * fitted
        fitted -= np.linalg.solve(x.T @ (x * (share * chance * (1 - chance))[:, None]) + RIDGE * np.eye(x.shape[1]), slope)
    weights = np.maximum(fitted[1:], 0) / spread
    return weights if weights.any() else alone


def _fit_threshold(ratio: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic score: the cut with the smallest share of wrong rows, both classes weighing the
    same however many rows they have, and a slope from the classes' spread."""
    if not len(ratio) or toxic.all() or not toxic.any():
        return 1.0, 0.0 if not len(ratio) or not toxic.all() else -1e9
    order = np.argsort(ratio, kind="stable")
    ratio, toxic = ratio[order], toxic[order].astype(bool)
    # wrong rows if all from place i on are called toxic
    missed = np.concatenate([[0], np.cumsum(toxic)]) / toxic.sum()
    wrong = missed + np.concatenate([np.cumsum(~toxic[::-1])[::-1], [0]]) / (~toxic).sum()
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    i = int(best[len(best) // 2])
    low, high = ratio[max(0, i - 1)], ratio[min(i, len(ratio) - 1)]
    middle = float((low + high) / 2)
    gap = abs(float(np.median(ratio[toxic])) - float(np.median(ratio[~toxic])))
    return 6.0 / max(gap, 1e-6), middle


def score(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted, text_hash) of every row of df, learned from all labelled rows that are not held out.

    The score is a logistic function, from 0 to 1, of two differences of log-likelihoods: of the whole text by the n-gram
    models, normalised by its length, and of its strongest words, normalised by their number; calibration rows give
    their weights. predicted is 1 from 0.5 on. Null and empty texts have difference 0. Rows without a label, or with a null one, teach nothing;
    repeated labels of an id teach once, the largest. Without labelled rows every score is below 0.5. Other columns are
    ignored, and neither they nor the id or the label are inputs of a score. Every row gives one row and is scored by its
    own text: null and repeated ids are like others, and text_hash, xxhash64 of the text, tells them apart; a label of a
    repeated id holds for all its rows, and null ids have none. Texts of any length are taken whole; an empty table gives
    an empty result.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    given = labels.filter(F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(toxic_col)).cast("int").alias("toxic")).filter(fold != HELD_OUT)
    # a merge join whatever the labels' size: they may be as many as the documents, and the plan is the same at all sizes
    bounded = cut(given.filter(fold == CALIBRATION).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS))
    taught = given.join(F.broadcast(bounded.select("doc_id")), "doc_id", "left_anti")
    counts = cut(_counts(docs.filter(fold != HELD_OUT).join(taught.hint("merge"), "doc_id"), True, True))
    scored = cut(log_ratios(docs, counts.filter("gram >= 0"), ngrams=_of_ngrams(counts)))

    # one row an id, however many rows have it
    known = scored.join(F.broadcast(bounded), "doc_id").groupBy("doc_id").agg(F.max(F.struct("ratio", "whole")).alias("m"), F.first("toxic").alias("toxic")).select("m.*", "toxic").toPandas()
    told, toxic = known[["ratio", "whole"]].to_numpy(), known["toxic"].to_numpy() > 0
    weights = _fit_weights(told, toxic)
    slope, middle = _fit_threshold(told @ weights, toxic)

    joint = F.col("ratio") * float(weights[0]) + F.col("whole") * float(weights[1])
    value = 1 / (1 + F.exp(F.greatest(F.lit(-500.0), F.least(F.lit(500.0), -F.lit(slope) * (joint - F.lit(middle) if len(known) else F.lit(-1.0))))))
    out = scored.select(F.col("doc_id").alias(id_col), (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT).alias("held_out"), value.alias("score"), "text_hash")
    return out.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_hash")
