"""Exact duplicate removal by progressive refinement: length, then a hash of the prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Characters of the prefix that the second step hashes.
PREFIX = 256


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashes: bool = False) -> DataFrame:
    """(id, keep_id, group_size, kept, text_hash, stays[, text_sha256]) of every row: groups of texts that are equal
    after normalising white space.

    The first reading keeps the length and the hash of a prefix of each text. Lengths that occur once end there, then
    pairs of length and prefix hash that occur once. Only the texts of the surviving groups are read again and hashed
    whole. With `hashes` the whole hash of every text is asked for, so the first reading takes it along, the groups
    are refined in the same steps, and no text is read again. text_hash is xxhash64 of the text as it is.

    Of a group the row with the smallest id stays; rows that share that id are all `kept`, and `stays` marks one of them
    (several only if they have the same id and text). Null texts count as empty,
    so that they are one group with the empty ones. Null ids come last: keep_id is null where a group has no others,
    and then all its rows are kept. Every row gives one row; texts of any length are taken whole; an empty table gives
    an empty result; other columns are ignored. Every step pre-aggregates before its shuffle and finds the group of
    each row by a join, which adaptive execution splits where one group is large.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).withColumn("t", normalised(F.col("text")))
    docs = docs.withColumns({"length": F.length("t"), "prefix": F.xxhash64(F.substring("t", 1, PREFIX))})
    full = F.sha2("t", 256).alias("text_sha256")
    carried = ["id", "text_hash", *(["text_sha256"] if hashes else [])]
    first = cut(docs.select("id", "text_hash", "length", "prefix", *([full] if hashes else [])))

    by_length = cut(first.groupBy("length").count().filter("count > 1").select("length"))
    by_prefix = first.join(by_length, "length", "left_semi").groupBy("length", "prefix").count()
    by_prefix = cut(by_prefix.filter("count > 1").select("length", "prefix"))

    alone = first.join(by_prefix, ["length", "prefix"], "left_anti").select(*carried, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("stays"))
    again = first if hashes else docs.select("id", "text_hash", "length", "prefix", "t")
    again = again.join(by_prefix, ["length", "prefix"], "left_semi")
    hashed = cut(again.select("id", "text_hash", "text_sha256" if hashes else full))
    order = F.struct(F.col("id").isNull().alias("null"), "id", "text_hash")
    groups = cut(hashed.groupBy("text_sha256").agg(F.min(order).alias("one"), F.count("*").alias("group_size")))
    stays = F.col("one.id").eqNullSafe(F.col("id")) & (F.col("one.text_hash") == F.col("text_hash"))
    grouped = hashed.join(groups, "text_sha256").select(*carried, F.col("one.id").alias("keep_id"), "group_size", stays.alias("stays"))

    out = alone.union(grouped).withColumn("kept", F.col("keep_id").eqNullSafe(F.col("id")))
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_hash", "stays", *carried[2:])
