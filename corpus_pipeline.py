"""The text pipeline: toxicity, exact copies, near copies, mixing to target weights, BPE ids."""

from __future__ import annotations

from collections.abc import Callable
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm import bpe, exact_dedup, minhash, mixing, toxicity
from loreloom.llm.common import cut, shared_folder
from loreloom.llm.queries import vocabulary_path

#: Each slot of the mix is a block of so many words.
BLOCK = 128


def _with(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """The rows of docs that are (left_semi) or aren't (left_anti) in found, told by id and text."""
    own = found.select(F.col("doc_id").alias("_found_id"), F.col("text_hash").alias("_found_hash"))
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("_found_id")) & (F.xxhash64("text") == F.col("_found_hash")), how)


def _one_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that found marks to stay; of rows with the same id and text one."""
    marked = cut(found.filter("stays").select("doc_id", "text_hash"))
    kept = _with(docs, marked, "left_semi")
    repeated = marked.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the rows whose text the toxicity score predicts as toxic.

    Null and empty texts are never toxic; null and repeated ids are rows like others; an empty table stays empty.
    """
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _with(docs, scored.filter("predicted = 1"), "left_anti")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, that of the smallest doc_id; null ids come last.

    Null and empty texts are one group; repeated rows are a group; an empty table stays empty.
    """
    return _one_each(docs, exact_dedup.exact_duplicates(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near duplicates, that of the smallest doc_id; null ids come last.

    Texts without words are linked with nothing and stay; repeated rows are a component; an empty table stays empty.
    """
    return _one_each(docs, minhash.near_duplicates(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it goes through them, each pass's words cut to those it takes.

    A pass that takes all of a document keeps its text as it is; where the mix begins or ends inside a document, that
    copy has only the words taken, joined by single spaces. Documents that the mix doesn't take go, texts without words
    among them; null ids and the null source are like others; an empty table stays empty. Rows are in the order of the
    slots in which the mix first takes them.
    """
    described, _, takes = mixing.mix(docs, block=BLOCK)
    # blocks of one pass follow each other, so a pass takes one range of words
    keys = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("source").alias("_source")]
    taken = takes.groupBy(*keys, "row", "pass").agg(F.min("first_word").alias("_first"), F.max(F.col("first_word") + F.col("n_words")).alias("_last"), F.min("slot").alias("_slot")).drop("row", "pass")
    # a plan of its own: as one with the texts' join and sort, adaptive execution plans all of it anew at each of its stages
    taken = cut(taken)
    # rows of equal id, text and source share what is taken of them
    repeated = described.groupBy("doc_id", "text_hash", "source").count().filter("count > 1").limit(1).count()
    own = docs.dropDuplicates(["doc_id", "text", "source"]) if repeated else docs
    joined = own.join(taken, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")) & F.col("source").eqNullSafe(F.col("_source")))
    words = F.split(F.trim(exact_dedup.normalised(F.col("text"))), " ")
    part = F.array_join(F.slice(words, F.col("_first").cast("int") + 1, (F.col("_last") - F.col("_first")).cast("int")), " ")
    text = F.when((F.col("_first") == 0) & (F.col("_last") == mixing.n_words(F.col("text"))), F.col("text")).otherwise(part)
    return joined.sort("_slot", "doc_id").withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, decoded_sha256): each row's token ids, and the digest of the text that they decode to.

    Null and empty texts have no ids and decode to the empty text; an empty table gives an empty result.
    """
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), vocabulary_path(), decoded_col="decoded")
    return encoded.select("doc_id", "source", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mix),
    ("bpe", encode),
]

#: Learned scores and merge rules can't be put in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each stage's rows are written to the shared folder and read again, and go
    once the next stage's are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{before}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
