"""Upkeep of the chunk index and other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stamp_chunks(chunks: DataFrame, model: str) -> DataFrame:
    """chunks (source_id, ordinal, …) with a chunk_id that depends on nothing but these two, and the model."""
    return chunks.withColumns({"chunk_id": F.concat(F.lit("chunk:"), F.sha2(F.concat_ws("|", "source_id", F.col("ordinal").cast("string")), 256)), "embed_model": F.lit(model)})


def delete_by_source(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index without the chunks of the sources (source_id)."""
    return index.join(ids.select("source_id").distinct(), "source_id", "left_anti").select(index.columns)


def upsert_chunks(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with all chunks of the sources in new replaced."""
    return delete_by_source(index, new).unionByName(new.select(index.columns))


#: Parts of a collection in the stored index; a source's chunks are all in one.
BUCKETS = 16


def _place(df: DataFrame) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("source_id"), F.lit(BUCKETS)).cast("int"))


def _by_folder(df: DataFrame) -> DataFrame:
    """df dealt out by folder, so that a folder gets few files and not one from each task; large ones are split."""
    return df.hint("rebalance", F.col("collection_id"), F.col("bucket"))


def write_index(index: DataFrame, path: str) -> None:
    """A new stored index: a folder for each collection and bucket of sources, so that a scope reads its own files only."""
    _by_folder(_place(index)).write.mode("overwrite").partitionBy("collection_id", "bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def replace_in_index(new: DataFrame, sources: DataFrame, path: str) -> None:
    """Puts the chunks in new (collection_id, source_id, ...) in place of all chunks of sources (collection_id, source_id)
    in the index at path; sources without new chunks lose theirs.

    Only the folders of the sources' buckets are read and written again, and each changes when the job commits. Doing it
    again changes nothing, so a batch of a stream may come twice. One writer at a time.
    """
    spark = new.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = _place(sources.select("collection_id", "source_id").distinct())
    touched = gone.select("collection_id", "bucket").distinct()
    merged = _place(new)
    if store.exists(folder):
        old = spark.read.parquet(path)
        kept = old.join(touched, ["collection_id", "bucket"], "left_semi").join(gone.select("collection_id", "source_id"), ["collection_id", "source_id"], "left_anti")
        merged = kept.select(old.columns).unionByName(merged.select(old.columns))
    _by_folder(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection_id", "bucket").parquet(path)
    # a folder that lost all its chunks isn't written, so what it had is still there
    left = spark.read.schema(merged.schema).parquet(path).join(touched, ["collection_id", "bucket"], "left_semi")
    stale = left.join(gone.select("collection_id", "source_id"), ["collection_id", "source_id"], "left_semi").join(new.select("collection_id", "source_id").distinct(), ["collection_id", "source_id"], "left_anti")
    for row in stale.select("collection_id", "bucket").distinct().toLocalIterator():
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(row["collection_id"]))
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/collection_id={name}/bucket={row['bucket']}"), True)


def apply_ingest_status(sources: DataFrame, index: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, index) after outcomes (source_id, ok): done, or error and without chunks."""
    marked = sources.join(outcomes.select(F.col("source_id").alias("id"), "ok"), "id", "left").withColumn("index_status", F.when(F.col("ok"), "done").when(~F.col("ok"), "error").otherwise(F.col("index_status")))
    return marked.select(sources.columns), delete_by_source(index, outcomes.filter("not ok"))


def delete_sources(sources: DataFrame, index: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources, index) without the sources (source_id)."""
    return sources.join(ids.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti").select(sources.columns), delete_by_source(index, ids)


def reindex(index: DataFrame, sources: DataFrame, chunks: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """(sources, index): all chunks of the sources made anew from chunks (source_id, collection_id, ordinal, …)."""
    new = stamp_chunks(chunks.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi"), model)
    got = new.select(F.col("source_id").alias("id"), F.lit(True).alias("_got")).distinct()
    marked = sources.join(got, "id", "left").withColumns({"index_status": F.when(F.col("_got"), "done").otherwise("error"), "embed_model": F.when(F.col("_got"), model).otherwise(F.col("embed_model"))}).select(sources.columns)
    return marked, upsert_chunks(index, new)


def backfill_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """df with defaults in place of nulls; columns that it lacks are added. Existing values stay."""
    for name, value in defaults.items():
        df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
    return df
