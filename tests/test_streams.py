"""The index sink and the streams on it, with batches that come twice, and answers by keyed state."""

from pathlib import Path

from pyspark.sql import functions as F

from loreloom.operators import tables as TB
from loreloom.operators import vectors as V
from loreloom.streaming import streams as ST

CHUNK = "collection_id string, source_id string, ordinal int, text string"


def test_sources_are_replaced(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(f"c {i % 2}/é", f"s{i % 9}", i, f"old {i}") for i in range(40)]
    TB.write_index(spark.createDataFrame(rows, CHUNK), path)
    new = [("c 0/é", "s2", 0, "new"), ("other", "s99", 0, "new")]
    gone = [("c 0/é", "s2"), ("c 1/é", "s1"), ("other", "s99"), ("c 0/é", "s8"), ("nowhere", "s1")]
    want = sorted([r for r in rows if r[:2] not in gone] + new)
    for _ in range(2):
        TB.replace_in_index(spark.createDataFrame(new, CHUNK), spark.createDataFrame(gone, "collection_id string, source_id string"), path)
        assert sorted(map(tuple, TB.read_index(spark, path).select("collection_id", "source_id", "ordinal", "text").collect())) == want
    # a folder whose last source goes
    TB.replace_in_index(spark.createDataFrame([], CHUNK), spark.createDataFrame([("other", "s99")], "collection_id string, source_id string"), path)
    assert TB.read_index(spark, path).count() == len(want) - 1 and not list(Path(path).glob("collection_id=other/bucket=*"))


def test_a_folder_of_the_index_gets_few_files(spark, tmp_path):
    rows = spark.range(0, 400, 1, 16).select(F.lit("all").alias("collection_id"), F.col("id").cast("string").alias("source_id"))
    TB.replace_in_index(rows, rows, str(tmp_path / "index"))
    files = [p.parent for p in (tmp_path / "index").rglob("*.parquet")]
    assert len(files) == len(set(files)) == TB.BUCKETS and TB.read_index(spark, str(tmp_path / "index")).count() == 400


def test_stream_into_the_index(spark, tmp_path):
    """A document that comes again replaces itself, one that comes blank goes, and a batch run twice changes nothing."""
    schema, index, stale, told = "doc_id long, text string, collection_id string, source_type string", str(tmp_path / "index"), [], []
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")

    def run(name):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in/n=*")
        job = ST.stream_index(stream, index, V.hash_embedder(16), lambda df: stale.append(sorted(map(tuple, df.collect()))), f"{tmp_path}/{name}", report=lambda stage, n: told.append((stage, n)), once=True)
        job.awaitTermination(200)

    put(1, [(1, "One. " * 400, "a", "rules"), (2, "Two.", "a", "lore"), (3, None, "b", "lore")])
    run("cp")
    first = TB.read_index(spark, index)
    assert first.filter("doc_id = 1").count() > 1 and {r.doc_id for r in first.collect()} == {1, 2} and first.filter("embedding IS NULL").count() == 0
    assert stale == [[("a", "lore"), ("a", "rules"), ("b", "lore")]] and told == [("extract", 3), ("embed", first.count())]
    put(2, [(1, "Only this.", "a", "rules"), (2, " \n ", "a", "lore"), (3, "Now there. And more.", "b", "lore")])
    run("cp")
    want = [(1, "Only this.", "hash"), (3, "Now there. And more.", "hash")]
    rows = lambda: sorted(map(tuple, TB.read_index(spark, index).select("doc_id", "text", "embed_model").collect()))
    assert rows() == want
    ids = {r.chunk_id for r in TB.read_index(spark, index).collect()}
    last = spark.read.schema(schema).parquet(f"{tmp_path}/in/n=2")
    ST.ingest(last, index, V.hash_embedder(16))
    assert rows() == want and ids == {r.chunk_id for r in TB.read_index(spark, index).collect()}


def test_answers_by_keyed_state(spark, tmp_path):
    """Tokens over three batches: late ones, a failed answer, an abandoned one, and one whose end comes first."""
    schema = "conv_id long, seq int, token string, done boolean, failed boolean"
    batches = [
        [(1, 1, "b", False, False), (1, 0, "a", False, False), (2, 0, "x", False, True), (3, 0, "never", False, False), (4, 1, "!", False, False)],
        [(1, 2, "c", False, False), (2, 1, "y", False, False), (4, 0, "hi", True, False)],
        [(1, 3, None, True, False), (2, 2, "z", True, False), (5, 0, "one", True, False), (1, 9, "after", False, False)],
    ]
    got = []
    for n, rows in enumerate(batches):
        if n == 2:
            rows = rows[:-1]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/n=*")
        ST.stream_answers(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(200)
        got.append(sorted(map(tuple, spark.read.schema("conv_id long, content string").parquet(str(tmp_path / "out")).collect())))
    assert got == [[], [(4, "hi!")], [(1, "abc"), (4, "hi!"), (5, "one")]]
    every = spark.createDataFrame([r for b in batches for r in b if r[2] != "after"], schema)
    assert sorted(map(tuple, ST.assemble_tokens(every).collect())) == got[-1]
    assert spark.conf.get(ST.STATE_STORE[0], "") != ST.STATE_STORE[1]


def test_abandoned_answers(spark, tmp_path, monkeypatch):
    """An answer without tokens for too long is forgotten: its end, when it comes, is all that is left."""
    monkeypatch.setattr(ST, "ABANDONED_MS", 1)
    schema = "conv_id long, seq int, token string, done boolean, failed boolean"
    for n, rows in enumerate([[(1, 0, "old", False, False)], [(2, 0, "x", True, False)], [(1, 1, "new", True, False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/n=*")
        ST.stream_answers(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(200)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, "new"), (2, "x")]
