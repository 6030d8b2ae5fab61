"""Jobs over streams of changes, tokens and documents. Each function also takes a plain DataFrame where it says so."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import StringType, StructField, StructType

from loreloom.functions import text as T
from loreloom.operators import chunking as C
from loreloom.operators import tables
from loreloom.operators import vectors as V
from loreloom.operators.vectors import Embedder

#: Quiet time that ends a burst, and how long an own write and an own delete are remembered.
GAP, WRITE_TTL, DELETE_TTL = "2 seconds", 30.0, 3.0

#: How late changes may come.
LATE = "10 minutes"


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_exports(changes: DataFrame, export: Callable[[DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Per micro-batch of changes (record) one export of its distinct records."""
    return _start(changes, lambda batch, _: export(batch.select("record").distinct()), checkpoint, once)


def debounce(changes: DataFrame, by: str = "vault", gap: str = GAP, late: str = LATE) -> DataFrame:
    """(by, start, end, events): bursts of a vault's changes (by, ts, kind, key) with no pause of `gap` in them; a burst's
    distinct events, rescans first, then upserts, then removals, by key. For streams and tables; later rows of a stream
    are dropped."""
    place = F.when(F.col("kind") == "rescan", 0).when(F.col("kind") == "upsert", 1).otherwise(2)
    marked = changes.withWatermark("ts", late) if changes.isStreaming else changes
    event = F.struct(place.alias("place"), "kind", F.col("key").cast("string").alias("key"))
    bursts = marked.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.array_sort(F.collect_set(event)).alias("events"))
    return bursts.select(by, "w.start", "w.end", F.transform("events", lambda e: F.struct(e["kind"].alias("kind"), e["key"].alias("key"))).alias("events"))


def _unechoed(rows: pd.DataFrame, write: tuple, delete: float | None) -> tuple[list[int], tuple, float | None]:
    """Places of the rows of one key, in order, that are not echoes of own writes and deletes."""
    kept = []
    for i, (ts, kind, digest) in enumerate(zip(rows["ts"].astype("int64") / 1e9 if rows["ts"].dtype == "datetime64[ns]" else rows["ts"].map(lambda t: t.timestamp()), rows["kind"], rows["hash"])):
        if kind == "own_write":
            write = (digest, ts)
        elif kind == "own_delete":
            delete = ts
        elif kind == "upsert" and write[0] is not None and write[0] == digest and ts - write[1] < WRITE_TTL:
            continue
        elif kind == "remove" and delete is not None and ts - delete < DELETE_TTL:
            delete = None  # one delete hides one removal
        else:
            kept.append(i)
    return kept, write, delete


ECHO = "key string, ts timestamp, kind string, hash string"


def suppress_echo(changes: DataFrame) -> DataFrame:
    """Changes (key, ts, kind, hash) without the echoes of own_write and own_delete rows, and without these.

    An upsert is an echo if the key's last own write has its hash and is under 30 s old, however often it comes. A removal
    is one if an own delete is under 3 s old, and uses it up. For streams, by keyed state, and tables.
    """
    own = changes.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "kind", "hash")
    if not own.isStreaming:
        # the last own write, and how many removals since the last own delete: the first of them, in time, is its echo
        along = Window.partitionBy("key").orderBy("ts", "kind", "hash").rowsBetween(Window.unboundedPreceding, -1)
        seconds = F.unix_micros("ts") / 1e6
        write = F.last(F.when(F.col("kind") == "own_write", F.struct("hash", seconds.alias("at"))), ignorenulls=True).over(along)
        deleted = F.last(F.when(F.col("kind") == "own_delete", seconds), ignorenulls=True).over(along)
        removed = F.count_if(F.col("kind") == "own_delete").over(along)
        marked = own.withColumns({"w": write, "d": deleted, "n": removed, "at": seconds})
        fresh = (F.col("kind") == "remove") & (F.col("at") - F.col("d") < DELETE_TTL)
        used = F.count_if(fresh).over(Window.partitionBy("key", "n").orderBy("ts", "kind", "hash").rowsBetween(Window.unboundedPreceding, -1))
        echo = (F.col("kind") == "upsert") & (F.col("w.hash") == F.col("hash")) & (F.col("at") - F.col("w.at") < WRITE_TTL)
        kept = marked.withColumn("echo", F.coalesce(echo, F.lit(False)) | (F.coalesce(fresh, F.lit(False)) & (used == 0)))
        return kept.filter(~F.col("echo") & ~F.col("kind").isin("own_write", "own_delete")).select("key", "ts", "kind", "hash")

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, at, delete = state.get if state.exists else (None, 0.0, None)
        rows = pd.concat([*parts]).sort_values(["ts", "kind", "hash"], kind="stable").reset_index(drop=True)
        kept, write, delete = _unechoed(rows, (digest, at), delete)
        state.update((write[0], float(write[1]), delete))
        state.setTimeoutDuration(int(WRITE_TTL * 2000))
        yield rows.iloc[kept][["key", "ts", "kind", "hash"]]

    def expire(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return iter(())
        return update(key, parts, state)

    return own.groupBy("key").applyInPandasWithState(expire, ECHO, "hash string, at double, del double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_reconcile(changes: DataFrame, relevant: Callable[[DataFrame], DataFrame], run: Callable[[], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs one reconciliation per micro-batch that has a relevant change; a rescan always is. Batches are never run side
    by side, so there is one writer."""

    def each(batch: DataFrame, _: int) -> None:
        if batch.filter("kind = 'rescan'").union(relevant(batch.filter("kind <> 'rescan'")).select(batch.columns)).limit(1).count():
            run()

    return _start(changes, each, checkpoint, once)


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, key): upserts and removals between two listings (key, mtime, size) of the same files."""
    old = before.select("key", F.col("mtime").alias("m"), F.col("size").alias("s"))
    joined = old.join(after, "key", "full").filter(~(F.col("m").eqNullSafe(F.col("mtime")) & F.col("s").eqNullSafe(F.col("size"))))
    return joined.select(F.when(F.col("mtime").isNull() & F.col("size").isNull(), "remove").otherwise("upsert").alias("kind"), "key")


#: After so long without a token, an answer is abandoned.
ABANDONED_MS = 600_000


def assemble_tokens(tokens: DataFrame) -> DataFrame:
    """(conv_id, content): the joined tokens (conv_id, seq, token, done, failed) of each answer whose end has come.

    Answers that fail or never end are dropped. For tables by grouping, and for streams by keyed state, where an answer
    without tokens for ten minutes of processing time is forgotten (stream_answers runs it).
    """
    own = tokens.select("conv_id", F.col("seq").cast("long").alias("seq"), "token", "done", "failed")
    if not own.isStreaming:
        ended = own.groupBy("conv_id").agg(F.max("done").alias("done"), F.max("failed").alias("failed"), F.sort_array(F.collect_list(F.struct("seq", "token"))).alias("t"))
        return ended.filter("done and not failed").select("conv_id", F.array_join(F.transform("t", lambda x: x["token"]), "").alias("content"))

    kind = own.schema["conv_id"].dataType
    return own.groupBy("conv_id").transformWithStateInPandas(Answers(ABANDONED_MS), StructType([StructField("conv_id", kind), StructField("content", StringType())]), "append", "processingTime")


class Answers(StatefulProcessor):
    """Keeps each open answer's tokens as a list that only grows, so that a token costs the same however many came before.

    A timer that every batch of tokens moves ends answers that nobody goes on with.
    """

    def __init__(self, abandoned_ms: int):
        self.abandoned_ms = abandoned_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getListState("tokens", "seq long, token string")
        self.failed = handle.getValueState("failed", "failed boolean")
        self.due = handle.getValueState("due", "at long")

    def _forget(self) -> None:
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        for state in (self.tokens, self.failed, self.due):
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        done = failed = False
        for part in rows:
            self.tokens.appendList([(int(s), t or "") for s, t in zip(part["seq"], part["token"])])
            done, failed = done or bool(part["done"].any()), failed or bool(part["failed"].any())
        failed = failed or self.failed.exists()
        if done:
            content = "".join(t for _, t in sorted(self.tokens.get()))
            self._forget()
            if not failed:
                yield pd.DataFrame({"conv_id": [key[0]], "content": [content]})
            return
        if failed:
            self.tokens.clear()
            self.failed.update((True,))
        if self.due.exists():
            self.handle.deleteTimer(self.due.get()[0])
        due = timerValues.getCurrentProcessingTimeInMs() + self.abandoned_ms
        self.handle.registerTimer(due)
        self.due.update((due,))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()  # its timer has gone off
        self._forget()
        return iter(())

    def close(self) -> None:
        pass


#: State of lists and timers needs this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

#: Timers would start one batch after another, so that a query over what there is would never end.
NO_DATA = ("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def stream_answers(tokens: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends the finished answers of a stream of tokens to the Parquet files at path, each once."""
    conf, wanted = tokens.sparkSession.conf, dict([STATE_STORE, NO_DATA] if once else [STATE_STORE])
    before = {key: conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():  # the query takes them along when it starts
            conf.set(key, value)
        writer = assemble_tokens(tokens).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def stream_ingest(documents: DataFrame, prepare: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Prepares and stores the chunks of documents as they arrive. A batch may come again after a failure, so store should
    replace what it had of the same documents; stream_index has such a store."""

    def each(batch: DataFrame, _: int) -> None:
        made = prepare(batch).persist()  # a store reads them more than once
        try:
            store(made)
        finally:
            made.unpersist()

    return _start(documents, each, checkpoint, once)


def ingest(documents: DataFrame, index: str, embedder: Embedder, model: str = "hash", report: Callable[[str, int], None] | None = None) -> DataFrame:
    """Reads documents (doc_id, text, collection_id, source_type) into the index at the given path and returns the changed
    (collection_id, source_type): repaired, chunked, stamped, embedded, and put in place of the documents' older chunks.

    A document is a source of its own, `source:` and its id; of equal ids the largest text counts. Null and blank texts
    have no chunks. report gets each stage and how many documents or chunks it has done.
    """
    seen, made = Observation(), Observation()
    own = documents.groupBy("doc_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "collection_id", "source_type")).alias("d")).select("doc_id", "d.*")
    own = own.observe(seen, F.count("*").alias("n")).withColumns({"text": T.normalize_text(F.col("text")), "source_id": F.concat(F.lit("source:"), F.col("doc_id").cast("string"))})
    own = own.persist()
    try:
        chunks = C.chunk_documents(own.filter("text <> ''").select("doc_id", "text")).join(own.select("doc_id", "source_id", "collection_id"), "doc_id")
        made_chunks = V.embed_documents(tables.stamp_chunks(chunks, model), embedder, model=model).observe(made, F.count("*").alias("n"))
        made_chunks = made_chunks.persist()
        made_chunks.count()
        tables.replace_in_index(made_chunks, own.select("collection_id", "source_id"), index)
        changed = own.select("collection_id", "source_type").distinct().collect()  # one row a collection and kind of source
        made_chunks.unpersist()
    finally:
        own.unpersist()
    if report:
        report("extract", seen.get["n"])
        report("embed", made.get["n"])
    return documents.sparkSession.createDataFrame(changed, documents.select("collection_id", "source_type").schema)


def stream_index(documents: DataFrame, index: str, embedder: Embedder, stale: Callable[[DataFrame], None], checkpoint: str, model: str = "hash", report: Callable[[str, int], None] | None = None, once: bool = False) -> StreamingQuery:
    """ingest() for each micro-batch of documents, and then stale with the changed (collection_id, source_type). Both may
    see a batch again after a failure, which changes nothing."""
    return _start(documents, lambda batch, _: stale(ingest(batch, index, embedder, model, report)), checkpoint, once)


# The share of the whole at which a stage begins and ends.
STAGES = {"extract": (0.08, 0.20), "embed": (0.30, 0.85)}


def progress(done: DataFrame, stage: str) -> DataFrame:
    """done (job_id, current, total) with `fraction` of the whole job."""
    low, high = STAGES[stage]
    share = F.when(F.col("total") > 0, F.least(F.col("current") / F.col("total"), F.lit(1.0))).otherwise(1.0)
    return done.withColumn("fraction", F.lit(low) + (high - low) * share)
