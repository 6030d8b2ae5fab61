"""Counts, groups in order, and rows up to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import batch_passages  # noqa: F401
from .scopes import KINDS, is_stale, live

def count_by_campaign(campaigns: DataFrame, visible: DataFrame, entities: DataFrame) -> DataFrame:
    """(campaign_id, kind, n) for every campaign and kind, zero included."""
    kinds = F.explode(F.array(*map(F.lit, KINDS))).alias("kind")
    grid = campaigns.select(F.col("id").alias("campaign_id"), kinds)
    counts = visible.join(entities.select(F.col("id").alias("entity_id"), "kind"), "entity_id").groupBy("campaign_id", "kind").agg(F.count("*").alias("n"))
    return grid.join(counts, ["campaign_id", "kind"], "left").select("campaign_id", "kind", F.coalesce("n", F.lit(0)).alias("n"))


def codex_status(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """(collection_id, total, stale, rules, stale_rules) of live rows."""
    own = live(entities).filter("collection_id is not null").groupBy("collection_id").agg(F.count("*").alias("total"), F.count_if(is_stale()).alias("stale"))
    book = live(rules).groupBy("collection_id").agg(F.count("*").alias("rules"), F.count_if(~F.col("stale").eqNullSafe(False)).alias("stale_rules"))
    return own.join(book, "collection_id", "full").na.fill(0, ["total", "stale", "rules", "stale_rules"])


def maintenance_counts(proposals: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: pending proposals and open findings."""
    return proposals.agg(F.count_if(F.col("status") == "pending").alias("pending")).crossJoin(findings.agg(F.count_if(~F.col("resolved")).alias("open")))


def collection_refs(collections: DataFrame, subs: DataFrame, sources: DataFrame) -> DataFrame:
    """(collection_id, subscribers, sources): what stands against deleting a collection."""
    count = lambda df, name: df.groupBy("collection_id").agg(F.count("*").alias(name))
    base = collections.select(F.col("id").alias("collection_id"))
    return base.join(count(subs, "subscribers"), "collection_id", "left").join(count(sources, "sources"), "collection_id", "left").na.fill(0, ["subscribers", "sources"])


def longest_wins(old: DataFrame, batches: DataFrame, *columns: str) -> DataFrame:
    """old (id, columns) with the longest value that batches (id, batch, columns) have for each column, in bytes; of equal
    lengths the earliest batch's. Empty values don't count."""
    best = [F.max_by(c, F.when(F.octet_length(c) > 0, F.struct(F.octet_length(c), -F.col("batch")))).alias(f"_{c}") for c in columns]
    joined = old.join(batches.groupBy("id").agg(*best), "id", "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(old.columns)


# The counters of a reconciliation, and the actions and steps that each counts.
COUNTERS = {
    "exported": ("export",), "unchanged": ("noop",), "adopted": ("adopt_base",), "applied": ("apply",), "conflicts": ("conflict", "freeze", "refresh", "restore", "keep"),
    "resolved": ("resolve", "unfreeze"), "soft_deleted": ("soft_delete",), "swept": ("sweep",), "invalid": ("invalid",), "failed": ("failed",),
}


def action_report(actions: DataFrame) -> DataFrame:
    """(counter, n) of a reconciliation's actions or steps (action): every counter, zero included; unknown ones count as
    failed."""
    own = F.lit("failed")
    for name, members in COUNTERS.items():
        own = F.when(F.col("action").isin(*members), name).otherwise(own)
    names = actions.sparkSession.createDataFrame([(x,) for x in COUNTERS], "counter string")
    counts = actions.groupBy(own.alias("counter")).agg(F.count("*").alias("n"))
    return names.join(counts, "counter", "left").select("counter", F.coalesce("n", F.lit(0)).alias("n"))


def assign_keys(records: DataFrame) -> DataFrame:
    """records (record, key) with "-id" before ".md" of each key that several claim."""
    shared = records.groupBy("key").count().filter("count > 1").select("key", F.lit(True).alias("_shared"))
    own = F.concat(F.regexp_replace("key", r"\.md$", ""), F.lit("-"), F.substring_index("record", ":", -1), F.lit(".md"))
    return records.join(shared, "key", "left").withColumn("key", F.when(F.col("_shared"), own).otherwise(F.col("key"))).select(records.columns)


def timeline_order(df: DataFrame) -> list[Column]:
    return [F.col("sequence_index").asc_nulls_last(), F.col("name"), F.col("id")]


def timeline(events: DataFrame, by: str = "campaign_id") -> DataFrame:
    """Live events with their place: by sequence, those without one last, then by name."""
    own = live(events)
    return own.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*timeline_order(own))))


def era_runs(timeline: DataFrame, by: str = "campaign_id") -> DataFrame:
    """(by, run, era, first, n): neighbours of one era in a timeline; an era that comes back is a new run."""
    along = Window.partitionBy(by).orderBy("place")
    new = ~F.col("era").eqNullSafe(F.lag("era").over(along)) | (F.row_number().over(along) == 1)
    runs = timeline.withColumn("_new", new).withColumn("run", F.sum(F.col("_new").cast("int")).over(along))
    return runs.groupBy(by, "run").agg(F.min("era").alias("era"), F.min("place").alias("first"), F.count("*").alias("n"))


def session_lanes(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """(campaign_id, session_id, lane, n_events): each session in order with its events; events of no session, or of an
    unknown one, in a last lane without session, if there are any."""
    own = live(events).select("campaign_id", "id", "session_id")
    known = sessions.select("campaign_id", F.col("id").alias("session_id"), "session_number")
    matched = own.join(known.select("campaign_id", "session_id", F.lit(True).alias("known")), ["campaign_id", "session_id"], "left")
    counts = matched.groupBy("campaign_id", F.when(F.col("known"), F.col("session_id")).alias("session_id")).agg(F.count("*").alias("n_events"))
    lanes = known.join(counts, ["campaign_id", "session_id"], "left").union(counts.filter("session_id is null").select("campaign_id", "session_id", F.lit(None).cast("long").alias("session_number"), "n_events"))
    order = Window.partitionBy("campaign_id").orderBy(F.col("session_number").asc_nulls_last(), "session_id")
    return lanes.select("campaign_id", "session_id", F.row_number().over(order).alias("lane"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def cap_per_scope(df: DataFrame, by: str, order: list[Column], n: int) -> tuple[DataFrame, DataFrame]:
    """(rows, remainder): the first n rows of each scope, and how many of each were left out."""
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    left = df.groupBy(by).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("remaining"))
    return ranked.filter(F.col("_n") <= n).drop("_n"), left


def origin_message(proposals: DataFrame, messages: DataFrame) -> DataFrame:
    """proposals (id, campaign_id, content) with message_id: the latest assistant message of that content."""
    said = messages.filter("role = 'assistant'").select("campaign_id", "content", F.col("id").alias("message_id"), "created_at")
    latest = said.groupBy("campaign_id", F.md5("content").alias("_h")).agg(F.max_by("message_id", F.struct("created_at", "message_id")).alias("message_id"))
    return proposals.withColumn("_h", F.md5("content")).join(latest, ["campaign_id", "_h"], "left").drop("_h")
