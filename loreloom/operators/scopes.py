"""Row filters, visibility and scope joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import text as T

KINDS = ("npc", "location", "faction", "creature", "item", "event", "player_character", "misc")


def is_live(flag: str = "vault_deleted") -> Column:
    """Not marked as deleted; a null mark is none."""
    return ~F.col(flag).eqNullSafe(True)


def live(df: DataFrame, flag: str = "vault_deleted") -> DataFrame:
    return df.filter(is_live(flag))


def is_stale() -> Column:
    """The flag isn't false, or there is no article."""
    return ~F.col("codex_stale").eqNullSafe(False) | F.col("codex_article").isNull()


def subscriptions(campaigns: DataFrame, subs: DataFrame) -> DataFrame:
    """(campaign_id, collection_id) of the given campaigns (id)."""
    return subs.join(campaigns.select(F.col("id").alias("campaign_id")), "campaign_id", "left_semi").select("campaign_id", "collection_id").distinct()


def visible_entities(entities: DataFrame, subs: DataFrame) -> DataFrame:
    """(campaign_id, entity_id): a campaign's own live entities and those of the collections that it subscribes to."""
    own = live(entities)
    mine = own.filter("campaign_id is not null").select("campaign_id", F.col("id").alias("entity_id"))
    shared = own.drop("campaign_id").join(subs.select("campaign_id", "collection_id"), "collection_id").select("campaign_id", F.col("id").alias("entity_id"))
    return mine.union(shared).distinct()


def collection_entities(entities: DataFrame, collections: DataFrame) -> DataFrame:
    """Live entities of the given collections (id)."""
    return live(entities).join(collections.select(F.col("id").alias("collection_id")), "collection_id", "left_semi")


def provenance_scope(collections: DataFrame, subs: DataFrame) -> DataFrame:
    """(collection_id, scope_id): the collections searched for a collection's sources: its owner's subscriptions if it is
    owned, else itself."""
    owned = collections.filter("owner_campaign is not null").select(F.col("id").alias("own"), F.col("owner_campaign").alias("campaign_id"))
    through = owned.join(subs, "campaign_id").select(F.col("own").alias("collection_id"), F.col("collection_id").alias("scope_id"))
    alone = collections.filter("owner_campaign is null").select(F.col("id").alias("collection_id"), F.col("id").alias("scope_id"))
    return through.union(alone).distinct()


def check_constraints(df: DataFrame, key: str, rules: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(rule, key): rows that break a rule, a condition that must hold, or share the values of a unique key."""
    found = [df.filter(~F.coalesce(holds, F.lit(False))).select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key")) for name, holds in rules.items()]
    for name, cols in (unique or {}).items():
        repeated = df.groupBy(*cols).count().filter("count > 1").drop("count")
        found.append(df.join(repeated, cols, "left_semi").select(F.lit(name).alias("rule"), F.col(key).cast("string").alias("key")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def find_by_name(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """candidates (collection_id, kind, name) with `id`: the smallest live entity of the same folded name."""
    folded = live(entities).groupBy("collection_id", "kind", F.lower("name").alias("folded")).agg(F.min("id").alias("id"))
    return candidates.withColumn("folded", F.lower("name")).join(folded, ["collection_id", "kind", "folded"], "left").drop("folded")


def with_scope(entities: DataFrame, in_campaign: DataFrame, in_collection: DataFrame) -> DataFrame:
    """entities with campaign_id and collection_id from the membership edges (entity_id, …), the smallest of each."""
    one = lambda df, c: df.groupBy(F.col("entity_id").alias("id")).agg(F.min(c).alias(c))
    base = entities.drop("campaign_id", "collection_id")
    return base.join(one(in_campaign, "campaign_id"), "id", "left").join(one(in_collection, "collection_id"), "id", "left")


def endpoint_scope(entities: DataFrame, collections: DataFrame) -> DataFrame:
    """(id, campaign_id, collection_id): the campaign of an entity's own or else its collection's owner."""
    owners = collections.select(F.col("id").alias("collection_id"), "owner_campaign")
    return entities.select("id", "campaign_id", "collection_id").join(owners, "collection_id", "left").select("id", F.coalesce("campaign_id", "owner_campaign").alias("campaign_id"), "collection_id")


def check_scope(edges: DataFrame, entities: DataFrame, collections: DataFrame, subs: DataFrame) -> DataFrame:
    """edges (from_id, to_id, …) with `allowed`.

    An edge is allowed if an end has no scope, both are of one collection or one campaign, or one is of a campaign that
    subscribes to the other's collection, which itself has no campaign.
    """
    ends = endpoint_scope(entities, collections)
    side = lambda p: ends.select(F.col("id").alias(f"{p}_id"), F.col("campaign_id").alias(f"{p}_campaign"), F.col("collection_id").alias(f"{p}_collection"))
    pairs = lambda a, b: subs.select(F.col("campaign_id").alias(f"{a}_campaign"), F.col("collection_id").alias(f"{b}_collection"), F.lit(True).alias(f"{a}_subscribes")).distinct()
    wide = edges.join(side("from"), "from_id", "left").join(side("to"), "to_id", "left")
    wide = wide.join(pairs("from", "to"), ["from_campaign", "to_collection"], "left").join(pairs("to", "from"), ["to_campaign", "from_collection"], "left")
    none = lambda p: F.col(f"{p}_campaign").isNull() & F.col(f"{p}_collection").isNull()
    allowed = (
        none("from") | none("to")
        | F.coalesce(F.col("from_collection") == F.col("to_collection"), F.lit(False))
        | F.coalesce(F.col("from_campaign") == F.col("to_campaign"), F.lit(False))
        | (F.col("from_subscribes").isNotNull() & F.col("to_campaign").isNull())
        | (F.col("to_subscribes").isNotNull() & F.col("from_campaign").isNull())
    )
    return wide.select(*edges.columns, allowed.alias("allowed"))


def with_source(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """chunks with source_name and source_type of their source; without a source, its id and no type.

    The chunk's own source_type isn't trusted.
    """
    named = sources.select(F.col("id").alias("source_id"), F.coalesce(T.nonblank(F.col("display_name")), F.col("filename")).alias("_name"), F.col("source_type").alias("_type"))
    return chunks.drop("source_type").join(named, "source_id", "left").withColumns({"source_name": F.coalesce("_name", "source_id"), "source_type": F.col("_type")}).drop("_name", "_type")


def rule_chunks(chunks: DataFrame, sources: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Chunks of rule books and supplements; with names (collection_id, name), those whose text has the name."""
    own = with_source(chunks, sources).filter(F.col("source_type").isin("rules", "supplement"))
    if names is None:
        return own
    return own.join(names, "collection_id").filter(F.contains(F.lower("text"), F.lower("name")))


def resolve_citations(citations: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations (citation_id, source_name, page) with the chunk behind each: of the source of that file name the first
    chunk whose pages hold the page, or the first chunk of all if there is no page."""
    files = sources.select(F.col("id").alias("source_id"), F.col("filename").alias("source_name"))
    own = chunks.select("source_id", "chunk_id", "page_start", "page_end").join(files, "source_id").select("source_name", "page_start", "page_end", F.struct("page_start", "chunk_id").alias("c"))
    asked = citations.select("source_name", "page").distinct()
    # the first of the chunks that end at a page or after it, if it starts there or before: a running minimum, from the last
    # page on, over the pages that chunks end on and those that are asked for
    ends = own.filter("page_start <= page_end").groupBy("source_name", F.col("page_end").alias("at")).agg(F.min("c").alias("c"))
    points = ends.unionByName(asked.filter("page is not null").select("source_name", F.col("page").alias("at"), "page"), allowMissingColumns=True)
    so_far = Window.partitionBy("source_name").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    held = points.withColumn("c", F.min("c").over(so_far)).filter("page is not null and c.page_start <= page").select("source_name", "page", "c")
    whole = asked.filter("page is null").join(own.groupBy("source_name").agg(F.min("c").alias("c")), "source_name")
    told = held.unionByName(whole.select("source_name", "page", "c")).select(F.col("source_name").alias("_name"), F.col("page").alias("_page"), "c")
    found = citations.join(told, (F.col("source_name") == F.col("_name")) & F.col("page").eqNullSafe(F.col("_page")))
    first = found.groupBy("citation_id").agg(F.min("c").alias("c")).select("citation_id", F.col("c.chunk_id").alias("chunk_id"))
    return citations.join(first, "citation_id", "left")


def session_events(entities: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session_id, entity_id, name): live event entities of each session, in order."""
    own = live(entities).filter("kind = 'event'").select(F.col("id").alias("entity_id"), "name", "session_id")
    return own.join(sessions.select(F.col("id").alias("session_id")), "session_id").select("session_id", "entity_id", "name")


def sync_records(entities: DataFrame, sessions: DataFrame, rules: DataFrame, campaigns: DataFrame, collections: DataFrame) -> DataFrame:
    """(record, type, name, aliases, scope_kind, scope_id, scope_name, number, summary, fenced, notes): everything that has a
    file; only entities have aliases.

    A campaign comes before a collection; entities without either are left out, as are deleted rows.
    """
    scopes = campaigns.select(F.lit("campaign").alias("scope_kind"), F.col("id").alias("scope_id"), F.col("name").alias("scope_name")).union(collections.select(F.lit("collection"), "id", "name"))
    kind = F.when(F.col("campaign_id").isNotNull(), "campaign").when(F.col("collection_id").isNotNull(), "collection")
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>").alias("aliases")
    rows = live(entities).select(F.col("id").alias("record"), F.col("kind").alias("type"), "name", "aliases", kind.alias("scope_kind"), F.coalesce("campaign_id", "collection_id").alias("scope_id"), F.lit(None).cast("long").alias("number"), "summary", F.col("codex_article").alias("fenced"), "notes")
    rows = rows.unionByName(live(sessions).select(F.col("id").alias("record"), F.lit("session").alias("type"), F.col("title").alias("name"), none, F.lit("campaign").alias("scope_kind"), F.col("campaign_id").alias("scope_id"), F.col("session_number").cast("long").alias("number"), null.alias("summary"), null.alias("fenced"), "notes"))
    rows = rows.unionByName(live(rules).select(F.col("id").alias("record"), F.lit("rule_entry").alias("type"), "name", none, F.lit("collection").alias("scope_kind"), F.col("collection_id").alias("scope_id"), F.lit(None).cast("long").alias("number"), null.alias("summary"), F.col("body").alias("fenced"), "notes"))
    return rows.join(scopes, ["scope_kind", "scope_id"]).select("record", "type", "name", "aliases", "scope_kind", "scope_id", "scope_name", "number", "summary", "fenced", "notes")


def listing(df: DataFrame, *order: str | Column) -> DataFrame:
    """Live rows in an order: sessions by number, sources and collections by name, messages by time."""
    return (live(df) if "vault_deleted" in df.columns else df).orderBy(*order)


def chat_history(messages: DataFrame) -> DataFrame:
    """Messages with their place in their campaign's history."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy("campaign_id").orderBy("created_at", "id")))


def union_kinds(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of all kinds of entities; columns that a kind lacks are null."""
    out: DataFrame | None = None
    for kind, df in tables.items():
        own = df.withColumn("kind", F.lit(kind))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out
