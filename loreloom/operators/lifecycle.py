"""Creation, change and deletion of campaigns, collections, entities and sessions, with what hangs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as T

from .findings import orphaned_edges
from .graph import extract_links, link_forward_refs, resolve_links, sync_mentions
from .review import apply_changes
from .scopes import live


def create_campaigns(rows: DataFrame) -> dict[str, DataFrame]:
    """campaigns, collections and subscriptions for new campaigns (id, name, system): each owns a collection of its name
    and subscribes to it."""
    own = F.concat(F.lit("collection:own-"), F.substring_index("id", ":", -1))
    return {
        "campaigns": rows.select("id", "name", "system"),
        "collections": rows.select(own.alias("id"), "name", F.col("id").alias("owner_campaign")),
        "subscriptions": rows.select(F.col("id").alias("campaign_id"), own.alias("collection_id")),
    }


def _without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(df.columns)


def purge_collections(tables: dict[str, DataFrame], ids: DataFrame, purge_orphans: bool = False) -> dict[str, DataFrame]:
    """The tables without the collections (id) and their sources, chunks, subscriptions, entities and edges.

    Rule entries and proposals stay behind unless purge_orphans.
    """
    out = dict(tables)
    lost = tables["entities"].join(ids.select(F.col("id").alias("collection_id")), "collection_id", "left_semi").select("id")
    out["collections"] = _without(tables["collections"], ids, "id")
    for name in ("entities", "sources", "chunks", "subscriptions", *(("rules", "proposals") if purge_orphans else ())):
        if name in tables:
            out[name] = _without(tables[name], ids, "collection_id")
    out["edges"] = _without(_without(tables["edges"], lost, "from_id"), lost, "to_id")
    return out


def delete_campaigns(tables: dict[str, DataFrame], requests: DataFrame) -> dict[str, DataFrame]:
    """The tables after requests (id, cascade): owned collections go with the campaign, or become free, which gives a
    finding for each edge between one's entity and a campaign's own."""
    owned = tables["collections"].join(requests.select(F.col("id").alias("owner_campaign"), "cascade"), "owner_campaign")
    freed = owned.filter("not cascade").select("id")
    out = purge_collections(tables, owned.filter("cascade").select("id"))
    gone = requests.select(F.col("id").alias("owner_campaign"), F.lit(True).alias("_gone"))
    out["collections"] = out["collections"].join(gone, "owner_campaign", "left").withColumn("owner_campaign", F.when(F.col("_gone").isNull(), F.col("owner_campaign"))).select(tables["collections"].columns)
    out["campaigns"] = _without(tables["campaigns"], requests, "id")
    out["subscriptions"] = _without(out["subscriptions"], requests, "campaign_id")
    out["orphaned"] = orphaned_edges(out["edges"], out["entities"], freed)
    return out


def apply_subscriptions(subs: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Subscriptions with those of add and without those of remove; doing either twice changes nothing."""
    keys = ["campaign_id", "collection_id"]
    return subs.select(keys).union(add.select(keys)).distinct().join(remove.select(keys), keys, "left_anti")


def create_entities(entities: DataFrame, edges: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, edges) with new rows (id, kind, name, …): their notes' links become mentions, and live entities of the
    same scope whose notes link a new name mention it."""
    fill = rows.select(*(F.col(c).cast(entities.schema[c].dataType).alias(c) if c in rows.columns else F.lit(None).cast(entities.schema[c].dataType).alias(c) for c in entities.columns)).withColumn("name", T.sanitize_scalar(F.col("name"))).filter("name <> ''")
    all_ = entities.unionByName(fill)
    scoped = live(all_).withColumn("scope", F.coalesce("collection_id", "campaign_id")).filter("scope is not null")
    fresh = scoped.join(fill.select("id"), "id", "left_semi")
    links = extract_links(fresh.withColumn("_k", F.struct("scope", "id")), "_k", "notes").select("_k.scope", F.col("_k.id").alias("from_id"), "link").distinct()
    out = resolve_links(links, scoped, "scope").filter("entity_id is not null").select("from_id", F.col("entity_id").alias("to_id"))
    mine = sync_mentions(edges, out, fill)
    back = link_forward_refs(fresh, scoped, "scope").join(fill.select(F.col("id").alias("from_id")), "from_id", "left_anti")
    return all_, sync_mentions(mine, back.select("from_id", "to_id"), fill.limit(0))


def update_entities(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """entities with rows' columns in place of their own, null too, but for aliases, where null keeps them; they turn
    stale. Rows of unknown ids change nothing."""
    new = [c for c in rows.columns if c != "id"]
    joined = entities.join(rows.select("id", *(F.col(c).alias(f"_{c}") for c in new), F.lit(True).alias("_hit")), "id", "left")
    put = {c: F.when(F.col("_hit"), F.coalesce("_aliases", "aliases") if c == "aliases" else F.col(f"_{c}")).otherwise(F.col(c)) for c in new}
    return joined.withColumns(put | {"codex_stale": F.when(F.col("_hit"), True).otherwise(F.col("codex_stale"))}).select(entities.columns)


def delete_entities(entities: DataFrame, ids: DataFrame, hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, not found): marked as deleted, or gone."""
    if hard:
        return _without(entities, ids, "id"), ids.select("id").distinct().join(entities.select("id"), "id", "left_anti")
    out, rejected = apply_changes(entities, ids.select("id", F.lit(True).alias("vault_deleted")).distinct())
    return out, rejected.select("id")


def upsert_sessions(sessions: DataFrame, rows: DataFrame, visible: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, links, rejected): new and changed sessions (id, campaign_id, session_number, title, notes), and the
    entities (campaign_id, id, name, aliases) that their notes link. Numbers below 1 and blank titles are rejected."""
    good = (F.col("session_number") > 0) & (T.strip(F.col("title")) != "")
    ok = rows.filter(F.coalesce(good, F.lit(False)))
    put = ok.select(*(F.col(c).cast(sessions.schema[c].dataType).alias(c) if c in ok.columns else F.lit(None).cast(sessions.schema[c].dataType).alias(c) for c in sessions.columns))
    links = extract_links(ok.withColumn("_k", F.struct("campaign_id", "id")), "_k", "notes").select("_k.campaign_id", F.col("_k.id").alias("session_id"), "link").distinct()
    linked = resolve_links(links, visible, "campaign_id").filter("entity_id is not null").select("session_id", "entity_id").distinct()
    return _without(sessions, ok, "id").unionByName(put), linked, rows.filter(~F.coalesce(good, F.lit(False))).select("id")
