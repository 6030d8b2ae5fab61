"""Data-quality findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as T

from .graph import extract_links, resolve_links
from .names import SUGGEST, alias_collisions, best_match, duplicate_entities
from .scopes import check_scope, is_stale, live, visible_entities

#: What every finding has: its kind and scope, what tells it from others of its kind, and whom it names.
COLUMNS = ["kind", "scope_id", "dedup_key", "parties", "detail", "similarity"]


def _finding(df: DataFrame, kind: str, scope: str, key, parties, detail=None, similarity=None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.lit(kind).alias("kind"), F.col(scope).alias("scope_id"), key.alias("dedup_key"), parties.alias("parties"),
        (none if detail is None else detail).cast("string").alias("detail"), (none if similarity is None else similarity).cast("double").alias("similarity"),
    )


def broken_wikilinks(entities: DataFrame, scope: str = "collection_id", suggest: bool = True) -> DataFrame:
    """(scope, entity_id, link, candidates, n): links in notes and articles that no live name in scope answers.

    Each once for an entity, whatever its case, in its first spelling; with the names of at least 0.72 and their number,
    which can be had without the names.
    """
    own = live(entities).filter(F.col(scope).isNotNull())
    links = extract_links(own.withColumn("_k", F.struct(scope, "id")), "_k", "notes", "codex_article").select(f"_k.{scope}", F.col("_k.id").alias("from_id"), "place", "link")
    first = links.groupBy(scope, "from_id", F.lower("link").alias("folded")).agg(F.min_by("link", "place").alias("link"))
    broken = resolve_links(first, own, scope).filter("entity_id is null").select(scope, F.col("from_id").alias("entity_id"), "link")
    if not suggest:
        return broken.withColumns({"candidates": F.array().cast("array<struct<similarity: double, id: string, name: string>>"), "n": F.lit(0).cast("long")})
    near = best_match(broken.select(scope, F.col("link").alias("needle")), own, [scope], SUGGEST).select(scope, F.col("needle").alias("link"), "candidates", "n")
    return broken.join(near, [scope, "link"], "left").select(scope, "entity_id", "link", "candidates", F.coalesce("n", F.lit(0)).alias("n"))


def stale_articles(entities: DataFrame) -> DataFrame:
    return live(entities).filter(is_stale()).select("collection_id", "id", "name")


def scope_violations(edges: DataFrame, entities: DataFrame, collections: DataFrame, subs: DataFrame) -> DataFrame:
    """(collection_id, edge_id, from_id, to_id): edges that scopes don't allow, under the collection of their start."""
    bad = check_scope(edges, entities, collections, subs).filter("not allowed")
    return bad.join(entities.select(F.col("id").alias("from_id"), "collection_id"), "from_id").select("collection_id", "edge_id", "from_id", "to_id")


def _lint(entities: DataFrame, violations: DataFrame, scope: str) -> DataFrame:
    """All findings of live entities within each scope; violations: (scope, edge_id, from_id, to_id)."""
    broken = broken_wikilinks(entities, scope, suggest=False)  # a finding names no candidates
    dup, alias = duplicate_entities(entities, scope), alias_collisions(entities, scope)
    stale = live(entities).filter(is_stale() & F.col(scope).isNotNull())
    parts = [
        _finding(broken, "broken_wikilink", scope, F.concat_ws("|", "entity_id", F.lower("link")), F.array("entity_id"), F.col("link")),
        _finding(dup, "duplicate_entity", scope, F.concat_ws("|", "a", "b"), F.array("a", "b"), None, F.col("similarity")),
        _finding(alias, "alias_collision", scope, F.concat_ws("|", "a", "b"), F.array("a", "b"), F.col("alias")),
        _finding(stale, "stale_article", scope, F.col("id"), F.array("id")),
        _finding(violations.filter(F.col(scope).isNotNull()), "scope_violation", scope, F.col("edge_id").cast("string"), F.array("from_id", "to_id")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def lint(entities: DataFrame, edges: DataFrame, collections: DataFrame, subs: DataFrame) -> DataFrame:
    """All findings of all collections, in one table of COLUMNS."""
    return _lint(entities, scope_violations(edges, entities, collections, subs), "collection_id")


def lint_campaigns(entities: DataFrame, edges: DataFrame, collections: DataFrame, subs: DataFrame) -> DataFrame:
    """All findings of all campaigns, each over its own entities and those of the collections that it subscribes to, so
    that duplicates and links between collections are seen. A finding comes once for each campaign that sees it;
    record_findings keeps one of them."""
    seen = visible_entities(entities, subs).select(F.col("entity_id").alias("id"), F.col("campaign_id").alias("scope"))
    bad = check_scope(edges, entities, collections, subs).filter("not allowed")
    violations = bad.join(seen.withColumnRenamed("id", "from_id"), "from_id").select("scope", "edge_id", "from_id", "to_id")
    return _lint(entities.join(seen, "id"), violations, "scope")


def record_findings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """existing (id, COLUMNS, resolved) with the new findings that no open one of the same kind and key stands for."""
    open_ = existing.filter("not resolved").select("kind", "dedup_key")
    fresh = new.dropDuplicates(["kind", "dedup_key"]).join(open_, ["kind", "dedup_key"], "left_anti")
    seen = existing.groupBy("kind", "dedup_key").agg(F.count("*").alias("_n"))
    fresh = fresh.join(seen, ["kind", "dedup_key"], "left").withColumn("id", F.concat(F.lit("finding:"), F.md5(F.concat_ws("|", "kind", "dedup_key", F.coalesce("_n", F.lit(0)).cast("string"))))).withColumn("resolved", F.lit(False))
    return existing.unionByName(fresh.select(existing.columns))


def lint_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many findings are new, and how many are open in all."""
    return after.join(before.select("id", F.lit(True).alias("_old")), "id", "left").agg(F.count_if(F.col("_old").isNull()).alias("new"), F.count_if(~F.col("resolved")).alias("open"))


def enrich_findings(findings: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, kind, place, party, name, summary, is_name): the parties of each finding; for a deleted one its raw id.

    is_name tells whether the finding's detail is the party's own name rather than an alias.
    """
    parties = findings.select("id", "kind", "detail", F.posexplode("parties").alias("place", "party"))
    known = live(entities).select(F.col("id").alias("party"), "name", "summary")
    named = parties.join(known, "party", "left")
    return named.select("id", "kind", "place", "party", F.coalesce("name", "party").alias("name"), "summary", F.coalesce(F.lower("name") == F.lower("detail"), F.lit(False)).alias("is_name"))


def resolve_collisions(findings: DataFrame, decisions: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, rejected) of decisions (finding_id, keep, drop): which entity keeps an alias and which loses it.

    Both must be the finding's parties and differ, keep must be live, and drop must have the name as an alias, not as its
    own name. applied: finding_id, keep, drop, alias.
    """
    found = findings.filter("kind = 'alias_collision' and not resolved").select(F.col("id").alias("finding_id"), "parties", F.col("detail").alias("alias"))
    alive = live(entities)
    wide = decisions.join(found, "finding_id", "left")
    wide = wide.join(alive.select(F.col("id").alias("keep"), F.lit(True).alias("k")), "keep", "left")
    wide = wide.join(alive.select(F.col("id").alias("drop"), F.col("name").alias("dn"), "aliases"), "drop", "left")
    key = T.name_key(F.col("alias"))
    held = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: T.name_key(a) == key)
    reason = (
        F.when(F.col("parties").isNull(), "no such finding")
        .when(~F.array_contains("parties", F.col("keep")) | ~F.array_contains("parties", F.col("drop")) | (F.col("keep") == F.col("drop")), "not a party")
        .when(F.col("k").isNull(), "keep not found")
        .when(F.col("dn").isNull(), "drop not found")
        .when(T.name_key(F.col("dn")) == key, "primary name")
        .when(~held, "no such alias")
    )
    judged = wide.withColumn("reason", reason)
    return judged.filter("reason is null").select("finding_id", "keep", "drop", "alias"), judged.filter("reason is not null").select("finding_id", "reason")


def resolve_findings(findings: DataFrame, ids: DataFrame) -> DataFrame:
    done = ids.select("id", F.lit(True).alias("_done")).distinct()
    return findings.join(done, "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_done", F.lit(False))).select(findings.columns)


def orphaned_edges(edges: DataFrame, entities: DataFrame, demoted: DataFrame) -> DataFrame:
    """(edge_id, from_id, to_id): edges between an entity of a demoted collection (id) and a campaign's own entity."""
    inside = entities.join(demoted.select(F.col("id").alias("collection_id")), "collection_id", "left_semi").select("id")
    own = entities.filter("campaign_id is not null").select("id")
    one = lambda ids, c: ids.select(F.col("id").alias(c)).distinct()
    out = edges.join(one(inside, "from_id"), "from_id", "left_semi").join(one(own, "to_id"), "to_id", "left_semi")
    back = edges.join(one(inside, "to_id"), "to_id", "left_semi").join(one(own, "from_id"), "from_id", "left_semi")
    return out.select("edge_id", "from_id", "to_id").union(back.select("edge_id", "from_id", "to_id")).distinct()


