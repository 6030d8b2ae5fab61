"""Extraction, compilation and review. A model is called outside: request tables go out, response tables come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import text as T

from .aggregates import cap_per_scope
from .context import page_refs
from .graph import canonical_relations, entity_relations, relate_collapsing
from .packing import BATCH_BYTES, batch_passages
from .postings import containing
from .scopes import KINDS, check_scope, is_live, is_stale, live, provenance_scope
from .vectors import Embedder, embed_queries, knn

#: Most rows of one run.
COMPILE_CAP, RULE_BATCH_CAP, ENRICH_CAP, PROPOSAL_CAP, NEIGHBOUR_CAP = 50, 40, 20, 8, 12

#: Passages that an article is written from.
ARTICLE_PASSAGES = 8

# A rule's categories, and a proposal's kinds.
CATEGORIES = ("entry", "condition", "action", "spell", "feat", "item", "procedure")
PROPOSAL_KINDS = ("entity_note", "entity_summary", "new_entity", "rule_note", "new_rule")

RELATION = "name: string, kind: string, rel_type: string, summary: string, notes: string"
EXTRACTION = f"entities array<struct<name: string, kind: string, summary: string, notes: string, relations: array<struct<{RELATION}>>>>"
RULES = "entries array<struct<name: string, category: string, body: string, page_refs: array<struct<source_name: string, page_start: bigint, page_end: bigint>>>>"
DRAFTS = "proposals array<struct<kind: string, target_name: string, entity_kind: string, category: string, proposed_text: string, rationale: string>>, mentioned array<string>"
PROFILE = "summary string, notes string"
REFS = "array<struct<source_name: string, page_start: bigint, page_end: bigint>>"


def strip_fences(raw: Column) -> Column:
    """A response without the code fence around it."""
    inner = T.strip(raw)
    return F.when(inner.startswith("```"), T.strip(F.regexp_replace(F.regexp_replace(inner, r"^```(?:json)?", ""), r"`+\s*$", ""))).otherwise(inner)


def parsed(raw: Column, schema: str) -> Column:
    """A response as a struct of the schema; null where it is no JSON."""
    return F.from_json(strip_fences(raw), schema, {"mode": "PERMISSIVE"})


def known_kind(kind: Column) -> Column:
    return F.when(kind.isin(*KINDS), kind).otherwise("misc")


def extraction_requests(chunks: DataFrame, instruction: str = "", budget: int = BATCH_BYTES) -> DataFrame:
    """(collection_id, batch, prompt): a collection's chunks, packed in order of their place."""
    packed = batch_passages(chunks, "collection_id", "place", "text", budget)
    return _prompts(packed, ["collection_id", "batch"], "place", instruction)


def _prompts(packed: DataFrame, keys: list[str], order: str, instruction: str) -> DataFrame:
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "\n\n")
    return packed.groupBy(*keys).agg(F.concat(F.lit(instruction), texts).alias("prompt"))


def seed_requests(passages: DataFrame, chunks: DataFrame, instruction: str = "", budget: int = BATCH_BYTES) -> DataFrame:
    """(query_id, batch, prompt) of hybrid passages (query_id, chunk_id, place)."""
    texts = passages.join(chunks.select("chunk_id", "text"), "chunk_id")
    return _prompts(batch_passages(texts, "query_id", "place", "text", budget), ["query_id", "batch"], "place", instruction)


def parse_extraction(responses: DataFrame) -> DataFrame:
    """(collection_id, batch, place, name, kind, summary, notes, relations): the entities of each readable response.

    Unknown kinds become misc; blank names are left out; a malformed response gives none.
    """
    wide = responses.select("collection_id", "batch", F.posexplode(parsed(F.col("response"), EXTRACTION)["entities"]).alias("place", "e"))
    return wide.select("collection_id", "batch", "place", T.sanitize_scalar(F.col("e.name")).alias("name"), known_kind(F.col("e.kind")).alias("kind"), "e.summary", "e.notes", "e.relations").filter("name <> ''")


def persist_extraction(found: DataFrame, entities: DataFrame, edges: DataFrame, collections: DataFrame, subs: DataFrame) -> dict[str, DataFrame]:
    """created, touched (id), edges and findings after parse_extraction.

    Entities and the ends of their relations are one by (collection, kind, folded name), the first winning. New ones get an
    id from these; known ones are touched and turn stale. Relations are made canonical; those out of scope are findings,
    the others join the edges, collapsed.
    """
    ends = found.select("collection_id", "batch", "place", F.explode("relations").alias("r"))
    names = found.select("collection_id", "kind", "name", "summary", "notes", F.struct("batch", "place", F.lit(0).alias("z")).alias("o"))
    names = names.union(ends.select("collection_id", known_kind(F.col("r.kind")), T.sanitize_scalar(F.col("r.name")), "r.summary", "r.notes", F.struct("batch", "place", F.lit(1).alias("z"))))
    first = names.filter("name <> ''").groupBy("collection_id", "kind", F.lower("name").alias("folded")).agg(F.min_by(F.struct("name", "summary", "notes"), "o").alias("e"))
    have = live(entities).groupBy("collection_id", "kind", F.lower("name").alias("folded")).agg(F.min("id").alias("id"))
    key = ["collection_id", "kind", "folded"]
    made = F.concat("kind", F.lit(":"), F.md5(F.concat_ws("|", *key)))
    ids = first.join(have, key, "left").withColumn("new", F.col("id").isNull()).withColumn("id", F.coalesce("id", made))
    created = ids.filter("new").select("id", "kind", "collection_id", "e.name", "e.summary", "e.notes")

    named = ids.select(*key, "id")
    start = named.select("collection_id", F.col("kind").alias("k1"), F.col("folded").alias("f1"), F.col("id").alias("from_id"))
    end = named.select("collection_id", F.col("kind").alias("k2"), F.col("folded").alias("f2"), F.col("id").alias("to_id"))
    told = found.select("collection_id", F.col("kind").alias("k1"), F.lower("name").alias("f1"), F.explode("relations").alias("r"))
    told = told.select("collection_id", "k1", "f1", known_kind(F.col("r.kind")).alias("k2"), F.lower(T.sanitize_scalar(F.col("r.name"))).alias("f2"), F.col("r.rel_type").alias("rel_type"), F.col("r.notes").alias("notes")).filter("f2 <> '' and rel_type <> ''")
    new = canonical_relations(told.join(start, ["collection_id", "k1", "f1"]).join(end, ["collection_id", "k2", "f2"]).select("from_id", "to_id", "rel_type", "notes")).filter("from_id <> to_id").distinct()
    everyone = entities.select("id", "campaign_id", "collection_id").union(created.select("id", F.lit(None).cast("string"), "collection_id"))
    judged = check_scope(new, everyone, collections, subs)
    ready = judged.filter("allowed").groupBy("from_id", "to_id", "rel_type").agg(F.min("notes").alias("notes"))
    columns = {"edge_id": F.xxhash64("from_id", "to_id", "rel_type").cast(edges.schema["edge_id"].dataType), "created_at": F.lit(None).cast(edges.schema["created_at"].dataType)}
    return {
        "created": created,
        "touched": ids.filter("not new").select("id").distinct(),
        "edges": relate_collapsing(edges, ready.withColumns(columns).select(edges.columns)),
        "findings": judged.filter("not allowed").select("from_id", "to_id", "rel_type"),
    }


def apply_profiles(entities: DataFrame, responses: DataFrame) -> DataFrame:
    """entities with the longest summary and notes of profile responses (id, batch, response)."""
    from .aggregates import longest_wins

    rows = responses.select("id", "batch", parsed(F.col("response"), PROFILE).alias("p")).select("id", "batch", "p.summary", "p.notes")
    return longest_wins(entities, rows, "summary", "notes")


def compile_targets(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, remainder): the first 50 stale live entities of each collection, by kind and name."""
    stale = live(entities).filter(is_stale() & F.col("collection_id").isNotNull())
    return cap_per_scope(stale, "collection_id", [F.col("kind"), F.col("name"), F.col("id")], COMPILE_CAP)


def labelled(passages: DataFrame) -> Column:
    """A passage under its source and pages."""
    pages = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", F.col("page_start").cast("string"), F.col("page_end").cast("string")))
    return F.concat(F.lit('[Source: "'), "source_name", F.lit('", p.'), pages, F.lit("]\n"), "text")


def article_passages(targets: DataFrame, chunks: DataFrame, collections: DataFrame, subs: DataFrame, embedder: Embedder, k: int = ARTICLE_PASSAGES) -> DataFrame:
    """(id, rank, chunk_id, source_name, page_start, page_end, text): for each target the k chunks nearest to its name,
    summary and notes, among the collections that its own one draws on. chunks carry chunk_id and embedding."""
    asked = targets.select(F.col("id").alias("query_id"), "collection_id", T.embed_text("entity", F.col("name"), F.col("summary"), F.col("notes")).alias("text"))
    scopes = asked.join(provenance_scope(collections, subs), "collection_id").select("query_id", F.col("scope_id").alias("collection_id"))
    near = knn(embed_queries(asked, embedder), chunks.select(F.col("chunk_id").alias("item_id"), "collection_id", "embedding"), scopes, k)
    told = chunks.select(F.col("chunk_id").alias("item_id"), "source_name", "page_start", "page_end", "text")
    return near.join(told, "item_id").select(F.col("query_id").alias("id"), "rank", F.col("item_id").alias("chunk_id"), "source_name", "page_start", "page_end", "text")


def article_requests(targets: DataFrame, passages: DataFrame, edges: DataFrame, entities: DataFrame, instruction: str = "") -> DataFrame:
    """(id, prompt): for each target its passages (id, rank, source_name, page_start, page_end, text) and up to 12
    neighbours; targets without passages are left out."""
    near = entity_relations(targets, edges, entities).withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("name", "other_id", "rel_type", "direction"))).filter(F.col("n") <= NEIGHBOUR_CAP)
    around = near.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.concat(F.lit("- [["), "name", F.lit("]] ("), "rel_type", F.lit(")")).alias("l")))), lambda x: x["l"]), "\n").alias("around"))
    texts = passages.withColumn("l", labelled(passages)).groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "l"))), lambda x: x["l"]), "\n\n").alias("texts"))
    wide = targets.select("id", "name", "kind", "summary", "notes").join(texts, "id").join(around, "id", "left")
    none = lambda c: F.coalesce(T.nonblank(F.col(c)), F.lit("(none)"))
    prompt = F.concat(F.lit(instruction), F.format_string('Write the article about the %s "%s".\n\n', "kind", "name"), F.lit("Known summary: "), none("summary"), F.lit("\nGM notes: "), none("notes"), F.lit("\nRelated entities:\n"), none("around"), F.lit("\n\nSource passages:\n"), "texts")
    return wide.select("id", prompt.alias("prompt"))


def apply_articles(entities: DataFrame, responses: DataFrame, passages: DataFrame, now: Column) -> DataFrame:
    """entities with the articles of responses (id, response), their sources and time; blank ones stay stale."""
    got = responses.withColumn("_a", T.strip(F.col("response"))).filter("_a <> ''").select("id", "_a")
    used = passages.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "source_name", "page_start", "page_end"))).alias("_s"))
    joined = entities.drop("codex_sources", "codex_compiled_at").join(got, "id", "left").join(used, "id", "left")
    hit = F.col("_a").isNotNull()
    return joined.withColumns({"codex_article": F.coalesce("_a", "codex_article"), "codex_stale": F.when(hit, False).otherwise(F.col("codex_stale")), "codex_compiled_at": F.when(hit, now), "codex_sources": F.when(hit, F.col("_s"))}).drop("_a", "_s")


def rule_requests(chunks: DataFrame, instruction: str = "") -> tuple[DataFrame, DataFrame]:
    """(requests, remainder): (collection_id, batch, prompt) of labelled rule chunks; 40 batches a collection and run."""
    packed = batch_passages(chunks.withColumn("text", labelled(chunks)), "collection_id", "place")
    return cap_per_scope(_prompts(packed, ["collection_id", "batch"], "place", instruction), "collection_id", [F.col("batch")], RULE_BATCH_CAP)


def parse_rules(responses: DataFrame) -> DataFrame:
    """(collection_id, batch, place, name, category, body, page_refs); blank names or bodies are left out, and other
    categories become entry."""
    wide = responses.select("collection_id", "batch", F.posexplode(parsed(F.col("response"), RULES)["entries"]).alias("place", "e"))
    category = F.when(F.col("e.category").isin(*CATEGORIES), F.col("e.category")).otherwise("entry")
    return wide.select("collection_id", "batch", "place", T.sanitize_scalar(F.col("e.name")).alias("name"), category.alias("category"), F.col("e.body").alias("body"), F.col("e.page_refs").alias("page_refs")).filter((F.col("name") != "") & (T.strip(F.col("body")) != ""))


def upsert_rules(rules: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, counts): parsed entries by collection and name. A known rule gets the last body and category and all page
    references, and keeps notes; counts has created and updated per collection."""
    refs, none = REFS, F.array().cast(REFS)
    rules = rules.withColumn("page_refs", F.col("page_refs").cast(refs))
    new = found.groupBy("collection_id", "name").agg(F.max_by(F.struct("category", "body"), F.struct("batch", "place")).alias("e"), F.array_distinct(F.flatten(F.sort_array(F.collect_list(F.coalesce(F.col("page_refs").cast(refs), none))))).alias("refs"))
    joined = rules.withColumn("_old", F.lit(True)).join(new, ["collection_id", "name"], "full")
    out = joined.withColumns({
        "id": F.coalesce("id", F.concat(F.lit("rule:"), F.md5(F.concat_ws("|", "collection_id", "name")))),
        "category": F.coalesce("e.category", "category"), "body": F.coalesce("e.body", "body"),
        "page_refs": F.array_union(F.coalesce("page_refs", none), F.coalesce("refs", none)),
        "stale": F.when(F.col("e").isNotNull(), False).otherwise(F.col("stale")),
    })
    counts = out.filter("e is not null").groupBy("collection_id").agg(F.count_if(F.col("_old").isNull()).alias("created"), F.count_if(F.col("_old").isNotNull()).alias("updated"))
    return out.select(rules.columns), counts


def redo_requests(rules: DataFrame, objections: DataFrame, chunks: DataFrame, instruction: str = "") -> DataFrame:
    """(id, prompt): rules to be written anew, with all objections so far and the new one (id, objection), and the rule
    chunks of their collection that have the name."""
    asked = rules.join(objections, "id").withColumn("all", F.array_append(F.coalesce("objections", F.array().cast("array<string>")), F.col("objection")))
    told = chunks.withColumn("l", labelled(chunks))
    texts = containing(asked.select(F.col("id").alias("query_id"), "collection_id", F.col("name").alias("needle")), told).withColumnRenamed("query_id", "id").join(told.select("chunk_id", "place", "l"), "chunk_id")
    joined = texts.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "l"))), lambda x: x["l"]), "\n\n").alias("texts"))
    wide = asked.join(joined, "id", "left")
    return wide.select("id", F.concat(F.lit(instruction), "name", F.lit("\n"), "body", F.lit("\nObjections:\n"), F.array_join(F.transform("all", lambda o: F.concat(F.lit("- "), o)), "\n"), F.lit("\n\n"), F.coalesce("texts", F.lit(""))).alias("prompt"))


def apply_redo(rules: DataFrame, objections: DataFrame, found: DataFrame) -> DataFrame:
    """rules with the new bodies of found (id, body, page_refs), the objection kept and the references joined."""
    refs = REFS
    rules = rules.withColumn("page_refs", F.col("page_refs").cast(refs))
    got = objections.join(found.select("id", F.col("body").alias("_b"), F.col("page_refs").cast(refs).alias("_r")), "id").filter(T.strip(F.col("_b")) != "")
    joined = rules.join(got, "id", "left")
    hit = F.col("_b").isNotNull()
    return joined.withColumns({"objections": F.when(hit, F.array_append(F.coalesce("objections", F.array().cast("array<string>")), F.col("objection"))).otherwise(F.col("objections")), "body": F.coalesce("_b", "body"), "page_refs": F.when(hit, F.array_union("page_refs", F.coalesce("_r", F.array().cast(refs)))).otherwise(F.col("page_refs"))}).select(rules.columns)


def propagate_staleness(entities: DataFrame, rules: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, rules) after sources (collection_id, source_type) were read anew: all of the collection's entities turn
    stale, and its rules where the source is a rule book or supplement."""
    any_ = changed.select("collection_id", F.lit(True).alias("_x")).distinct()
    book = changed.filter(F.col("source_type").isin("rules", "supplement")).select("collection_id", F.lit(True).alias("_x")).distinct()
    mark = lambda df, hit, c: df.join(hit, "collection_id", "left").withColumn(c, F.when(F.col("_x"), True).otherwise(F.col(c))).select(df.columns)
    return mark(entities, any_, "codex_stale"), mark(rules, book, "stale")


def distil_requests(sources: DataFrame, visible: DataFrame, rules: DataFrame, instruction: str = "", known: int = 200) -> DataFrame:
    """(id, prompt) for texts (id, campaign_id, text): with the names of the campaign's entities and rules, the first
    `known` by kind and name of either."""
    rows = visible.select("campaign_id", "kind", "name").union(rules.select("campaign_id", F.lit("rule"), "name")).distinct()
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("campaign_id", F.col("kind") == "rule").orderBy("kind", "name"))).filter(F.col("n") <= known)
    listed = ranked.groupBy("campaign_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "name"))), lambda x: F.concat(F.lit("- ["), x["kind"], F.lit("] "), x["name"])), "\n").alias("known"))
    return sources.join(listed, "campaign_id", "left").select("id", F.concat(F.lit(instruction), F.lit("Known:\n"), F.coalesce("known", F.lit("(none)")), F.lit("\n\n"), "text").alias("prompt"))


def build_proposals(responses: DataFrame, entities: DataFrame, rules: DataFrame, collections: DataFrame) -> DataFrame:
    """(id, kind, target, collection_id, campaign_id, proposed_text, rationale, origin, status) of responses (origin,
    campaign_id, response).

    Unknown kinds and blank texts are dropped. The target is the campaign's entity or rule of that folded name. The
    collection is the target's, else the one that the campaign owns; without either there is no proposal. 8 a response.
    """
    wide = responses.select("origin", "campaign_id", F.posexplode(parsed(F.col("response"), DRAFTS)["proposals"]).alias("place", "p")).select("origin", "campaign_id", "place", "p.*")
    wide = wide.filter(F.col("kind").isin(*PROPOSAL_KINDS) & (T.strip(F.col("proposed_text")) != ""))
    wide = wide.withColumns({"folded": F.lower(F.trim("target_name")), "table": F.when(F.col("kind").startswith("rule"), "rule").when(F.col("kind").startswith("entity"), "entity")})
    targets = entities.select("campaign_id", F.lit("entity").alias("table"), F.lower("name").alias("folded"), "id", "collection_id").union(rules.select("campaign_id", F.lit("rule"), F.lower("name"), "id", "collection_id"))
    one = targets.groupBy("campaign_id", "table", "folded").agg(F.min(F.struct("id", "collection_id")).alias("t"))
    owned = collections.filter("owner_campaign is not null").groupBy(F.col("owner_campaign").alias("campaign_id")).agg(F.min("id").alias("owned"))
    joined = wide.join(one, ["campaign_id", "table", "folded"], "left").join(owned, "campaign_id", "left").withColumn("collection_id", F.coalesce("t.collection_id", "owned"))
    joined = joined.filter(F.col("collection_id").isNotNull() & (F.col("table").isNull() | F.col("t").isNotNull()))
    first = joined.withColumn("_n", F.row_number().over(Window.partitionBy("origin").orderBy("place"))).filter(F.col("_n") <= PROPOSAL_CAP)
    return first.select(F.concat(F.lit("proposal:"), F.md5(F.concat_ws("|", "origin", F.col("place").cast("string")))).alias("id"), "kind", F.col("t.id").alias("target"), "collection_id", "campaign_id", F.trim("proposed_text").alias("proposed_text"), "rationale", "target_name", "entity_kind", "category", "origin", F.lit("pending").alias("status"))


def replace_session_proposals(proposals: DataFrame, new: DataFrame, responses: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proposals, entities): the pending proposals of the responses' origins give way to the new ones, and entities that
    the responses mention turn stale."""
    gone = responses.select("origin", F.lit("pending").alias("status")).distinct()
    kept = proposals.join(gone, ["origin", "status"], "left_anti").select(proposals.columns)
    told = responses.select("campaign_id", F.explode(parsed(F.col("response"), DRAFTS)["mentioned"]).alias("m")).select("campaign_id", F.lower(F.trim("m")).alias("folded"), F.lit(True).alias("_x")).distinct()
    marked = entities.withColumn("folded", F.lower("name")).join(told, ["campaign_id", "folded"], "left")
    return kept.unionByName(new.select(proposals.columns)), marked.withColumn("codex_stale", F.when(F.col("_x"), True).otherwise(F.col("codex_stale"))).select(entities.columns)


def list_proposals(proposals: DataFrame, entities: DataFrame, rules: DataFrame) -> DataFrame:
    """proposals with target_label and current_text: the name of the target and the field that would change."""
    known = entities.select(F.col("id").alias("target"), F.col("name").alias("_n"), "summary", F.col("notes").alias("_t")).union(rules.select("id", "name", F.lit(None).cast("string"), "notes"))
    joined = proposals.join(known, "target", "left")
    current = F.when(F.col("kind") == "entity_summary", F.col("summary")).when(F.col("kind").isin("entity_note", "rule_note"), F.col("_t"))
    return joined.withColumns({"target_label": F.col("_n"), "current_text": current}).select(*proposals.columns, "target_label", "current_text")


def accept_proposals(proposals: DataFrame, ids: DataFrame, entities: DataFrame, rules: DataFrame) -> dict[str, DataFrame]:
    """proposals, entities, rules and rejected after accepting the given ones (id), pending ones only.

    A note is added to the target's notes and a summary replaces it; both turn an entity stale. A new entity or rule is a
    row of its own.
    """
    asked = ids.select("id").distinct().join(proposals, "id", "left")
    ok = asked.filter("status = 'pending'")
    reason = F.when(F.col("status").isNull(), "not found").otherwise("not pending")
    by_target = ok.filter("target is not null").groupBy(F.col("target").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind").isin("entity_note", "rule_note"), F.struct(F.col("id").alias("i"), F.col("proposed_text").alias("t"))))), lambda x: x["t"]), "\n\n").alias("_add"), F.max_by("proposed_text", F.when(F.col("kind") == "entity_summary", F.col("id"))).alias("_sum"))
    added = lambda: F.when(F.coalesce("_add", F.lit("")) != "", F.concat_ws("\n\n", T.nonblank(F.col("notes")), F.col("_add"))).otherwise(F.col("notes"))
    changed = entities.join(by_target, "id", "left")
    changed = changed.withColumns({"notes": added(), "summary": F.coalesce("_sum", "summary"), "codex_stale": F.when(F.col("_add").isNotNull() | F.col("_sum").isNotNull(), True).otherwise(F.col("codex_stale"))}).select(entities.columns)
    ruled = rules.join(by_target, "id", "left").withColumn("notes", added()).select(rules.columns)
    fresh = ok.filter("kind = 'new_entity'").select(F.concat(known_kind(F.col("entity_kind")), F.lit(":"), F.md5("id")).alias("id"), known_kind(F.col("entity_kind")).alias("kind"), T.sanitize_scalar(F.col("target_name")).alias("name"), "collection_id", F.col("proposed_text").alias("notes"), F.lit(True).alias("codex_stale"))
    written = ok.filter("kind = 'new_rule'").select(F.concat(F.lit("rule:"), F.md5("id")).alias("id"), T.sanitize_scalar(F.col("target_name")).alias("name"), "collection_id", F.when(F.col("category").isin(*CATEGORIES), F.col("category")).otherwise("entry").alias("category"), F.col("proposed_text").alias("body"))
    fill = lambda new, old: new.select(*(new[c].cast(old.schema[c].dataType) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns))
    done = proposals.join(ok.select("id", F.lit(True).alias("_ok")), "id", "left").withColumn("status", F.when(F.col("_ok"), "accepted").otherwise(F.col("status"))).select(proposals.columns)
    return {"proposals": done, "entities": changed.unionByName(fill(fresh, entities)), "rules": ruled.unionByName(fill(written, rules)), "rejected": asked.filter("status is null or status <> 'pending'").select("id", reason.alias("reason"))}


def apply_changes(table: DataFrame, changes: DataFrame, key: str = "id", checks: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, rejected): rows of the table with the columns of changes (key, …) put in their place.

    Changes of unknown keys are rejected, as are those that fail a check: a condition on the old row and the new columns,
    which are named new_…; null values of a change do replace.
    """
    new = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in new), F.lit(True).alias("_hit"))
    known = renamed.join(table, key, "left")
    missing = changes.join(table.select(key), key, "left_anti").select(F.col(key).cast("string").alias("id"), F.lit("not found").alias("reason"))
    reason = F.lit(None).cast("string")
    for name, holds in (checks or {}).items():
        reason = F.when(reason.isNull() & ~F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    judged = known.join(table.select(key), key, "left_semi").withColumn("_reason", reason)
    good = judged.filter("_reason is null").select(key, *(f"new_{c}" for c in new), "_hit")
    out = table.join(good, key, "left").withColumns({c: F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in new}).select(table.columns)
    return out, judged.filter("_reason is not null").select(F.col(key).cast("string").alias("id"), F.col("_reason").alias("reason")).union(missing)


def reject_proposals(proposals: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    changes = ids.select("id", F.lit("rejected").alias("status")).distinct()
    return apply_changes(proposals, changes, checks={"not pending": F.col("status") == "pending"})


def update_rule_notes(rules: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return apply_changes(rules, notes.select("id", "notes"), checks={"not found": is_live()})


def rule_pages(rules: DataFrame) -> DataFrame:
    return rules.withColumn("pages", page_refs(F.col("page_refs")))
