"""Queries on scopes, counts, order and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as T
from loreloom.operators import aggregates as A
from loreloom.operators import scopes as S
from loreloom.operators import vectors as V

from .registry import LIVE, STALE, Base, query

KINDS = ", ".join(f"('{k}')" for k in S.KINDS)
VISIBLE = f"(SELECT DISTINCT campaign_id, id AS entity_id FROM entity WHERE campaign_id IS NOT NULL AND {LIVE} UNION SELECT s.campaign_id, e.id FROM entity e JOIN subscription s ON s.collection_id = e.collection_id WHERE {LIVE})"
ENDS = "(SELECT e.id, coalesce(e.campaign_id, c.owner_campaign) AS campaign_id, e.collection_id FROM entity e LEFT JOIN collection c ON c.id = e.collection_id)"
ALLOWED = """((a.campaign_id IS NULL AND a.collection_id IS NULL) OR (b.campaign_id IS NULL AND b.collection_id IS NULL)
    OR coalesce(a.collection_id = b.collection_id, false) OR coalesce(a.campaign_id = b.campaign_id, false)
    OR (b.campaign_id IS NULL AND EXISTS (SELECT 1 FROM subscription s WHERE s.campaign_id = a.campaign_id AND s.collection_id = b.collection_id))
    OR (a.campaign_id IS NULL AND EXISTS (SELECT 1 FROM subscription s WHERE s.campaign_id = b.campaign_id AND s.collection_id = a.collection_id)))"""
SCOPED = f"SELECT e.edge_id, e.from_id, e.to_id, {ALLOWED} AS allowed FROM edge e LEFT JOIN {ENDS} a ON a.id = e.from_id LEFT JOIN {ENDS} b ON b.id = e.to_id"


@query("f1_live", f"SELECT id, kind, name FROM entity WHERE {LIVE}")
def f1(kb: Base) -> DataFrame:
    return S.live(kb.entity).select("id", "kind", "name")


@query("u1_union_kinds", "SELECT kind, count(*) AS n, count(sequence_index) AS n_sequence FROM (SELECT kind, NULL AS sequence_index FROM entity UNION ALL SELECT kind, sequence_index FROM event_entity) GROUP BY kind")
def u1(kb: Base) -> DataFrame:
    entities = kb.entity
    tables = {k: entities.filter(F.col("kind") == k).drop("kind") for k in ("npc", "faction", "item")} | {"event": kb.event_entity.drop("kind")}
    return S.union_kinds(tables).groupBy("kind").agg(F.count("*").alias("n"), F.count("sequence_index").alias("n_sequence"))


@query("f2_visible_entities", f"SELECT campaign_id, entity_id FROM {VISIBLE}")
def f2(kb: Base) -> DataFrame:
    return S.visible_entities(kb.entity, kb.subscription)


@query("f3_collection_entities", f"SELECT e.id, e.collection_id FROM entity e WHERE {LIVE} AND e.collection_id IN (SELECT id FROM collection WHERE owner_campaign IS NOT NULL)")
def f3(kb: Base) -> DataFrame:
    return S.collection_entities(kb.entity, kb.collection.filter("owner_campaign is not null")).select("id", "collection_id")


@query("f4_subscriptions", "SELECT DISTINCT campaign_id, collection_id FROM subscription WHERE campaign_id IN (SELECT id FROM campaign)")
def f4(kb: Base) -> DataFrame:
    return S.subscriptions(kb.campaign, kb.subscription)


@query("f5_provenance_scope", "SELECT DISTINCT c.id AS collection_id, s.collection_id AS scope_id FROM collection c JOIN subscription s ON s.campaign_id = c.owner_campaign UNION SELECT id, id FROM collection WHERE owner_campaign IS NULL")
def f5(kb: Base) -> DataFrame:
    return S.provenance_scope(kb.collection, kb.subscription)


@query("f6_constraints", "SELECT 'index_status' AS rule, id AS \"key\" FROM source WHERE index_status NOT IN ('done') UNION ALL SELECT 'display_name', id FROM source WHERE trim(display_name) = '' UNION ALL SELECT 'unique_model', id FROM source WHERE (collection_id, embed_model) IN (SELECT (collection_id, embed_model) FROM source GROUP BY ALL HAVING count(*) > 1)".replace("GROUP BY ALL", "GROUP BY collection_id, embed_model"))
def f6(kb: Base) -> DataFrame:
    rules = {"index_status": F.col("index_status").isin("done"), "display_name": T.strip(F.col("display_name")) != ""}
    return S.check_constraints(kb.source, "id", rules, {"unique_model": ["collection_id", "embed_model"]})


@query("f7_find_by_name", f"SELECT c.collection_id, c.kind, c.name, (SELECT min(e.id) FROM entity e WHERE {LIVE} AND e.collection_id = c.collection_id AND e.kind = c.kind AND lower(e.name) = lower(c.name)) AS id FROM (SELECT DISTINCT collection_id, kind, upper(name) AS name FROM entity WHERE collection_id IS NOT NULL) c")
def f7(kb: Base) -> DataFrame:
    asked = kb.entity.filter("collection_id is not null").select("collection_id", "kind", F.upper("name").alias("name")).distinct()
    return S.find_by_name(asked, kb.entity).select("collection_id", "kind", "name", "id")


@query("f8_with_scope", "SELECT id, campaign_id, collection_id FROM entity")
def f8(kb: Base) -> DataFrame:
    one = kb.entity.select(F.col("id").alias("entity_id"), "campaign_id").filter("campaign_id is not null")
    two = kb.entity.select(F.col("id").alias("entity_id"), "collection_id").filter("collection_id is not null")
    return S.with_scope(kb.entity, one, two).select("id", "campaign_id", "collection_id")


@query("f9_endpoint_scope", f"SELECT id, campaign_id, collection_id FROM {ENDS}")
def f9(kb: Base) -> DataFrame:
    return S.endpoint_scope(kb.entity, kb.collection)


@query("f10_check_scope", SCOPED)
def f10(kb: Base) -> DataFrame:
    return S.check_scope(kb.edge, kb.entity, kb.collection, kb.subscription).select("edge_id", "from_id", "to_id", "allowed")


@query("f11_with_source", "SELECT c.chunk_id, coalesce(CASE WHEN trim(s.display_name) <> '' THEN s.display_name END, s.filename, c.source_id) AS source_name, s.source_type FROM chunk c LEFT JOIN source s ON s.id = c.source_id")
def f11(kb: Base) -> DataFrame:
    return S.with_source(kb.chunk, kb.source).select("chunk_id", "source_name", "source_type")


@query("f12_rule_chunks", "SELECT c.chunk_id, s.source_type FROM chunk c JOIN source s ON s.id = c.source_id WHERE s.source_type IN ('rules', 'supplement')")
def f12(kb: Base) -> DataFrame:
    return S.rule_chunks(kb.chunk, kb.source).select("chunk_id", "source_type")


@query("f13_resolve_citations", """
    SELECT q.citation_id, arg_min(c.chunk_id, (c.page_start, c.chunk_id)) AS chunk_id
    FROM (SELECT event_id AS citation_id, 'src' || CAST(user_id % 23 AS STRING) || '.pdf' AS source_name, CASE WHEN event_id % 4 <> 0 THEN event_id % 33 END AS page FROM events) q
    LEFT JOIN source s ON s.filename = q.source_name
    LEFT JOIN chunk c ON c.source_id = s.id AND (q.page IS NULL OR q.page BETWEEN c.page_start AND c.page_end) GROUP BY q.citation_id""")
def f13(kb: Base) -> DataFrame:
    asked = kb.table("events").select(F.col("event_id").alias("citation_id"), F.concat(F.lit("src"), (F.col("user_id") % 23).cast("string"), F.lit(".pdf")).alias("source_name"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 33).alias("page"))
    return S.resolve_citations(asked, kb.source, kb.chunk).select("citation_id", "chunk_id")


@query("f14_session_events", f"SELECT e.session_id, e.id AS entity_id, e.name FROM event_entity e JOIN session s ON s.id = e.session_id WHERE e.{LIVE}")
def f14(kb: Base) -> DataFrame:
    return S.session_events(kb.event_entity, kb.session)


@query("f15_sync_records", f"""
    WITH r AS (SELECT id AS record, kind AS type, name, CASE WHEN campaign_id IS NOT NULL THEN 'campaign' ELSE 'collection' END AS scope_kind, coalesce(campaign_id, collection_id) AS scope_id FROM entity WHERE {LIVE}
        UNION ALL SELECT id, 'session', title, 'campaign', campaign_id FROM session WHERE {LIVE}
        UNION ALL SELECT id, 'rule_entry', name, 'collection', collection_id FROM rule WHERE {LIVE})
    SELECT r.record, r.type, r.name, r.scope_kind, coalesce(a.name, b.name) AS scope_name FROM r
    LEFT JOIN campaign a ON r.scope_kind = 'campaign' AND a.id = r.scope_id LEFT JOIN collection b ON r.scope_kind = 'collection' AND b.id = r.scope_id WHERE r.scope_id IS NOT NULL AND coalesce(a.name, b.name) IS NOT NULL""")
def f15(kb: Base) -> DataFrame:
    return S.sync_records(kb.entity, kb.session, kb.rule, kb.campaign, kb.collection).select("record", "type", "name", "scope_kind", "scope_name")


@query("f16_chat_history", "SELECT campaign_id, id, role, row_number() OVER (PARTITION BY campaign_id ORDER BY created_at, id) AS place FROM message")
def f16(kb: Base) -> DataFrame:
    return S.chat_history(kb.message).select("campaign_id", "id", "role", F.col("place").cast("long").alias("place"))


@query("f17_sources_by_collection", "SELECT collection_id, id, display_name, page_count FROM source ORDER BY collection_id, display_name, id")
def f17(kb: Base) -> DataFrame:
    return S.listing(kb.source, "collection_id", "display_name", "id").select("collection_id", "id", "display_name", "page_count")


@query("listing_sessions", f"SELECT campaign_id, id, session_number FROM session WHERE {LIVE} ORDER BY campaign_id, session_number")
def listing_sessions(kb: Base) -> DataFrame:
    return S.listing(kb.session, "campaign_id", "session_number").select("campaign_id", "id", "session_number")


@query("a1_count_by_campaign", f"SELECT c.id AS campaign_id, k.kind, count(e.id) AS n FROM campaign c CROSS JOIN (VALUES {KINDS}) k(kind) LEFT JOIN {VISIBLE} v ON v.campaign_id = c.id LEFT JOIN entity e ON e.id = v.entity_id AND e.kind = k.kind GROUP BY c.id, k.kind")
def a1(kb: Base) -> DataFrame:
    return A.count_by_campaign(kb.campaign, S.visible_entities(kb.entity, kb.subscription), kb.entity)


@query("a2_codex_status", f"""
    SELECT coalesce(a.collection_id, b.collection_id) AS collection_id, coalesce(total, 0) AS total, coalesce(stale, 0) AS stale, coalesce(rules, 0) AS rules, coalesce(stale_rules, 0) AS stale_rules
    FROM (SELECT collection_id, count(*) AS total, count(*) FILTER ({STALE}) AS stale FROM entity WHERE {LIVE} AND collection_id IS NOT NULL GROUP BY collection_id) a
    FULL JOIN (SELECT collection_id, count(*) AS rules, count(*) FILTER (stale IS DISTINCT FROM false) AS stale_rules FROM rule WHERE {LIVE} GROUP BY collection_id) b ON a.collection_id = b.collection_id""")
def a2(kb: Base) -> DataFrame:
    return A.codex_status(kb.entity, kb.rule)


@query("a3_maintenance_counts", "SELECT (SELECT count(*) FROM proposal WHERE status = 'pending') AS pending, (SELECT count(*) FROM finding WHERE NOT resolved) AS open")
def a3(kb: Base) -> DataFrame:
    return A.maintenance_counts(kb.proposal, kb.finding)


@query("a4_collection_refs", "SELECT c.id AS collection_id, (SELECT count(*) FROM subscription s WHERE s.collection_id = c.id) AS subscribers, (SELECT count(*) FROM source s WHERE s.collection_id = c.id) AS sources FROM collection c")
def a4(kb: Base) -> DataFrame:
    return A.collection_refs(kb.collection, kb.subscription, kb.source)


@query("a5_longest_wins", "SELECT e.id, coalesce(b.t, e.summary) AS summary FROM entity e LEFT JOIN (SELECT 'npc:' || CAST(o_custkey AS STRING) AS id, arg_max(o_orderpriority || repeat('!', CAST(o_orderkey % 9 AS INT)), (strlen(o_orderpriority || repeat('!', CAST(o_orderkey % 9 AS INT))), -o_orderkey)) AS t FROM orders GROUP BY 1) b ON b.id = e.id")
def a5(kb: Base) -> DataFrame:
    told = kb.table("orders").select(F.concat(F.lit("npc:"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderkey").alias("batch"), F.expr("o_orderpriority || repeat('!', cast(o_orderkey % 9 as int))").alias("summary"))
    return A.longest_wins(kb.entity, told, "summary").select("id", "summary")


@query("w3_assign_keys", "SELECT id AS record, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '-' || split_part(id, ':', 2) || '.md' ELSE name || '.md' END AS \"key\" FROM entity")
def w3(kb: Base) -> DataFrame:
    return A.assign_keys(kb.entity.select(F.col("id").alias("record"), F.concat("name", F.lit(".md")).alias("key")))


TIMELINE = f"SELECT campaign_id, id, era, row_number() OVER (PARTITION BY campaign_id ORDER BY sequence_index ASC NULLS LAST, name, id) AS place FROM event_entity WHERE {LIVE}"


@query("w6_timeline", TIMELINE)
def w6(kb: Base) -> DataFrame:
    return A.timeline(kb.event_entity).select("campaign_id", "id", "era", F.col("place").cast("long").alias("place"))


@query("w4_era_runs", f"""
    WITH t AS ({TIMELINE}), g AS (SELECT *, CASE WHEN era IS NOT DISTINCT FROM lag(era) OVER (PARTITION BY campaign_id ORDER BY place) AND place > 1 THEN 0 ELSE 1 END AS b FROM t),
    r AS (SELECT *, sum(b) OVER (PARTITION BY campaign_id ORDER BY place) AS run FROM g)
    SELECT campaign_id, CAST(run AS BIGINT) AS run, min(era) AS era, min(place) AS "first", count(*) AS n FROM r GROUP BY campaign_id, run""")
def w4(kb: Base) -> DataFrame:
    return A.era_runs(A.timeline(kb.event_entity)).select("campaign_id", F.col("run").cast("long").alias("run"), "era", F.col("first").cast("long").alias("first"), "n")


@query("w5_session_lanes", f"""
    WITH own AS (SELECT e.campaign_id, s.id AS session_id FROM event_entity e LEFT JOIN session s ON s.id = e.session_id AND s.campaign_id = e.campaign_id WHERE e.{LIVE}),
    l AS (SELECT s.campaign_id, s.id AS session_id, s.session_number, (SELECT count(*) FROM own o WHERE o.session_id = s.id AND o.campaign_id = s.campaign_id) AS n_events FROM session s
        UNION ALL SELECT campaign_id, NULL, NULL, count(*) FROM own WHERE session_id IS NULL GROUP BY campaign_id)
    SELECT campaign_id, session_id, row_number() OVER (PARTITION BY campaign_id ORDER BY session_number ASC NULLS LAST, session_id) AS lane, n_events FROM l""")
def w5(kb: Base) -> DataFrame:
    return A.session_lanes(kb.session, kb.event_entity).select("campaign_id", "session_id", F.col("lane").cast("long").alias("lane"), "n_events")


@query("w8_batch_passages", """
    WITH RECURSIVE p AS (SELECT collection_id, place, strlen(text) AS b, row_number() OVER (PARTITION BY collection_id ORDER BY place) AS r FROM chunk),
    w AS (SELECT collection_id, place, r, b AS used, 0 AS batch FROM p WHERE r = 1
        UNION ALL SELECT p.collection_id, p.place, p.r, CASE WHEN w.used + 2 + p.b <= 16000 THEN w.used + 2 + p.b ELSE p.b END, CASE WHEN w.used + 2 + p.b <= 16000 THEN w.batch ELSE w.batch + 1 END
        FROM w JOIN p ON p.collection_id = w.collection_id AND p.r = w.r + 1)
    SELECT collection_id, place, batch FROM w""".replace("WITH RECURSIVE", "WITH"))
def w8(kb: Base) -> DataFrame:
    return A.batch_passages(kb.chunk).select("collection_id", "place", "batch")


@query("w9_cap_per_scope", f"SELECT collection_id, id FROM (SELECT collection_id, id, row_number() OVER (PARTITION BY collection_id ORDER BY kind, name, id) AS n FROM entity WHERE {LIVE} AND collection_id IS NOT NULL) WHERE n <= 50")
def w9(kb: Base) -> DataFrame:
    return A.cap_per_scope(S.live(kb.entity).filter("collection_id is not null"), "collection_id", [F.col("kind"), F.col("name"), F.col("id")], 50)[0].select("collection_id", "id")


@query("w9_remainder", f"SELECT collection_id, greatest(count(*) - 50, 0) AS remaining FROM entity WHERE {LIVE} AND collection_id IS NOT NULL GROUP BY collection_id")
def w9b(kb: Base) -> DataFrame:
    return A.cap_per_scope(S.live(kb.entity).filter("collection_id is not null"), "collection_id", [F.col("kind"), F.col("name"), F.col("id")], 50)[1]


@query("w10_origin_message", "SELECT m.id, (SELECT max(o.id) FROM message o WHERE o.role = 'assistant' AND o.campaign_id = m.campaign_id AND o.content = m.content) AS message_id FROM message m")
def w10(kb: Base) -> DataFrame:
    return A.origin_message(kb.message.select("id", "campaign_id", "content"), kb.message).select("id", "message_id")


NEAR = "1.0 - list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])))"
#: Each query searches the collection of its own label and the next.
SCOPES = "(SELECT q.vec_id AS query_id, 'collection:' || CAST((CAST(substr(q.collection_id, 12) AS INT) + d.d) AS STRING) AS collection_id FROM vector q CROSS JOIN (VALUES (0), (1)) d(d) WHERE q.vec_id % 50 = 0)"


def _queries(kb: Base) -> tuple[DataFrame, DataFrame]:
    asked = kb.vector.filter("vec_id % 50 = 0")
    scopes = asked.select(F.col("vec_id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("d"), F.substring("collection_id", 12, 9).cast("int").alias("l"))
    return asked.select(F.col("vec_id").alias("query_id"), "embedding"), scopes.select("query_id", F.concat(F.lit("collection:"), (F.col("l") + F.col("d")).cast("string")).alias("collection_id"))


def _knn_sql(k: int, by: str = "", where: str = "true") -> str:
    part = f"query_id{', ' + by if by else ''}"
    return f"""
    WITH n AS (SELECT s.query_id, {f'v.{by}, ' if by else ''}v.item_id, {NEAR} AS d FROM {SCOPES} s JOIN vector q ON q.vec_id = s.query_id JOIN vector v ON v.collection_id = s.collection_id WHERE {where}),
    r AS (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY d, item_id) AS rank FROM n)
    SELECT {part}, item_id, rank FROM r WHERE rank <= {k}"""


@query("v3_scoped_knn", _knn_sql(15))
def v3(kb: Base) -> DataFrame:
    asked, scopes = _queries(kb)
    return V.knn(asked, kb.vector, scopes).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("v4_entity_knn", _knn_sql(10, "kind", "v.vault_deleted IS DISTINCT FROM true"))
def v4(kb: Base) -> DataFrame:
    asked, scopes = _queries(kb)
    return V.knn_entities(asked, kb.vector, scopes, 10).select("query_id", "kind", "item_id", F.col("rank").cast("long").alias("rank"))


@query("v5_scan_entities", f"SELECT query_id, kind, item_id FROM (SELECT s.campaign_id AS query_id, e.kind, e.id AS item_id, row_number() OVER (PARTITION BY s.campaign_id, e.kind ORDER BY e.id) AS n FROM subscription s JOIN entity e ON e.collection_id = s.collection_id WHERE {LIVE}) WHERE n <= 50")
def v5(kb: Base) -> DataFrame:
    scopes = kb.subscription.withColumnRenamed("campaign_id", "query_id")
    return V.scan_entities(scopes, S.live(kb.entity)).select("query_id", "kind", "item_id")


@query("v6_rule_knn", _knn_sql(5, "", "v.kind = 'item' AND v.vault_deleted IS DISTINCT FROM true"))
def v6(kb: Base) -> DataFrame:
    asked, scopes = _queries(kb)
    return V.knn_rules(asked, kb.vector.filter("kind = 'item'"), scopes, 5).select("query_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query("v8_embed_text", "SELECT id, name || CASE WHEN trim(coalesce(summary, '')) <> '' THEN ': ' || summary ELSE '' END || CASE WHEN trim(coalesce(notes, '')) <> '' THEN chr(10) || notes ELSE '' END || CASE WHEN trim(coalesce(codex_article, '')) <> '' THEN chr(10) || codex_article ELSE '' END AS t FROM entity")
def v8(kb: Base) -> DataFrame:
    return kb.entity.select("id", T.embed_text("entity", F.col("name"), F.col("summary"), F.col("notes"), F.col("codex_article")).alias("t"))


@query("v8_embed_text_rules", "SELECT id, name || ' (' || category || '): ' || body AS t FROM rule")
def v8r(kb: Base) -> DataFrame:
    return kb.rule.select("id", T.embed_text("rule", F.col("name"), F.col("category"), F.col("body")).alias("t"))


@query("v1_embed_documents", r"""
    WITH w AS (SELECT doc_id, unnest(string_split(lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nl}\p{Nd}\p{No}]+', ' ', 'g')), ' ')) AS w FROM documents),
    h AS (SELECT doc_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 256 AS k, count(*) AS c FROM w WHERE w <> '' GROUP BY 1, 2)
    SELECT doc_id, count(*) AS filled, arg_max(k, (c, -k)) AS top, round(max(c) / sqrt(sum(c * c)), 6) AS top_value FROM h GROUP BY doc_id""")
def v1(kb: Base) -> DataFrame:
    made = V.embed_documents(kb.table("documents").select("doc_id", "text"), V.hash_embedder()).filter("embedding is not null")
    top = F.array_max("embedding")
    return made.select("doc_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("filled"), (F.array_position("embedding", top) - 1).cast("long").alias("top"), F.round(top, 6).alias("top_value"))


@query("v9_apply_embeddings", "SELECT item_id AS id, len(embedding) AS width, CASE WHEN vec_id % 3 = 0 THEN 'old' ELSE 'new' END AS embed_model FROM vector")
def v9(kb: Base) -> DataFrame:
    rows = kb.vector.select(F.col("item_id").alias("id"), "vec_id", "embedding", F.lit("old").alias("embed_model"))
    new = rows.select("id", F.when(F.col("vec_id") % 3 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("embedding"))
    return V.apply_embeddings(rows, new, "new").select("id", F.size("embedding").cast("long").alias("width"), "embed_model")


@query("v10_model_mismatch", "SELECT embed_model, count(*) AS n FROM source WHERE embed_model NOT IN ('', 'small') GROUP BY embed_model ORDER BY embed_model")
def v10(kb: Base) -> DataFrame:
    return V.model_mismatch(kb.source, "small")
