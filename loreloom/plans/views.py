"""The knowledge base that the registered queries run on, derived from the given tables.

Each view is SQL that Spark and other engines read alike, so that a query's check starts from the same rows. `array(` is
the one word that differs elsewhere.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Flags and texts that every kind of entity gets, by its number: deleted (null, true, false), stale, article, links.
_COMMON = """
    CASE WHEN {n} % 5 = 0 THEN array({name} || ' of ' || {place}, 'The ' || {name}) WHEN {n} % 5 = 1 THEN array('Old ' || {name}) ELSE array() END AS aliases,
    CASE WHEN {n} % 4 = 0 THEN NULL ELSE 'About ' || {name} END AS summary,
    CASE {n} % 6 WHEN 0 THEN 'Seen near [[' || {link} || ']].' WHEN 1 THEN 'Knows [[' || upper({link}) || ']] and [[The ' || {link} || ']].' WHEN 2 THEN 'Met [[' || {link} || 's]] and [[nobody ' || CAST({n} % 50 AS STRING) || ']].' WHEN 3 THEN '' WHEN 4 THEN 'As [[' || {name} || 'x]].' END AS notes,
    CASE WHEN {n} % 3 = 0 THEN NULL ELSE 'Article on ' || {name} || '. It cites [[' || {link} || ']].' END AS codex_article,
    CASE {n} % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS codex_stale,
    CASE {n} % 7 WHEN 0 THEN true WHEN 1 THEN false END AS vault_deleted
"""


def _common(n: str, name: str, place: str, link: str) -> str:
    return _COMMON.format(n=n, name=name, place=place, link=link)


VIEWS = {
    "campaign": "SELECT 'campaign:' || CAST(r_regionkey AS STRING) AS id, r_name AS name, 'system ' || CAST(r_regionkey % 3 AS STRING) AS system FROM region",
    "collection": "SELECT 'collection:' || CAST(n_nationkey AS STRING) AS id, n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'campaign:' || CAST(n_regionkey AS STRING) END AS owner_campaign FROM nation",
    "subscription": "SELECT 'campaign:' || CAST(n_regionkey AS STRING) AS campaign_id, 'collection:' || CAST(n_nationkey AS STRING) AS collection_id FROM nation",
    "entity": "SELECT 'npc:' || CAST(c_custkey AS STRING) AS id, 'npc' AS kind, c_name AS name, " + _common("c_custkey", "c_name", "lower(c_mktsegment)", "'Supplier#' || lpad(CAST(c_custkey % 97 AS STRING), 9, '0')")
    + ", 'collection:' || CAST(c_nationkey AS STRING) AS collection_id, CASE WHEN c_custkey % 3 = 0 THEN 'campaign:' || CAST(c_custkey % 5 AS STRING) END AS campaign_id FROM customer"
    + " UNION ALL SELECT 'faction:' || CAST(s_suppkey AS STRING), 'faction', s_name, " + _common("s_suppkey", "s_name", "'the coast'", "'Customer#' || lpad(CAST(s_suppkey * 7 AS STRING), 9, '0')")
    + ", CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 'collection:' || CAST(s_nationkey AS STRING) END, CASE WHEN s_suppkey % 11 = 1 THEN 'campaign:1' END FROM supplier"
    + " UNION ALL SELECT 'item:' || CAST(p_partkey AS STRING), 'item', p_name, " + _common("p_partkey", "p_name", "lower(p_type)", "'red widget'")
    + ", 'collection:' || CAST(p_partkey % 25 AS STRING), NULL FROM part",
    "edge": "SELECT l_orderkey * 10 + l_linenumber AS edge_id, 'faction:' || CAST(l_suppkey AS STRING) AS from_id, 'item:' || CAST(l_partkey AS STRING) AS to_id, CASE l_returnflag WHEN 'A' THEN 'mentioned' WHEN 'N' THEN 'related_to' ELSE CASE WHEN l_linenumber % 2 = 0 THEN 'owned_by' ELSE 'owns' END END AS rel_type, CAST(NULL AS STRING) AS notes, CAST(l_shipdate AS TIMESTAMP) AS created_at FROM lineitem",
    "event_entity": "SELECT 'event:' || CAST(o_orderkey AS STRING) AS id, 'event' AS kind, 'Order ' || CAST(o_orderkey AS STRING) AS name, 'campaign:' || CAST(o_custkey % 5 AS STRING) AS campaign_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS sequence_index, o_orderpriority AS era, CASE WHEN o_orderkey % 3 <> 0 THEN 'session:' || CAST(o_custkey % 200 AS STRING) END AS session_id, CASE o_orderkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS vault_deleted FROM orders",
    "session": "SELECT 'session:' || CAST(conv_id AS STRING) AS id, 'campaign:' || CAST(conv_id % 5 AS STRING) AS campaign_id, conv_id + 1 AS session_number, 'Evening ' || CAST(conv_id AS STRING) AS title, CASE WHEN conv_id % 2 = 0 THEN '1 May' END AS date_played, min(text) AS notes, CASE conv_id % 7 WHEN 0 THEN true WHEN 1 THEN false END AS vault_deleted FROM conversations GROUP BY conv_id",
    "message": "SELECT conv_id * 1000 + turn AS id, 'campaign:' || CAST(conv_id % 5 AS STRING) AS campaign_id, conv_id, role, CASE WHEN role = 'assistant' THEN 'See [Source: \"src' || CAST(conv_id % 20 AS STRING) || '.pdf\", p.' || CAST(turn + 1 AS STRING) || '] and ' || text || CASE WHEN turn % 2 = 1 THEN ' [Source: \"src1.pdf\", p.3-4, quote: \"as it is\"] end' ELSE ' [Source: \"src2.pdf\"]' END ELSE text END AS content, conv_id * 1000 + turn AS created_at FROM conversations",
    "source": "SELECT 'source:' || source AS id, source || '.pdf' AS filename, CASE WHEN source LIKE '%3' THEN '' ELSE 'Book ' || source END AS display_name, 'collection:' || CAST(length(source) + min(doc_id) % 7 AS STRING) AS collection_id, CASE CAST(min(doc_id) % 3 AS INT) WHEN 0 THEN 'rules' WHEN 1 THEN 'lore' ELSE 'supplement' END AS source_type, CASE WHEN min(doc_id) % 4 = 0 THEN 'done' ELSE 'pending' END AS index_status, CASE CAST(min(doc_id) % 3 AS INT) WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE '' END AS embed_model, count(*) AS page_count FROM documents WHERE source IS NOT NULL GROUP BY source",
    "chunk": "SELECT 'chunk:' || CAST(doc_id AS STRING) AS chunk_id, 'source:' || source AS source_id, 'collection:' || CAST(doc_id % 25 AS STRING) AS collection_id, doc_id AS place, text, 1 + doc_id % 30 AS page_start, 2 + doc_id % 30 AS page_end, 'Part ' || lang AS section_heading, '' AS source_type FROM documents",
    "rule": "SELECT 'rule:' || CAST(p_partkey AS STRING) AS id, 'collection:' || CAST(p_partkey % 25 AS STRING) AS collection_id, p_name || ' ' || CAST(p_partkey AS STRING) AS name, CASE p_partkey % 3 WHEN 0 THEN 'entry' WHEN 1 THEN 'spell' ELSE 'item' END AS category, 'Rule on ' || p_type || repeat(' and more', CAST(p_size AS INT)) AS body, CASE WHEN p_partkey % 4 = 0 THEN 'We say ' || p_brand END AS notes, 1 + p_partkey % 40 AS page_start, 1 + p_partkey % 40 + p_partkey % 2 AS page_end, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS stale, CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false END AS vault_deleted FROM part",
    "vector": "SELECT 'vec:' || CAST(vec_id AS STRING) AS item_id, vec_id, 'collection:' || CAST(label AS STRING) AS collection_id, CASE WHEN vec_id % 3 = 0 THEN 'npc' ELSE 'item' END AS kind, embedding, CASE vec_id % 7 WHEN 0 THEN true WHEN 1 THEN false END AS vault_deleted FROM embeddings",
    "change": "SELECT event_id, CAST(user_id AS STRING) AS key, ts, CASE event_type WHEN 'error' THEN 'remove' ELSE 'upsert' END AS kind, md5(props) AS hash FROM events",
    "proposal": "SELECT 'proposal:' || CAST(o_orderkey AS STRING) AS id, CASE o_orderkey % 3 WHEN 0 THEN 'entity_note' WHEN 1 THEN 'entity_summary' ELSE 'rule_note' END AS kind, CASE WHEN o_orderkey % 3 = 2 THEN 'rule:' ELSE 'npc:' END || CAST(o_custkey AS STRING) AS target, 'collection:' || CAST(o_custkey % 25 AS STRING) AS collection_id, 'campaign:' || CAST(o_custkey % 5 AS STRING) AS campaign_id, 'Text ' || CAST(o_orderkey AS STRING) AS proposed_text, CAST(NULL AS STRING) AS target_name, CAST(NULL AS STRING) AS entity_kind, CAST(NULL AS STRING) AS category, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'accepted' ELSE 'rejected' END AS status, 'session:' || CAST(o_custkey % 200 AS STRING) AS origin FROM orders",
    "finding": "SELECT 'finding:' || CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'alias_collision' ELSE 'broken_wikilink' END AS kind, 'collection:' || CAST(o_custkey % 25 AS STRING) AS scope_id, 'npc:' || CAST(o_custkey AS STRING) || '|' || CAST(o_orderkey % 9 AS STRING) AS dedup_key, array('npc:' || CAST(o_custkey AS STRING), 'npc:' || CAST(o_custkey + 5 AS STRING)) AS parties, CASE WHEN o_orderkey % 4 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') ELSE 'Old Customer#' || lpad(CAST(o_custkey + 5 AS STRING), 9, '0') END AS detail, o_orderstatus <> 'P' AS resolved FROM orders",
}


def needed(sql: str) -> list[str]:
    """The views that a statement reads."""
    return [name for name in VIEWS if re.search(rf"\b(FROM|JOIN) {name}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    sql = VIEWS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **tables)


def with_views(sql: str) -> str:
    """A statement for other engines, with the views that it uses before it."""
    names = needed(sql)
    body = sql.strip()
    if not names:
        return body.replace("array(", "list_value(")
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    joined = f"WITH RECURSIVE {heads}, {body[5:].strip()}" if body.upper().startswith("WITH ") else f"WITH {heads} {body}"
    return joined.replace("array(", "list_value(")
