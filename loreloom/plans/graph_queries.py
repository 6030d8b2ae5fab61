"""Queries on links, relations, findings, review, context, files, lifecycles and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as T
from loreloom.operators import context as X
from loreloom.operators import findings as L
from loreloom.operators import graph as G
from loreloom.operators import lifecycle as C
from loreloom.operators import names as N
from loreloom.operators import review as R
from loreloom.operators import scopes as S
from loreloom.operators import sync as Y
from loreloom.operators import tables as M
from loreloom.streaming import streams as ST

from .registry import LIVE, STALE, Base, query, sql_key
from .scope_queries import SCOPED
from .text_queries import COLLISIONS, DUPLICATES, near_sql

TIER = "CASE rel_type WHEN 'mentioned' THEN 0 WHEN 'related_to' THEN 1 WHEN 'knows' THEN 1 ELSE 2 END"
LINKS = f"(SELECT id AS from_id, collection_id, trim(unnest(regexp_extract_all(notes, '\\[\\[([^\\[\\]]+)\\]\\]', 1))) AS link FROM entity WHERE {LIVE} AND collection_id IS NOT NULL)"
FORMS = f"(SELECT collection_id, id, 1 AS tier, lower(name) AS form FROM entity WHERE {LIVE} UNION SELECT collection_id, id, 2, lower(unnest(aliases)) FROM entity WHERE {LIVE} UNION SELECT collection_id, id, 3, {sql_key('n')} FROM (SELECT collection_id, id, unnest(list_concat([name], aliases)) AS n FROM entity WHERE {LIVE}))"
RESOLVED = f"(SELECT q.collection_id, q.link, arg_min(f.id, (f.tier, f.id)) AS entity_id FROM (SELECT DISTINCT collection_id, link FROM {LINKS}) q LEFT JOIN {FORMS} f ON f.collection_id = q.collection_id AND f.form <> '' AND ((f.tier < 3 AND f.form = lower(q.link)) OR (f.tier = 3 AND f.form = {sql_key('q.link')})) GROUP BY q.collection_id, q.link)"


def _own(kb: Base) -> DataFrame:
    return S.live(kb.entity).filter("collection_id is not null")


def _links(kb: Base) -> DataFrame:
    own = _own(kb).withColumn("_k", F.struct("collection_id", "id"))
    return G.extract_links(own, "_k", "notes").select("_k.collection_id", F.col("_k.id").alias("from_id"), "place", "link")


@query("g1_extract_links", f"SELECT from_id, link FROM {LINKS}")
def g1(kb: Base) -> DataFrame:
    return _links(kb).select("from_id", "link")


@query("g2_resolve_links", f"SELECT l.from_id, l.link, r.entity_id FROM {LINKS} l JOIN {RESOLVED} r ON r.collection_id = l.collection_id AND r.link = l.link")
def g2(kb: Base) -> DataFrame:
    return G.resolve_links(_links(kb), _own(kb), "collection_id").select("from_id", "link", "entity_id")


OWN_KEYS = f"SELECT collection_id, id, {sql_key('name')} AS k FROM entity WHERE {LIVE} AND collection_id IS NOT NULL"
#: CTEs up to fuzzy (collection_id, link, entity_id): open links that exactly one name is near enough to.
FUZZY_SQL = f"""
    open AS (SELECT collection_id, link, {sql_key('link')} AS k FROM {RESOLVED} WHERE entity_id IS NULL), {near_sql("SELECT collection_id, k FROM open", OWN_KEYS)},
    found AS (SELECT o.collection_id, o.link, o.k, min(e.id) AS entity_id FROM open o JOIN near n ON n.collection_id = o.collection_id AND n.a = o.k AND n.s >= 0.9 - 1e-12 JOIN ({OWN_KEYS}) e ON e.collection_id = n.collection_id AND e.k = n.b GROUP BY o.collection_id, o.link, o.k HAVING count(*) = 1),
    fuzzy AS (SELECT * FROM found f WHERE (SELECT count(DISTINCT entity_id) FROM found g WHERE g.collection_id = f.collection_id AND g.k = f.k) = 1)"""


@query("g3_fuzzy_resolve", f"WITH {FUZZY_SQL} SELECT collection_id, entity_id, min(link) AS alias FROM fuzzy GROUP BY collection_id, entity_id, k")
def g3(kb: Base) -> DataFrame:
    open_ = G.resolve_links(_links(kb), _own(kb), "collection_id").filter("entity_id is null").select("collection_id", "link").distinct()
    return G.fuzzy_resolve(open_, _own(kb), "collection_id")[1]  # names with a letter too many


PAIRS = "least(from_id, to_id) AS lo, greatest(from_id, to_id) AS hi"


@query("g4_sync_mentions", f"""
    WITH kept AS (SELECT from_id, to_id, rel_type, {PAIRS} FROM edge WHERE NOT (rel_type = 'mentioned' AND from_id IN (SELECT id FROM entity WHERE {LIVE}))),
    new AS (SELECT DISTINCT l.from_id, r.entity_id AS to_id, least(l.from_id, r.entity_id) AS lo, greatest(l.from_id, r.entity_id) AS hi FROM {LINKS} l JOIN {RESOLVED} r ON r.collection_id = l.collection_id AND r.link = l.link WHERE r.entity_id <> l.from_id)
    SELECT from_id, to_id, rel_type FROM kept UNION ALL SELECT from_id, to_id, 'mentioned' FROM new n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.lo = n.lo AND k.hi = n.hi AND k.rel_type <> 'mentioned')""")
def g4(kb: Base) -> DataFrame:
    found = G.resolve_links(_links(kb), _own(kb), "collection_id").filter("entity_id is not null")
    return G.sync_mentions(kb.edge, found.select("from_id", F.col("entity_id").alias("to_id")), S.live(kb.entity)).select("from_id", "to_id", "rel_type")


@query("g5_forward_refs", f"SELECT DISTINCT l.from_id, e.id AS to_id FROM {LINKS} l JOIN entity e ON e.collection_id = l.collection_id AND lower(e.name) = lower(l.link) AND e.{LIVE} WHERE e.id <> l.from_id AND e.kind = 'item'")
def g5(kb: Base) -> DataFrame:
    return G.link_forward_refs(_own(kb).filter("kind = 'item'"), _own(kb), "collection_id")


@query("g6_resync_wikilinks", f"""
    WITH {FUZZY_SQL}, kept AS (SELECT from_id, to_id, rel_type, {PAIRS} FROM edge WHERE NOT (rel_type = 'mentioned' AND from_id IN (SELECT id FROM entity WHERE {LIVE} AND coalesce(collection_id, campaign_id) IS NOT NULL))),
    told AS (SELECT collection_id, link, entity_id FROM {RESOLVED} WHERE entity_id IS NOT NULL UNION ALL SELECT collection_id, link, entity_id FROM fuzzy),
    new AS (SELECT DISTINCT l.from_id, r.entity_id AS to_id, least(l.from_id, r.entity_id) AS lo, greatest(l.from_id, r.entity_id) AS hi FROM {LINKS} l JOIN told r ON r.collection_id = l.collection_id AND r.link = l.link WHERE r.entity_id <> l.from_id)
    SELECT from_id, rel_type, count(*) AS n FROM (SELECT from_id, to_id, rel_type FROM kept UNION ALL SELECT from_id, to_id, 'mentioned' FROM new n WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.lo = n.lo AND k.hi = n.hi AND k.rel_type <> 'mentioned')) GROUP BY from_id, rel_type""")
def g6(kb: Base) -> DataFrame:
    return G.resync_wikilinks(kb.entity, kb.edge)[0].groupBy("from_id", "rel_type").agg(F.count("*").alias("n"))


@query("g7_upsert_edges", "SELECT from_id, to_id, rel_type, count(DISTINCT from_id) AS n FROM edge GROUP BY from_id, to_id, rel_type")
def g7(kb: Base) -> DataFrame:
    return G.upsert_edges(kb.edge, kb.edge).groupBy("from_id", "to_id", "rel_type").agg(F.count("*").alias("n"))


COLLAPSED = f"SELECT DISTINCT from_id, to_id, rel_type FROM (SELECT *, {TIER} AS t, max({TIER}) OVER (PARTITION BY least(from_id, to_id), greatest(from_id, to_id)) AS m FROM edge) WHERE t = m"


@query("w1_collapse_edges", COLLAPSED)
def w1(kb: Base) -> DataFrame:
    return G.collapse_edges(kb.edge).select("from_id", "to_id", "rel_type")


@query("g8_relate_collapsing", COLLAPSED)
def g8(kb: Base) -> DataFrame:
    return G.relate_collapsing(kb.edge, kb.edge).select("from_id", "to_id", "rel_type")


@query("g9_canonical_relations", "SELECT edge_id, CASE WHEN rel_type = 'owned_by' THEN to_id ELSE from_id END AS from_id, CASE WHEN rel_type = 'owned_by' THEN from_id ELSE to_id END AS to_id, CASE WHEN rel_type = 'owned_by' THEN 'owns' ELSE rel_type END AS rel_type FROM edge")
def g9(kb: Base) -> DataFrame:
    return G.canonical_relations(kb.edge).select("edge_id", "from_id", "to_id", "rel_type")


RELATIONS = f"""
    WITH b AS (SELECT from_id AS id, to_id AS other_id, rel_type, 'out' AS direction FROM edge UNION ALL SELECT to_id, from_id, rel_type, 'in' FROM edge),
    n AS (SELECT b.*, e.name, {TIER} AS t, max({TIER}) OVER (PARTITION BY b.id, b.other_id) AS m FROM b JOIN entity e ON e.id = b.other_id AND e.{LIVE} WHERE b.id <> b.other_id AND b.id IN (SELECT id FROM entity WHERE kind = 'faction'))
    SELECT DISTINCT id, other_id, name, rel_type, direction FROM n WHERE t = m"""


@query("g10_entity_relations", RELATIONS)
def g10(kb: Base) -> DataFrame:
    return G.entity_relations(kb.entity.filter("kind = 'faction'"), kb.edge, kb.entity)


@query("g11_ego_graph", RELATIONS.replace("SELECT DISTINCT id, other_id, name, rel_type, direction FROM n WHERE t = m", "SELECT DISTINCT id AS centre, CASE direction WHEN 'out' THEN id ELSE other_id END AS from_id, CASE direction WHEN 'out' THEN other_id ELSE id END AS to_id, rel_type FROM n WHERE t = m"))
def g11(kb: Base) -> DataFrame:
    return G.ego_graph(kb.entity.filter("kind = 'faction'"), kb.edge, kb.entity)[1]


@query("g12_missing_links", f"SELECT r.collection_id, 'missing:' || {sql_key('r.link')} AS id, min(r.link) AS name FROM {RESOLVED} r WHERE r.entity_id IS NULL GROUP BY 1, 2")
def g12(kb: Base) -> DataFrame:
    found = G.resolve_links(_links(kb), _own(kb), "collection_id")
    return G.missing_link_nodes(found, "collection_id")[0].select("collection_id", "id", "name")


@query("g13_delete_edges", "SELECT edge_id FROM edge WHERE edge_id NOT IN (SELECT edge_id FROM edge WHERE rel_type = 'mentioned')")
def g13(kb: Base) -> DataFrame:
    return G.delete_edges(kb.edge, kb.edge.filter("rel_type = 'mentioned'")).select("edge_id")


@query("g14_link_dictionary", f"SELECT form, min(id) AS id FROM (SELECT id, lower(n) AS form FROM (SELECT id, unnest(list_concat([name], aliases)) AS n FROM entity WHERE {LIVE}) UNION ALL SELECT id, {sql_key('n')} FROM (SELECT id, unnest(list_concat([name], aliases)) AS n FROM entity WHERE {LIVE})) WHERE form <> '' GROUP BY form HAVING count(DISTINCT id) = 1")
def g14(kb: Base) -> DataFrame:
    return G.link_dictionary(kb.entity)


@query("u2_merge_graphs", "SELECT id, kind FROM entity UNION SELECT id, kind FROM event_entity")
def u2(kb: Base) -> DataFrame:
    nodes = kb.entity.select("id", "kind"), kb.entity.select("id", "kind").union(kb.event_entity.select("id", "kind"))
    return G.merge_graphs(nodes, (kb.edge, kb.edge))[0]


@query("u3_array_union", "SELECT collection_id, array_to_string(list_sort(list_distinct(flatten(list(aliases)))), '|') AS aliases FROM entity GROUP BY collection_id")
def u3(kb: Base) -> DataFrame:
    return kb.entity.groupBy("collection_id").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("aliases")))), "|").alias("aliases"))


BROKEN = f"SELECT DISTINCT l.collection_id, l.from_id AS entity_id, lower(l.link) AS link FROM (SELECT id AS from_id, collection_id, trim(unnest(regexp_extract_all(concat_ws(chr(10), notes, codex_article), '\\[\\[([^\\[\\]]+)\\]\\]', 1))) AS link FROM entity WHERE {LIVE} AND collection_id IS NOT NULL) l WHERE NOT EXISTS (SELECT 1 FROM {FORMS} f WHERE f.collection_id = l.collection_id AND ((f.tier < 3 AND f.form = lower(l.link)) OR (f.tier = 3 AND f.form = {sql_key('l.link')})))"


@query("l1_broken_wikilinks", BROKEN)
def l1(kb: Base) -> DataFrame:
    return L.broken_wikilinks(kb.entity, suggest=False).select("collection_id", "entity_id", F.lower("link").alias("link"))


@query("l1_suggestions", f"""
    WITH broken AS ({BROKEN}), {near_sql(f"SELECT collection_id, {sql_key('link')} AS k FROM broken", OWN_KEYS)}
    SELECT b.collection_id, b.entity_id, b.link, CAST(count(e.id) AS INT) AS n FROM broken b LEFT JOIN near n ON n.collection_id = b.collection_id AND n.a = {sql_key('b.link')} AND n.s >= 0.72 - 1e-12 LEFT JOIN ({OWN_KEYS}) e ON e.collection_id = n.collection_id AND e.k = n.b GROUP BY b.collection_id, b.entity_id, b.link""")
def l1s(kb: Base) -> DataFrame:
    return L.broken_wikilinks(kb.entity).select("collection_id", "entity_id", F.lower("link").alias("link"), F.col("n").cast("int").alias("n"))


@query("l2_stale_articles", f"SELECT collection_id, id, name FROM entity WHERE {LIVE} AND {STALE}")
def l2(kb: Base) -> DataFrame:
    return L.stale_articles(kb.entity)


@query("l3_scope_violations", f"SELECT e.collection_id, s.edge_id, s.from_id, s.to_id FROM ({SCOPED}) s JOIN entity e ON e.id = s.from_id WHERE NOT s.allowed")
def l3(kb: Base) -> DataFrame:
    return L.scope_violations(kb.edge, kb.entity, kb.collection, kb.subscription)


def _lint(kb: Base) -> DataFrame:
    return L.lint(kb.entity, kb.edge, kb.collection, kb.subscription)


def _lint_sql() -> str:
    """Each kind of finding counted from the statement that checks it on its own."""
    counted = {"broken_wikilink": BROKEN, "stale_article": f"SELECT collection_id FROM entity WHERE {LIVE} AND {STALE}", "scope_violation": f"SELECT e.collection_id FROM ({SCOPED}) s JOIN entity e ON e.id = s.from_id WHERE NOT s.allowed", "duplicate_entity": DUPLICATES, "alias_collision": COLLISIONS}
    return " UNION ALL ".join(f"SELECT '{kind}' AS kind, collection_id AS scope_id, count(*) AS n FROM ({sql}) WHERE collection_id IS NOT NULL GROUP BY collection_id" for kind, sql in counted.items())


@query("l6_lint", _lint_sql())
def l6(kb: Base) -> DataFrame:
    return _lint(kb).groupBy("kind", "scope_id").agg(F.count("*").alias("n"))


#: Each entity once for every campaign that sees it, with that campaign in place of its collection.
_SEEN = f"seen_entity AS (SELECT e.id, e.kind, e.name, e.aliases, e.notes, e.codex_article, e.codex_stale, e.vault_deleted, s.campaign_id AS collection_id FROM entity e JOIN subscription s ON s.collection_id = e.collection_id WHERE e.{LIVE} UNION SELECT id, kind, name, aliases, notes, codex_article, codex_stale, vault_deleted, campaign_id FROM entity WHERE campaign_id IS NOT NULL AND {LIVE})"


@query("l6_lint_campaigns", f"WITH {_SEEN} " + _lint_sql().replace(f"({SCOPED})", "(@)").replace("FROM entity", "FROM seen_entity").replace("JOIN entity", "JOIN seen_entity").replace("(@)", f"({SCOPED})"))
def l6c(kb: Base) -> DataFrame:
    found = L.lint_campaigns(kb.entity, kb.edge, kb.collection, kb.subscription)
    return found.groupBy("kind", "scope_id").agg(F.count("*").alias("n"))


@query("l5_record_findings", "SELECT id, kind, dedup_key, resolved FROM finding")
def l5(kb: Base) -> DataFrame:
    """Findings that are open already are not recorded again."""
    found = kb.finding.withColumn("similarity", F.lit(None).cast("double"))
    return L.record_findings(found, found.filter("not resolved").select(L.COLUMNS)).select("id", "kind", "dedup_key", "resolved")


@query("l7_enrich_findings", f"SELECT p.id, p.place, p.party, coalesce(e.name, p.party) AS name, coalesce(lower(e.name) = lower(p.detail), false) AS is_name FROM (SELECT id, detail, unnest(parties) AS party, unnest(range(len(parties))) AS place FROM finding) p LEFT JOIN entity e ON e.id = p.party AND e.{LIVE}")
def l7(kb: Base) -> DataFrame:
    return L.enrich_findings(kb.finding, kb.entity).select("id", F.col("place").cast("long").alias("place"), "party", "name", "is_name")


def _decisions(kb: Base) -> DataFrame:
    return kb.finding.select(F.col("id").alias("finding_id"), F.element_at("parties", 1).alias("keep"), F.element_at("parties", 2).alias("drop"))


@query("l8_resolve_collisions", f"""
    WITH d AS (SELECT f.*, f.parties[1] AS k, f.parties[2] AS l, a.id AS kept, b.id AS dropped, {sql_key('f.detail')} AS dk, {sql_key('b.name')} AS bk, list_transform(b.aliases, lambda x: {sql_key('x')}) AS ks FROM finding f LEFT JOIN entity a ON a.id = f.parties[1] AND a.{LIVE} LEFT JOIN entity b ON b.id = f.parties[2] AND b.{LIVE})
    SELECT id AS finding_id, CASE WHEN kind <> 'alias_collision' OR resolved THEN 'no such finding' WHEN kept IS NULL THEN 'keep not found' WHEN dropped IS NULL THEN 'drop not found' WHEN bk = dk THEN 'primary name' ELSE 'no such alias' END AS reason
    FROM d WHERE kind <> 'alias_collision' OR resolved OR kept IS NULL OR dropped IS NULL OR bk = dk OR NOT list_contains(ks, dk)""")
def l8(kb: Base) -> DataFrame:
    return L.resolve_collisions(kb.finding, _decisions(kb), kb.entity)[1]


@query("l9_resolve_findings", "SELECT id, resolved OR kind = 'broken_wikilink' AS resolved FROM finding")
def l9(kb: Base) -> DataFrame:
    return L.resolve_findings(kb.finding, kb.finding.filter("kind = 'broken_wikilink'")).select("id", "resolved")


@query("l10_orphaned_edges", "SELECT DISTINCT d.edge_id, d.from_id, d.to_id FROM edge d JOIN entity a ON a.id = d.from_id JOIN entity b ON b.id = d.to_id WHERE (a.collection_id IN (SELECT id FROM collection WHERE owner_campaign IS NOT NULL) AND b.campaign_id IS NOT NULL) OR (b.collection_id IN (SELECT id FROM collection WHERE owner_campaign IS NOT NULL) AND a.campaign_id IS NOT NULL)")
def l10(kb: Base) -> DataFrame:
    return L.orphaned_edges(kb.edge, kb.entity, kb.collection.filter("owner_campaign is not null"))


MERGES = f"(SELECT l.id AS loser, s.id AS survivor, l.name AS lost_name, l.aliases AS lost_aliases, l.summary AS lost_summary, l.notes AS lost_notes FROM entity l JOIN entity s ON l.kind = 'npc' AND CAST(split_part(l.id, ':', 2) AS INT) % 10 = 3 AND s.id = 'npc:' || CAST(CAST(split_part(l.id, ':', 2) AS INT) - 1 AS STRING) WHERE l.{LIVE} AND s.{LIVE})"
_BOTH = "CASE WHEN trim(coalesce(e.{c}, '')) = '' THEN CASE WHEN trim(coalesce(m.lost_{c}, '')) <> '' THEN m.lost_{c} END ELSE e.{c} || CASE WHEN trim(coalesce(m.lost_{c}, '')) <> '' THEN repeat(chr(10), 2) || '## ' || m.lost_name || repeat(chr(10), 2) || m.lost_{c} ELSE '' END END"


def _merged(kb: Base) -> dict[str, DataFrame]:
    """Every customer whose number ends in 3 is merged into the one before."""
    merges = kb.table("customer").filter("c_custkey % 10 = 3").select(F.concat(F.lit("npc:"), F.col("c_custkey").cast("string")).alias("loser"), F.concat(F.lit("npc:"), (F.col("c_custkey") - 1).cast("string")).alias("survivor"))
    _checkpointed(kb)
    return N.merge_entities(kb.entity, kb.edge, kb.finding, merges, kb.collection, kb.subscription)


@query("n7_merge_entities", f"""
    SELECT e.id, coalesce(d.loser IS NOT NULL, false) OR e.vault_deleted IS TRUE AS deleted, CASE WHEN m.loser IS NOT NULL THEN true ELSE e.codex_stale END AS codex_stale,
        array_to_string(list_sort(list_filter(list_distinct(list_concat(e.aliases, CASE WHEN m.loser IS NOT NULL THEN list_concat([m.lost_name], m.lost_aliases) ELSE list_filter(e.aliases, lambda x: false) END)), lambda x: m.loser IS NULL OR x <> e.name)), '|') AS aliases,
        CASE WHEN m.loser IS NOT NULL THEN {_BOTH.format(c='summary')} ELSE e.summary END AS summary, CASE WHEN m.loser IS NOT NULL THEN {_BOTH.format(c='notes')} ELSE e.notes END AS notes
    FROM entity e LEFT JOIN {MERGES} m ON m.survivor = e.id LEFT JOIN {MERGES} d ON d.loser = e.id""")
def n7(kb: Base) -> DataFrame:
    return _merged(kb)["entities"].select("id", F.col("vault_deleted").eqNullSafe(True).alias("deleted"), "codex_stale", F.array_join(F.sort_array("aliases"), "|").alias("aliases"), "summary", "notes")


@query("n7_merged_findings", f"SELECT f.id, f.resolved OR EXISTS (SELECT 1 FROM {MERGES} m WHERE list_contains(f.parties, m.loser)) AS resolved FROM finding f")
def n7f(kb: Base) -> DataFrame:
    return _merged(kb)["findings"].select("id", "resolved")


@query("n7_rejected_merges", f"SELECT 'npc:' || CAST(c_custkey AS STRING) AS loser, 'npc:' || CAST(c_custkey - 1 AS STRING) AS survivor, 'not found' AS reason FROM customer WHERE c_custkey % 10 = 3 AND 'npc:' || CAST(c_custkey AS STRING) NOT IN (SELECT loser FROM {MERGES})")
def n7r(kb: Base) -> DataFrame:
    return _merged(kb)["rejected"]


def _checkpointed(kb: Base) -> None:
    """Sets a checkpoint folder where the session has none; only a single machine gets a temporary one."""
    sc = kb.spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def _stored(kb: Base, df: DataFrame) -> DataFrame:
    """df as a table in the shared folder."""
    _checkpointed(kb)
    path = f"{kb.spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return kb.spark.read.schema(df.schema).parquet(path)


def _hits(kb: Base) -> DataFrame:
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("collection_id").orderBy("id"))
    return S.live(kb.rules).select(F.col("collection_id").alias("query_id"), "id", "name", "category", "body", "notes", "page_refs", rank.alias("rank"))


RULES_SQL = r"""
    h AS (SELECT collection_id AS query_id, id, '[' || category || '] ' || name || ' — Book ' || split_part(collection_id, ':', 2) || ' p.' || page_start || CASE WHEN page_start = page_end THEN '' ELSE '-' || page_end END || chr(10) || CASE WHEN length(body) > 1200 THEN left(body, 1200) || '…' ELSE body END || chr(10) || CASE WHEN trim(coalesce(notes, '')) <> '' THEN 'GM table ruling: ' || trim(notes) || chr(10) ELSE '' END || chr(10) AS entry,
        row_number() OVER (PARTITION BY collection_id ORDER BY id) AS rank FROM rule WHERE vault_deleted IS DISTINCT FROM true),
    u AS (SELECT *, 49 + sum(length(entry)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM h),
    ruled AS (SELECT query_id, 'COMPILED RULES (distilled from your rulebooks):' || chr(10) || chr(10) || string_agg(entry, '' ORDER BY rank) AS rules_context FROM u WHERE used <= 4000 GROUP BY query_id)"""


@query("w7_rules_block", f"WITH {RULES_SQL} SELECT query_id, md5(rules_context) AS digest FROM ruled")
def w7(kb: Base) -> DataFrame:
    return X.rules_block(_hits(kb)).select("query_id", F.md5("rules_context").alias("digest"))


@query("r2_entity_context", f"""
    WITH kinds AS (SELECT unnest(['player_character', 'npc', 'location', 'faction', 'creature', 'item', 'event', 'misc']) AS kind, unnest(range(1, 9)) AS place),
    cut AS (SELECT *, trim(regexp_replace(coalesce(codex_article, ''), '\\s+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(notes, ''), '\\s+', ' ', 'g')) AS t FROM entity WHERE {LIVE}),
    told AS (SELECT *, '[' || kind || '] ' || name || CASE WHEN a <> '' THEN ' · Codex: ' || CASE WHEN length(a) <= 600 THEN a ELSE left(a, 600) || '…' END WHEN trim(coalesce(summary, '')) <> '' THEN ' · ' || summary ELSE '' END || CASE WHEN t <> '' THEN ' · Notes: ' || CASE WHEN length(t) <= 280 THEN t ELSE left(t, 280) || '…' END ELSE '' END AS line FROM cut),
    own AS (SELECT campaign_id AS query_id, k.place AS section, string_agg(line, chr(10) ORDER BY name, id) AS lines FROM told JOIN kinds k ON k.kind = told.kind WHERE campaign_id IS NOT NULL GROUP BY 1, 2),
    evenings AS (SELECT campaign_id AS query_id, 20 AS section, string_agg('[session ' || session_number || '] ' || title || coalesce(' · ' || date_played, '') || CASE WHEN n <> '' THEN ' · Notes: ' || CASE WHEN length(n) <= 280 THEN n ELSE left(n, 280) || '…' END ELSE '' END, chr(10) ORDER BY session_number, title, id) AS lines FROM (SELECT *, trim(regexp_replace(coalesce(notes, ''), '\\s+', ' ', 'g')) AS n FROM session WHERE {LIVE}) GROUP BY 1),
    near AS (SELECT s.campaign_id AS query_id, 30 AS section, string_agg(line, chr(10) ORDER BY k.place * 1000 + CAST('0x' || substr(md5(told.id), 1, 4) AS BIGINT) % 1000, told.id) AS lines FROM told JOIN subscription s ON s.collection_id = told.collection_id JOIN kinds k ON k.kind = told.kind GROUP BY 1),
    shown AS (SELECT query_id, section, chr(10) || CASE WHEN section = 30 THEN 'Collection knowledge (from subscribed rulebooks):' || chr(10) ELSE '' END || lines || chr(10) AS shown FROM (SELECT * FROM own UNION ALL SELECT * FROM evenings UNION ALL SELECT * FROM near))
    SELECT query_id, md5('Campaign notes (your GM records):' || chr(10) || string_agg(shown, '' ORDER BY section)) AS digest, CAST(length('Campaign notes (your GM records):') + 1 + sum(length(shown)) AS BIGINT) AS n FROM shown GROUP BY query_id""")
def r2(kb: Base) -> DataFrame:
    own = S.live(kb.entity).filter("campaign_id is not null").withColumnRenamed("campaign_id", "query_id")
    hits = S.live(kb.entity).join(kb.subscription.withColumnRenamed("campaign_id", "query_id"), "collection_id").drop("campaign_id").withColumn("rank", F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("long") % 1000)
    told = S.live(kb.session).withColumnRenamed("campaign_id", "query_id")
    return X.entity_context(own, told, hits).select("query_id", F.md5("entity_context").alias("digest"), F.length("entity_context").cast("long").alias("n"))


PASSAGES_SQL = """SELECT query_id, 'Relevant source material:' || chr(10) || chr(10) || string_agg('[' || r || '] Source: "' || source_name || '", p. ' || page_start || '-' || page_end || ' — "' || section_heading || '"' || chr(10) || text || chr(10) || chr(10), '' ORDER BY r) AS rag_context FROM (
    SELECT c.collection_id AS query_id, row_number() OVER (PARTITION BY c.collection_id ORDER BY place) - 1 AS r, coalesce(CASE WHEN trim(s.display_name) <> '' THEN s.display_name END, s.filename, c.source_id) AS source_name, page_start, page_end, section_heading, text FROM chunk c LEFT JOIN source s ON s.id = c.source_id) WHERE r < 15 GROUP BY query_id"""


def _first_passages(kb: Base) -> DataFrame:
    """The passages context of each collection's first passages, as many as a question gets."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("collection_id").orderBy("place"))
    first = kb.chunk.withColumn("rank", rank).filter(F.col("rank") <= 15)
    return X.passage_context(S.with_source(first, kb.source).withColumn("query_id", F.col("collection_id")))


@query("r3_passage_context", f"SELECT query_id, md5(rag_context) AS digest FROM ({PASSAGES_SQL})")
def r3(kb: Base) -> DataFrame:
    return _first_passages(kb).select("query_id", F.md5("rag_context").alias("digest"))


@query("r4_prompts", f"""
    WITH p AS ({PASSAGES_SQL}), {RULES_SQL}
    SELECT c.id AS query_id, md5('You are an expert Game Master assistant.' || chr(10) || chr(10) || coalesce(r.rules_context || chr(10), '') || coalesce('REFERENCE MATERIAL:' || chr(10) || p.rag_context || chr(10), '')
        || 'INSTRUCTIONS:' || chr(10) || '- Respond in German.' || chr(10) || '- Read every passage above.' || chr(10)) AS digest
    FROM collection c LEFT JOIN ruled r ON r.query_id = c.id LEFT JOIN p ON p.query_id = c.id""")
def r4(kb: Base) -> DataFrame:
    rules = X.rules_block(_hits(kb))
    asked = kb.collection.select(F.col("id").alias("query_id"), F.lit("de").alias("language")).join(rules, "query_id", "left").join(_first_passages(kb), "query_id", "left").withColumn("entity_context", F.lit(""))
    return X.assemble_prompts(asked, {"all": "- Read every passage above.\n"}).select("query_id", F.md5("prompt").alias("digest"))


CITED = r"""SELECT id, i AS place, m, regexp_extract(m, '\[Source:\s*"([^"]+)"', 1) AS source_name, TRY_CAST(regexp_extract(m, ',\s*p\.\s*(\d+)', 1) AS BIGINT) AS page FROM (SELECT id, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (SELECT id, regexp_extract_all(content, '\[Source:\s*"[^"]+"[^\]]*\]') AS ms FROM message))"""


@query("r6_parse_citations", f"SELECT id, place, source_name, page FROM ({CITED})")
def r6(kb: Base) -> DataFrame:
    return X.parse_citations(kb.message).select("id", F.col("place").cast("long").alias("place"), "source_name", "page")


@query("r7_attach_citations", "SELECT m.id, CASE WHEN role = 'assistant' THEN len(regexp_extract_all(content, '\\[Source:\\s*\"[^\"]+\"[^\\]]*\\]')) ELSE 0 END AS n FROM message m")
def r7(kb: Base) -> DataFrame:
    return X.attach_citations(kb.message).select("id", F.size("citations").cast("long").alias("n"))


BATCHED = """
    p AS (SELECT collection_id, place, text, strlen(text) AS b, row_number() OVER (PARTITION BY collection_id ORDER BY place) AS i FROM passage),
    w AS (SELECT collection_id, i, 0 AS batch, b AS used FROM p WHERE i = 1 UNION ALL
        SELECT p.collection_id, p.i, CASE WHEN w.used > 0 AND w.used + 2 + p.b > 16000 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.used > 0 AND w.used + 2 + p.b <= 16000 THEN w.used + 2 + p.b ELSE p.b END FROM w JOIN p ON p.collection_id = w.collection_id AND p.i = w.i + 1)"""


@query("x1_extraction_requests", f"WITH passage AS (SELECT collection_id, place, text FROM chunk), {BATCHED} SELECT p.collection_id, w.batch, md5('Extract.' || chr(10) || string_agg(p.text, repeat(chr(10), 2) ORDER BY p.place)) AS digest FROM p JOIN w ON w.collection_id = p.collection_id AND w.i = p.i GROUP BY p.collection_id, w.batch")
def x1(kb: Base) -> DataFrame:
    return R.extraction_requests(kb.chunk, "Extract.\n").select("collection_id", "batch", F.md5("prompt").alias("digest"))


def _responses(kb: Base) -> DataFrame:
    """Responses as a model might give them, one a part: fenced, malformed and plain."""
    parts = kb.table("part")
    entity = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 == 0, "spirit").otherwise("item").alias("kind"), F.col("p_brand").alias("summary"), F.concat(F.lit("Made of "), "p_type").alias("notes"), F.array(F.struct(F.concat(F.lit("Maker "), F.col("p_size").cast("string")).alias("name"), F.lit("faction").alias("kind"), F.lit("owned_by").alias("rel_type"), F.lit(None).cast("string").alias("summary"), F.lit("by hand").alias("notes"))).alias("relations"))
    body = F.to_json(F.struct(F.array(entity).alias("entities")))
    raw = F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("p_partkey") % 7 == 1, F.left(body, F.lit(40))).otherwise(body)
    return parts.select(F.concat(F.lit("collection:"), (F.col("p_partkey") % 25).cast("string")).alias("collection_id"), F.col("p_partkey").cast("int").alias("batch"), raw.alias("response"))


@query("x3_parse_extraction", "SELECT 'collection:' || CAST(p_partkey % 25 AS STRING) AS collection_id, CAST(p_partkey AS INT) AS batch, p_name AS name, CASE WHEN p_size % 5 = 0 THEN 'misc' ELSE 'item' END AS kind FROM part WHERE p_partkey % 7 <> 1")
def x3(kb: Base) -> DataFrame:
    return R.parse_extraction(_responses(kb)).select("collection_id", "batch", "name", "kind")


@query("x4_persist_extraction", f"""
    WITH r AS (SELECT 'collection:' || CAST(p_partkey % 25 AS STRING) AS c, CASE WHEN p_size % 5 = 0 THEN 'misc' ELSE 'item' END AS kind, lower(p_name) AS f FROM part WHERE p_partkey % 7 <> 1
        UNION SELECT 'collection:' || CAST(p_partkey % 25 AS STRING), 'faction', 'maker ' || CAST(p_size AS STRING) FROM part WHERE p_partkey % 7 <> 1)
    SELECT DISTINCT kind, c AS collection_id, f AS folded FROM r WHERE NOT EXISTS (SELECT 1 FROM entity e WHERE e.collection_id = r.c AND e.kind = r.kind AND lower(e.name) = r.f AND e.{LIVE})""")
def x4(kb: Base) -> DataFrame:
    return R.persist_extraction(R.parse_extraction(_responses(kb)), kb.entity, kb.edge, kb.collection, kb.subscription)["created"].select("kind", "collection_id", F.lower("name").alias("folded"))


#: Names that the responses tell of, by collection, kind and folded name, and the ids that they have or get.
TOLD_SQL = f"""
    r AS (SELECT 'collection:' || CAST(p_partkey % 25 AS STRING) AS c, CASE WHEN p_size % 5 = 0 THEN 'misc' ELSE 'item' END AS kind, lower(p_name) AS f, 'maker ' || CAST(p_size AS STRING) AS maker FROM part WHERE p_partkey % 7 <> 1),
    have AS (SELECT collection_id, kind, lower(name) AS f, min(id) AS id FROM entity WHERE {LIVE} GROUP BY 1, 2, 3),
    ids AS (SELECT n.c, n.kind, n.f, h.id AS old, coalesce(h.id, n.kind || ':' || md5(n.c || '|' || n.kind || '|' || n.f)) AS id FROM (SELECT c, kind, f FROM r UNION SELECT c, 'faction', maker FROM r) n LEFT JOIN have h ON h.collection_id = n.c AND h.kind = n.kind AND h.f = n.f)"""


def _persisted(kb: Base) -> dict[str, DataFrame]:
    return R.persist_extraction(R.parse_extraction(_responses(kb)), kb.entity, kb.edge, kb.collection, kb.subscription)


@query("x4_touched", f"WITH {TOLD_SQL} SELECT DISTINCT old AS id FROM ids WHERE old IS NOT NULL")
def x4t(kb: Base) -> DataFrame:
    return _persisted(kb)["touched"]


@query("x4_edges", f"WITH {TOLD_SQL} SELECT DISTINCT m.id AS from_id, i.id AS to_id, 'owns' AS rel_type, 'by hand' AS notes FROM r JOIN ids m ON m.c = r.c AND m.kind = 'faction' AND m.f = r.maker JOIN ids i ON i.c = r.c AND i.kind = r.kind AND i.f = r.f")
def x4e(kb: Base) -> DataFrame:
    """The edges that the responses add: all that have their note."""
    return _persisted(kb)["edges"].filter("notes = 'by hand'").select("from_id", "to_id", "rel_type", "notes")


@query("x6_compile_targets", f"SELECT collection_id, id FROM (SELECT collection_id, id, row_number() OVER (PARTITION BY collection_id ORDER BY kind, name, id) AS n FROM entity WHERE {LIVE} AND {STALE} AND collection_id IS NOT NULL) WHERE n <= 50")
def x6(kb: Base) -> DataFrame:
    return R.compile_targets(kb.entity)[0].select("collection_id", "id")


@query("x10_upsert_rules", "SELECT collection_id, count(DISTINCT CASE WHEN CAST(split_part(id, ':', 2) AS INT) % 5 <> 0 THEN split_part(name, ' ', 1) END) AS created, count(*) FILTER (CAST(split_part(id, ':', 2) AS INT) % 5 = 0) AS updated FROM rule GROUP BY collection_id")
def x10(kb: Base) -> DataFrame:
    return _ruled(kb)[1]


def _ruled(kb: Base) -> tuple[DataFrame, DataFrame]:
    """An entry a rule, under the first word of its name, so that many tell of one new rule; every fifth is of itself."""
    rules = kb.rules
    number = F.element_at(F.split("id", ":"), 2).cast("int")
    name = F.when(number % 5 == 0, F.col("name")).otherwise(F.element_at(F.split("name", " "), 1))
    entry = F.struct(name.alias("name"), "category", F.upper("body").alias("body"), "page_refs")
    told = rules.select("collection_id", number.alias("batch"), F.to_json(F.struct(F.array(entry).alias("entries"))).alias("response"))
    return R.upsert_rules(rules, R.parse_rules(told))


@query("x10_rule_rows", """
    WITH told AS (SELECT *, CAST(split_part(id, ':', 2) AS INT) AS n, CASE WHEN CAST(split_part(id, ':', 2) AS INT) % 5 = 0 THEN name ELSE split_part(name, ' ', 1) END AS told, 'Book ' || split_part(collection_id, ':', 2) || '|' || page_start || '|' || page_end AS ref FROM rule),
    last AS (SELECT collection_id, told, arg_max(category, n) AS category, arg_max(upper(body), n) AS body FROM told GROUP BY collection_id, told),
    refs AS (SELECT collection_id, told, string_agg(ref, ',' ORDER BY page_start, page_end) AS refs FROM (SELECT DISTINCT collection_id, told, ref, page_start, page_end FROM told) GROUP BY collection_id, told)
    SELECT 'rule:' || md5(l.collection_id || '|' || l.told) AS id, l.told AS name, l.category, md5(l.body) AS digest, r.refs, CAST(NULL AS STRING) AS notes, false AS stale FROM last l JOIN refs r ON r.collection_id = l.collection_id AND r.told = l.told WHERE NOT EXISTS (SELECT 1 FROM rule o WHERE o.collection_id = l.collection_id AND o.name = l.told)
    UNION ALL SELECT id, name, category, md5(CASE WHEN n % 5 = 0 THEN upper(body) ELSE body END), ref, notes, CASE WHEN n % 5 = 0 THEN false ELSE stale END FROM told""")
def x10r(kb: Base) -> DataFrame:
    """All rules with their bodies, references and kept notes."""
    refs = F.array_join(F.transform("page_refs", lambda p: F.concat_ws("|", p["source_name"], p["page_start"].cast("string"), p["page_end"].cast("string"))), ",")
    return _ruled(kb)[0].select("id", "name", "category", F.md5("body").alias("digest"), refs.alias("refs"), "notes", "stale")


@query("x12_stale_rules", "SELECT id, CASE WHEN collection_id IN (SELECT collection_id FROM source WHERE index_status = 'done' AND source_type IN ('rules', 'supplement')) THEN true ELSE stale END AS stale FROM rule")
def x12r(kb: Base) -> DataFrame:
    return R.propagate_staleness(kb.entity, kb.rule, kb.source.filter("index_status = 'done'"))[1].select("id", "stale")


@query("x12_staleness", "SELECT id, CASE WHEN collection_id IN (SELECT collection_id FROM source WHERE index_status = 'done') THEN true ELSE codex_stale END AS codex_stale FROM entity")
def x12(kb: Base) -> DataFrame:
    return R.propagate_staleness(kb.entity, kb.rule, kb.source.filter("index_status = 'done'"))[0].select("id", "codex_stale")


@query("x16_list_proposals", "SELECT p.id, coalesce(e.name, r.name) AS target_label, CASE p.kind WHEN 'entity_summary' THEN e.summary WHEN 'entity_note' THEN e.notes ELSE r.notes END AS current_text FROM proposal p LEFT JOIN entity e ON e.id = p.target LEFT JOIN rule r ON r.id = p.target")
def x16(kb: Base) -> DataFrame:
    return R.list_proposals(kb.proposal, kb.entity, kb.rule).select("id", "target_label", "current_text")


@query("x17_accept_proposals", "SELECT id, CASE WHEN status = 'pending' THEN 'accepted' ELSE status END AS status FROM proposal")
def x17(kb: Base) -> DataFrame:
    return R.accept_proposals(kb.proposal, kb.proposal, kb.entity, kb.rules)["proposals"].select("id", "status")


@query("x17_accepted_notes", """
    WITH by_target AS (SELECT target, string_agg(CASE WHEN kind <> 'entity_summary' THEN proposed_text END, repeat(chr(10), 2) ORDER BY id) AS added, arg_max(proposed_text, CASE WHEN kind = 'entity_summary' THEN id END) AS told FROM proposal WHERE status = 'pending' GROUP BY target)
    SELECT e.id, md5(CASE WHEN coalesce(b.added, '') = '' THEN e.notes WHEN trim(coalesce(e.notes, '')) = '' THEN b.added ELSE e.notes || repeat(chr(10), 2) || b.added END) AS digest, coalesce(b.told, e.summary) AS summary FROM entity e LEFT JOIN by_target b ON b.target = e.id""")
def x17n(kb: Base) -> DataFrame:
    return R.accept_proposals(kb.proposal, kb.proposal, kb.entity, kb.rules)["entities"].select("id", F.md5("notes").alias("digest"), "summary")


@query("x18_reject_proposals", "SELECT id, CASE WHEN status = 'pending' THEN 'rejected' ELSE status END AS status FROM proposal")
def x18(kb: Base) -> DataFrame:
    return R.reject_proposals(kb.proposal, kb.proposal)[0].select("id", "status")


@query("x19_rule_notes", f"SELECT id, CASE WHEN {LIVE} THEN 'Note on ' || name ELSE notes END AS notes FROM rule")
def x19(kb: Base) -> DataFrame:
    return R.update_rule_notes(kb.rule, kb.rule.select("id", F.concat(F.lit("Note on "), "name").alias("notes")))[0].select("id", "notes")


def _vault(kb: Base) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with keys and contents, files of which some changed or vanished, and the state of the last pass, each by a
    number from the record's hash: 1 has a changed file, 2 none, 3 no state, 4 and 5 an older one, 5 a conflict."""
    records = S.sync_records(kb.entity, kb.session, kb.rule, kb.campaign, kb.collection)
    made = Y.render_records(Y.file_keys(records)).withColumn("n", _number(8)).select("record", "key", "name", "content", "n")
    made = _stored(kb, made)  # all three tables are made of it, and each is read several times
    content = F.when(F.col("n") == 1, F.concat("content", F.lit("\nmore\n"))).otherwise(F.col("content"))
    files = made.filter("n <> 2").select("key", "record", content.alias("content"))
    state = made.filter("n <> 3").select("record", "key", F.when(F.col("n").isin(4, 5), "old").otherwise(T.content_hash(F.col("content"))).alias("synced_hash"), (F.col("n") == 5).alias("conflict"))
    return made.select("record", "key", "name", "content"), files, state


def _number(n: int):
    return F.conv(F.substring(F.md5("record"), 1, 4), 16, 10).cast("long") % n


def _slug(x: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({x}, '[^\p{{L}}\p{{M}}\p{{N}}]+', '-', 'g')), '^-+|-+$', '', 'g')"


#: CTEs up to keyed (record, name, key, n): all records with their files' keys; no name here is a device's or empty.
KEYED_SQL = f"""
    r AS (SELECT id AS record, kind AS type, name, NULL AS number, CASE WHEN campaign_id IS NOT NULL THEN 'campaign' ELSE 'collection' END AS scope_kind, coalesce(campaign_id, collection_id) AS scope_id FROM entity WHERE {LIVE}
        UNION ALL SELECT id, 'session', title, session_number, 'campaign', campaign_id FROM session WHERE {LIVE}
        UNION ALL SELECT id, 'rule_entry', name, NULL, 'collection', collection_id FROM rule WHERE {LIVE}),
    scoped AS (SELECT r.*, coalesce(a.name, b.name) AS scope_name FROM r LEFT JOIN campaign a ON r.scope_kind = 'campaign' AND a.id = r.scope_id LEFT JOIN collection b ON r.scope_kind = 'collection' AND b.id = r.scope_id WHERE coalesce(a.name, b.name) IS NOT NULL),
    slugs AS (SELECT scope_kind, {_slug('scope_name')} AS slug, count(DISTINCT scope_id) AS n FROM scoped GROUP BY 1, 2),
    paths AS (SELECT s.record, s.name, s.scope_kind || 's/' || g.slug || CASE WHEN g.n > 1 THEN '-' || split_part(s.scope_id, ':', 2) ELSE '' END || '/' || CASE type WHEN 'session' THEN 'sessions/' || CASE WHEN number < 1000 THEN lpad(CAST(number AS STRING), 3, '0') ELSE CAST(number AS STRING) END || '-' WHEN 'rule_entry' THEN 'rules/' ELSE 'entities/' || type || '/' END || {_slug('s.name')} AS path
        FROM scoped s JOIN slugs g ON g.scope_kind = s.scope_kind AND g.slug = {_slug('s.scope_name')}),
    keyed AS (SELECT record, name, path || CASE WHEN count(*) OVER (PARTITION BY path) > 1 THEN '-' || split_part(record, ':', 2) ELSE '' END || '.md' AS key, CAST('0x' || substr(md5(record), 1, 4) AS BIGINT) AS h FROM paths)"""


def _quoted(x: str) -> str:
    return rf"""'"' || replace(replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '\', '\\'), '"', '\"') || '"'"""


#: CTEs up to rendered (record, key, content): the whole text of each record's file.
RENDERED_SQL = f"""{KEYED_SQL},
    bodies AS (SELECT id AS record, aliases, summary, codex_article AS fenced, notes FROM entity UNION ALL SELECT id, NULL, NULL, NULL, notes FROM session UNION ALL SELECT id, NULL, NULL, body, notes FROM rule),
    told AS (SELECT s.*, k.key, list_concat([s.name], coalesce(b.aliases, list_filter([''], lambda a: false))) AS every, b.summary, b.fenced, b.notes FROM scoped s JOIN keyed k ON k.record = s.record JOIN bodies b ON b.record = s.record),
    fronts AS (SELECT *, array_to_string(list_transform(list_filter(every, lambda a, i: list_position(list_transform(every, lambda b: lower(b)), lower(a)) = i), lambda a: {_quoted('a')}), ', ') AS names FROM told),
    rendered AS (SELECT record, key, '---' || chr(10) || array_to_string(['id: ' || {_quoted('record')}, CASE WHEN type <> 'session' THEN 'name: ' || {_quoted('name')} END, 'title: ' || {_quoted('name')}, 'aliases: [' || names || ']',
        CASE WHEN type NOT IN ('session', 'rule_entry') THEN 'type: ' || {_quoted('type')} END, scope_kind || ': ' || {_quoted('scope_name')}, CASE WHEN type = 'session' THEN 'session_number: ' || number END, CASE WHEN type = 'session' THEN 'date_played: ""' END, 'created_at: ""', 'updated_at: ""'], chr(10))
        || chr(10) || '---' || chr(10) || CASE WHEN summary IS NULL AND fenced IS NULL AND notes IS NULL THEN '' ELSE chr(10) || array_to_string(['## Summary' || repeat(chr(10), 2) || summary, '<!-- codex:begin -->' || chr(10) || fenced || chr(10) || '<!-- codex:end -->', '## Notes' || repeat(chr(10), 2) || notes], repeat(chr(10), 2)) || chr(10) END AS content FROM fronts)"""


@query("y4_render_records", f"WITH {RENDERED_SQL} SELECT record, key, md5(content) AS digest FROM rendered")
def y4(kb: Base) -> DataFrame:
    made = Y.render_records(Y.file_keys(S.sync_records(kb.entity, kb.session, kb.rule, kb.campaign, kb.collection)))
    return made.select("record", "key", F.md5("content").alias("digest"))


@query("y1_sync_decisions", f"""
    WITH e AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 3 END AS b, user_id % 3 AS t, CASE WHEN user_id % 7 = 0 THEN NULL ELSE (event_id + user_id) % 3 END AS f FROM events)
    SELECT event_id, CASE WHEN f IS NULL THEN CASE WHEN b IS NULL THEN 'export' ELSE 'soft_delete' END WHEN t = f THEN CASE WHEN b = t THEN 'noop' ELSE 'adopt_base' END WHEN b IS NULL THEN 'conflict' WHEN f = b THEN 'export' WHEN t = b THEN 'apply' ELSE 'conflict' END AS action FROM e""")
def y1(kb: Base) -> DataFrame:
    e = kb.table("events")
    base, table = F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 3), F.col("user_id") % 3
    file = F.when(F.col("user_id") % 7 != 0, (F.col("event_id") + F.col("user_id")) % 3)
    return e.select("event_id", Y.decide(base, table, file).alias("action"))


@query("y3_parse_rendered", f"SELECT id AS record, name, summary, codex_article AS fenced, CASE WHEN trim(notes) <> '' THEN notes END AS notes FROM entity WHERE {LIVE} AND (campaign_id IS NOT NULL OR collection_id IS NOT NULL)")
def y3(kb: Base) -> DataFrame:
    records = S.sync_records(kb.entity, kb.session, kb.rule, kb.campaign, kb.collection).filter(F.col("type").isin("npc", "faction", "item"))
    made = Y.render_records(Y.file_keys(records)).select("key", "content")
    return Y.parse_vault_files(made).select("record", "name", "summary", "fenced", "notes")


@query("y5_file_keys", f"WITH {KEYED_SQL} SELECT record, key FROM keyed")
def y5(kb: Base) -> DataFrame:
    return Y.file_keys(S.sync_records(kb.entity, kb.session, kb.rule, kb.campaign, kb.collection)).select("record", "key")


@query("y7_conflict_actions", f"WITH {KEYED_SQL} SELECT record, ['noop', 'apply', 'soft_delete', 'adopt_base', 'adopt_base', 'adopt_base', 'noop', 'noop'][h % 8 + 1] AS action, ['noop', 'apply', 'soft_delete', 'adopt_base', 'adopt_base', 'unfreeze', 'noop', 'noop'][h % 8 + 1] AS step FROM keyed")
def y7(kb: Base) -> DataFrame:
    records, files, state = _vault(kb)
    return Y.conflict_actions(Y.sync_decisions(records, files, state), files).select("record", "action", "step")


@query("y8_orphan_sweep", f"WITH {KEYED_SQL} SELECT record, key, h % 8 IN (0, 6, 7) AS delete_file, replace(key, '.md', '.conflict.md') AS sidecar FROM keyed WHERE h % 8 <> 3 AND h % 3 = 0")
def y8(kb: Base) -> DataFrame:
    records, files, state = _vault(kb)
    return Y.orphan_sweep(state, records.filter(_number(3) != 0), files)


@query("y9_export_refs", f"WITH {KEYED_SQL} SELECT record, key FROM keyed WHERE h % 8 IN (0, 3, 4, 6, 7)")
def y9(kb: Base) -> DataFrame:
    records, files, state = _vault(kb)
    return Y.export_refs(records.select("record"), Y.sync_decisions(records, files, state)).select("record", "key")


@query("y10_list_conflicts", f"WITH {KEYED_SQL} SELECT record, key, name FROM keyed WHERE h % 8 = 5")
def y10(kb: Base) -> DataFrame:
    records, _, state = _vault(kb)
    return Y.list_conflicts(state, records)


RECONCILED_SQL = f"""
    WITH {KEYED_SQL}, told AS (SELECT ['unchanged', 'applied', 'soft_deleted', 'adopted', 'adopted', 'resolved', 'unchanged', 'unchanged'][h % 8 + 1] AS counter FROM keyed)
    SELECT c.counter, count(t.counter) AS n FROM (SELECT unnest(['exported', 'unchanged', 'adopted', 'applied', 'conflicts', 'resolved', 'soft_deleted', 'swept', 'invalid', 'failed']) AS counter) c LEFT JOIN told t ON t.counter = c.counter GROUP BY c.counter"""


@query("y11_reconcile", RECONCILED_SQL)
def y11(kb: Base) -> DataFrame:
    return Y.reconcile(*_vault(kb))["report"]


@query("c1_create_campaigns", "SELECT 'collection:own-' || split_part(id, ':', 2) AS id, name, id AS owner_campaign FROM campaign")
def c1(kb: Base) -> DataFrame:
    return C.create_campaigns(kb.campaign)["collections"]


def _tables(kb: Base) -> dict[str, DataFrame]:
    return {"campaigns": kb.campaign, "collections": kb.collection, "subscriptions": kb.subscription, "entities": kb.entity, "edges": kb.edge, "sources": kb.source, "chunks": kb.chunk, "rules": kb.rule, "proposals": kb.proposal}


def _after_deletion(kb: Base) -> dict[str, DataFrame]:
    """Two campaigns go, one of them with what it owns."""
    asked = kb.campaign.filter("id in ('campaign:0', 'campaign:1')").select("id", (F.col("id") == "campaign:0").alias("cascade"))
    return C.delete_campaigns(_tables(kb), asked)


PURGED = "collection_id IN (SELECT id FROM collection WHERE owner_campaign = 'campaign:0')"
OWNED = "collection_id IN (SELECT id FROM collection WHERE owner_campaign IS NOT NULL)"


@query("c2_delete_campaigns", "SELECT id, CASE WHEN owner_campaign IN ('campaign:0', 'campaign:1') THEN NULL ELSE owner_campaign END AS owner_campaign FROM collection WHERE owner_campaign IS NULL OR owner_campaign <> 'campaign:0'")
def c2(kb: Base) -> DataFrame:
    return _after_deletion(kb)["collections"].select("id", "owner_campaign")


@query("c2_deleted_rows", f"SELECT 'campaign' AS what, id FROM campaign WHERE id NOT IN ('campaign:0', 'campaign:1') UNION ALL SELECT 'entity', id FROM entity WHERE {PURGED} IS NOT TRUE UNION ALL SELECT 'chunk', chunk_id FROM chunk WHERE {PURGED} IS NOT TRUE UNION ALL SELECT 'source', id FROM source WHERE {PURGED} IS NOT TRUE UNION ALL SELECT 'rule', id FROM rule UNION ALL SELECT 'subscription', campaign_id || ' ' || collection_id FROM subscription WHERE campaign_id NOT IN ('campaign:0', 'campaign:1') AND {PURGED} IS NOT TRUE")
def c2r(kb: Base) -> DataFrame:
    """What is left of the other tables; rules stay."""
    left = _after_deletion(kb)
    ids = {"campaign": left["campaigns"].select("id"), "entity": left["entities"].select("id"), "chunk": left["chunks"].select(F.col("chunk_id").alias("id")), "source": left["sources"].select("id"), "rule": left["rules"].select("id"), "subscription": left["subscriptions"].select(F.concat_ws(" ", "campaign_id", "collection_id").alias("id"))}
    parts = [df.select(F.lit(what).alias("what"), "id") for what, df in ids.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query("c3_purge_collections", f"SELECT edge_id FROM edge WHERE from_id NOT IN (SELECT id FROM entity WHERE {OWNED}) AND to_id NOT IN (SELECT id FROM entity WHERE {OWNED})")
def c3(kb: Base) -> DataFrame:
    return C.purge_collections(_tables(kb), kb.collection.filter("owner_campaign is not null"))["edges"].select("edge_id")


@query("c3_purged_rows", f"SELECT 'entity' AS what, id FROM entity WHERE {OWNED} IS NOT TRUE UNION ALL SELECT 'rule', id FROM rule WHERE {OWNED} IS NOT TRUE UNION ALL SELECT 'proposal', id FROM proposal WHERE {OWNED} IS NOT TRUE UNION ALL SELECT 'collection', id FROM collection WHERE owner_campaign IS NULL")
def c3r(kb: Base) -> DataFrame:
    left = C.purge_collections(_tables(kb), kb.collection.filter("owner_campaign is not null"), purge_orphans=True)
    parts = [left[name].select(F.lit(what).alias("what"), "id") for what, name in (("entity", "entities"), ("rule", "rules"), ("proposal", "proposals"), ("collection", "collections"))]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("c4_apply_subscriptions", "SELECT DISTINCT campaign_id, collection_id FROM subscription WHERE collection_id NOT IN (SELECT id FROM collection WHERE owner_campaign IS NOT NULL)")
def c4(kb: Base) -> DataFrame:
    gone = kb.subscription.join(kb.collection.filter("owner_campaign is not null").select(F.col("id").alias("collection_id")), "collection_id", "left_semi")
    return C.apply_subscriptions(kb.subscription, kb.subscription, gone)


def _created(kb: Base) -> tuple[DataFrame, DataFrame]:
    """A new faction for each, with its notes."""
    rows = kb.entity.filter("kind = 'faction'").select(F.concat("id", F.lit("-new")).alias("id"), "kind", F.concat(F.lit("New "), "name").alias("name"), "notes", "collection_id")
    return C.create_entities(kb.entity, kb.edge, rows)


@query("c5_create_entities", f"""
    WITH l AS (SELECT id || '-new' AS from_id, collection_id, trim(unnest(regexp_extract_all(notes, '\\[\\[([^\\[\\]]+)\\]\\]', 1))) AS link FROM entity WHERE kind = 'faction' AND collection_id IS NOT NULL),
    r AS (SELECT q.collection_id, q.link, arg_min(f.id, (f.tier, f.id)) AS to_id FROM (SELECT DISTINCT collection_id, link FROM l) q JOIN {FORMS} f ON f.collection_id = q.collection_id AND f.form <> '' AND ((f.tier < 3 AND f.form = lower(q.link)) OR (f.tier = 3 AND f.form = {sql_key('q.link')})) GROUP BY q.collection_id, q.link)
    SELECT from_id, rel_type, count(*) AS n FROM (SELECT from_id, rel_type FROM edge UNION ALL SELECT from_id, 'mentioned' FROM (SELECT DISTINCT l.from_id, r.to_id FROM l JOIN r ON r.collection_id = l.collection_id AND r.link = l.link)) GROUP BY from_id, rel_type""")
def c5(kb: Base) -> DataFrame:
    return _created(kb)[1].groupBy("from_id", "rel_type").agg(F.count("*").alias("n"))


@query("c5_created_rows", "SELECT id || '-new' AS id, kind, 'New ' || name AS name, notes, collection_id, CAST(NULL AS BOOLEAN) AS vault_deleted FROM entity WHERE kind = 'faction'")
def c5c(kb: Base) -> DataFrame:
    return _created(kb)[0].filter("id like '%-new'").select("id", "kind", "name", "notes", "collection_id", "vault_deleted")


@query("c5_mentions", f"""
    WITH l AS (SELECT id || '-new' AS from_id, collection_id, trim(unnest(regexp_extract_all(notes, '\\[\\[([^\\[\\]]+)\\]\\]', 1))) AS link FROM entity WHERE kind = 'faction' AND collection_id IS NOT NULL),
    r AS (SELECT q.collection_id, q.link, arg_min(f.id, (f.tier, f.id)) AS to_id FROM (SELECT DISTINCT collection_id, link FROM l) q JOIN {FORMS} f ON f.collection_id = q.collection_id AND f.form <> '' AND ((f.tier < 3 AND f.form = lower(q.link)) OR (f.tier = 3 AND f.form = {sql_key('q.link')})) GROUP BY q.collection_id, q.link)
    SELECT DISTINCT l.from_id, r.to_id, 'mentioned' AS rel_type FROM l JOIN r ON r.collection_id = l.collection_id AND r.link = l.link""")
def c5m(kb: Base) -> DataFrame:
    return _created(kb)[1].filter("from_id like '%-new' or to_id like '%-new'").select("from_id", "to_id", "rel_type")


@query("c6_update_entities", "SELECT id, name || ' II' AS name, array_to_string(aliases, '|') AS aliases, CAST(NULL AS STRING) AS summary, true AS codex_stale FROM entity")
def c6(kb: Base) -> DataFrame:
    rows = kb.entity.select("id", F.concat("name", F.lit(" II")).alias("name"), F.lit(None).cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("summary"))
    return C.update_entities(kb.entity, rows).select("id", "name", F.array_join("aliases", "|").alias("aliases"), "summary", "codex_stale")


@query("c7_delete_entities", "SELECT id, vault_deleted IS TRUE OR kind = 'item' AS deleted FROM entity")
def c7(kb: Base) -> DataFrame:
    return C.delete_entities(kb.entity, kb.entity.filter("kind = 'item'"))[0].select("id", F.col("vault_deleted").eqNullSafe(True).alias("deleted"))


@query("c8_upsert_sessions", f"""
    WITH seen AS (SELECT DISTINCT s.campaign_id, e.id, e.name, e.aliases FROM entity e JOIN subscription s ON s.collection_id = e.collection_id WHERE e.{LIVE} UNION SELECT campaign_id, id, name, aliases FROM entity WHERE campaign_id IS NOT NULL AND {LIVE}),
    forms AS (SELECT campaign_id, id, 1 AS tier FROM seen WHERE lower(name) = 'red widget' UNION ALL SELECT campaign_id, id, 2 FROM seen WHERE len(list_filter(aliases, lambda a: lower(a) = 'red widget')) > 0 UNION ALL SELECT campaign_id, id, 3 FROM seen WHERE {sql_key('name')} = 'red widget' UNION ALL SELECT campaign_id, id, 3 FROM (SELECT campaign_id, id, unnest(aliases) AS a FROM seen) WHERE {sql_key('a')} = 'red widget'),
    best AS (SELECT campaign_id, arg_min(id, (tier, id)) AS entity_id FROM forms GROUP BY campaign_id)
    SELECT s.id AS session_id, b.entity_id FROM session s JOIN best b ON b.campaign_id = s.campaign_id""")
def c8(kb: Base) -> DataFrame:
    rows = kb.session.select("id", "campaign_id", "session_number", "title", F.concat("notes", F.lit(" [[red widget]]")).alias("notes"))
    seen = kb.entity.join(S.visible_entities(kb.entity, kb.subscription).withColumnRenamed("entity_id", "id").withColumnRenamed("campaign_id", "c"), "id").select(F.col("c").alias("campaign_id"), "id", "name", "aliases")
    return C.upsert_sessions(kb.session, rows, seen)[1]


STAMPED = "'chunk:' || sha256(concat_ws('|', source_id, CAST(place AS STRING)))"


@query("s3_upsert_chunks", f"SELECT {STAMPED} AS chunk_id, source_id, CASE WHEN source_id = 'source:src1' THEN 'old' ELSE 'new' END AS embed_model FROM chunk WHERE source_id IS NOT NULL")
def s3(kb: Base) -> DataFrame:
    """All sources' chunks are made anew, but for one."""
    own = kb.chunk.withColumn("ordinal", F.col("place")).filter("source_id is not null")
    return M.upsert_chunks(M.stamp_chunks(own, "old"), M.stamp_chunks(own, "new").filter("source_id <> 'source:src1'")).select("chunk_id", "source_id", "embed_model")


@query("s4_delete_by_source", "SELECT chunk_id FROM chunk WHERE source_id NOT IN (SELECT id FROM source WHERE index_status = 'done')")
def s4(kb: Base) -> DataFrame:
    return M.delete_by_source(kb.chunk, kb.source.filter("index_status = 'done'").select(F.col("id").alias("source_id"))).select("chunk_id")


def _outcomes(kb: Base) -> tuple[DataFrame, DataFrame]:
    return M.apply_ingest_status(kb.source, kb.chunk, kb.source.select(F.col("id").alias("source_id"), (F.col("embed_model") == "small").alias("ok")))


@query("s5_ingest_status", "SELECT id, CASE WHEN embed_model = 'small' THEN 'done' ELSE 'error' END AS index_status FROM source")
def s5(kb: Base) -> DataFrame:
    return _outcomes(kb)[0].select("id", "index_status")


@query("s5_ingest_index", "SELECT chunk_id, source_id FROM chunk WHERE source_id IS NULL OR source_id IN (SELECT id FROM source WHERE embed_model = 'small')")
def s5i(kb: Base) -> DataFrame:
    return _outcomes(kb)[1].select("chunk_id", "source_id")


def _reindexed(kb: Base) -> tuple[DataFrame, DataFrame]:
    """All sources but the lore have new chunks."""
    chunks = kb.chunk.withColumn("ordinal", F.col("place"))
    return M.reindex(M.stamp_chunks(chunks, "old"), kb.source, chunks.join(kb.source.filter("source_type <> 'lore'").select(F.col("id").alias("source_id")), "source_id", "left_semi"), "hash")


@query("s6_reindex", "SELECT id, CASE WHEN source_type = 'lore' THEN 'error' ELSE 'done' END AS index_status, CASE WHEN source_type = 'lore' THEN embed_model ELSE 'hash' END AS embed_model FROM source")
def s6(kb: Base) -> DataFrame:
    return _reindexed(kb)[0].select("id", "index_status", "embed_model")


@query("s6_reindexed_chunks", f"SELECT {STAMPED} AS chunk_id, source_id, CASE WHEN source_id IN (SELECT id FROM source WHERE source_type <> 'lore') THEN 'hash' ELSE 'old' END AS embed_model FROM chunk")
def s6i(kb: Base) -> DataFrame:
    return _reindexed(kb)[1].select("chunk_id", "source_id", "embed_model")


@query("s9_backfill", "SELECT id, coalesce(vault_deleted, false) AS vault_deleted, 'unset' AS era FROM entity")
def s9(kb: Base) -> DataFrame:
    return M.backfill_defaults(kb.entity, {"vault_deleted": False, "era": "unset"}).select("id", "vault_deleted", "era")


@query("s10_delete_sources", "SELECT id FROM source WHERE source_type <> 'lore'")
def s10(kb: Base) -> DataFrame:
    return M.delete_sources(kb.source, kb.chunk, kb.source.filter("source_type = 'lore'").select(F.col("id").alias("source_id")))[0].select("id")


@query("s10_deleted_chunks", "SELECT chunk_id FROM chunk WHERE source_id IS NULL OR source_id NOT IN (SELECT id FROM source WHERE source_type = 'lore')")
def s10i(kb: Base) -> DataFrame:
    return M.delete_sources(kb.source, kb.chunk, kb.source.filter("source_type = 'lore'").select(F.col("id").alias("source_id")))[1].select("chunk_id")


@query("t2_debounce", """
    WITH c AS (SELECT *, CAST("key" AS BIGINT) % 25 AS vault FROM change), g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY vault ORDER BY ts) + INTERVAL 2 SECOND THEN 1 ELSE 0 END AS b FROM c),
    s AS (SELECT *, sum(b) OVER (PARTITION BY vault ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g),
    e AS (SELECT vault, epoch_us(min(ts)) AS start_us, list_sort(list_distinct(list(CASE kind WHEN 'upsert' THEN 1 ELSE 2 END || kind || '|' || "key"))) AS events FROM s GROUP BY vault, run)
    SELECT vault, start_us, len(events) AS n_events, md5(array_to_string(list_transform(events, lambda x: x[2:]), ',')) AS digest FROM e""")
def t2(kb: Base) -> DataFrame:
    found = ST.debounce(kb.change.withColumns({"ts": F.col("ts").cast("timestamp"), "vault": F.col("key").cast("long") % 25}))
    listed = F.array_join(F.transform("events", lambda e: F.concat(e["kind"], F.lit("|"), e["key"])), ",")
    return found.select("vault", F.unix_micros("start").alias("start_us"), F.size("events").cast("long").alias("n_events"), F.md5(listed).alias("digest"))


@query("t3_suppress_echo", """
    WITH e AS (SELECT CAST(user_id AS STRING) AS "key", ts, CASE event_type WHEN 'error' THEN 'remove' WHEN 'view' THEN 'own_write' WHEN 'signup' THEN 'own_delete' ELSE 'upsert' END AS kind, md5(props) AS hash FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY "key" ORDER BY ts, kind, hash) AS i FROM e),
    last AS (SELECT o.*, max(CASE WHEN p.kind = 'own_write' THEN p.i END) AS w, max(CASE WHEN p.kind = 'own_delete' THEN p.i END) AS d FROM o LEFT JOIN o p ON p."key" = o."key" AND p.i < o.i GROUP BY ALL),
    timed AS (SELECT l.*, w.hash AS own_hash, l.ts < w.ts + INTERVAL 30 SECOND AS written, l.ts < d.ts + INTERVAL 3 SECOND AS deleted FROM last l LEFT JOIN o w ON w."key" = l."key" AND w.i = l.w LEFT JOIN o d ON d."key" = l."key" AND d.i = l.d),
    first AS (SELECT "key", d, min(i) AS i FROM timed WHERE kind = 'remove' AND deleted GROUP BY "key", d)
    SELECT t."key", t.ts, t.kind, t.hash FROM timed t LEFT JOIN first f ON f."key" = t."key" AND f.i = t.i
    WHERE t.kind IN ('upsert', 'remove') AND NOT coalesce(t.kind = 'upsert' AND t.own_hash = t.hash AND t.written, false) AND f.i IS NULL""".replace("GROUP BY ALL", 'GROUP BY o."key", o.ts, o.kind, o.hash, o.i'))
def t3(kb: Base) -> DataFrame:
    own = kb.table("events").select(F.col("user_id").cast("string").alias("key"), "ts", F.expr("CASE event_type WHEN 'error' THEN 'remove' WHEN 'view' THEN 'own_write' WHEN 'signup' THEN 'own_delete' ELSE 'upsert' END").alias("kind"), F.md5("props").alias("hash"))
    return ST.suppress_echo(own)


@query("t5_diff_snapshots", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'remove' ELSE 'upsert' END AS kind, CAST(doc_id AS STRING) AS \"key\" FROM documents WHERE doc_id % 3 <> 1")
def t5(kb: Base) -> DataFrame:
    docs = kb.table("documents").select(F.col("doc_id").cast("string").alias("key"), "doc_id", F.lit(1).alias("mtime"), F.col("n_chars").alias("size"))
    after = docs.filter("doc_id % 3 <> 0").withColumn("mtime", F.when(F.col("doc_id") % 3 == 2, 2).otherwise(1))
    return ST.diff_snapshots(docs.drop("doc_id"), after.drop("doc_id"))


@query("t6_assemble_tokens", "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) || ' ' AS content FROM conversations GROUP BY conv_id")
def t6(kb: Base) -> DataFrame:
    turns = kb.table("conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    tokens = turns.join(last, "conv_id").select("conv_id", (F.col("turn") * 100_000).alias("base"), (F.col("turn") == F.col("last")).alias("end"), F.posexplode(F.split("text", " ")).alias("i", "word"))
    return ST.assemble_tokens(tokens.select("conv_id", (F.col("base") + F.col("i")).alias("seq"), F.concat("word", F.lit(" ")).alias("token"), F.col("end").alias("done"), F.lit(False).alias("failed")))


@query("t8_progress", "SELECT event_id, round(0.30 + 0.55 * least((user_id % 10) / 10.0, 1.0), 6) AS fraction FROM events")
def t8(kb: Base) -> DataFrame:
    done = kb.table("events").select("event_id", (F.col("user_id") % 10).alias("current"), F.lit(10).alias("total"))
    return ST.progress(done, "embed").select("event_id", F.round("fraction", 6).alias("fraction"))

