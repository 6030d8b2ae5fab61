"""Wiki links and the graph of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import text as T

from .scopes import live

# Each inverse relation and the one that it becomes with its ends swapped.
INVERSES = {"led_by": "leads", "has_member": "member_of", "contains": "located_in", "owned_by": "owns", "served_by": "serves", "created_by": "created", "child_of": "parent_of"}

# Relations that say less than all others.
TIERS = {"mentioned": 0, "related_to": 1, "knows": 1}

EDGE = ["from_id", "to_id", "rel_type", "notes"]


def tier(rel_type: Column) -> Column:
    """How much a relation says: 0 for a mention, 1 for a loose one, 2 for all others."""
    return F.when(rel_type == "mentioned", 0).when(rel_type.isin("related_to", "knows"), 1).otherwise(2)


def canonical_pair(a: str = "from_id", b: str = "to_id") -> Column:
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))


def collapse_edges(edges: DataFrame, group: Column | None = None) -> DataFrame:
    """Of the edges between two entities, in either direction, those that say most, without repeats.

    Of equal edges (from_id, to_id, rel_type) the one with the smallest other columns stays.
    """
    ranked = edges.withColumn("_tier", tier(F.col("rel_type"))).withColumn("_pair", canonical_pair() if group is None else group)
    best = ranked.groupBy("_pair").agg(F.max("_tier").alias("_tier"))
    kept = ranked.join(best, ["_pair", "_tier"])
    others = [c for c in edges.columns if c not in ("from_id", "to_id", "rel_type")]
    if not others:
        return kept.select(edges.columns).distinct()
    one = kept.groupBy("from_id", "to_id", "rel_type").agg(F.min(F.struct(*others)).alias("_o"))
    return one.select("from_id", "to_id", "rel_type", *(F.col(f"_o.{c}").alias(c) for c in others)).select(edges.columns)


def canonical_relations(edges: DataFrame) -> DataFrame:
    """Edges with inverse relations turned round; others, unknown ones too, stay as they are."""
    names = F.create_map(*(F.lit(x) for pair in INVERSES.items() for x in pair))
    flip = F.col("rel_type").isin(*INVERSES)
    turned = {"from_id": F.when(flip, F.col("to_id")).otherwise(F.col("from_id")), "to_id": F.when(flip, F.col("from_id")).otherwise(F.col("to_id")), "rel_type": F.coalesce(names[F.col("rel_type")], "rel_type")}
    return edges.withColumns(turned)


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the new ones, which replace those of the same ends and relation; of new ones the last by created_at."""
    order = Window.partitionBy("from_id", "to_id", "rel_type").orderBy(F.col("_new").desc(), F.col("created_at").desc_nulls_last(), *(c for c in edges.columns if c not in ("from_id", "to_id", "rel_type", "created_at")))
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.select(edges.columns).withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(edges.columns)


def relate_collapsing(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges with the new ones, of which only those that say most remain for each pair of ends that a new one joins."""
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.select(edges.columns).withColumn("_new", F.lit(1)))
    both = both.withColumns({"_p": canonical_pair(), "_tier": tier(F.col("rel_type"))})
    # one exchange and one sort serve both windows: the pair's rows lie together, and in it those of an edge
    order = Window.partitionBy("_p", "from_id", "to_id", "rel_type").orderBy(F.col("_new").desc(), F.col("created_at").desc_nulls_last(), *(c for c in edges.columns if c not in ("from_id", "to_id", "rel_type", "created_at")))
    pair = Window.partitionBy("_p")
    marked = both.withColumn("_n", F.row_number().over(order)).withColumns({"_touched": F.max("_new").over(pair), "_best": F.max("_tier").over(pair)})
    return marked.filter("_touched = 0 or (_tier = _best and _n = 1)").select(edges.columns)


def delete_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select("edge_id"), "edge_id", "left_anti")


def extract_links(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, place, link): the trimmed names in [[ ]] of the columns in turn, blank ones left out."""
    text = F.concat_ws("\n", *columns)
    found = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1))).alias("place", "link"))
    return found.select(key, "place", T.strip(F.col("link")).alias("link")).filter("link <> ''")


def _answers(visible: DataFrame, scope: str) -> DataFrame:
    """(scope, tier, form, id): what each entity answers to at each tier: its name, its aliases, and the keys of both."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    named = visible.select(scope, "id", F.lit(1).alias("tier"), F.lower("name").alias("form"))
    named = named.union(visible.select(scope, "id", F.lit(2), F.explode(F.transform(aliases, lambda a: F.lower(a)))))
    keyed = visible.select(scope, "id", F.lit(3), F.explode(F.transform(F.concat(F.array("name"), aliases), lambda a: T.name_key(a))).alias("form"))
    return named.union(keyed).filter("form <> ''").groupBy(scope, "tier", "form").agg(F.min("id").alias("id"))


def resolve_links(links: DataFrame, visible: DataFrame, scope: str = "campaign_id") -> DataFrame:
    """links (scope, link, …) with `entity_id`: the entity of that name, else of that alias, else of that key.

    visible has (scope, id, name, aliases). Of several at one tier the smallest id; null if there is none. Each distinct
    link of a scope is looked up once.
    """
    asked = links.select(scope, "link").distinct()
    form = lambda tier, made: F.struct(F.lit(tier).alias("tier"), made.alias("form"))
    folded = F.lower(T.strip(F.col("link")))
    forms = F.array(form(1, folded), form(2, folded), form(3, T.name_key(F.col("link"))))
    wide = asked.select(scope, "link", F.explode(forms).alias("f")).select(scope, "link", "f.tier", "f.form")
    best = wide.join(_answers(visible, scope), [scope, "tier", "form"]).groupBy(scope, "link").agg(F.min(F.struct("tier", "id")).alias("b"))
    return links.join(best.select(scope, "link", F.col("b.id").alias("entity_id")), [scope, "link"], "left")


def fuzzy_resolve(unresolved: DataFrame, visible: DataFrame, scope: str = "campaign_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(resolved links, new aliases, findings) for links (scope, link) that no name answers exactly.

    A link with exactly one name of at least 0.90 resolves to it, and its spelling becomes an alias, the smallest of those
    of one key. Keys wanted for two entities are refused. Aliases and findings come from one table, so neither is alone.
    """
    from .names import SAME, best_match

    found = best_match(unresolved.select(scope, F.col("link").alias("needle")), visible, [scope], SAME).filter("outcome = 'unique'")
    hits = found.select(scope, F.col("needle").alias("link"), F.col("candidates")[0]["id"].alias("entity_id"), F.col("candidates")[0]["similarity"].alias("similarity")).withColumn("key", T.name_key(F.col("link")))
    wanted = hits.groupBy(scope, "key").agg(F.min("entity_id").alias("x"), F.max("entity_id").alias("y")).filter("x = y").select(scope, "key")
    hits = hits.join(wanted, [scope, "key"], "left_semi")
    aliases = hits.groupBy(scope, "entity_id", "key").agg(F.min("link").alias("alias"), F.max("similarity").alias("similarity"))
    findings = aliases.select(scope, F.lit("auto_alias").alias("kind"), "entity_id", "alias", "similarity")
    return hits.select(scope, "link", "entity_id"), aliases.select(scope, "entity_id", "alias"), findings


def sync_mentions(edges: DataFrame, resolved: DataFrame, sources: DataFrame) -> DataFrame:
    """edges with the mentions of the sources (id) replaced by those of resolved (from_id, to_id).

    Mentions of oneself, and between entities that another relation joins, are left out.
    """
    kept = edges.join(sources.select(F.col("id").alias("from_id"), F.lit("mentioned").alias("rel_type")), ["from_id", "rel_type"], "left_anti").select(edges.columns)
    joined = kept.filter("rel_type <> 'mentioned'").select(canonical_pair().alias("_p")).distinct()
    new = resolved.select("from_id", "to_id").filter("from_id <> to_id").distinct().withColumn("_p", canonical_pair()).join(joined, "_p", "left_anti")
    filled = {"rel_type": F.lit("mentioned"), "edge_id": F.xxhash64("from_id", "to_id", F.lit("mentioned")), "notes": F.lit(None).cast("string"), "created_at": F.lit(None).cast("timestamp")}
    typed = new.withColumns({k: v.cast(edges.schema[k].dataType) for k, v in filled.items() if k in edges.columns})
    return kept.unionByName(typed.select(edges.columns))


def link_forward_refs(new: DataFrame, notes: DataFrame, scope: str = "campaign_id") -> DataFrame:
    """(from_id, to_id): live entities whose notes link the exact name of a new entity (scope, id, name)."""
    links = extract_links(notes.withColumn("_k", F.struct(scope, "id")), "_k", "notes").select(F.col(f"_k.{scope}").alias(scope), F.col("_k.id").alias("from_id"), F.lower("link").alias("form"))
    named = new.select(scope, F.col("id").alias("to_id"), F.lower("name").alias("form"))
    links, named = links.distinct(), named.distinct()
    # many entities may link one name that many have, so there are many more pairs than rows: they are made by tasks that
    # share a name, and not compared with one another where they can't come twice, as for entities of one name and scope
    parts, spark = 16, links.sparkSession
    dealt = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    named = named.join(links.select(scope, "form").distinct(), [scope, "form"], "left_semi").withColumn("n", F.count("*").over(Window.partitionBy("to_id")))
    spread = named.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    links = links.withColumn("part", F.pmod(F.xxhash64("from_id"), F.lit(parts)).cast("int")).repartition(dealt, scope, "form", "part")
    pairs = lambda own: links.join(own, [scope, "form", "part"]).filter("from_id <> to_id").select("from_id", "to_id")
    return pairs(spread.filter("n = 1")).union(pairs(spread.filter("n > 1")).distinct())


def resync_wikilinks(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, new aliases, findings): the links of all live entities' notes, resolved within their own scope.

    An entity's scope is its collection, else its campaign; one without either is skipped.
    """
    own = live(entities).withColumn("scope", F.coalesce("collection_id", "campaign_id")).filter("scope is not null")
    links = extract_links(own.withColumn("_k", F.struct("scope", "id")), "_k", "notes").select("_k.scope", F.col("_k.id").alias("from_id"), "link").distinct()
    exact = resolve_links(links, own, "scope")
    near, aliases, findings = fuzzy_resolve(exact.filter("entity_id is null").select("scope", "link"), own, "scope")
    fuzzy = exact.filter("entity_id is null").drop("entity_id").join(near, ["scope", "link"])
    resolved = exact.filter("entity_id is not null").select("from_id", F.col("entity_id").alias("to_id")).union(fuzzy.select("from_id", "entity_id"))
    return sync_mentions(edges, resolved, own), aliases, findings


def entity_relations(ids: DataFrame, edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, other_id, name, rel_type, direction): the relations of the entities (id), both ways, without loops.

    Only live others count; for each other entity the relations that say most remain. By name.
    """
    out = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), "rel_type", F.lit("out").alias("direction"))
    back = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"), "rel_type", F.lit("in").alias("direction"))
    both = out.union(back).filter("id <> other_id").join(ids.select("id").distinct(), "id", "left_semi").withColumn("tier", tier(F.col("rel_type")))
    named = both.join(live(entities).select(F.col("id").alias("other_id"), "name"), "other_id")
    best = named.groupBy("id", "other_id").agg(F.max("tier").alias("tier"))
    return named.join(best, ["id", "other_id", "tier"]).select("id", "other_id", "name", "rel_type", "direction").distinct()


def ego_graph(ids: DataFrame, edges: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): for each centre (id) itself and its live neighbours, and the collapsed edges between them."""
    near = entity_relations(ids, edges, entities)
    centre = live(entities).join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("centre"), "id", "name", "kind")
    around = near.select(F.col("id").alias("centre"), F.col("other_id").alias("id")).distinct().join(live(entities).select("id", "name", "kind"), "id").select("centre", "id", "name", "kind")
    start, end = F.when(F.col("direction") == "out", F.col("id")).otherwise(F.col("other_id")), F.when(F.col("direction") == "out", F.col("other_id")).otherwise(F.col("id"))
    return centre.union(around), near.select(F.col("id").alias("centre"), start.alias("from_id"), end.alias("to_id"), "rel_type")


def missing_link_nodes(links: DataFrame, scope: str = "campaign_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of resolved links (scope, from_id, link, entity_id) that no entity answers: one node a key."""
    open_ = links.filter("entity_id is null").withColumn("key", T.name_key(F.col("link"))).withColumn("id", F.concat(F.lit("missing:"), F.col("key")))
    nodes = open_.groupBy(scope, "id").agg(F.min("link").alias("name"), F.lit("unresolved").alias("kind"))
    return nodes, open_.select(scope, "from_id", F.col("id").alias("to_id"), F.lit("unresolved").alias("rel_type")).distinct()


def merge_graphs(nodes: tuple[DataFrame, DataFrame], edges: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes of both graphs, one an id, and edges, one for ends and relation; the left graph's rows come first."""

    def one(pair: tuple[DataFrame, DataFrame], keys: list[str]) -> DataFrame:
        left, right = pair
        return left.unionByName(right.join(left.select(keys).distinct(), keys, "left_anti")).dropDuplicates(keys)

    return one(nodes, ["id"]), one(edges, ["from_id", "to_id", "rel_type"])


def link_dictionary(entities: DataFrame) -> DataFrame:
    """(form, id): folded names and aliases and their keys; forms that two entities claim are left out."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    forms = live(entities).select("id", F.explode(names).alias("n")).select("id", F.explode(F.array(F.lower("n"), T.name_key(F.col("n")))).alias("form")).filter("form <> ''")
    return forms.groupBy("form").agg(F.min("id").alias("id"), F.max("id").alias("_other")).filter("id = _other").select("form", "id")
