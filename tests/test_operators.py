"""Examples and invariants of the operators, on small tables."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F
import pytest

from loreloom.functions import text as T
from loreloom.operators import aggregates as A
from loreloom.operators import chunking as C
from loreloom.operators import context as X
from loreloom.operators import graph as G
from loreloom.operators import names as N
from loreloom.operators import review as R
from loreloom.operators import scopes as S
from loreloom.operators import sync as Y
from loreloom.operators import vectors as V
from loreloom.sources import vault
from loreloom.streaming import streams as ST


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.select(expression(F.col("t")).alias("x"), "i").orderBy("i").collect()]


def test_text_repair(spark):
    given = ["power-\nful  blade", "one\ntwo\n\nthree", " a\t b ", "", "1-\n2", "x \n\n y"]
    assert column(spark, given, T.normalize_text) == ["powerful blade", "one two\n\nthree", "a b", "", "1- 2", "x\n\n y"]
    once = column(spark, given, T.normalize_text)
    assert column(spark, once, T.normalize_text) == once


def test_headings(spark):
    yes = ["Chapter 1", "3.5 Skills", "COMBAT RULES", "WARNING!", "The Lord of the Rings"]
    no = ["the quick brown fox", "This is a sentence that ends.", "", "A", "Eleven Words Are Far Too Many For One Title Line Here Now"]
    assert column(spark, yes, T.is_heading) == [True] * len(yes)
    assert column(spark, no, T.is_heading) == [False] * len(no)


def test_name_keys(spark):
    given = ["The Free League", "Free League", "Quassars", "Atlas", "Chaos", "series", "Cities", "Seraphina's", "!!!", "The", "Boxes", "Bus"]
    assert column(spark, given, T.name_key) == ["free league", "free league", "quassar", "atlas", "chaos", "series", "city", "seraphina", "!!!", "the", "box", "bus"]
    once = column(spark, given, T.name_key)
    assert column(spark, once, T.name_key) == once


def test_languages(spark):
    given = ["what is the rule", "wie ist die Regel", "quelle est la règle", "¿qué es la regla?", "hi"]
    assert column(spark, given, lambda c: T.detect_language(c, F.lit("en"))) == ["en", "de", "fr", "es", "en"]


def test_similarity_is_symmetric_and_join_finds_all(spark):
    random.seed(3)
    words = ["iron", "fist", "quassar", "family", "free", "league", "leagues", "johar"]
    keys = sorted({" ".join(random.choices(words, k=random.randint(1, 3))) for _ in range(40)})
    df = spark.createDataFrame([(1, k) for k in keys], "blk int, key string")
    pairs = df.select(F.col("key").alias("a")).crossJoin(df.select(F.col("key").alias("c")))
    measured = {(r.a, r.c): r.s for r in pairs.select("a", "c", N.similarity(F.col("a"), F.col("c")).alias("s")).collect()}
    assert all(measured[a, b] == measured[b, a] for a, b in measured)
    assert measured["iron", "iron"] == 1.0
    for limit in (N.SAME, N.SUGGEST):
        found = {(r.a, r.b) for r in N.similar_keys(df, df, ["blk"], limit).collect()}
        assert found == {p for p, s in measured.items() if s >= limit - 1e-12}


def test_similar_keys_of_numbers_other_scripts_and_few_known_trigrams(spark):
    random.seed(5)
    keys = {f"customer {random.randrange(3000):09d}" for _ in range(60)} | {"aaaaaaaa", "aaaaaaa", "aaaaaaaab", "\U0001f409 dragon", "\U0001f409 dragons", "дракон", "драконы", "x", "xy"}
    df = spark.createDataFrame([(b, k) for k in sorted(keys) for b in (1, 2)], "blk int, key string")
    one = df.filter("blk = 1").drop("blk")
    pairs = one.select(F.col("key").alias("a")).crossJoin(one.select(F.col("key").alias("b")))
    measured = [(r.a, r.b) for r in pairs.select("a", "b", N.similarity(F.col("a"), F.col("b")).alias("s")).filter(F.col("s") >= N.SUGGEST - 1e-12).collect()]
    for head in (N.HEAD, 3):
        found = [(r.blk, r.a, r.b) for r in N.similar_keys(df, df, ["blk"], N.SUGGEST, head).collect()]
        assert sorted(found) == sorted((b, *p) for p in measured for b in (1, 2))


def test_similar_keys_meet_in_tiles_and_by_signatures(spark):
    """Blocks of several tiles, a table with itself and with another, keys in one block only, and high thresholds."""
    random.seed(9)
    keys = sorted({f"customer {random.randrange(400):09d}" for _ in range(60)} | {"customer", "customers hall", "hall of customers", "aaaaaaaa", "aaaaaaa", "ab ab ab", "ab"})
    left, right = spark.createDataFrame([(1, k) for k in keys] + [(2, "lost"), (None, "x")], "blk int, key string"), spark.createDataFrame([(1, f"{k}x") for k in keys] + [(1, ""), (1, None)], "blk int, key string")
    for a, b in ((left, left), (left, right)):
        pairs = a.filter("blk = 1").select(F.col("key").alias("a")).crossJoin(b.filter("blk = 1 and key <> ''").select(F.col("key").alias("b")))
        measured = {(r.a, r.b): r.s for r in pairs.select("a", "b", N.similarity(F.col("a"), F.col("b")).alias("s")).collect()}
        for limit in (N.SUGGEST, N.SAME):
            plan = N.similar_keys(a, b, ["blk"], limit, tile=16)
            found = [(r.a, r.b, r.similarity) for r in plan.filter("blk = 1").collect()]
            assert sorted(found) == sorted((*p, s) for p, s in measured.items() if s >= limit - 1e-12)
            assert plan.filter("blk = 2").count() == (1 if b is left else 0)


def test_matches_are_counted_without_candidates(spark):
    names = spark.createDataFrame([(1, f"i{i}", "Alba" if i % 2 else "alba") for i in range(6)] + [(1, "j", "Albax")], "blk int, id string, name string")
    needles = spark.createDataFrame([(1, "ALBA"), (1, "the Alba"), (1, "zzz")], "blk int, needle string")
    found = N.best_match(needles, names, ["blk"], N.SUGGEST)
    assert sorted((r.needle, r.n, r.outcome, len(r.candidates or [])) for r in found.collect()) == [("ALBA", 7, "ambiguous", 7), ("the Alba", 7, "ambiguous", 7), ("zzz", 0, "none", 0)]
    counted = found.select("needle", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in counted


def test_lint_looks_for_no_candidates_that_it_does_not_tell(spark, monkeypatch):
    monkeypatch.setattr("loreloom.operators.findings.best_match", lambda *a: pytest.fail("candidates of broken links are not part of a finding"))
    edges = spark.createDataFrame([], "edge_id long, from_id string, to_id string, rel_type string, notes string, created_at timestamp")
    collections, subs = spark.createDataFrame([("c", "C", None)], "id string, name string, owner_campaign string"), spark.createDataFrame([("k", "c")], "campaign_id string, collection_id string")
    rows = entities(spark, [{"id": "a", "name": "Alba", "notes": "[[Nobody]]", "codex_article": "x", "codex_stale": False}])
    from loreloom.operators import findings as L

    for found in (L.lint(rows, edges, collections, subs), L.lint_campaigns(rows, edges, collections, subs)):
        assert [(r.kind, r.detail) for r in found.collect()] == [("broken_wikilink", "Nobody")]


def entities(spark, rows):
    full = {"kind": "npc", "aliases": [], "summary": None, "notes": None, "codex_article": None, "codex_stale": None, "vault_deleted": None, "collection_id": "c", "campaign_id": None}
    schema = "id string, kind string, name string, aliases array<string>, summary string, notes string, codex_article string, codex_stale boolean, vault_deleted boolean, collection_id string, campaign_id string"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple((full | r).get(n) for n in names) for r in rows], schema)


def test_forward_refs_come_once_and_are_not_compared(spark):
    notes = entities(spark, [{"id": f"n{i}", "name": "n", "notes": "[[Red]] [[red]] [[Blue]]"} for i in range(40)])
    new = entities(spark, [{"id": f"r{i}", "name": "Red"} for i in range(50)] + [{"id": "two", "name": "Red"}, {"id": "two", "name": "blue"}, {"id": "n3", "name": "RED"}])
    found = G.link_forward_refs(new, notes, "collection_id")
    assert sorted(map(tuple, found.collect())) == sorted((f"n{i}", t) for i in range(40) for t in [f"r{j}" for j in range(50)] + ["two", "n3"] if t != f"n{i}")
    top = found._jdf.queryExecution().optimizedPlan()
    assert top.nodeName() == "Union" and sum("Aggregate" == top.children().apply(i).nodeName() for i in range(2)) == 1


def test_links_resolve_by_name_then_alias_then_key(spark):
    own = entities(spark, [{"id": "npc:1", "name": "Free League"}, {"id": "npc:2", "name": "X", "aliases": ["free league", "Bob"]}, {"id": "npc:3", "name": "The Bobs"}])
    links = spark.createDataFrame([("c", x) for x in ("FREE LEAGUE", "bob", "The  Free League", "nobody")], "collection_id string, link string")
    got = {r.link: r.entity_id for r in G.resolve_links(links, own, "collection_id").collect()}
    assert got == {"FREE LEAGUE": "npc:1", "bob": "npc:2", "The  Free League": "npc:1", "nobody": None}


def test_fuzzy_links_become_aliases_with_findings(spark):
    own = entities(spark, [{"id": "npc:1", "name": "Constantinople Harbourmaster"}])
    links = spark.createDataFrame([("c", "Constantinople Harbourmastr"), ("c", "else")], "collection_id string, link string")
    resolved, aliases, findings = G.fuzzy_resolve(links, own, "collection_id")
    assert [r.entity_id for r in resolved.collect()] == ["npc:1"]
    assert [r.alias for r in aliases.collect()] == [r.alias for r in findings.collect()] == ["Constantinople Harbourmastr"]


def test_collapse_does_not_depend_on_order(spark):
    edges = [("a", "b", "mentioned"), ("b", "a", "knows"), ("a", "b", "owns"), ("a", "b", "owns"), ("c", "d", "mentioned")]
    want = {("a", "b", "owns"), ("c", "d", "mentioned")}
    for rows in (edges, edges[::-1]):
        df = spark.createDataFrame(rows, "from_id string, to_id string, rel_type string")
        assert {tuple(r) for r in G.collapse_edges(df).collect()} == want


def exchanges(df):
    return str(df._jdf.queryExecution().optimizedPlan()), df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_relations_are_collapsed_in_one_exchange(spark):
    columns = "edge_id long, from_id string, to_id string, rel_type string, notes string, created_at timestamp"
    old = spark.createDataFrame([(1, "a", "b", "mentioned", None, None), (2, "b", "a", "knows", None, None), (3, "c", "d", "mentioned", None, None), (3, "c", "d", "mentioned", None, None), (4, "c", "d", "owns", None, None)], columns)
    new = spark.createDataFrame([(5, "a", "b", "knows", "x", None), (6, "b", "a", "knows", None, None)], columns)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = G.relate_collapsing(old, new)
        assert exchanges(made)[1] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.edge_id for r in made.collect()) == [3, 3, 4, 5, 6]


def test_reports_of_a_reconciliation_shuffle_no_contents(spark):
    from loreloom.plans.graph_queries import _vault
    from loreloom.plans.registry import Base

    tables = _vault(Base(spark, "/root/testdata/sf0.001"))
    assert all(t.inputFiles() for t in tables) and len({tuple(sorted(t.inputFiles())) for t in tables}) == 1
    plan = Y.sync_decisions(*tables).groupBy("action").count()._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("LogicalRDD") if "LogicalRDD" in plan else plan.index("Relation")]
    assert "min_by(content" not in above


def test_deleted_rows_are_nowhere(spark):
    own = entities(spark, [{"id": f"npc:{i}", "name": "Same", "vault_deleted": d} for i, d in enumerate((None, False, True))])
    assert {r.id for r in S.live(own).collect()} == {"npc:0", "npc:1"}
    assert [(r.a, r.b) for r in N.duplicate_entities(own).collect()] == [("npc:0", "npc:1")]
    assert [(r.a, r.b) for r in N.alias_collisions(own).collect()] == [("npc:0", "npc:1")]


def test_merge_follows_chains(spark):
    spark.sparkContext.setCheckpointDir("/tmp/spark-tests")
    merges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "loser string, survivor string")
    assert {tuple(r) for r in N.final_survivors(merges).collect()} == {("a", "c"), ("b", "c")}


def test_merged_findings_meet_their_parties_by_keys(spark):
    spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
    entities = spark.createDataFrame([Row(id=i, kind="npc", name=i, aliases=[], summary=None, notes=None, codex_stale=False, vault_deleted=None, collection_id="c", campaign_id=None) for i in "abcd"], "id string, kind string, name string, aliases array<string>, summary string, notes string, codex_stale boolean, vault_deleted boolean, collection_id string, campaign_id string")
    edges = spark.createDataFrame([], "edge_id long, from_id string, to_id string, rel_type string, notes string, created_at timestamp")
    findings = spark.createDataFrame([("1", ["a", "b"], False), ("2", ["c"], False), ("3", None, False), ("4", ["b", "b"], True), ("5", [], False)], "id string, parties array<string>, resolved boolean")
    merges = spark.createDataFrame([("b", "a")], "loser string, survivor string")
    collections, subs = spark.createDataFrame([], "id string, name string, owner_campaign string"), spark.createDataFrame([], "campaign_id string, collection_id string")
    after = N.merge_entities(entities, edges, findings, merges, collections, subs)["findings"]
    assert {r.id: r.resolved for r in after.collect()} == {"1": True, "2": False, "3": False, "4": True, "5": False}
    assert "NestedLoop" not in after._jdf.queryExecution().executedPlan().toString()


def test_citations_meet_each_page_once(spark):
    sources = spark.createDataFrame([("s", "f.pdf"), ("t", "f.pdf"), ("u", "g.pdf")], "id string, filename string")
    spans = [("s", "a", 1, 2), ("s", "b", 2, 9), ("t", "c", 2, 4), ("s", "bad", 5, 3), ("u", "d", 7, 7), ("s", "open", 1, None)]
    chunks = spark.createDataFrame(spans, "source_id string, chunk_id string, page_start long, page_end long")
    asked = [(i, f, p) for i, (f, p) in enumerate([("f.pdf", 1), ("f.pdf", 2), ("f.pdf", 3), ("f.pdf", 9), ("f.pdf", 10), ("f.pdf", None), ("g.pdf", 6), ("g.pdf", 7), ("none", 1), (None, 1)])]
    found = S.resolve_citations(spark.createDataFrame(asked, "citation_id long, source_name string, page long"), sources, chunks)
    assert [r.chunk_id for r in found.orderBy("citation_id").collect()] == ["a", "a", "b", "b", None, "a", None, "d", None, None]

    # no row for each pair of a chunk and a citation of one source
    joins = [line for line in S.resolve_citations(spark.createDataFrame(asked, "citation_id long, source_name string, page long"), sources, chunks)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
    assert joins and not any("page_end" in line or "page_start" in line for line in joins)



def test_decisions_are_total(spark):
    rows = [(b, t, f) for b in (None, "x", "y") for t in ("x", "y") for f in (None, "x", "y")]
    df = spark.createDataFrame(rows, "b string, t string, f string")
    got = {(r.b, r.t, r.f): r.a for r in df.select("*", Y.decide(F.col("b"), F.col("t"), F.col("f")).alias("a")).collect()}
    assert set(got.values()) <= set(Y.ACTIONS) and len(got) == 18
    assert got[None, "x", None] == "export" and got["x", "x", None] == "soft_delete" and got[None, "x", "x"] == "adopt_base"
    assert got["x", "x", "x"] == "noop" and got["x", "y", "x"] == "export" and got["x", "x", "y"] == "apply" and got[None, "x", "y"] == "conflict"


def test_files_round_trip(spark, tmp_path):
    rows = [("npc:1", "npc", 'Al "x" \\ y', "campaign", "campaign:1", "Höhle", None, "Sum", "Body [[z]]", "Notes\nmore"), ("npc:2", "npc", "B", "campaign", "campaign:1", "Höhle", None, None, None, None)]
    records = spark.createDataFrame(rows, "record string, type string, name string, scope_kind string, scope_id string, scope_name string, number long, summary string, fenced string, notes string")
    made = Y.render_records(Y.file_keys(records))
    assert vault.write_files(made, str(tmp_path / "v")) == 2
    back = {r.record: r for r in vault.scan_vault(spark, str(tmp_path / "v")).collect()}
    assert back["npc:1"].key == "campaigns/höhle/entities/npc/al-x-y.md"
    assert (back["npc:1"].name, back["npc:1"].summary, back["npc:1"].fenced, back["npc:1"].notes) == ('Al "x" \\ y', "Sum", "Body [[z]]", "Notes\nmore")
    assert (back["npc:2"].summary, back["npc:2"].fenced, back["npc:2"].notes) == (None, None, None)
    files = spark.createDataFrame([(r.key, r.record, r.content) for r in back.values()], "key string, record string, content string")
    state = files.select("record", "key", T.content_hash(F.col("content")).alias("synced_hash"), F.lit(False).alias("conflict"))
    report = {r.counter: r.n for r in Y.reconcile(made.select("record", "key", "name", "content"), files, state)["report"].collect()}
    assert report == dict.fromkeys(A.COUNTERS, 0) | {"unchanged": 2}


def test_citations(spark):
    text = 'A [Source: "PHB", p.45-49, quote: "Be bold."] b [Source: "DMG"] tail text'
    df = spark.createDataFrame([(1, text)], "id int, content string")
    got = [(r.source_name, r.page, r.text_excerpt) for r in X.parse_citations(df).orderBy("place").collect()]
    assert got == [("PHB", 45, "Be bold."), ("DMG", None, "tail text")]


def test_tolerant_parsing(spark):
    good = '{"entities":[{"name":" A ","kind":"npc"},{"name":"B","kind":"ghost"}]}'
    rows = [("c", 0, f"```json\n{good}\n```"), ("c", 1, good[:20]), ("c", 2, "nothing")]
    df = spark.createDataFrame(rows, "collection_id string, batch int, response string")
    assert {(r.batch, r.name, r.kind) for r in R.parse_extraction(df).collect()} == {(0, "A", "npc"), (0, "B", "misc")}


def packed(texts, target=1000, overlap=200):
    out, i = [], 0
    while i < len(texts):
        j, text = i, ""
        while j < len(texts) and (not text or len(text) + 1 + len(texts[j]) <= target):
            text, j = f"{text} {texts[j]}" if text else texts[j], j + 1
        out.append(text)
        if j >= len(texts):
            break
        n, size = j, 0
        while n > i + 1 and size < overlap:
            n -= 1
            size += len(texts[n])
        i = max(n, i + 1)
    return out


def test_chunks_are_packed_in_order(spark):
    random.seed(5)
    docs = [" ".join("Ab" + "x" * random.randint(0, 400) + "." for _ in range(random.randint(0, 40))) for _ in range(30)]
    df = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    sentences, chunks = {}, {}
    for r in C.split_sentences(df).orderBy("doc_id", "ordinal").collect():
        assert docs[r.doc_id][r.start :].startswith(r.sentence)
        sentences.setdefault(r.doc_id, []).append(r.sentence)
    for r in C.chunk_documents(df).orderBy("doc_id", "ordinal").collect():
        chunks.setdefault(r.doc_id, []).append(r.text)
    assert chunks == {k: packed(v) for k, v in sentences.items()}


def test_chunks_are_made_where_documents_are(spark):
    docs = spark.createDataFrame([(1, "Combat Rules\n\nFirst. " + "Word after word goes on. " * 90), (None, "Of no id."), (2, " \n "), (3, None)], "doc_id long, text string")
    made = C.chunk_documents(docs)
    assert exchanges(made)[1] == 0
    rows = made.orderBy("doc_id", "ordinal").collect()
    assert [(r.doc_id, r.ordinal) for r in rows] == [(None, 0), (1, 0), (1, 1), (1, 2)]
    assert [r.section_heading for r in rows] == ["", *["Combat Rules"] * 3] and all(r.end == r.start + len(r.text) for r in rows)


def test_chunk_pages_and_headings(spark):
    pages = spark.createDataFrame([(1, 1, "Combat Rules\n\nFirst text here."), (1, 2, "Second page here.")], "doc_id long, page_num int, text string")
    got = C.chunk_documents(C.assemble_documents(pages)).collect()
    assert [(r.page_start, r.page_end, r.section_heading) for r in got] == [(1, 2, "Combat Rules")]


def test_knn_filters_first(spark):
    index = spark.createDataFrame([("a", "c", [1.0, 0.0]), ("b", "d", [1.0, 0.0]), ("e", "c", [0.0, 1.0]), ("f", "c", None)], "item_id string, collection_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0])], "query_id int, embedding array<double>")
    scopes = spark.createDataFrame([(1, "c")], "query_id int, collection_id string")
    for bound in (0, 100):
        got = V.knn(asked, index, scopes, 5, broadcast_numbers=bound).orderBy("rank").collect()
        assert [(r.query_id, r.item_id) for r in got] == [(1, "a"), (1, "e")]


def test_batches_and_runs(spark):
    df = spark.createDataFrame([("c", i, "x" * n) for i, n in enumerate((7, 7, 30, 1))], "collection_id string, place long, text string")
    assert [r.batch for r in A.batch_passages(df, budget=16).orderBy("place").collect()] == [0, 0, 1, 2]


EVENTS = [("k", 0.0, "own_write", "h"), ("k", 1.0, "upsert", "h"), ("k", 2.0, "upsert", "h"), ("k", 40.0, "upsert", "h"), ("k", 50.0, "own_delete", None), ("k", 51.0, "remove", None), ("k", 52.0, "remove", None), ("j", 1.0, "upsert", "h")]


def test_echoes_in_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "key string, s double, kind string, hash string").select("key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "kind", "hash")
    want = {("k", "upsert"): 1, ("k", "remove"): 1, ("j", "upsert"): 1}
    count = lambda rows: {k: sum((r["key"], r["kind"]) == k for r in rows) for k in {(r["key"], r["kind"]) for r in rows}}
    assert count(ST.suppress_echo(df).collect()) == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = ST.suppress_echo(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    job = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert count(spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_stream_ingest_twice_changes_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "One. Two."), (2, "Three.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    seen = []
    job = ST.stream_ingest(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), C.chunk_documents, lambda df: seen.append(df.count()), str(tmp_path / "cp"), once=True)
    job.awaitTermination(120)
    assert sum(seen) == 2


def test_exports_are_coalesced(spark, tmp_path):
    spark.createDataFrame([("a",), ("a",), ("b",)], "record string").write.parquet(str(tmp_path / "in"))
    seen = []
    job = ST.stream_exports(spark.readStream.schema("record string").parquet(str(tmp_path / "in")), lambda df: seen.extend(r.record for r in df.collect()), str(tmp_path / "cp"), once=True)
    job.awaitTermination(120)
    assert sorted(seen) == ["a", "b"]


def test_state_versions(spark, tmp_path):
    state = spark.createDataFrame([Row(record="npc:1", key="k", synced_hash="h", conflict=False)])
    vault.snapshot_state(state, str(tmp_path / "s"), 1)
    assert vault.restore_state(spark, str(tmp_path / "s"), 1).count() == 1
    assert [tuple(r) for r in vault.list_states(spark, str(tmp_path / "s")).collect()] == [(1, 1)]
    with pytest.raises(Exception):
        vault.snapshot_state(state, str(tmp_path / "s"), 1)


def test_notes_of_a_campaign_are_made_once(spark, monkeypatch):
    """However many questions a campaign has, its entities come once; every question gets its campaign's notes."""
    from loreloom.operators import context as X
    from loreloom.plans import retrieval

    made, seen = X.entity_context, []
    monkeypatch.setattr(X, "entity_context", lambda own, told, hits, by="query_id": seen.append((own.count(), told.count(), hits.count())) or made(own, told, hits, by))
    questions = spark.createDataFrame([(f"q{i}", ["c1", "c2", None][i % 3], [1.0, 0.0], "en", "why") for i in range(30)], "query_id string, campaign_id string, embedding array<double>, language string, text string")
    subs = spark.createDataFrame([("c1", "k1")], "campaign_id string, collection_id string")
    entities = spark.createDataFrame([("e1", "npc", "Ada", "c1", None, None), ("e2", "npc", "Bo", "c2", None, None), ("e3", "npc", "Cy", None, "k1", None)], "id string, kind string, name string, campaign_id string, collection_id string, vault_deleted boolean")
    sessions = spark.createDataFrame([("s1", "c1", 1, "Start", None, None, None)], "id string, campaign_id string, session_number int, title string, date_played string, notes string, vault_deleted boolean")
    rules = spark.createDataFrame([], "item_id string, collection_id string, embedding array<double>, vault_deleted boolean, name string, category string, body string, notes string, page_refs array<struct<source_name:string,page_start:long,page_end:long>>")
    chunks = spark.createDataFrame([], "item_id string, source_id string, collection_id string, embedding array<double>, text string, page_start long, page_end long, section_heading string, source_type string")
    sources = spark.createDataFrame([], "id string, filename string, display_name string, collection_id string, source_type string")
    got = {r.query_id: r.entity_context or "" for r in retrieval.retrieve(questions, subs, entities, sessions, rules, chunks, sources).select("query_id", "entity_context").collect()}
    assert seen == [(2, 1, 1)] and len(got) == 30
    for i in range(30):
        text = got[f"q{i}"]
        assert [x in text for x in ("Ada", "Bo", "Cy", "Start")] == [[True, False, True, True], [False, True, False, False], [False] * 4][i % 3]


def test_layout_packs_glyphs(spark):
    """Pages whose glyphs lie scattered are laid out whole, and where they lie together no row a glyph is shuffled."""
    text = ["Head", "\n", *"body one", "\r", "\r", *"next ", None, *"tail"]
    rows = [(d, p, i, ch, 14.0 if ch == "Head" else 10.0, None, 0.0) for d in (1, 2) for p in (1, 2) for i, ch in enumerate(text)] + [(3, 1, 0, "\n", 10.0, False, 0.0), (None, 1, 0, "x", 10.0, False, 0.0)]
    schema = "doc_id long, page_num int, pos int, ch string, font_size double, is_bold boolean, y double"
    want = {(d, p): "Head\n\nbody one\nnext \ntail\n" for d in (1, 2) for p in (1, 2)}
    for glyphs in (spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame(rows[::-1], schema).repartition(7)):
        assert {(r.doc_id, r.page_num): r.text for r in C.layout_pages(glyphs).collect()} == want
    assert C._runs(spark.createDataFrame(rows, schema).coalesce(1), ["doc_id", "page_num"]).count() == 5


def test_glyphs_of_a_line_are_shuffled_as_its_text(spark):
    """Ligatures, empty and unknown glyphs keep their places, and a line of like glyphs is one run."""
    from loreloom.operators import chunking as C

    rows = [(1, 1, 10 * n + i, ch, 10.0, False, -12.0 * n) for n, line in enumerate(("plain text", "more of it")) for i, ch in enumerate(line)]
    rows += [(2, 1, i, ch, 10.0, None if i == 2 else False, 0.0) for i, ch in enumerate(["o", "ffi", "c", "", "e"])] + [(2, 1, 5, None, 10.0, False, 0.0), (2, 1, None, "x", None, False, 0.0)]
    glyphs = spark.createDataFrame(rows, "doc_id long, page_num int, pos long, ch string, font_size double, is_bold boolean, y double").coalesce(1)
    packed = {r.doc_id: r for r in C._runs(glyphs, ["doc_id", "page_num"]).collect()}
    assert packed[1].text == ["plain text", "more of it"] and packed[1].sizes == [None, None] and packed[1].pos == [0, 10]
    assert packed[2].text == ["offi", "c", "e\r", "x"] and packed[2].sizes == [[1, 3], None, [0, 1, 1], None]
    for parts in (1, 4):
        assert {r.doc_id: r.text for r in C.layout_pages(glyphs.repartition(parts)).collect()} == {1: "plain text\nmore of it\n", 2: "xoffice\n"}


def test_recall_cuts_up_again_what_was_found_only(spark, monkeypatch):
    """The second time, only documents of the five chunks found for each question are cut up."""
    from loreloom.plans import text_queries
    from loreloom.plans.registry import Base

    cut, seen = text_queries.C.chunk_documents, []
    monkeypatch.setattr(text_queries.C, "chunk_documents", lambda docs: seen.append(docs) or cut(docs))
    kb = Base(spark, "/root/testdata/sf0.001")
    text_queries.v11(kb)
    assert len(seen) == 2 and "rank" in seen[1].schema["doc_id"].dataType.fieldNames()
