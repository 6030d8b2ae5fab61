"""Tables and Markdown files in step: a three-way comparison with the last synchronised state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as T

from .aggregates import action_report, assign_keys
from .scopes import KINDS

# The parts of a file's body.
FENCE_START, FENCE_END = "<!-- codex:begin -->", "<!-- codex:end -->"
SUMMARY, NOTES = "## Summary", "## Notes"

ACTIONS = ("noop", "adopt_base", "export", "apply", "conflict", "soft_delete")


def decide(base: Column, table: Column, file: Column) -> Column:
    """What to do with a record, from the hashes of the last state, of the record and of its file; null: there is none."""
    return (
        F.when(file.isNull(), F.when(base.isNull(), "export").otherwise("soft_delete"))
        .when(table.eqNullSafe(file), F.when(base.eqNullSafe(table), "noop").otherwise("adopt_base"))
        .when(base.isNull(), "conflict")
        .when(file == base, "export")
        .when(table == base, "apply")
        .otherwise("conflict")
    )


def sync_decisions(records: DataFrame, files: DataFrame, state: DataFrame) -> DataFrame:
    """(record, key, content, file_key, file_content, base_hash, table_hash, file_hash, was_conflict, action).

    records: record, key, content; files: key, record (null if unreadable), content; state: record, key, synced_hash,
    conflict.
    """
    # contents are hashed where they are, and go through the joins only for who reads them
    hashed = files.filter("record is not null").withColumn("file_hash", T.content_hash(F.col("content")))
    first = F.struct("key", "file_hash")
    found = hashed.groupBy("record").agg(F.min("key").alias("file_key"), F.min_by("content", first).alias("file_content"), F.min_by("file_hash", first).alias("file_hash"))
    known = state.select("record", F.col("synced_hash").alias("base_hash"), F.coalesce("conflict", F.lit(False)).alias("was_conflict"))
    wide = records.select("record", "key", "content", T.content_hash(F.col("content")).alias("table_hash")).join(found, "record", "left").join(known, "record", "left")
    wide = wide.withColumn("was_conflict", F.coalesce("was_conflict", F.lit(False))).select("record", "key", "content", "file_key", "file_content", "base_hash", "was_conflict", "table_hash", "file_hash")
    return wide.withColumn("action", decide(F.col("base_hash"), F.col("table_hash"), F.col("file_hash")))


def quote(value: Column) -> Column:
    clean = T.sanitize_scalar(value)
    return F.concat(F.lit('"'), F.replace(F.replace(clean, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def file_aliases(name: Column, aliases: Column) -> Column:
    """The name, then the aliases, each once whatever its ASCII case."""
    every = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    folded = F.transform(every, lambda a: T.ascii_lower(a))
    return F.filter(every, lambda a, i: F.array_position(folded, T.ascii_lower(a)) == i + 1)


def render_records(records: DataFrame) -> DataFrame:
    """records of sync_records (with optional aliases, category, date_played, created_at, updated_at) with `content`."""
    own = records.withColumns({c: F.lit(None).cast("string") for c in ("category", "date_played", "created_at", "updated_at") if c not in records.columns})
    if "aliases" not in own.columns:
        own = own.withColumn("aliases", F.array().cast("array<string>"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value)
    entity = F.col("type").isin(*KINDS)
    session = F.col("type") == "session"
    names = F.concat(F.lit("["), F.array_join(F.transform(file_aliases(F.col("name"), F.col("aliases")), quote), ", "), F.lit("]"))
    lines = [
        line("id", quote(F.col("record"))),
        F.when(~session, line("name", quote(F.col("name")))),
        line("title", quote(F.col("name"))),
        line("aliases", names),
        F.when(entity, line("type", quote(F.col("type")))),
        F.when(F.col("scope_kind") == "campaign", line("campaign", quote(F.col("scope_name")))),
        F.when(F.col("scope_kind") == "collection", line("collection", quote(F.col("scope_name")))),
        line("category", quote(F.col("category"))),
        F.when(session, line("session_number", F.col("number").cast("string"))),
        F.when(session, line("date_played", quote(F.coalesce("date_played", F.lit(""))))),
        line("created_at", quote(F.coalesce("created_at", F.lit("")))),
        line("updated_at", quote(F.coalesce("updated_at", F.lit("")))),
    ]
    parts = F.concat_ws("\n\n", F.concat(F.lit(f"{SUMMARY}\n\n"), "summary"), F.concat(F.lit(f"{FENCE_START}\n"), "fenced", F.lit(f"\n{FENCE_END}")), F.concat(F.lit(f"{NOTES}\n\n"), "notes"))
    body = F.when(parts == "", "").otherwise(F.concat(F.lit("\n"), parts, F.lit("\n")))
    content = F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), body)
    return own.withColumn("content", content).select(*records.columns, "content")


def parse_vault_files(files: DataFrame) -> DataFrame:
    """files (key, content) with record, name, title, aliases, summary, fenced and notes; record is null where the front
    matter can't be read or has no id.

    The body's fenced part is cut out first, then a leading summary, then a leading notes heading; all else is notes.
    """
    text = F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n"))
    front = F.regexp_extract(text, r"^---\n((?s:.*?))\n---(?:\n|$)", 1)
    body = F.regexp_replace(text, r"^---\n(?s:.*?)\n---(?:\n|$)", "")
    scalar = lambda key: T.nonblank(F.replace(F.replace(F.regexp_extract(front, rf'(?m)^{key}: *"?((?:[^"\\\n]|\\.)*)"? *$', 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\")))
    listed = F.regexp_extract_all(F.regexp_extract(front, r"(?m)^aliases: *\[(.*)\] *$", 1), F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    fence = rf"(?s){FENCE_START}(.*?){FENCE_END}"
    out = files.withColumns({"_body": F.regexp_replace(body, fence.replace("(.*?)", ".*?"), ""), "record": scalar("id"), "name": scalar("name"), "title": scalar("title"), "aliases": F.transform(listed, lambda a: F.replace(F.replace(a, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))), "fenced": F.when(body.rlike(fence), T.strip(F.regexp_extract(body, fence, 1)))})
    head = rf"^\s*{SUMMARY}\n((?s:.*?))(?=(?:(?<=\n)## )|\z)"
    out = out.withColumns({"summary": T.nonblank(T.strip(F.regexp_extract("_body", head, 1))), "_rest": F.when(F.col("_body").rlike(rf"^\s*{SUMMARY}\n"), F.regexp_replace("_body", head, "")).otherwise(F.col("_body"))})
    notes = T.nonblank(T.strip(F.regexp_replace("_rest", rf"^\s*{NOTES}(?:\n|\z)", "")))
    return out.withColumn("notes", notes).drop("_body", "_rest")


def scope_folder(kind: Column, scope_id: Column, name: Column, collides: Column) -> Column:
    return F.concat(kind, F.lit("s/"), T.slug(name), F.when(collides, F.concat(F.lit("-"), F.substring_index(scope_id, ":", -1))).otherwise(""))


def file_keys(records: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """records of sync_records with `key`: folder of the scope, kind and name; colliding ones get their ids. A record that
    has a file already, in index (record, key), keeps its key."""
    scopes = records.select("scope_kind", "scope_id", T.slug(F.col("scope_name")).alias("_slug")).distinct()
    shared = scopes.groupBy("scope_kind", "_slug").count().filter("count > 1").select("scope_kind", "_slug", F.lit(True).alias("_c"))
    own = records.withColumn("_slug", T.slug(F.col("scope_name"))).join(shared, ["scope_kind", "_slug"], "left")
    folder = scope_folder(F.col("scope_kind"), F.col("scope_id"), F.col("scope_name"), F.coalesce("_c", F.lit(False)))
    number = F.lpad(F.col("number").cast("string"), 3, "0")
    number = F.when(F.length(F.col("number").cast("string")) > 3, F.col("number").cast("string")).otherwise(number)
    path = F.when(F.col("type") == "session", F.concat(F.lit("sessions/"), number, F.lit("-"))).when(F.col("type") == "rule_entry", F.lit("rules/")).otherwise(F.concat(F.lit("entities/"), "type", F.lit("/")))
    named = assign_keys(own.withColumn("key", F.concat(folder, F.lit("/"), path, T.slug(F.col("name")), F.lit(".md")))).drop("_slug", "_c")
    if index is None:
        return named
    return named.join(index.select("record", F.col("key").alias("_k")), "record", "left").withColumn("key", F.coalesce("_k", "key")).drop("_k")


def is_managed(key: Column) -> Column:
    """Whether a file's key is one of those that records can have."""
    kinds = "|".join(KINDS)
    shape = rf"^(campaigns|collections)/[^/]+/(entities/({kinds})|sessions|rules)/[^/]+\.md$"
    wrong = key.rlike(r"^campaigns/[^/]+/rules/|^collections/[^/]+/sessions/") | key.rlike(r"\.conflict(\.[^/]*)?\.md$") | key.rlike(r"(^|/)\.\.(/|$)")
    return key.rlike(shape) & ~wrong


def sidecar_key(key: Column) -> Column:
    return F.concat(F.regexp_replace(key, r"\.md$", ""), F.lit(".conflict.md"))


def conflict_actions(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """decisions with `step`, what becomes of conflicts.

    A new conflict writes a sidecar with the record's text and freezes the record. While frozen: with the sidecar there it
    is refreshed; without it the file has been settled and is applied, unless it can't be read, which restores the sidecar;
    and where both sides agree again the record is freed.
    """
    sidecars = files.select(F.col("key").alias("_side"), F.lit(True).alias("sidecar"))
    readable = files.select(F.col("key").alias("_own"), F.col("record").isNotNull().alias("readable"))
    wide = decisions.withColumns({"_side": sidecar_key(F.coalesce("file_key", "key")), "_own": F.coalesce("file_key", "key")}).join(sidecars, "_side", "left").join(readable, "_own", "left")
    has, ok = F.coalesce("sidecar", F.lit(False)), F.coalesce("readable", F.lit(False))
    step = (
        F.when(~F.col("was_conflict"), F.when(F.col("action") == "conflict", "freeze").otherwise(F.col("action")))
        .when(F.col("table_hash").eqNullSafe(F.col("file_hash")), "unfreeze")
        .when(has, "refresh")
        .when(ok, "resolve")
        .otherwise("restore")
    )
    return wide.withColumn("step", step).drop("_side", "_own", "sidecar", "readable")


def orphan_sweep(state: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """(record, key, delete_file, sidecar): state rows without a live record. The file goes only if it is as we wrote it;
    the sidecar always goes."""
    gone = state.join(records.select("record"), "record", "left_anti")
    now = files.select("key", T.content_hash(F.col("content")).alias("_h"))
    return gone.join(now, "key", "left").select("record", "key", F.coalesce(F.col("_h") == F.col("synced_hash"), F.lit(False)).alias("delete_file"), sidecar_key(F.col("key")).alias("sidecar"))


def export_refs(refs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(record, key, content): of the given records those whose files can be written: not frozen, and the file as we wrote
    it, as the record has it, or never written."""
    own = decisions.join(refs.select("record").distinct(), "record", "left_semi").filter("not was_conflict")
    ours = F.col("file_hash").isNull() & F.col("base_hash").isNull() | F.coalesce(F.col("file_hash") == F.col("base_hash"), F.lit(False)) | F.coalesce(F.col("file_hash") == F.col("table_hash"), F.lit(False))
    return own.filter(ours).select("record", F.coalesce("file_key", "key").alias("key"), "content")


def apply_inbound(actions: DataFrame, parsed: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities with the files' parts, unreadable records) for actions (record) to apply.

    A file's parts are the complete state: what it leaves out is cleared. The record's own name is no alias; it turns stale.
    """
    parts = parsed.filter("record is not null").select(F.col("record").alias("id"), F.col("name").alias("_n"), F.col("aliases").alias("_a"), F.col("summary").alias("_s"), F.col("notes").alias("_t"), F.lit(True).alias("_hit"))
    asked = actions.select(F.col("record").alias("id")).distinct()
    joined = entities.join(asked.join(parts, "id"), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    name = F.coalesce("_n", "name")
    put = {
        "name": F.when(hit, name).otherwise(F.col("name")),
        "aliases": F.when(hit, F.filter(F.coalesce("_a", F.array().cast("array<string>")), lambda a: T.ascii_lower(a) != T.ascii_lower(name))).otherwise(F.col("aliases")),
        "summary": F.when(hit, F.col("_s")).otherwise(F.col("summary")),
        "notes": F.when(hit, F.col("_t")).otherwise(F.col("notes")),
        "codex_stale": F.when(hit, True).otherwise(F.col("codex_stale")),
    }
    return joined.withColumns(put).select(entities.columns), asked.join(parts, "id", "left_anti").select(F.col("id").alias("record"))


def list_conflicts(state: DataFrame, records: DataFrame) -> DataFrame:
    """(record, key, name) of frozen records that still exist."""
    return state.filter("conflict").join(records.select("record", "name"), "record").select("record", "key", "name")


def reconcile(records: DataFrame, files: DataFrame, state: DataFrame) -> dict[str, DataFrame]:
    """One full pass over records (record, key, content, name), files (key, record, content) and state.

    writes (key, content), deletes (key), applies (record), soft_deletes (record), state, and report (counter, n). The
    new state belongs to the files after the writes, so it is to be stored last.
    """
    steps = conflict_actions(sync_decisions(records, files, state), files)
    swept = orphan_sweep(state, records, files)
    target = F.coalesce("file_key", "key")
    writes = steps.filter(F.col("step") == "export").select(target.alias("key"), "content")
    writes = writes.union(steps.filter(F.col("step").isin("freeze", "refresh", "restore")).select(sidecar_key(target), "content"))
    deletes = swept.filter("delete_file").select("key").union(swept.join(files.select(F.col("key").alias("sidecar")), "sidecar", "left_semi").select("sidecar"))
    deletes = deletes.union(steps.filter("step = 'unfreeze'").select(sidecar_key(target).alias("sidecar")).join(files.select(F.col("key").alias("sidecar")), "sidecar", "left_semi"))
    settled = F.when(F.col("step").isin("export", "adopt_base", "noop", "unfreeze"), F.col("table_hash")).when(F.col("step").isin("apply", "resolve"), F.col("file_hash")).otherwise(F.col("base_hash"))
    after = steps.filter("step <> 'soft_delete'").select("record", target.alias("key"), settled.alias("synced_hash"), F.col("step").isin("freeze", "refresh", "restore").alias("conflict"))
    return {
        "writes": writes,
        "deletes": deletes,
        "applies": steps.filter(F.col("step").isin("apply", "resolve")).select("record"),
        "soft_deletes": steps.filter("step = 'soft_delete'").select("record"),
        "state": after,
        "report": action_report(steps.select(F.col("step").alias("action")).union(swept.select(F.lit("sweep")))),
    }
