"""Queries on text: repair, headings, sentences, chunks, languages, names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as T
from loreloom.operators import chunking as C
from loreloom.operators import names as N
from loreloom.operators import scopes as S
from loreloom.operators import vectors as V

from .registry import LIVE, Base, query, sql_key


REPAIRED_SQL = r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(1), ' '), '\n{2,}', chr(1), 'g'), '\n', ' ', 'g'), '\s+', ' ', 'g'), ' *' || chr(1), chr(10) || chr(10), 'g'), ' ' || chr(10)) AS text FROM documents"""

#: Whether the trimmed line l of w words is a heading.
HEADING_SQL = r"""    WHERE l <> '' AND NOT (regexp_matches(l, '[.!?]$') AND w > 3) AND (
        regexp_matches(l, '(?i)^(chapter|part|section|appendix)\s+\S+') OR regexp_matches(l, '^\d+(?:\.\d+)*[.)]?\s+\p{Lu}') OR (w <= 15 AND regexp_matches(l, '^[\p{Lu}\s\d''\-.!?/:;]{2,}$'))
        OR (NOT regexp_matches(l, '[.!?]$') AND w <= 10 AND (w > 1 OR length(l) >= 3)
            AND list_bool_and(list_transform(string_split(regexp_replace(l, '\s+', ' ', 'g'), ' '), lambda x: lower(x) IN ('a','an','the','and','or','of','in','on','at','to','for','with','by','from','into','onto','as','but','nor','vs') OR regexp_matches(x, '^\p{Lu}')))
            AND list_bool_or(list_transform(string_split(regexp_replace(l, '\s+', ' ', 'g'), ' '), lambda x: lower(x) NOT IN ('a','an','the','and','or','of','in','on','at','to','for','with','by','from','into','onto','as','but','nor','vs'))))
    )"""


#: The sentence-break class of a character x, of those that the rules name.
CLASS_SQL = r"""CASE WHEN x = chr(13) THEN 'C' WHEN x = chr(10) THEN 'L' WHEN unicode(x) IN (133, 8232, 8233) THEN 'P' WHEN regexp_matches(x, '^[\p{M}\x{200D}]$') THEN 'E' WHEN regexp_matches(x, '^\p{Cf}$') THEN 'F'
    WHEN unicode(x) IN (9, 11, 12) OR regexp_matches(x, '^\p{Zs}$') THEN 'S' WHEN regexp_matches(x, '^[\p{Ll}ªº]$') THEN 'l' WHEN regexp_matches(x, '^[\p{Lu}\p{Lt}]$') THEN 'U' WHEN regexp_matches(x, '^[\p{L}\p{Nl}]$') THEN 'O' WHEN regexp_matches(x, '^\p{Nd}$') THEN 'N'
    WHEN regexp_matches(x, '^[.․﹒．]$') THEN 'A' WHEN regexp_matches(x, '^[!?։؟۔।॥‼‽⁇⁈⁉。！？｡]$') THEN 'T' WHEN regexp_matches(x, '^[,:;՝،–—、，：；､-]$') THEN 'c' WHEN regexp_matches(x, '^[\p{Ps}\p{Pe}\p{Pi}\p{Pf}"\x27]$') THEN 'X' ELSE 'o' END"""


def sentences_sql(docs: str) -> str:
    """CTEs up to sent (doc_id, ordinal, start, sentence) of a statement for (doc_id, text): each character's class, then for
    each place between characters the terminator before it, if only closing marks and spaces are in between, and the next
    letter after it. Extenders go with the character before them."""
    return rf"""docs AS ({docs}), letters AS (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(regexp_extract_all(text, '(?s).')) AS x FROM docs),
        classes AS (SELECT x, {CLASS_SQL} AS c FROM (SELECT DISTINCT x FROM letters)),
        kept AS (SELECT doc_id, i, c, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM letters l JOIN classes USING (x) WHERE c NOT IN ('E', 'F')),
        seen AS (SELECT *, lead(i) OVER w AS pos, lead(c) OVER w AS next, lag(c) OVER w AS before, max(CASE WHEN c <> 'S' THEN k END) OVER w AS word, max(CASE WHEN c <> 'X' THEN k END) OVER w AS solid,
            first_value(CASE WHEN c IN ('O', 'U', 'l', 'P', 'C', 'L', 'A', 'T') THEN c END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS letter
            FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY k)),
        ended AS (SELECT a.doc_id, a.pos, a.k, a.c, a.next, a.letter, a.word, r.k AS stop, r.c AS how, r.before
            FROM seen a JOIN seen q ON q.doc_id = a.doc_id AND q.k = a.word JOIN seen r ON r.doc_id = a.doc_id AND r.k = q.solid WHERE a.pos IS NOT NULL AND a.c IN ('S', 'X', 'A', 'T')),
        bounds AS (SELECT doc_id, 1 AS pos FROM docs WHERE text <> '' UNION ALL SELECT doc_id, pos FROM seen WHERE pos IS NOT NULL AND c IN ('P', 'C', 'L') AND NOT (c = 'C' AND next = 'L')
            UNION ALL SELECT doc_id, pos FROM ended WHERE how IN ('A', 'T') AND next NOT IN ('c', 'A', 'T', 'P', 'C', 'L', 'S') AND NOT (next = 'X' AND word = k)
                AND NOT (how = 'A' AND (letter IS NOT DISTINCT FROM 'l' OR stop = k AND next = 'N' OR stop = k AND next = 'U' AND before IN ('U', 'l')))),
        cuts AS (SELECT b.doc_id, pos, lead(pos) OVER (PARTITION BY b.doc_id ORDER BY pos) AS stop, row_number() OVER (PARTITION BY b.doc_id ORDER BY pos) - 1 AS ordinal FROM bounds b),
        pieces AS (SELECT d.doc_id, ordinal, substring(text, CAST(pos AS BIGINT), CAST(coalesce(stop, length(text) + 1) - pos AS BIGINT)) AS piece FROM cuts c JOIN docs d ON d.doc_id = c.doc_id),
        located AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM pieces),
        sent AS (SELECT doc_id, ordinal, CAST(a + length(piece) - length(regexp_replace(piece, '^\s+', '')) AS BIGINT) AS start, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS sentence FROM located WHERE trim(piece, ' ' || chr(10) || chr(9)) <> '')"""


def headings_sql(docs: str) -> str:
    """(doc_id, start, heading) of a statement for (doc_id, text)."""
    return rf"""SELECT doc_id, start, l AS heading FROM (SELECT doc_id, start, trim(line) AS l, len(string_split(regexp_replace(trim(line), '\s+', ' ', 'g'), ' ')) AS w FROM (
        SELECT doc_id, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM ({docs})))) {HEADING_SQL}"""


def chunks_sql(docs: str, pages: str) -> str:
    """A statement for chunks, by a walk from chunk to chunk; pages has (doc_id, page_num, start, stop)."""
    return rf"""
        WITH RECURSIVE {sentences_sql(docs)},
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n, coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM sent),
        ends AS (SELECT doc_id, k, n, p, p + k AS v, p + k + length(sentence) AS e FROM numbered),
        taken AS (SELECT doc_id, k, n, greatest(k + 1, (SELECT count(*) FROM ends f WHERE f.doc_id = ends.doc_id AND f.e <= ends.v + 1000)) AS j FROM ends),
        steps AS (SELECT t.doc_id, t.k, t.n, t.j, greatest(t.k + 1, coalesce((SELECT max(b.k) FROM ends b WHERE b.doc_id = t.doc_id AND b.p <= (SELECT x.p FROM ends x WHERE x.doc_id = t.doc_id AND x.k = t.j) - 200), 0)) AS next FROM taken t),
        walk AS (SELECT * FROM steps WHERE k = 0 UNION ALL SELECT s.* FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.k = w.next WHERE w.j < w.n),
        made AS (SELECT w.doc_id, w.k, min(s.start) AS start, string_agg(s.sentence, ' ' ORDER BY s.k) AS text FROM walk w JOIN numbered s ON s.doc_id = w.doc_id AND s.k >= w.k AND s.k < w.j GROUP BY w.doc_id, w.k),
        chunks AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS ordinal, start, start + length(text) AS stop, text FROM made),
        heads AS ({headings_sql("SELECT * FROM docs")}), pages AS ({pages}),
        headed AS (SELECT c.doc_id, c.ordinal, arg_max(h.heading, h.start) AS heading FROM chunks c JOIN heads h ON h.doc_id = c.doc_id AND h.start <= c.start GROUP BY c.doc_id, c.ordinal),
        paged AS (SELECT c.doc_id, c.ordinal, max(CASE WHEN p.start <= c.start AND c.start < p.stop THEN p.page_num END) AS first, max(CASE WHEN p.start < c.stop AND c.stop <= p.stop THEN p.page_num END) AS inside, max(CASE WHEN c.start < p.start AND c.stop > p.start THEN p.page_num END) AS beyond FROM chunks c JOIN pages p ON p.doc_id = c.doc_id GROUP BY c.doc_id, c.ordinal)
        SELECT c.doc_id, c.ordinal, c.start, c.stop AS "end", coalesce(h.heading, '') AS section_heading, CAST(coalesce(g.first, 1) AS BIGINT) AS page_start, CAST(greatest(coalesce(g.inside, 1), coalesce(g.beyond, 1)) AS BIGINT) AS page_end, md5(c.text) AS digest
        FROM chunks c LEFT JOIN headed h ON h.doc_id = c.doc_id AND h.ordinal = c.ordinal LEFT JOIN paged g ON g.doc_id = c.doc_id AND g.ordinal = c.ordinal"""


#: Each line of a document as a page, repaired; empty ones are skipped.
PAGES_SQL = r"""SELECT doc_id, n, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (
    SELECT doc_id, n, trim(regexp_replace(l, '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)) WHERE line <> ''"""
ASSEMBLED_SQL = f"SELECT doc_id, string_agg(line, chr(10) ORDER BY n) AS text FROM ({PAGES_SQL}) GROUP BY doc_id"


def _repaired(kb: Base) -> DataFrame:
    return kb.table("documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


def _dealt(kb: Base) -> DataFrame:
    """_repaired, dealt out by document before the heavy part: the one exchange that all later steps by document need."""
    return kb.table("documents").select("doc_id", "text").repartition("doc_id").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("p1_normalize_text", r"""
    SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(1), ' '), '\n{2,}', chr(1), 'g'), '\n', ' ', 'g'), '\s+', ' ', 'g'), ' *' || chr(1), chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest
    FROM documents""")
def p1(kb: Base) -> DataFrame:
    return _repaired(kb).select("doc_id", F.md5("text").alias("digest"))


@query("p2_assemble_documents", f"SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY n)) AS digest, count(*) AS n_pages, CAST(max(start + length(line)) AS BIGINT) AS length FROM ({PAGES_SQL}) GROUP BY doc_id")
def p2(kb: Base) -> DataFrame:
    pages = kb.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_num", "text")).withColumn("page_num", F.col("page_num") + 1)
    return C.assemble_documents(pages).select("doc_id", F.md5("text").alias("digest"), F.size("pages").cast("long").alias("n_pages"), F.element_at("pages", -1)["end"].cast("long").alias("length"))


@query("p3_headings", r"""
    SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(line) AS l, len(string_split(regexp_replace(trim(line), '\s+', ' ', 'g'), ' ')) AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
    WHERE l <> '' AND NOT (regexp_matches(l, '[.!?]$') AND w > 3) AND (
        regexp_matches(l, '(?i)^(chapter|part|section|appendix)\s+\S+') OR regexp_matches(l, '^\d+(?:\.\d+)*[.)]?\s+\p{Lu}') OR (w <= 15 AND regexp_matches(l, '^[\p{Lu}\s\d''\-.!?/:;]{2,}$'))
        OR (NOT regexp_matches(l, '[.!?]$') AND w <= 10 AND (w > 1 OR length(l) >= 3)
            AND list_bool_and(list_transform(string_split(regexp_replace(l, '\s+', ' ', 'g'), ' '), lambda x: lower(x) IN ('a','an','the','and','or','of','in','on','at','to','for','with','by','from','into','onto','as','but','nor','vs') OR regexp_matches(x, '^\p{Lu}')))
            AND list_bool_or(list_transform(string_split(regexp_replace(l, '\s+', ' ', 'g'), ' '), lambda x: lower(x) NOT IN ('a','an','the','and','or','of','in','on','at','to','for','with','by','from','into','onto','as','but','nor','vs'))))
    ) GROUP BY doc_id""")
def p3(kb: Base) -> DataFrame:
    lines = kb.table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.filter(T.is_heading(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("p4_heading_positions", headings_sql("SELECT doc_id, text FROM documents"))
def p4(kb: Base) -> DataFrame:
    return C.detect_headings(kb.table("documents").select("doc_id", "text"))


@query("p5_sentences", f"WITH {sentences_sql(REPAIRED_SQL)} SELECT doc_id, CAST(ordinal AS INT) AS ordinal, start, md5(sentence) AS digest FROM sent")
def p5(kb: Base) -> DataFrame:
    return C.split_sentences(_dealt(kb)).select("doc_id", "ordinal", "start", F.md5("sentence").alias("digest"))


@query("p6_chunk_documents", chunks_sql(REPAIRED_SQL, "SELECT doc_id, 1 AS page_num, 0 AS start, length(text) AS stop FROM docs"))
def p6(kb: Base) -> DataFrame:
    return C.chunk_documents(_dealt(kb)).select("doc_id", "ordinal", "start", "end", "section_heading", "page_start", "page_end", F.md5("text").alias("digest"))


@query("p8_chunk_pages", "SELECT doc_id, ordinal, page_start, page_end FROM (" + chunks_sql(ASSEMBLED_SQL, f"SELECT doc_id, n AS page_num, start, start + length(line) AS stop FROM ({PAGES_SQL})") + ")")
def p8(kb: Base) -> DataFrame:
    pages = kb.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_num", "text")).withColumn("page_num", F.col("page_num") + 1)
    return C.chunk_documents(C.assemble_documents(pages)).select("doc_id", "ordinal", "page_start", "page_end")


@query("p9_approx_tokens", "SELECT doc_id, CAST(round(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def p9(kb: Base) -> DataFrame:
    return kb.table("documents").select("doc_id", T.approx_tokens(F.col("text")).alias("tokens"))


@query("p10_layout_pages", r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
    sized AS (SELECT *, CASE WHEN len(string_split(line, ' ')) = 1 THEN 14.0 ELSE 10.0 END AS size FROM l),
    body AS (SELECT doc_id, arg_max(size, (glyphs, size)) AS body FROM (SELECT doc_id, size, sum(length(line) + 1) AS glyphs FROM sized GROUP BY doc_id, size) GROUP BY doc_id),
    pieces AS (SELECT s.doc_id, n, CASE WHEN trim(line) = '' THEN repeat(chr(10), 2) WHEN size > body * 1.15 THEN repeat(chr(10), 2) || trim(line) || repeat(chr(10), 2) ELSE line || chr(10) END AS piece FROM sized s JOIN body b ON b.doc_id = s.doc_id)
    SELECT doc_id, 1 AS page_num, md5(regexp_replace(regexp_replace(string_agg(piece, '' ORDER BY n), '^\n+', ''), '\n{3,}', repeat(chr(10), 2), 'g')) AS digest FROM pieces GROUP BY doc_id""")
def p10(kb: Base) -> DataFrame:
    """Glyphs made from the documents' lines: a line's number is its height, and lines of one word are large."""
    lines = kb.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    # told once a line, before the line comes apart, not once a glyph
    lines = lines.withColumn("single", F.size(F.split("line", " ")) == 1)
    glyphs = lines.select("doc_id", F.lit(1).alias("page_num"), "n", F.posexplode(F.split("line", "")).alias("i", "ch"), "single")
    glyphs = glyphs.select("doc_id", "page_num", (F.col("n") * 1_000_000 + F.col("i")).alias("pos"), "ch", F.when(F.col("single"), 14.0).otherwise(10.0).alias("font_size"), F.lit(False).alias("is_bold"), (-12.0 * F.col("n")).alias("y"))
    return C.layout_pages(glyphs).select("doc_id", "page_num", F.md5("text").alias("digest"))


@query("p11_sanitize_scalar", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def p11(kb: Base) -> DataFrame:
    return kb.table("documents").select("doc_id", F.md5(T.sanitize_scalar(F.col("text"))).alias("digest"))


LANGUAGE_SQL = ", ".join(
    f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in words.split('|'))})))" + (f" + least(len(regexp_extract_all(f, '{T.LANGUAGE_LETTERS[name]}')), 2)" if T.LANGUAGE_LETTERS[name] else "") + f" AS {name}" for name, words in T.LANGUAGE_WORDS.items()
)


@query("p12_detect_language", rf"""
    WITH folded AS (SELECT doc_id, lang, lower(trim(text)) AS f, regexp_extract_all(lower(trim(text)), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+') AS t FROM documents),
    scored AS (SELECT doc_id, lang, len(regexp_extract_all(f, '\p{{L}}+')) AS n, {LANGUAGE_SQL} FROM folded),
    ranked AS (SELECT *, greatest(en, de, fr, es) AS best, list_reverse_sort([en, de, fr, es])[2] AS second FROM scored)
    SELECT doc_id, lang, CASE WHEN n >= 3 AND best >= 2 AND best > second THEN CASE best WHEN en THEN 'en' WHEN de THEN 'de' WHEN fr THEN 'fr' ELSE 'es' END ELSE 'en' END AS detected FROM ranked""")
def p12(kb: Base) -> DataFrame:
    return kb.table("documents").select("doc_id", "lang", T.detect_language(F.col("text"), F.lit("en")).alias("detected"))


@query("r1_excerpt", r"SELECT doc_id, CASE WHEN length(t) <= 280 THEN t ELSE left(t, 280) || '…' END AS e FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) WHERE t <> ''")
def r1(kb: Base) -> DataFrame:
    return kb.table("documents").select("doc_id", T.excerpt(F.col("text"), 280).alias("e")).filter("e is not null")


@query("y2_content_hash", "SELECT doc_id, md5(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '^\\s+', ''), '\\s+$', '')) AS h FROM documents")
def y2(kb: Base) -> DataFrame:
    return kb.table("documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))


_WORDS_SQL = r"string_split(lower(regexp_replace(text, '[^\p{L}\p{M}\p{Nl}\p{Nd}\p{No}]+', ' ', 'g')), ' ')"


def embedded_sql(rows: str, width: int, weighted: bool = False) -> str:
    """(id, k, v): the places and values of the hashing embedder's vectors of a statement for (id, text); weighted: with the
    signs of words and the weights of weights_sql."""
    words = f"SELECT id, w, md5(w) AS h FROM (SELECT id, unnest({_WORDS_SQL}) AS w FROM ({rows})) WHERE w <> ''"
    place = f"CAST('0x' || substr(h, 1, 8) AS BIGINT) % {width}"
    if not weighted:
        return f"SELECT id, k, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS v FROM (SELECT id, {place} AS k, count(*) AS c FROM ({words}) GROUP BY 1, 2)"
    return f"SELECT id, k, c / nullif(sqrt(sum(c * c) OVER (PARTITION BY id)), 0) AS v FROM (SELECT id, {place} AS k, sum(CASE WHEN substr(h, 9, 1) < '8' THEN g ELSE -g END) AS c FROM ({words}) JOIN weights ON kind = CAST('0x' || substr(h, 10, 8) AS BIGINT) % {V.WORD_CLASSES} GROUP BY 1, 2)"


def weights_sql(rows: str, others: str) -> str:
    """weights (kind, g): the weight of each class of words by a statement for (doc_id, text), of its words and those of others."""
    kinds = lambda own: f"SELECT doc_id, CAST('0x' || substr(md5(w), 10, 8) AS BIGINT) % {V.WORD_CLASSES} AS kind FROM (SELECT doc_id, unnest({_WORDS_SQL}) AS w FROM ({own})) WHERE w <> ''"
    return f"""seen AS ({kinds(rows)}), frequent AS (SELECT kind, count(DISTINCT doc_id) AS n FROM seen GROUP BY kind),
        weights AS MATERIALIZED (SELECT k.kind, ln((1 + (SELECT count(*) FROM ({rows}))) / (1.0 + coalesce(n, 0))) + 1 AS g FROM (SELECT kind FROM frequent UNION SELECT kind FROM ({kinds(others)})) k LEFT JOIN frequent f ON f.kind = k.kind)"""


_CHUNK_TEXTS = chunks_sql(REPAIRED_SQL, "SELECT doc_id, 1 AS page_num, 0 AS start, length(text) AS stop FROM docs").replace("md5(c.text) AS digest", "c.text AS text")


#: Width of the vectors whose recall is measured.
RECALL_WIDTH = 512


@query("v11_recall", f"""
    WITH asked AS (SELECT item_id AS query_id, {REPAIRED_SQL.split('SELECT doc_id, ')[1].rsplit(' AS text', 1)[0]} AS text FROM benchmark), truth AS (SELECT query_id, left(text, 60) AS marker FROM asked),
    held AS (SELECT * FROM truth t WHERE EXISTS (SELECT 1 FROM ({REPAIRED_SQL}) d WHERE contains(d.text, t.marker))),
    pieces AS (SELECT doc_id || ':' || ordinal AS id, text FROM ({_CHUNK_TEXTS})), {weights_sql(REPAIRED_SQL, "SELECT query_id AS doc_id, text FROM asked")},
    qv AS ({embedded_sql("SELECT query_id AS id, text FROM asked", RECALL_WIDTH, True)}), cv AS ({embedded_sql("SELECT id, text FROM pieces", RECALL_WIDTH, True)}),
    near AS (SELECT q.id AS query_id, c.id, row_number() OVER (PARTITION BY q.id ORDER BY round(1 - sum(q.v * c.v), 9), c.id) AS rank FROM qv q JOIN cv c ON c.k = q.k GROUP BY q.id, c.id QUALIFY rank <= 5)
    SELECT h.query_id, coalesce(bool_or(contains(lower(p.text), lower(h.marker))), false) AS hit FROM held h LEFT JOIN near n ON n.query_id = h.query_id LEFT JOIN pieces p ON p.id = n.id GROUP BY h.query_id""")
def v11(kb: Base) -> DataFrame:
    """Recall of the benchmark's passages among the chunks of all documents, by the hashing embedder with the documents'
    word weights, five a passage.

    The marker is the passage's first 60 characters; only passages that some document has count.
    """
    docs = _dealt(kb)
    embed = V.hash_embedder(RECALL_WIDTH, V.word_weights(docs))
    chunks = C.chunk_documents(docs).select(F.concat_ws(":", "doc_id", "ordinal").alias("item_id"), F.lit("all").alias("collection_id"), "text")
    asked = kb.table("benchmark").select(F.col("item_id").alias("query_id"), T.normalize_text(F.col("text")).alias("text"))
    truth = asked.select("query_id", F.left("text", F.lit(60)).alias("marker"))
    # documents that can have a marker have its longest word: an equi-join of words alone, and then the text itself is looked at
    words = F.slice(F.split("marker", " "), 2, F.greatest(F.size(F.split("marker", " ")) - 2, F.lit(1)))
    rare = truth.withColumn("word", F.element_at(F.sort_array(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"])
    having = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    having = having.join(rare, "word").select(F.col("doc_id").alias("held_by"), "query_id", "marker").distinct()
    held = docs.join(having, F.col("doc_id").eqNullSafe(F.col("held_by"))).filter(F.contains(F.col("text"), F.col("marker"))).select("query_id").distinct()
    truth = truth.join(held, "query_id", "left_semi")
    near = V.knn(V.embed_queries(asked, embed), V.embed_documents(chunks, embed), asked.select("query_id", F.lit("all").alias("collection_id")), 5)
    # texts are cut up again for the few documents that were found only, not for all
    near = near.withColumn("found", F.when(F.contains("item_id", F.lit(":")), F.regexp_extract("item_id", "^(.*):", 1)))
    hits = docs.join(F.broadcast(near), F.col("doc_id").cast("string").eqNullSafe(F.col("found"))).select(F.struct("query_id", "rank", "item_id", "doc_id").alias("doc_id"), "text")
    texts = C.chunk_documents(hits).filter(F.concat_ws(":", "doc_id.doc_id", "ordinal") == F.col("doc_id.item_id")).select("doc_id.query_id", "doc_id.rank", "text")
    return V.recall_at_k(texts, truth, 5)


NAMED = f"(SELECT collection_id, kind, id, name, {sql_key('name')} AS k FROM entity WHERE {LIVE} AND collection_id IS NOT NULL)"
GRAMS = "SELECT collection_id, kind, k, substr('  ' || k || ' ', CAST(i AS INT), 3) AS g, count(*) AS c FROM (SELECT collection_id, kind, k, unnest(range(1, length(k) + 2)) AS i FROM keys) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2, 3, 4")
SIMILAR = f"""
    WITH keys AS (SELECT DISTINCT collection_id, kind, k FROM {NAMED} WHERE k <> ''), grams AS ({GRAMS}),
    pairs AS (SELECT x.collection_id, x.kind, x.k AS a, y.k AS b, 2.0 * sum(least(x.c, y.c)) / (length(x.k) + 1 + length(y.k) + 1) AS d FROM grams x JOIN grams y ON x.collection_id = y.collection_id AND x.kind = y.kind AND x.g = y.g GROUP BY x.collection_id, x.kind, x.k, y.k),
    sims AS (SELECT collection_id, kind, a, b, CASE WHEN a = b THEN 1.0 WHEN list_has_all(string_split(b, ' '), string_split(a, ' ')) OR list_has_all(string_split(a, ' '), string_split(b, ' ')) THEN greatest(d, 0.75 + 0.25 * d) ELSE d END AS s FROM pairs)"""


def near_sql(left: str, right: str) -> str:
    """CTEs up to near (collection_id, a, b, s): similarities of the keys of two statements for (collection_id, k)."""
    grams = lambda t: f"SELECT collection_id, k, g, count(*) AS c FROM (SELECT collection_id, k, substr('  ' || k || ' ', CAST(i AS INT), 3) AS g FROM (SELECT collection_id, k, unnest(range(1, length(k) + 2)) AS i FROM {t})) GROUP BY collection_id, k, g"
    return f"""ls AS (SELECT DISTINCT collection_id, k FROM ({left}) WHERE k <> ''), rs AS (SELECT DISTINCT collection_id, k FROM ({right}) WHERE k <> ''), lg AS ({grams('ls')}), rg AS ({grams('rs')}),
        common AS (SELECT x.collection_id, x.k AS a, y.k AS b, 2.0 * sum(least(x.c, y.c)) / (length(x.k) + 1 + length(y.k) + 1) AS d FROM lg x JOIN rg y ON x.collection_id = y.collection_id AND x.g = y.g GROUP BY x.collection_id, x.k, y.k),
        near AS (SELECT collection_id, a, b, CASE WHEN a = b THEN 1.0 WHEN list_has_all(string_split(b, ' '), string_split(a, ' ')) OR list_has_all(string_split(a, ' '), string_split(b, ' ')) THEN greatest(d, 0.75 + 0.25 * d) ELSE d END AS s FROM common)"""


@query("n1_name_key", f"SELECT id, {sql_key('name')} AS name_key FROM entity")
def n1(kb: Base) -> DataFrame:
    return kb.entity.select("id", T.name_key(F.col("name")).alias("name_key"))


@query("n2_similar_keys", SIMILAR + " SELECT collection_id, kind, a, b, round(s, 6) AS similarity FROM sims WHERE s >= 0.72 - 1e-12")
def n2(kb: Base) -> DataFrame:
    keys = S.live(kb.entity).filter("collection_id is not null").select("collection_id", "kind", "name").distinct().select("collection_id", "kind", T.name_key(F.col("name")).alias("key"))
    return N.similar_keys(keys, keys, ["collection_id", "kind"], N.SUGGEST).select("collection_id", "kind", "a", "b", F.round("similarity", 6).alias("similarity"))


DUPLICATES = SIMILAR + f""", firsts AS (SELECT collection_id, kind, k, min(id) AS f FROM {NAMED} WHERE k <> '' GROUP BY collection_id, kind, k)
    SELECT n.collection_id, n.kind, f.f AS a, n.id AS b, CAST(1 AS DOUBLE) AS similarity FROM {NAMED} n JOIN firsts f ON f.collection_id = n.collection_id AND f.kind = n.kind AND f.k = n.k WHERE n.id <> f.f
    UNION ALL SELECT s.collection_id, s.kind, least(x.f, y.f), greatest(x.f, y.f), round(s.s, 6) FROM sims s JOIN firsts x ON x.collection_id = s.collection_id AND x.kind = s.kind AND x.k = s.a JOIN firsts y ON y.collection_id = s.collection_id AND y.kind = s.kind AND y.k = s.b WHERE s.s >= 0.9 - 1e-12 AND s.a < s.b"""


@query("n3_duplicate_entities", DUPLICATES)
def n3(kb: Base) -> DataFrame:
    return N.duplicate_entities(kb.entity).select("collection_id", "kind", "a", "b", F.round("similarity", 6).alias("similarity"))


CLAIMS = f"(SELECT DISTINCT collection_id, id, alias, {sql_key('alias')} AS k FROM (SELECT collection_id, id, unnest(list_concat([name], aliases)) AS alias FROM entity WHERE {LIVE} AND collection_id IS NOT NULL))"


COLLISIONS = f"""
    WITH o AS (SELECT collection_id, k, id, min(alias) AS alias FROM {CLAIMS} WHERE k <> '' GROUP BY collection_id, k, id),
    f AS (SELECT *, first_value(id) OVER (PARTITION BY collection_id, k ORDER BY id) AS a, first_value(alias) OVER (PARTITION BY collection_id, k ORDER BY id) AS x FROM o)
    SELECT collection_id, a, id AS b, min(least(alias, x)) AS alias FROM f WHERE id <> a GROUP BY collection_id, a, id"""


@query("n4_alias_collisions", COLLISIONS)
def n4(kb: Base) -> DataFrame:
    return N.alias_collisions(kb.entity)


def _requests(kb: Base) -> DataFrame:
    """Each entity asks for its own summary as an alias, and every fourth for the name of its neighbour by number."""
    e = kb.entity.withColumn("n", F.element_at(F.split("id", ":"), 2).cast("long"))
    return e.select("id", F.when(F.col("n") % 4 == 0, F.concat(F.lit("Customer#"), F.lpad((F.col("n") + 25).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("Alias "), F.col("n").cast("string"))).alias("alias"))


ASKED = "(SELECT id, CASE WHEN CAST(split_part(id, ':', 2) AS INT) % 4 = 0 THEN 'Customer#' || lpad(CAST(CAST(split_part(id, ':', 2) AS INT) + 25 AS STRING), 9, '0') ELSE 'Alias ' || split_part(id, ':', 2) END AS alias, name, aliases, collection_id, vault_deleted FROM entity)"
JUDGED = f"""
    WITH claimed AS (SELECT collection_id, k, min(id) AS low, max(id) AS high FROM {CLAIMS} WHERE k <> '' GROUP BY collection_id, k),
    a AS (SELECT *, {sql_key('alias')} AS k FROM {ASKED} WHERE {LIVE} AND collection_id IS NOT NULL),
    first AS (SELECT collection_id, k, min(id) AS winner FROM a GROUP BY collection_id, k),
    judged AS (SELECT a.id, a.alias, CASE WHEN c.low IS NOT NULL AND (c.low <> a.id OR c.high <> a.id) THEN 'taken' WHEN f.winner <> a.id THEN 'claimed' END AS reason FROM a JOIN first f ON f.collection_id = a.collection_id AND f.k = a.k LEFT JOIN claimed c ON c.collection_id = a.collection_id AND c.k = a.k)"""


@query("n5_add_aliases", JUDGED + " SELECT e.id, array_to_string(list_sort(list_concat(e.aliases, CASE WHEN j.id IS NOT NULL AND j.alias <> e.name AND NOT list_contains(e.aliases, j.alias) THEN [j.alias] ELSE list_filter(e.aliases, lambda x: false) END)), '|') AS aliases FROM entity e LEFT JOIN judged j ON j.id = e.id AND j.reason IS NULL")
def n5(kb: Base) -> DataFrame:
    return N.add_aliases(kb.entity, _requests(kb))[0].select("id", F.array_join(F.sort_array("aliases"), "|").alias("aliases"))


@query("n5_refused_aliases", JUDGED + f" SELECT id, alias, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT id, alias, 'not found' FROM {ASKED} WHERE NOT ({LIVE})")
def n5b(kb: Base) -> DataFrame:
    return N.add_aliases(kb.entity, _requests(kb))[1]


@query("n6_remove_aliases", "SELECT id, array_to_string(list_filter(aliases, lambda a: lower(a) <> 'old ' || lower(name)), '|') AS aliases FROM entity")
def n6(kb: Base) -> DataFrame:
    gone = kb.entity.select("id", F.concat(F.lit("OLD "), "name").alias("alias"))
    return N.remove_aliases(kb.entity, gone).select("id", F.array_join("aliases", "|").alias("aliases"))


@query("n8_alias_decisions", f"""
    WITH d AS (SELECT parties[1] AS id, 'Also ' || detail AS alias, length(id) % 2 = 0 AS accept FROM finding WHERE kind = 'alias_collision'),
    g AS (SELECT id, list(DISTINCT alias) FILTER (accept) AS added, list(DISTINCT lower(alias)) FILTER (NOT accept) AS gone FROM d GROUP BY id)
    SELECT e.id, array_to_string(list_sort(list_filter(list_distinct(CASE WHEN {LIVE} AND e.collection_id IS NOT NULL THEN list_concat(e.aliases, coalesce(g.added, [])) ELSE e.aliases END), lambda a: NOT list_contains(coalesce(g.gone, []), lower(a)))), '|') AS aliases FROM entity e LEFT JOIN g ON g.id = e.id""")
def n8(kb: Base) -> DataFrame:
    found = kb.finding
    decisions = found.filter("kind = 'alias_collision'").select(F.col("id").alias("finding_id"), (F.length("id") % 2 == 0).alias("accept"), F.element_at("parties", 1).alias("id"), F.concat(F.lit("Also "), "detail").alias("alias"))
    return N.apply_alias_decisions(kb.entity, found, decisions)[0].select("id", F.array_join(F.sort_array("aliases"), "|").alias("aliases"))


@query("w2_best_match", SIMILAR.replace("WITH keys AS", f"WITH asked AS (SELECT DISTINCT collection_id, kind, id, regexp_extract(notes, '\\[\\[([^\\[\\]]+)\\]\\]', 1) AS needle FROM entity WHERE {LIVE} AND collection_id IS NOT NULL AND notes LIKE '%[[%'), keys AS").split("SELECT DISTINCT collection_id, kind, k FROM")[0] + f"""
    SELECT DISTINCT collection_id, kind, k FROM {NAMED} WHERE k <> '' UNION SELECT collection_id, kind, {sql_key('needle')} FROM asked), grams AS ({GRAMS}),""" + SIMILAR.split("GROUP BY 1, 2, 3, 4),")[1] + f"""
    SELECT q.collection_id, q.kind, q.needle, CASE count(n.id) WHEN 0 THEN 'none' WHEN 1 THEN 'unique' ELSE 'ambiguous' END AS outcome
    FROM (SELECT DISTINCT collection_id, kind, needle, {sql_key('needle')} AS k FROM asked) q LEFT JOIN sims s ON s.collection_id = q.collection_id AND s.kind = q.kind AND s.a = q.k AND s.s >= 0.72 - 1e-12
    LEFT JOIN {NAMED} n ON n.collection_id = s.collection_id AND n.kind = s.kind AND n.k = s.b GROUP BY q.collection_id, q.kind, q.needle""")
def w2(kb: Base) -> DataFrame:
    own = S.live(kb.entity).filter("collection_id is not null")
    asked = own.select("collection_id", "kind", F.regexp_extract("notes", r"\[\[([^\[\]]+)\]\]", 1).alias("needle")).filter("needle <> ''").distinct()
    return N.best_match(asked, own, ["collection_id", "kind"], N.SUGGEST).select("collection_id", "kind", "needle", "outcome")
