"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, minhash, mixing, ngram_join, pii, quality, sharding, suffix_dedup, token_counts, toxicity, vector_codes
from .common import documents

#: Key of the surrogates of the registered query; who runs the operator gives their own.
SURROGATE_KEY = b"the registered query's key"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), vocabulary_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(documents(spark, sf_dir), SURROGATE_KEY)
    return made.select("doc_id", F.size("spans").cast("long").alias("n_entities"), "text", F.to_json("spans").alias("spans"))


def op3_hyperminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("text_hash", "stays")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), vocabulary_path()).drop("text")
    decoded = bpe.decode(encoded, vocabulary_path())
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_hash")


def op6_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(documents(spark, sf_dir), hashes=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_line_frequency_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.line_quality(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_kept_words")


def op8_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _, takes = mixing.mix(documents(spark, sf_dir))
    taken = takes.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return docs.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op9_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(documents(spark, sf_dir), 200)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(documents(spark, sf_dir), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op12_member_resident_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_pii_surrogates, op3_hyperminhash_near_dedup, op4_kneser_ney_toxicity, op5_bpe, op6_progressive_exact_dedup, op7_line_frequency_quality, op8_low_discrepancy_mix, op9_prefix_free_dedup, op10_histogram_sort, op11_ngram_jaccard_join, op12_member_resident_codes, op13_filter_audit)}

SQL: dict[str, str] = {
    "op6_progressive_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t""",
    # words of a line are folded and its digits alike; equal documents count once for a line
    "op7_line_frequency_quality": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT r, source, line, array_to_string(w, ' ') AS content, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM (SELECT r, source, w, unnest(string_split(text, chr(10))) AS line FROM d)),
        k AS (SELECT r, source, line, content, len(lw) AS n, regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g') AS folded FROM l WHERE len(lw) > 0),
        shared AS (SELECT source, folded FROM k GROUP BY source, folded HAVING count(DISTINCT content) > 20),
        lines AS (SELECT k.r, count(*) - count(DISTINCT k.line) AS dup, coalesce(sum(CASE WHEN s.folded IS NOT NULL THEN k.n END), 0) AS lost FROM k LEFT JOIN shared s ON s.folded = k.folded AND s.source IS NOT DISTINCT FROM k.source GROUP BY k.r),
        g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
        c AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS times FROM g), unnest(range(5)) AS o(j) WHERE times > 1 GROUP BY r),
        f AS (SELECT d.doc_id, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, CAST(len(w) - coalesce(lines.lost, 0) AS BIGINT) AS n_kept_words
            FROM d LEFT JOIN lines ON lines.r = d.r LEFT JOIN c ON c.r = d.r),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
        SELECT *, NOT base_failed AND n_kept_words >= 10 AND n_kept_words >= 0.5 * n_words AS kept FROM b""",
    # one round is a pair of statements: `a` has each part's nearest entry, `b` the codebooks that follow
    "op12_member_resident_codes": """
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q, len(embedding) // 16 AS w
            FROM embeddings WHERE len(embedding) > 0 AND len(embedding) = len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)])),
        p AS MATERIALIZED (SELECT r, (i - 1) // w AS pos, (i - 1) % w AS j, q[i] AS x FROM v, unnest(range(1, len(q) + 1)) AS u(i)),
        b0 AS MATERIALIZED (SELECT pos, r - 1 AS e, j, x AS c FROM p WHERE r <= 64)"""
    + "".join(
        f""",
        d{k} AS (SELECT r, p.pos, e, sum((x - c) * (x - c)) AS d FROM p JOIN b{k} b ON b.pos = p.pos AND b.j = p.j GROUP BY r, p.pos, e),
        a{k} AS MATERIALIZED (SELECT r, pos, e, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY r, pos ORDER BY d, e) = 1),
        b{k + 1} AS MATERIALIZED (SELECT b.pos, b.e, b.j, coalesce(CAST(floor(n.s / n.m) AS BIGINT), b.c) AS c
            FROM b{k} b LEFT JOIN (SELECT a.pos, a.e, p.j, sum(p.x) AS s, count(*) AS m FROM a{k} a JOIN p ON p.r = a.r AND p.pos = a.pos GROUP BY a.pos, a.e, p.j) n ON n.pos = b.pos AND n.e = b.e AND n.j = b.j)"""
        for k in range(3)
    )
    + """,
        f AS (SELECT r, string_agg(printf('%02x', CAST(e AS INT)), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY r)
        SELECT v.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY pos, e, j)) FROM b2) AS codebooks_sha256
        FROM v JOIN f ON f.r = v.r""",
    "op13_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f AS (SELECT doc_id, part, CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
                + 4 * CAST(100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) AS INT) + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INT)
                + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), min(doc_id) OVER (PARTITION BY x) IS NOT NULL) AS INT) AS mask FROM t),
        l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
        m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, mask),
        k(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
        o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM k a, k b, k c, k d, k e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
        s AS (SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS gone FROM o, unnest(range(1, 6)) AS u(step)),
        r AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0) AS BIGINT) AS kept,
                CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS BIGINT) AS removed, CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & gone > 0), 0) AS BIGINT) AS redundant,
                CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails, CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS BIGINT) AS good_lost,
                CAST(coalesce(sum(bad) FILTER (mask & bit > 0 AND mask & gone = 0), 0) AS BIGINT) AS toxic_lost FROM m, s GROUP BY part, filter_order, step, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
}
