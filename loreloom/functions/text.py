"""Column expressions on text. None of them needs Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a heading may have in lower case.
HEADING_STOPWORDS = ("a", "an", "the", "and", "or", "of", "in", "on", "at", "to", "for", "with", "by", "from", "into", "onto", "as", "but", "nor", "vs")

# Marker words and distinctive letters of the languages that are told apart.
LANGUAGE_WORDS = {
    "en": "the|and|what|how|does|can|is|are|with|rule|rules|cover|work|please",
    "de": "der|die|das|und|wie|was|ist|sind|funktioniert|regel|regeln|mit|für|kann",
    "fr": "le|la|les|de|des|et|est|quelle|quel|comment|règle|règles|avec|pour|peut",
    "es": "el|la|los|las|de|del|y|qué|como|cómo|es|son|regla|reglas|con|para|puede",
}
LANGUAGE_LETTERS = {"en": None, "de": "[äöüß]", "fr": "[àâæçéèêëîïôœùûüÿ]", "es": "[áéíóúüñ¿¡]"}

CHARS_PER_TOKEN = 4


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Repairs of text taken from pages, in order: words split by a hyphen at a line's end are joined, single line breaks
    become spaces, two or more become a blank line, other white space is collapsed, and the ends are trimmed."""
    steps = ((r"(?<=\p{L})-\n(?=\p{L})", ""), (r"\n{2,}", "\u0001"), (r"\n", " "), (r"(?U)\s+", " "), (" *\u0001", "\n\n"))
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return strip(text)


def is_heading(line: Column) -> Column:
    """Whether a line looks like a heading: a chapter or part, a numbered section, up to 15 words in capitals, or up to
    10 words that begin with capitals but for short words. More than 3 words that end a sentence are none."""
    return let(strip(line), lambda own: let(F.split(collapse(own), " "), lambda words: _heading(own, words)))


def _heading(line: Column, words: Column) -> Column:
    ends = line.rlike(r"[.!?]$")
    title = F.forall(words, lambda w: F.lower(w).isin(*HEADING_STOPWORDS) | w.rlike(r"^\p{Lu}"))
    title &= F.exists(words, lambda w: ~F.lower(w).isin(*HEADING_STOPWORDS)) & (F.size(words) <= 10) & ~ends
    title &= (F.size(words) > 1) | (F.length(line) >= 3)
    found = line.rlike(r"(?i)^(chapter|part|section|appendix)\s+\S+") | line.rlike(r"^\d+(?:\.\d+)*[.)]?\s+\p{Lu}")
    found |= (F.size(words) <= 15) & line.rlike(r"(?U)^[\p{Lu}\s\d'\-.!?/:;]{2,}$")
    return F.coalesce((line != "") & ~(ends & (F.size(words) > 3)) & (found | title), F.lit(False))


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded."""
    return F.round(F.length(text) / CHARS_PER_TOKEN).cast("long")


def sanitize_scalar(text: Column) -> Column:
    """One line without control characters; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\p{Cc}", ""))


def detect_language(text: Column, fallback: Column) -> Column:
    """en, de, fr or es by marker words and at most two distinctive letters; the fallback for fewer than 3 words, a score
    under 2 or a tie."""
    folded = F.lower(strip(text))
    scores = []
    for name, found in LANGUAGE_WORDS.items():
        score = F.regexp_count(folded, F.lit(rf"(?U)\b(?:{found})\b"))
        if letters := LANGUAGE_LETTERS[name]:
            score = score + F.least(F.regexp_count(folded, F.lit(letters)), F.lit(2))
        scores.append(F.struct(score.alias("score"), F.lit(name).alias("name")))
    ranked = F.sort_array(F.array(*scores), asc=False)
    best, second = F.element_at(ranked, 1), F.element_at(ranked, 2)
    sure = (F.regexp_count(folded, F.lit(r"\p{L}+")) >= 3) & (best["score"] >= 2) & (best["score"] > second["score"])
    return F.when(sure, best["name"]).otherwise(fallback)


def excerpt(text: Column, n: int) -> Column:
    """The first n characters of the collapsed text, with an ellipsis if there are more; null for a blank one."""
    flat = collapse(text)
    return F.when(flat != "", F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.left(flat, F.lit(n)), F.lit("…"))))


def nonblank(text: Column) -> Column:
    """The text, or null for a blank one."""
    return F.when(strip(text) != "", text)


def content_hash(text: Column) -> Column:
    """Hash of a file's text; line ends and outer white space don't count."""
    return F.md5(strip(F.replace(text, F.lit("\r\n"), F.lit("\n"))))


def slug(name: Column) -> Column:
    """Lower-case letters and digits of any script, in words joined by hyphens; "untitled" for none.

    Names that are reserved for devices get "-x".
    """
    made = F.regexp_replace(F.lower(F.regexp_replace(name, r"[^\p{IsAlphabetic}\p{N}]+", "-")), "^-+|-+$", "")
    made = F.when(made == "", F.lit("untitled")).otherwise(made)
    return F.when(made.rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.concat(made, F.lit("-x"))).otherwise(made)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def embed_text(kind: str, first: Column, *others: Column) -> Column:
    """What is embedded of a record: an entity's "name: summary" with notes and article on lines of their own, a
    session's title and notes, or a rule's "name (category): body"."""
    if kind == "rule":
        category, body = others
        return F.format_string("%s (%s): %s", first, category, body)
    if kind == "session":
        return F.concat_ws("\n", first, nonblank(others[0]))
    summary, *rest = others
    return F.concat_ws("\n", F.concat_ws(": ", first, nonblank(summary)), *map(nonblank, rest))


def name_key(name: Column) -> Column:
    """The key under which names are the same: folded, without possessives, punctuation, a leading "the" and plurals."""
    return let(collapse(F.lower(name)), _key)


def _key(folded: Column) -> Column:
    clean = F.regexp_replace(folded, r"['’]s(?= |$)", "")
    words = F.split(collapse(F.regexp_replace(clean, r"[^\p{IsAlphabetic}\p{N}\s]", " ")), " ")
    named = let(words, lambda w: F.when((F.element_at(w, 1) == "the") & (F.size(w) > 1), F.slice(w, 2, 1 << 30)).otherwise(w))
    return let(F.array_join(F.transform(named, _singular), " "), lambda key: F.when(key == "", folded).otherwise(key))


def _singular(word: Column) -> Column:
    long = F.octet_length(word) > 3
    cut = lambda n: F.left(word, F.length(word) - n)
    return (
        F.when(word.isin("series", "species") | ~long, word)
        .when(word.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("es") & ~word.endswith("ses"), cut(2))
        .when(word.endswith("s") & ~word.rlike("(ss|us|os|as|is)$"), cut(1))
        .otherwise(word)
    )


def trigrams(key: Column) -> Column:
    """The runs of three characters of the key with two spaces before and one after it, repeats included."""
    padded = F.concat(F.lit("  "), key, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(key) + 1), lambda i: F.substring(padded, i, 3))
