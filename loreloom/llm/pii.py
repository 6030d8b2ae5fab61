"""Personal data and secrets, replaced by keyed surrogates of the same kind and form."""

from __future__ import annotations

from bisect import bisect, insort
from collections.abc import Iterator
import hashlib
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_texts

#: Surrogates that had to be drawn again are broadcast if they are at most so many, else joined per document.
BROADCAST_ROWS = 50_000

#: An invented name has three syllables, and one more after each so many attempts, so that names never run out.
REDRAWS = 4

# Titles that show a person's gender, or that one follows.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Señora": "f", "Sra": "f", "Dr": "n", "Prof": "n", "г-н": "m", "г-жа": "f"}

# Common given names, by the gender of those who mostly have them.
GIVEN = dict.fromkeys("""
    Adam Ahmed Albert Alexander Ali Andreas Andrew Anthony Antonio Arthur Ben Benjamin Carlos Charles Christian Christopher Daniel
    David Dennis Diego Dmitri Edward Emil Eric Felix Fernando Francisco Frank Gary George Giovanni Hans Harry Henry Hugo Ivan Jack
    Jacob James Jan Javier Jean Jeffrey John Jonathan Jorge José Joseph Juan Jürgen Karl Kevin Lars Leon Louis Luca Lucas Luis Marco
    Mark Martin Matthew Max Michael Miguel Mohammed Nicolas Oliver Oscar Pablo Patrick Paul Pedro Peter Philippe Pierre Ralph
    Richard Robert Ryan Samuel Sergei Stefan Stephen Steven Thomas Timothy Tobias Victor Walter William Wolfgang Иван Михаил
    """.split(), "m") | dict.fromkeys("""
    Alice Amanda Amelia Amy Ana Andrea Angela Anna Anne Barbara Betty Carmen Carol Caroline Catherine Charlotte Christine Claire
    Claudia Deborah Diana Donna Dorothy Elena Elizabeth Ella Emily Emma Eva Fatima Florence Gabriela Hannah Heidi Helen Ingrid
    Irene Isabel Jane Janet Jennifer Jessica Joan Julia Karen Kate Katharina Laura Linda Lisa Lucy Margaret Maria María Marie Marta
    Martha Mary Mia Michelle Monica Nancy Natalia Nicole Olga Olivia Pamela Patricia Paula Petra Rachel Rebecca Rosa Ruth Sandra
    Sara Sarah Sharon Silvia Sofia Sophie Susan Susanne Teresa Ursula Victoria Virginia Yvonne Zoe Анна Елена
    """.split(), "f")

# Words that make the name of a place or an institution of a person's name.
PLACES = frozenset("""
    Airport Allee Avenue Bahnhof Bay Beach Boulevard Bridge Castle Cathedral Church City College County Falls Gasse Hall Harbour
    Hill Hospital Hotel House Institute Island Lake Lane Library Mountain Museum Palace Park Platz Plaza Point Prize River Road
    School Square Stadium Station Straße Street Theatre Tower Town University Valley Village
    """.split())

# Domains that no mail reaches.
RESERVED = re.compile(r"(?i)(?:^|\.)(?:example\.(?:com|net|org)|example|test|invalid|localhost)$")

# Country calling codes of two digits; those of one digit are 1 and 7, all others have three.
CALLING = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_INITIAL = r"[A-ZА-ЯЁ]\."
_FULL = r"[^\W\d_a-zа-я](?:['’][^\W\d_])?[^\W\d_]+(?:['’-](?!s\b)[^\W\d_]+)*"
#: A part of a name: an initial, or a word with its hyphens and apostrophes but without a genitive's ending.
_PART = re.compile(rf"(?<![\w'’-])(?:{_INITIAL}|{_FULL})")

#: A given name, initials and a last name of one or two words; the given name is looked up.
_NAMED = re.compile(rf"(?<![\w'’-])(?P<given>[^\W\d_a-zа-я][^\W\d_]+)(?: {_INITIAL}){{0,3}} {_FULL}(?: {_FULL})?")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Each kind's pattern, and a character without which there can be no match.
PATTERNS = {
    "email": (re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])"), "@"),
    "access_key": (re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)"), "IA"),
    "web_token": (re.compile(r"(?<![\w.-])eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}"), "eyJ"),
    "key_block": (re.compile(r"-----BEGIN (?P<of>[A-Z ]{0,20}PRIVATE KEY)-----(?P<own>[A-Za-z0-9+/=\s]+)-----END (?P=of)-----"), "PRIVATE KEY-----"),
    "secret": (re.compile(r"""(?i)(?:(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)["']?\s*[:=]\s*["']?|\bbearer\s+)(?P<own>[A-Za-z0-9+/_\-]{16,})"""), ""),
    "ipv6": (re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:.])"), ":"),
    "iban": (re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"), ""),
    "ip": (re.compile(rf"(?<![\d.vV]){_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)"), "."),
    "ssn": (re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), "-"),
    "card": (re.compile(r"(?<![\d.])(?:\d[ -]?){12,18}\d(?![\d])"), ""),
    "phone": (re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d-])"), ""),
    "name": (re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(TITLES, key=len, reverse=True))})\.?[^\S\n]{{0,4}}\s[^\S\n]{{0,4}}(?P<own>(?:{_INITIAL} ?){{0,3}}{_FULL}(?: (?:{_INITIAL} ?){{0,3}}{_FULL})?)"), ""),
}

_HAS_DIGITS = re.compile(r"\d[\d .()-]{5}")
_HAS_TITLE = re.compile("|".join(sorted(TITLES, key=len, reverse=True)))
_HAS_SECRET = re.compile(r"(?i)token|secret|passw|key|bearer")


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, form) of the entities, in order and without overlap; earlier kinds in PATTERNS come first.

    Names are found after a title, or by a common given name with a last name, unless they name a place. form is what a surrogate must match besides the characters: the gender of a name.
    """
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    digits, titles, secrets = _HAS_DIGITS.search(text), _HAS_TITLE.search(text), _HAS_SECRET.search(text)
    for kind, (pattern, needed) in PATTERNS.items():
        if needed not in text or kind in ("ip", "ssn", "card", "phone", "iban") and not digits or kind == "name" and not titles or kind == "secret" and not secrets:
            continue
        for m in pattern.finditer(text):
            group = "own" if "own" in m.groupdict() else 0
            a, b = m.span(group)
            if kind == "card" and not _is_card(m[0]) or kind == "ipv6" and not _is_ipv6(m[0]):
                continue
            if all(b <= x or y <= a for x, y, *_ in found):
                found.append((a, b, kind, _gender(m["title"], m["own"]) if kind == "name" else ""))
    for m in _NAMED.finditer(text):
        words = m[0].split(" ")
        if (gender := GIVEN.get(m["given"])) and not any(x[0].islower() or x in PLACES for x in words) and not PLACES.intersection(text[m.end() : m.end() + 20].split()[:1]) and all(m.end() <= x or y <= m.start() for x, y, *_ in found):
            found.append((*m.span(), "name", gender))
    return sorted(found)


def _gender(title: str, name: str) -> str:
    """The gender that a title shows, else the one of those who mostly have the given name."""
    shown, first = TITLES[title], name.split(" ")[0]
    return GIVEN.get(first, shown) if shown == "n" and " " in name else shown


def _is_ipv6(text: str) -> bool:
    if sum(map(bool, text.split(":"))) < 3:
        return False  # as of names in a program
    try:
        return ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def _is_card(text: str) -> bool:
    """Whether a number has the length, the first digit and the check digit of payment cards."""
    digits = [int(c) for c in text if c.isdigit()]
    return 13 <= len(digits) <= 19 and 2 <= digits[0] <= 6 and _luhn(digits) == 0


class _Person:
    """A person of one text: the fullest form of the name, the gender that a title shows, and the places of mentions."""

    def __init__(self, parts: list[str], gender: str, at: int):
        self.parts, self.gender, self.at = parts, gender, [at]

    def fits(self, parts: list[str], gender: str) -> bool:
        if "n" not in (gender, self.gender) and gender != self.gender:
            return False
        if len(parts) == 1:
            return parts[0].lower() in (p.lower() for p in self.parts)
        if len(self.parts) == 1:
            return self.parts[0].lower() in (p.lower() for p in parts)
        return parts[-1].lower() == self.parts[-1].lower() and all(_same(x, y) for x, y in zip(parts[:-1], self.parts[:-1]))

    def add(self, parts: list[str], gender: str, at: int) -> None:
        if (len(parts), sum(map(len, parts))) > (len(self.parts), sum(map(len, self.parts))):
            self.parts = parts
        self.gender = self.gender if gender == "n" else gender
        insort(self.at, at)


def _same(x: str, y: str) -> bool:
    """Whether two first names can be one: an initial is any name that it begins."""
    return x[0] == y[0] if x.endswith(".") or y.endswith(".") else x.lower() == y.lower()


def _nearest(people: list[_Person], at: int) -> _Person:
    """Whose last mention before a place is nearest, else whose first one after it."""
    def far(person: _Person) -> tuple[bool, int]:
        i = bisect(person.at, at)
        return (False, at - person.at[i - 1]) if i else (True, person.at[0] - at)

    return min(people, key=far)


def entities(text: str | None) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, form, own) of the entities and, of persons found by a title or a given name, of all their other mentions.

    own is the text that tells an entity: of a name the fullest form in this text. Names of a text are one person if
    they share the last name, or one is a single part of the other, and neither titles' genders nor first names
    contradict. Mentions that fit several persons go to the one that was last mentioned before.
    """
    spans = detect(text)
    named = [(a, b, form) for a, b, kind, form in spans if kind == "name"]
    if not named:
        return [(a, b, kind, form, text[a:b]) for a, b, kind, form in spans]
    by_part: dict[str, list[_Person]] = {}
    mentions: dict[tuple[int, int], _Person] = {}

    def fitting(parts: list[str], gender: str) -> list[_Person]:
        return [p for p in {id(p): p for x in parts for p in by_part.get(x.lower(), ())}.values() if p.fits(parts, gender)]

    # the fullest names first, and those whose title shows a gender
    for a, b, gender in sorted(named, key=lambda x: (-len(parts := _PART.findall(text[x[0] : x[1]])), -sum(map(len, parts)), x[2] == "n", x)):
        parts = _PART.findall(text[a:b])
        if found := fitting(parts, gender):
            person = _nearest(found, a)
            person.add(parts, gender, a)
        else:
            person = _Person(parts, gender, a)
        for part in parts:
            if not part.endswith(".") and person not in by_part.setdefault(part.lower(), []):
                by_part[part.lower()].append(person)
        mentions[a, b] = person

    taken, i, run = spans, 0, []
    runs: list[list[re.Match]] = []
    for m in _PART.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end() or not m[0].endswith(".") and m[0].lower() not in by_part:
            continue
        if run and text[run[-1].end() : m.start()] in (" ", ""):
            run.append(m)
        else:
            runs.append(run := [m])
    for run in runs:
        while run and run[-1][0].endswith("."):
            run.pop()
        if not run:
            continue
        if not fitting([m[0] for m in run], "n"):
            # not one name: each part is a mention of its own
            alone = [[m] for m in run if not m[0].endswith(".")]
        else:
            alone = [run]
        for part in alone:
            a, b = part[0].start(), part[-1].end()
            if found := fitting([m[0] for m in part], "n"):
                mentions[a, b] = _nearest(found, a)
                insort(mentions[a, b].at, a)
    out = [(a, b, kind, form, text[a:b]) for a, b, kind, form in spans if kind != "name"]
    return sorted(out + [(a, b, "name", p.gender, " ".join(p.parts)) for (a, b), p in mentions.items()])


def _mention(made: str, own: str, text: str) -> str:
    """A mention of a name in the surrogate of the name's fullest form: the same parts, initials as initials."""
    full, new, shown = _PART.findall(own), made.split(" "), _PART.findall(text)
    places = [next((k for k, y in enumerate(full) if y.lower() == x.lower()), None) for x in shown]
    out = []
    for i, x in enumerate(shown):
        k = places[i]
        if k is None:
            k = next((k for k, y in enumerate(full[:-1]) if k not in places and _same(x, y)), min(i, len(full) - 1))
        part = new[k][0] + "." if x.endswith(".") else new[k]
        out.append(part.upper() if x.isupper() else part)
    return " ".join(out)


#: Kinds in which letter case counts.
SECRETS = ("secret", "access_key", "web_token", "key_block")


def entity_key(kind: str, raw: str, form: str) -> str:
    """What two mentions of one entity share: separators and, but for secrets, letter case don't tell entities apart."""
    if kind in ("card", "iban", "phone", "ssn"):
        raw = re.sub(r"[^0-9A-Za-z+]", "", raw)
    return f"{kind}|{form}|{raw if kind in SECRETS else raw.lower()}"


class _Draw:
    """Keyed random numbers for one entity and attempt."""

    def __init__(self, key: bytes, entity: str, attempt: int):
        self.seed, self.block, self.pool = hmac.new(key, f"{attempt}|{entity}".encode(), hashlib.sha256).digest(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 64:
            self.pool |= int.from_bytes(hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest(), "big") << self.left
            self.left, self.block = self.left + 256, self.block + 1
        value = self.pool & ((1 << 32) - 1)
        self.pool, self.left = self.pool >> 32, self.left - 32
        return value * n >> 32


#: Ranges of letters of one script and case; a letter's surrogate comes from its own range.
SCRIPTS = [("a", "z"), ("A", "Z"), ("0", "9"), ("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω"), ("א", "ת"), ("ぁ", "ん"), ("ァ", "ン"), ("가", "힣"), ("一", "龥")]


def _letter(c: str, draw: _Draw) -> str:
    """Another letter or digit of the same script and case; other characters stay."""
    for low, high in SCRIPTS:
        if low <= c <= high:
            made = chr(ord(low) + draw.below(ord(high) - ord(low) + 1))
            return made if made.isalnum() else low
    # other letters of the Latin script with marks become plain ones of the same case
    return (chr(97 + draw.below(26)) if c.islower() else chr(65 + draw.below(26))) if c.isalpha() else c


def _shaped(own: str, draw: _Draw) -> str:
    return "".join(_letter(c, draw) for c in own)


def _secret(own: str, draw: _Draw) -> str:
    """Hexadecimal digits become others, in the same places letters and digits alike."""
    if not re.fullmatch(r"(?=.*[a-f])[0-9a-f]+|(?=.*[A-F])[0-9A-F]+", own):
        return _shaped(own, draw)
    made = "".join("0123456789abcdef"[draw.below(16)] for _ in own)
    made = made if re.search("[a-f]", made) else "a" + made[1:]
    return made.upper() if own.upper() == own else made


def _luhn(digits: list[int]) -> int:
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10


def _fill(form: str, chars: str) -> str:
    """The form with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in form)


#: Onsets, vowels and the endings of female, male and other names, for scripts with syllables of this kind.
SYLLABLES = {
    "latin": ("bdfgklmnprstv", "aeiou", {"f": "a", "m": "n", "n": "l"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": "а", "m": "н", "n": "л"}),
    "greek": ("βγδζθκλμνπρστφχ", "αεηιου", {"f": "α", "m": "ς", "n": "ν"}),
}


def _script(word: str) -> str | None:
    """Which syllables a name of this script is made of; none for other scripts than these."""
    for c in word.lower():
        if c.isalpha():
            return "cyrillic" if "а" <= c <= "я" or c == "ё" else "greek" if "ͱ" <= c <= "ώ" else "latin" if c < "\u0250" else None
    return "latin"


def _name(own: str, gender: str, draw: _Draw, longer: int = 0) -> str:
    """Invented names from syllables of the name's script, the last letter following the gender; in a script without
    syllables here other letters of that script, with more of them the longer."""
    words = []
    for word in re.split("([ -])", own):
        if word in (" ", "-"):
            words.append(word)
            continue
        if (script := _script(word)) is None:
            words.append("".join(_letter(c, draw) for c in word + word[-1] * longer))
            continue
        onsets, vowels, ends = SYLLABLES[script]
        if word.endswith("."):
            words.append((onsets[draw.below(len(onsets))] + ".").upper())
            continue
        made = "".join(onsets[draw.below(len(onsets))] + vowels[draw.below(len(vowels))] for _ in range(3 + longer)) + onsets[draw.below(len(onsets))] * (gender == "f") + ends[gender]
        words.append(made.upper() if word.isupper() and len(word) > 1 else made.capitalize())
    return "".join(words)


# Networks that are private or the machine's own, as their first octets.
_OWN_NETWORKS = [(10,), (127,), (192, 168), (169, 254), *((172, n) for n in range(16, 32))]


def _ip(own: str, draw: _Draw) -> str:
    """Another address of the same private network, or another public one."""
    octets = tuple(map(int, own.split(".")))
    if octets[0] in (0, *range(224, 256)):  # of a group of receivers, or reserved
        return ".".join(map(str, (octets[0], *(draw.below(256) for _ in range(3)))))
    for network in _OWN_NETWORKS:
        if octets[: len(network)] == network:
            return ".".join(map(str, (*network, *(draw.below(256) for _ in range(4 - len(network))))))
    while True:
        made = (1 + draw.below(223), *(draw.below(256) for _ in range(3)))
        if not any(made[: len(n)] == n for n in _OWN_NETWORKS):
            return ".".join(map(str, made))


def _ipv6(own: str, draw: _Draw) -> str:
    """Other hexadecimal digits in the same places; the first group, which tells the kind of network, stays."""
    first, _, rest = own.partition(":")
    hexes = "0123456789ABCDEF" if own.upper() == own else "0123456789abcdef"
    return first + ":" + "".join(hexes[draw.below(16)] if c.isalnum() else c for c in rest)


def _calling(digits: str) -> int:
    """Length of the country's calling code at the start of a number with it."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in CALLING else 3


def surrogate(key: bytes, kind: str, own: str, form: str, attempt: int = 0) -> str:
    """A replacement of the same kind: same separators, length and scripts, valid where the original is. It is drawn from
    what mentions of one entity share, and then laid into the form of this mention."""
    draw = _Draw(key, entity_key(kind, own, form), attempt)
    if kind == "name":
        return _name(own, form, draw, attempt // REDRAWS)
    if kind == "ip":
        return _ip(own, draw)
    if kind == "email":
        local, _, domain = own.partition("@")
        if RESERVED.search(domain):
            made = _shaped(local.lower(), draw)
            return f"{made.upper() if own.isupper() else made}@{domain}"
        host, _, top = domain.rpartition(".")
        made = f"{_shaped(local.lower(), draw)}@{_shaped(host.lower(), draw)}"
        return (made.upper() if own.isupper() else made) + f".{top}"
    if kind in ("secret", "key_block"):
        return _secret(own, draw)
    if kind == "access_key":
        return own[:4] + _shaped(own[4:], draw)
    if kind == "web_token":
        return ".".join(("eyJ" if part.startswith("eyJ") else "") + _shaped(part.removeprefix("eyJ"), draw) for part in own.split("."))
    if kind == "ipv6":
        return _ipv6(own, draw)
    plain = re.sub(r"[^0-9A-Za-z]", "", own)
    if kind == "card":
        kept = 1 if plain[0] == "4" else 2 if plain[0] in "35" else 4  # what tells the network
        digits = [*map(int, plain[:kept]), *(draw.below(10) for _ in plain[kept:])]
        digits[-1] = (digits[-1] - _luhn(digits)) % 10
        return _fill(own, "".join(map(str, digits)))
    if kind == "iban":
        body = _shaped(plain[4:], draw)
        number = int("".join(str(int(c, 36)) for c in body + plain[:2] + "00"))
        return _fill(own, plain[:2] + f"{98 - number % 97:02d}" + body)
    if kind == "phone":
        kept = _calling(plain) if own.startswith("+") else 0
        made = [plain[:kept], *_shaped(plain[kept:], draw)]
        # an area begins as areas do, and in the North American plan the exchange after it too
        for i in (1, *((4,) if len(plain) - kept == 10 and plain[:kept] in ("", "1") else ())):
            digit = plain[kept + i - 1]
            made[i] = digit if digit in "01" else str(2 + draw.below(8))
        return _fill(own, "".join(made))
    if kind == "ssn" and plain[:3] not in ("000", "666") and plain[0] != "9" and plain[3:5] != "00" and plain[5:] != "0000":
        area = 1 + draw.below(898)
        return f"{area + (area >= 666):03d}-{1 + draw.below(99):02d}-{1 + draw.below(9999):04d}"
    return _shaped(own, draw)


def _distinct(docs: DataFrame) -> DataFrame:
    """(entity, kind, form, own): each entity once, with its smallest mention."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found: dict[str, tuple[str, str, str]] = {}
        for text in batch.column(0):
            text = text.as_py()
            for _, _, kind, form, own in entities(text):
                entity = entity_key(kind, own, form)
                found[entity] = min(found.get(entity, (kind, form, own)), (kind, form, own))
        yield pa.record_batch([pa.array([*found], pa.string()), *(pa.array([v[i] for v in found.values()], pa.string()) for i in range(3))], ["entity", "kind", "form", "own"])

    rows = map_texts(docs.select("text"), run, "entity string, kind string, form string, own string")
    return rows.groupBy("entity").agg(F.min(F.struct("kind", "form", "own")).alias("x")).select("entity", "x.kind", "x.form", "x.own")


def assign(docs: DataFrame, key: bytes) -> DataFrame:
    """(entity, attempt, surrogate_key): for each entity of (text) the attempt whose surrogate no other entity has.

    A surrogate must differ from all other surrogates and from all real entities. Of entities that drew the same one,
    the smallest keeps it; the others draw again, until all differ.
    """

    def drawn(rows: DataFrame) -> DataFrame:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            made = [entity_key(k, surrogate(key, k, o, f, n), f) for k, f, o, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.string())], ["entity", "kind", "form", "own", "attempt", "surrogate_key"])

        return map_texts(rows, run, "entity string, kind string, form string, own string, attempt int, surrogate_key string")

    real = cut(_distinct(docs))
    rows = cut(drawn(real.withColumn("attempt", F.lit(0))))
    while True:
        owners = rows.groupBy("surrogate_key").agg(F.min(F.struct("attempt", "entity")).alias("owner"), F.count("*").alias("n")).filter("n > 1").select("surrogate_key", F.col("owner.entity").alias("owner"))
        clash = rows.join(owners, "surrogate_key", "left").join(real.select(F.col("entity").alias("surrogate_key"), F.lit(True).alias("real")), "surrogate_key", "left")
        again = F.col("real").isNotNull() | (F.col("owner").isNotNull() & (F.col("owner") != F.col("entity")))
        marked = cut(clash.select("entity", "kind", "form", "own", "attempt", "surrogate_key", again.alias("again")))
        if not marked.filter("again").limit(1).count():
            return marked.select("entity", "attempt", "surrogate_key")
        redrawn = drawn(marked.filter("again").select("entity", "kind", "form", "own", (F.col("attempt") + 1).alias("attempt")))
        rows = cut(marked.filter(~F.col("again")).drop("again").union(redrawn))


def _replaced(text: str | None, key: bytes, attempts: dict[str, int]) -> tuple[str | None, list[dict]]:
    spans = entities(text)
    if not spans:
        return text, []
    out, at, told = [], 0, []
    for a, b, kind, form, own in spans:
        made = surrogate(key, kind, own, form, attempts.get(entity_key(kind, own, form), 0))
        made = _mention(made, own, text[a:b]) if kind == "name" else made
        out += [text[at:a], made]
        told.append({"start": a, "end": b, "kind": kind, "surrogate": made})
        at = b
    return "".join([*out, text[at:]]), told


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("surrogate", pa.string())]))


def pseudonymise(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, text, spans) of every row: each detected entity replaced by its surrogate.

    The same key gives the same surrogates in every run. All mentions of an entity get one surrogate, in the form of the
    mention; a name is told by its fullest form in the text, and its shorter mentions, with other titles or none, get
    the same parts of its surrogate. Different entities get different ones. spans have the place of each entity in the original, in characters,
    its kind and its surrogate. Null texts stay null and empty ones empty. Every row gives one row, whatever its id: null
    and repeated ids are like others. Texts of any length are taken whole; an empty table gives an empty result; other
    columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    again = cut(assign(docs, key).filter("attempt > 0").select("entity", "attempt"))
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, text string, spans array<struct<start: long, end: long, kind: string, surrogate: string>>"

    def rows(ids: pa.Array, texts: pa.Array, attempts) -> pa.RecordBatch:
        made = [_replaced(t.as_py(), key, attempts(i)) for i, t in enumerate(texts)]
        return pa.record_batch([ids, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], SPANS)], [id_col, "text", "spans"])

    if again.count() <= broadcast_rows:
        known = docs.sparkSession.sparkContext.broadcast({r["entity"]: r["attempt"] for r in again.collect()})

        def near(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield rows(batch.column(0), batch.column(1), lambda i: known.value)

        return map_texts(docs, near, schema)

    # redrawn entities by text, so that rows of one text share them whatever their ids
    def mentions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, keys = [], []
        for i, text in enumerate(batch.column(1)):
            own = {entity_key(k, o, f) for _, _, k, f, o in entities(text.as_py())}
            at += [i] * len(own)
            keys += own
        yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.string())], ["own_hash", "entity"])

    hashed = docs.select("id", "text", F.xxhash64("text").alias("hash"))
    own = map_texts(hashed.select("hash", "text"), mentions, "own_hash long, entity string").join(again, "entity").distinct()
    own = own.groupBy("own_hash").agg(F.collect_list(F.struct("entity", "attempt")).alias("attempts"))  # at most the text's entities

    def joined(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = batch.column(2)
        yield rows(batch.column(0), batch.column(1), lambda i: {x["entity"]: x["attempt"] for x in own[i].as_py() or ()})

    return map_texts(hashed.join(own, F.col("hash") == F.col("own_hash"), "left").select("id", "text", "attempts"), joined, schema)
