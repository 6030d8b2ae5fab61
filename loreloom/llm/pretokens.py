"""Cutting texts into pieces that a byte-level BPE tokenizer's merges never cross."""

from __future__ import annotations

from functools import lru_cache
import re
import unicodedata

from tokenizers import Tokenizer

# The white space that the tokenizer's own pattern knows.
_WS = r"\t\n\x0b\x0c\r \x85\xa0  -     　"

#: A word with the one space before it, or a run of white space. The tokenizer's pattern cuts at these places too.
_LED = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

#: Longer pieces are cut further, so that a text without spaces does not become one entry of a vocabulary.
LONG = 48


@lru_cache(2)
def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(2)
def _specials(path: str) -> re.Pattern | None:
    added = load(path).get_added_tokens_decoder().values()
    found = sorted((t.content for t in added), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None


def _class(first: str) -> str:
    """The characters below U+0250 of a general category, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == first)


#: The tokenizer's pattern for texts of characters below U+0250, whose categories no Unicode version has changed.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_class('L')}]+| ?[{_class('N')}]+| ?[^{_WS}{_class('L')}{_class('N')}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
_ONLY_LATIN = re.compile("[\x00-\u024f]*").fullmatch


def split(piece: str, path: str) -> list[str]:
    """The tokenizer's own pre-tokens of a piece."""
    if _ONLY_LATIN(piece):
        return _LATIN.findall(piece)
    cut = load(path).pre_tokenizer.pre_tokenize_str(piece)
    return [piece[a:b] for _, (a, b) in cut]


def pieces(text: str | None, path: str) -> list[str]:
    """The text in pieces; each special token's string is a piece of its own, as the tokenizer has it."""
    if not text:
        return []
    special = _specials(path)
    if special and (parts := special.split(text)) and len(parts) > 1:
        out = []
        for i, part in enumerate(parts):
            out += [part] if i % 2 else _led(part, path)
        return out
    return _led(text, path)


def _led(text: str, path: str) -> list[str]:
    found = _LED.findall(text)
    if max(map(len, found), default=0) <= LONG:
        return found
    out: list[str] = []
    for x in found:
        if len(x) <= LONG:
            out.append(x)
        else:
            out += split(x, path)
    return out
