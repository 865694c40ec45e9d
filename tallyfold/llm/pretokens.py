"""Pre-tokens: the matches of the public byte-level pattern, with quick ways for texts of few characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import regex

#: Above this many characters a text is matched piece by piece, so that no list of all matches is held.
LONG_TEXT = 1_000_000
PIECES = 50_000


def _written_out(codes: range) -> str:
    """The pattern with its classes written out for the given characters, which `re` matches much faster."""
    letters, numbers, spaces = ("".join(re.escape(c) for c in map(chr, codes) if test(c)) for test in (
        lambda c: unicodedata.category(c)[0] == "L", lambda c: unicodedata.category(c)[0] == "N", lambda c: c in "\t\n\x0b\x0c\r \x85\xa0"))
    out = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]")
    return out.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")


@lru_cache(1)
def _matchers():
    """Patterns for all characters, for the first 256, and for the first 128."""
    return regex.compile(public_tokenizers.PATTERN), re.compile(_written_out(range(256))), re.compile(_written_out(range(128)))


def _matcher(text: str):
    whole, latin, ascii_only = _matchers()
    if text.isascii():
        return ascii_only
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return whole
    return latin


def pretokens(text: str) -> list[str]:
    """All pre-tokens of a text, in order."""
    return _matcher(text).findall(text)


def pretoken_lists(text: str) -> Iterator[list[str]]:
    """The pre-tokens in lists of bounded length."""
    if len(text) < LONG_TEXT:
        yield pretokens(text)
        return
    out: list[str] = []
    for m in _matcher(text).finditer(text):
        out.append(m.group())
        if len(out) >= PIECES:
            yield out
            out = []
    yield out
