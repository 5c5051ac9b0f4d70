"""Cutting text into pre-tokens, as the public byte-level BPE libraries do."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import regex

# Letters and numbers that are newer than Unicode 16.0. The tokenizer
# libraries follow Unicode 16.0 and see them as other characters.
NEWER = (
    (0x558, 0x558), (0x58b, 0x58c), (0x88f, 0x88f), (0xc5c, 0xc5c), (0xcdc, 0xcdc), (0x208f, 0x208f),
    (0x209d, 0x209f), (0xa7ce, 0xa7cf), (0xa7d2, 0xa7d2), (0xa7d4, 0xa7d4), (0xa7dd, 0xa7dd), (0xa7e2, 0xa7e2),
    (0xa7f1, 0xa7f1), (0xab6c, 0xab6d), (0x107bb, 0x107bf), (0x10940, 0x10959), (0x10ec5, 0x10ec7),
    (0x10ed9, 0x10eee), (0x11b0a, 0x11b0a), (0x11db0, 0x11ddb), (0x11de0, 0x11de9), (0x11df1, 0x11df1),
    (0x1246f, 0x1246f), (0x12475, 0x1247f), (0x12550, 0x12686), (0x16ea0, 0x16eb8), (0x16ebb, 0x16ed3),
    (0x16ff2, 0x16ff6), (0x187f8, 0x187ff), (0x18cd6, 0x18cda), (0x18d09, 0x18d20), (0x18d80, 0x18df2),
    (0x18e00, 0x19191), (0x191a0, 0x191d2), (0x1b123, 0x1b128), (0x1b168, 0x1b168), (0x1d6a6, 0x1d6a6),
    (0x1df1f, 0x1df24), (0x1df2b, 0x1df81), (0x1df90, 0x1df96), (0x1dfcd, 0x1dfff), (0x1e6c0, 0x1e6de),
    (0x1e6e0, 0x1e6e2), (0x1e6e4, 0x1e6e5), (0x1e6e7, 0x1e6ed), (0x1e6f0, 0x1e6f4), (0x1e6fe, 0x1e6ff),
    (0x2b73a, 0x2b73f), (0x2b81e, 0x2b81e), (0x2cea2, 0x2cead), (0x323b0, 0x33479), (0x3d000, 0x3fc3f))
#: A character without a class of its own in any version.
OTHER = "\u0378"
#: Texts over this many characters are cut piece by piece, not into one list.
LONG_TEXT = 1 << 20
#: The characters from the first of NEWER on. Most texts have none, and one range is searched for in a tenth of the time.
HIGH = re.compile(f"[{chr(NEWER[0][0])}-\U0010ffff]")


@lru_cache(maxsize=None)
def _newer() -> regex.Pattern:
    return regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")


#: What the classes of a pattern hold in ASCII.
ASCII = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r ", r"\S": r"\x00-\x08\x0e-\x1f!-\x7f"}
_CLASS = re.compile(r"\\p\{\w+\}|\\[sS]")
#: A pattern of which only the classes outside of ``re`` are rewritten: letters, groups of ``?:`` and ``?!``, plain sets and quantifiers.
_PLAIN = re.compile(r"(?:\[\^?(?:\\p\{[LN]\}|\\[sS])+\]|\\p\{[LN]\}|\\[sS]|\(\?[:!]|\)|[?*+](?![?*+])|\||[A-Za-z' ])+")


@lru_cache(maxsize=None)
def _ascii(pattern: str) -> re.Pattern | None:
    """``pattern`` for ``re``, which cuts ASCII texts in half the time; None if it has more than what is told from PLAIN."""
    if not _PLAIN.fullmatch(pattern):
        return None
    parts = re.split(r"(\[[^\]]*\])", pattern)            # sets at the odd places
    return re.compile("".join(_CLASS.sub(lambda m, one=i % 2: ASCII[m[0]] if one else f"[{ASCII[m[0]]}]", p) for i, p in enumerate(parts)))


@lru_cache(maxsize=None)
def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def _first_newer(text: str) -> regex.Match | None:
    high = not text.isascii() and HIGH.search(text)
    return _newer().search(text, high.start()) if high else None


def piece_groups(text: str, pattern: str, group: int = 200_000) -> Iterator[list[str]]:
    """The pre-tokens of ``text`` in order, in lists of bounded length."""
    cut = text.isascii() and _ascii(pattern) or _compiled(pattern)
    newer = _first_newer(text)
    if not newer and len(text) <= LONG_TEXT:
        yield cut.findall(text)
        return
    shadow = _newer().sub(OTHER, text) if newer else text
    found = cut.finditer(shadow)
    while part := [text[m.start():m.end()] for m in itertools.islice(found, group)]:
        yield part
