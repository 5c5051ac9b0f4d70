"""Text column expressions (STR-*, SYN-1, MTH-5, SET-1/2, AGG-2).

All of them are built from Spark SQL functions so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import constants as K

_WS = K.PY_WHITESPACE_CLASS


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace (``trim`` only
    drops U+0020, so the whole character set is given to ``btrim``)."""
    return F.btrim(_c(x), F.lit(K.PY_WHITESPACE_CHARS))


#: Code points that decompose or are combining marks lie in these ranges.
_DECOMPOSING = (range(0x80, 0xD800), range(0xE000, 0x30000), range(0xE0000, 0xE0200))
_SYLLABLES, _VOWELS, _TAILS = 0xAC00, 21, 28


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, dict[str, str]]:
    """(from, to, spelled): ``from`` / ``to`` for ``translate``: every character whose canonical
    decomposition, without combining marks (category Mn), is one other character or nothing, the
    marks too; ``spelled``: those with several characters there, but Hangul syllables, which
    follow a rule. Built from ``unicodedata`` by rule, not listed by hand."""
    src, dst, drop, spelled = [], [], [], {}
    for cp in (c for r in _DECOMPOSING for c in r):
        if _SYLLABLES <= cp < _SYLLABLES + 19 * _VOWELS * _TAILS:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize("NFD", ch) if unicodedata.category(c) != "Mn")
        if base == ch:
            continue
        if not base:
            drop.append(ch)
        elif len(base) == 1:
            src.append(ch)
            dst.append(base)
        else:
            spelled[ch] = base
    return "".join(src) + "".join(drop), "".join(dst), spelled


def _spell(x: Column, spelled: dict[str, str]) -> Column:
    """``x`` with the characters of ``spelled`` and Hangul syllables as their parts."""
    table = F.create_map(*[F.lit(v) for pair in spelled.items() for v in pair])
    leads, vowels = ("".join(chr(first + i) for i in range(n)) for first, n in ((0x1100, 19), (0x1161, _VOWELS)))
    tails = "".join(chr(0x11A8 + i) for i in range(_TAILS - 1))

    def one(ch: Column) -> Column:
        n = F.ascii(ch) - _SYLLABLES
        pick = lambda parts, at: F.substr(F.lit(parts), at + 1, F.lit(1))
        tail = F.when(n % _TAILS == 0, "").otherwise(pick(tails, (n % _TAILS - 1).cast("int")))
        syllable = F.concat(pick(leads, F.floor(n / (_VOWELS * _TAILS)).cast("int")),
                            pick(vowels, F.floor(n / _TAILS).cast("int") % _VOWELS), tail)
        return F.when((n >= 0) & (n < 19 * _VOWELS * _TAILS), syllable).otherwise(F.coalesce(F.try_element_at(table, ch), ch))
    return F.array_join(F.transform(F.split(x, ""), one), "")


def strip_marks(x) -> Column:
    """NFD without combining marks (Mn)."""
    frm, to, spelled = fold_table()
    folded = F.translate(_c(x), frm, to)
    has = "[\uac00-\ud7a3" + "".join(spelled) + "]"
    return F.when(folded.rlike(has), _spell(folded, spelled)).otherwise(folded)


def normalize_text(x) -> Column:
    """STR-1: lower, strip, NFD, drop combining marks (Mn)."""
    return strip_marks(py_strip(F.lower(_c(x))))


def extract_query_term(x) -> Column:
    """STR-2 + FLT-8: drop a leading definition phrase, cut at the first ``, ? .``,
    strip; a term of two characters or fewer becomes empty."""
    cleaned = F.regexp_replace(py_strip(_c(x)), r"(?iu)\A" + K.QUERY_PREFIX_BODY, "")
    term = py_strip(F.split(cleaned, K.TERM_CUT_CLASS).getItem(0))
    return F.when(F.length(term) > 2, term).otherwise(F.lit(""))


def within_one_edit(a, b) -> Column:
    """STR-3: Levenshtein distance <= 1 (the threshold form returns -1 when over)."""
    return F.levenshtein(_c(a), _c(b), 1) >= 0


def tokenize_words(x) -> Column:
    """STR-4: lower-case Unicode word tokens (Python's ``\\w+``)."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(f"({K.WORD_PATTERN})"), 1)


def word_set(x) -> Column:
    """AGG-2: distinct words of a text."""
    return F.array_distinct(tokenize_words(x))


def tokenize_whitespace(x) -> Column:
    """STR-5: ``x.lower().split()``."""
    return F.filter(F.split(F.lower(_c(x)), f"{_WS}+"), lambda t: t != "")


def whitespace_set(x) -> Column:
    return F.array_distinct(tokenize_whitespace(x))


def jaccard_sets(a, b) -> Column:
    """STR-7 on two distinct-token arrays: |A∩B| / |A∪B|, both empty -> 0.0."""
    inter = F.size(F.array_intersect(_c(a), _c(b)))
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union)


def jaccard_words(a, b) -> Column:
    """STR-7 on two texts (whitespace word sets, lower-cased)."""
    return jaccard_sets(whitespace_set(a), whitespace_set(b))


def stopword_array() -> Column:
    return F.array(*[F.lit(w) for w in dict.fromkeys(K.STOPWORDS)])


def extract_keywords(x) -> Column:
    """SYN-1 / FLT-3: distinct words longer than two characters, not stopwords."""
    stop = stopword_array()
    return F.filter(word_set(x), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def sentence_parts(x) -> Column:
    """STR-6: split on runs of ``. ! ? ;`` (empty parts kept; positions are list indices)."""
    return F.split(_c(x), K.SENTENCE_SPLIT)


def overlap_score(words, keywords) -> Column:
    """MTH-5 / SET-2: |words ∩ keywords| / |words|, no words -> 0.0."""
    n = F.size(_c(words))
    hit = F.size(F.array_intersect(_c(words), _c(keywords)))
    return F.when(n == 0, F.lit(0.0)).otherwise(hit.cast("double") / n)


def decapitalize(x) -> Column:
    """STR-8: lower-case the first character."""
    return F.concat(F.lower(F.substr(_c(x), F.lit(1), F.lit(1))), F.substr(_c(x), F.lit(2)))


def ensure_period(x) -> Column:
    """STR-9: append ``.`` unless the text already ends with one."""
    return F.when(_c(x).endswith("."), _c(x)).otherwise(F.concat(_c(x), F.lit(".")))


def prefix_match(text, term) -> Column:
    """STR-10: the normalised first ``len(term)+3`` characters start with the normalised term."""
    head = F.substr(_c(text), F.lit(1), F.length(_c(term)) + 3)
    return normalize_text(head).startswith(normalize_text(term))


def render_messages(messages) -> Column:
    """STR-11: ``ROLE: content`` lines plus a final ``ASSISTANT:`` line."""
    lines = F.transform(_c(messages), lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"]))
    return F.concat(F.array_join(lines, "\n"), F.lit("\nASSISTANT:"))


def whitespace_token_count(x) -> Column:
    """AGG-5: ``len(x.split())``."""
    return F.size(F.filter(F.split(_c(x), f"{_WS}+"), lambda t: t != ""))
