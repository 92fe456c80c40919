"""Text normalisers. They differ on purpose: keys, lookups, identities and places each use theirs.

All are Column expressions, so they run inside generated code.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of Serbian Latin and Cyrillic and what they become.
LATIN_SINGLE = ("čćšž", "ccsz")
CYRILLIC_SINGLE = ("абвгдезијклмнопрстћуфхцчшж", "abvgdezijklmnoprstcufhccsz")
DIGRAPHS = {"đ": "dj", "ђ": "dj", "љ": "lj", "њ": "nj", "џ": "dz"}

#: Words of a query that carry no meaning, and short ones that do.
STOPWORDS = ["a", "i", "u", "o", "za", "sa", "od", "na", "po", "iz", "do", "se", "je", "ili", "the", "of", "with", "and", "for", "in"]
KEEP_SHORT = ["c", "d", "b", "k", "e", "a"]

#: Latin-1 and Latin-2 letters by their base letter; other scripts have no entry.
ACCENTED = {
    "a": "àáâãäåāăą", "c": "çĉċ", "d": "ď", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭį", "j": "ĵ", "k": "ķ", "l": "ĺļľ", "n": "ñńņň",
    "o": "òóôõöōŏő", "r": "ŕŗř", "s": "śŝş", "t": "ţť", "u": "ùúûüũūŭůűų", "w": "ŵ", "y": "ýÿŷ", "z": "źż",
}


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def transliterate(c: Column, cyrillic: bool = True) -> Column:
    """Lower-cased text in plain Latin letters."""
    for letter, pair in DIGRAPHS.items():
        if cyrillic or letter == "đ":
            c = F.replace(c, F.lit(letter), F.lit(pair))
    a, b = (x + y for x, y in zip(LATIN_SINGLE, CYRILLIC_SINGLE if cyrillic else ("", ""), strict=True))
    return F.translate(c, a, b)


def _spaced(c: Column, other: str) -> Column:
    return F.trim(F.regexp_replace(c, other, " "))


def normalize_key(c: Column) -> Column:
    """For keys and queries: letters and digits of any script stay, all else is one space."""
    return _spaced(transliterate(F.lower(F.trim(_blank(c)))), r"[^\p{L}\p{Nd}]+")


def normalize_lookup(c: Column) -> Column:
    """For look-ups: a letter outside a-z after transliteration parts the word."""
    return _spaced(F.lower(transliterate(F.lower(_blank(c)))), "[^0-9a-z]+")


def fold_accents(c: Column) -> Column:
    a = "".join(ACCENTED.values())
    b = "".join(k * len(v) for k, v in ACCENTED.items())
    return F.regexp_replace(F.translate(c, a, b), r"\p{M}+", "")


def normalize_identity(c: Column) -> Column:
    """For brands and cores: accents are folded to their base letter."""
    return _spaced(fold_accents(transliterate(F.lower(_blank(c)))), "[^0-9a-z]+")


def normalize_place(c: Column) -> Column:
    """For place names: Serbian Latin only, all other letters part words."""
    return _spaced(transliterate(F.lower(_blank(c)), cyrillic=False), "[^0-9a-z]+")


def words(c: Column) -> Column:
    """Words of normalised text; none if it is empty."""
    return F.filter(F.split(c, " "), lambda w: w != "")


def tokenize(c: Column) -> Column:
    """Distinct meaningful words of a query, in order."""
    short = F.array(*[F.lit(x) for x in KEEP_SHORT])
    stop = F.array(*[F.lit(x) for x in STOPWORDS])
    kept = F.filter(words(normalize_key(c)), lambda w: ((F.octet_length(w) > 1) | F.array_contains(short, w)) & ~F.array_contains(stop, w))
    return F.array_distinct(kept)


def join(ws: Column) -> Column:
    return F.array_join(ws, " ")


def title_words(c: Column) -> Column:
    """Words for display: codes like d3 in capitals, other words with a capital first letter."""
    word = lambda w: F.when(w.rlike(r"\p{Nd}") & w.rlike(r"\p{L}"), F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    )
    return join(F.transform(F.filter(F.split(_blank(c), r"\s+"), lambda w: w != ""), word))


def python_title(c: Column) -> Column:
    """Every letter after a non-letter is a capital, all others are small."""
    runs = F.regexp_extract_all(F.lower(_blank(c)), F.lit(r"\p{L}+|\P{L}+"), 0)
    return F.array_join(F.transform(runs, F.initcap), "")


def contains_text(c: Column, needle: str) -> Column:
    """Case-insensitive substring; null never matches."""
    return F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))


def contains_all(tokens: Column, required: list[str]) -> Column:
    """All of ``required`` are among ``tokens``; nothing required or null tokens never match."""
    if not required:
        return F.lit(False)
    found = [F.array_contains(tokens, F.lit(t)) for t in required]
    out = found[0]
    for c in found[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


@lru_cache(maxsize=None)
def literals(values: tuple[str, ...]) -> list[Column]:
    """A column for each value, made once: a plan that names a dictionary often doesn't pay for
    thousands of literals each time."""
    return [F.lit(v) for v in values]


@lru_cache(maxsize=None)
def map_of(items: tuple[tuple[str, object], ...]) -> Column:
    """A map literal, made once."""
    return F.create_map(*[F.lit(x) for kv in items for x in kv])
