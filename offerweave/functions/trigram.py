"""Trigram similarity as Column expressions.

A word is padded with two blanks before and one after; its trigrams are all runs of three
characters. Words are what runs of letters and digits give, lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_trigrams(c: Column) -> Column:
    """Trigrams in order of place, repeated ones included; null text has none."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{Nd}]+"), 0)
    of = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)))
    return F.flatten(F.transform(ws, of))


def trigrams(c: Column) -> Column:
    return F.array_distinct(ordered_trigrams(c))


def overlap(a: Column, b: Column) -> Column:
    """Share of two trigram sets that both have; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    return overlap(trigrams(a), trigrams(b))


def word_overlap(want: Column, have: Column) -> Column:
    """The greatest overlap of trigram set ``want`` with any run of the ordered trigrams ``have``.

    A best run begins and ends with a trigram of ``want``, so only runs between such places are
    compared: their number is the square of the hits, not of the text. Give both as columns that
    were selected before, else they are worked out again for each run.
    """
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(have), F.lit(1))), lambda i: F.array_contains(want, F.get(have, i - 1)))
    best = F.transform(
        at,
        lambda i: F.array_max(
            F.transform(F.filter(at, lambda j: j >= i), lambda j: overlap(want, F.array_distinct(F.slice(have, i, j - i + 1))))
        ),
    )
    return F.coalesce(F.array_max(best), F.lit(0.0))


def word_similarity(needle: Column, text: Column) -> Column:
    return word_overlap(trigrams(needle), ordered_trigrams(text))


def is_similar(a: Column, b: Column, least: float = 0.3) -> Column:
    return similarity(a, b) >= least


def is_word_similar(needle: Column, text: Column, least: float = 0.5) -> Column:
    return word_similarity(needle, text) >= least


def word_distance(x: Column, y: Column) -> Column:
    """1 - word_similarity(x, y)."""
    return F.lit(1.0) - word_similarity(x, y)
