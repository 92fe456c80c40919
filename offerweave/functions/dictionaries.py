"""Dictionaries of ingredients, brands and stop words: inputs, not constants.

``Dictionaries.load`` reads full ones from JSON files; ``Dictionaries.small`` has a short built-in
set. Matching them is done with Column expressions built from the dictionary.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from offerweave.functions import text as T

#: Categories of ingredients that identify a product whatever its brand.
IDENTIFYING = ("supplement", "otc-drug", "otc", "drug")
SEARCH_ONLY = "searchcat"

# A short dictionary of ingredients, (canonical, category, aliases).
SMALL_INGREDIENTS = [
    ("vitamin d3", "supplement", ["vitamin d3", "d3", "d 3", "vit d3", "vitamin d 3", "vitamin d", "holekalciferol", "detrical"]),
    ("vitamin c", "supplement", ["vitamin c", "vit c", "vitaminom c", "c vitamin", "askorbinska kiselina", "ascorbic acid"]),
    ("vitamin e", "supplement", ["vitamin e", "vit e", "tokoferol"]),
    ("vitamin k2", "supplement", ["vitamin k2", "k2", "mk7", "menakinon"]),
    ("vitamin b6", "supplement", ["vitamin b6", "b6", "piridoksin"]),
    ("vitamin b12", "supplement", ["vitamin b12", "b12", "kobalamin"]),
    ("magnezijum", "supplement", ["magnezijum", "magnesium", "magnezijuma", "magnezij"]),
    ("cink", "supplement", ["cink", "zinc", "cinka"]),
    ("selen", "supplement", ["selen", "selenium"]),
    ("gvozdje", "supplement", ["gvozdje", "iron", "ferrum"]),
    ("omega 3", "supplement", ["omega 3", "omega3", "riblje ulje", "fish oil"]),
    ("koenzim q10", "supplement", ["koenzim q10", "coenzyme q10", "coq10", "q10"]),
    ("kolagen", "supplement", ["kolagen", "collagen"]),
    ("probiotik", "supplement", ["probiotik", "probiotic", "probiotici"]),
    ("multivitamin", "supplement", ["multivitamin", "multivitamini"]),
    ("ibuprofen", "otc-drug", ["ibuprofen"]),
    ("paracetamol", "otc-drug", ["paracetamol"]),
    ("pantenol", "cosmetic", ["pantenol", "panthenol", "dexpanthenol"]),
    ("hijaluron", "cosmetic", ["hijaluron", "hyaluron", "hijaluronska kiselina"]),
]

# Brands to leave out of a residual, words to keep all the same, makers of cosmetics.
SMALL_BRANDS = {
    "strip": ["now", "solgar", "bioderma", "garnier", "ultimate", "nutrition", "eucerin", "nivea", "balea", "vichy"],
    "keep": ["vitamin", "omega"],
    "cosmetic": ["bioderma", "garnier", "eucerin", "nivea", "balea", "vichy", "la roche posay"],
    "known": ["now", "solgar", "bioderma", "garnier", "ultimate nutrition", "eucerin", "nivea", "balea", "vichy", "la roche posay", "dietpharm", "gumedici", "centrum"],
}
SMALL_STOPWORDS = {
    "noise": ["za", "sa", "i", "od", "na", "dodatak", "ishrani", "preparat", "proizvod", "novo", "akcija", "protein", "whey", "komada", "kom", "pakovanje"],
    "forms": ["tablete", "tableta", "tabl", "tab", "kapsule", "kapsula", "kaps", "kap", "caps", "capsules", "sirup", "sprej", "kapi", "gel", "krema", "mast", "losion", "serum", "kesice", "ampule", "bombone", "prah"],
}

# What is put on the skin or is no food, by word.
TOPICAL = (
    "krema krem gel serum losion mast sampon balzam sapun maska pena puder lak ruz tonik mleko mlijeko emulzija fluid pasta dezodorans parfem edt edp kupka "
    "micelarna voda scrub piling melem maramice maramica ulosci ulozak ulozaka jastucici jastucic vagitorije vaginalete vaginaleta supozitorije supozitorija "
    "patrona patrone papir duda dude dudica cucla cucle stapici tampon tamponi traka trake vosak stik roll nocna dnevna bora falten antiageing highlighter korektor maskara"
).split()

# Words of cosmetic brands that don't make another brand cosmetic.
COSMETIC_DENY = "natural nature strong nutrition health active vitamin complex formula pharma plus care beauty gold premium".split()

# Spellings of words in a product line.
SYNONYMS = {
    "caseine": "casein", "kazein": "casein", "kazeina": "casein", "micelarni": "micellar", "micelarna": "micellar",
    "izolat": "isolate", "izolata": "isolate", "izolatom": "isolate", "isolat": "isolate",
}


def plain(text: str, ascii_only: bool = False) -> str:
    """A dictionary entry on the driver, as normalize_key (or normalize_identity) makes it."""
    table = dict(zip(*(x + y for x, y in zip(T.LATIN_SINGLE, T.CYRILLIC_SINGLE, strict=True)), strict=True)) | T.DIGRAPHS
    text = "".join(table.get(c, c) for c in (text or "").strip().lower())
    if ascii_only:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        return " ".join(re.sub("[^0-9a-z]+", " ", text).split())
    return " ".join("".join(c if c.isalpha() or c.isdecimal() else " " for c in text).split())


@dataclass
class Dictionaries:
    """aliases: phrase -> canonical and category; brands and stop words as sets of phrases."""

    canonical: dict[str, str] = field(default_factory=dict)
    category: dict[str, str] = field(default_factory=dict)
    strip: set[str] = field(default_factory=set)
    keep: set[str] = field(default_factory=set)
    cosmetic: set[str] = field(default_factory=set)
    known: set[str] = field(default_factory=set)
    noise: set[str] = field(default_factory=set)
    forms: set[str] = field(default_factory=set)
    concepts: list[dict] = field(default_factory=list)

    @classmethod
    def of(cls, ingredients, brands, stopwords, concepts=()) -> Dictionaries:
        """The first entry that names an alias keeps it; concepts are for queries only."""
        out = cls(concepts=list(concepts))
        for name, category, aliases in ingredients:
            if name := plain(name):
                out.category[name] = category
                for alias in aliases:
                    if alias := plain(alias):
                        out.canonical.setdefault(alias, name)
        for concept in concepts:
            if name := plain(concept["token"]):
                out.category[name] = SEARCH_ONLY
                for alias in [concept["token"], *concept.get("queryAliases", [])]:
                    if alias := plain(alias):
                        out.canonical.setdefault(alias, name)
        phrases = lambda xs: {p for x in xs if (p := plain(x))}
        out.strip, out.keep, out.cosmetic = (phrases(brands.get(k, [])) for k in ("strip", "keep", "cosmetic"))
        out.known = phrases(brands.get("known", [])) or out.strip
        out.noise, out.forms = phrases(stopwords.get("noise", [])), phrases(stopwords.get("forms", []))
        return out

    @classmethod
    def small(cls) -> Dictionaries:
        return cls.of(SMALL_INGREDIENTS, SMALL_BRANDS, SMALL_STOPWORDS)

    @classmethod
    def load(cls, spark: SparkSession, ingredients: str, brands: str | None = None, stopwords: str | None = None, concepts: str | None = None) -> Dictionaries:
        """From JSON files that Spark can read (dictionaries are small: a file each)."""
        read = lambda path: json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())) if path else {}
        entries = [(e["canonical"], e.get("category", "supplement"), e.get("aliases", [])) for e in read(ingredients).get("ingredients", [])]
        return cls.of(entries, read(brands), read(stopwords), read(concepts).get("categories", []))

    def aliases(self, identifying: bool = False) -> dict[str, str]:
        return {a: c for a, c in self.canonical.items() if not identifying or self.category[c] in IDENTIFYING}

    def aliases_for(self, canonical: str) -> list[str]:
        return [a for a, c in self.canonical.items() if c == canonical]

    def cosmetic_words(self) -> set[str]:
        return {w for b in self.cosmetic for w in b.split() if len(w) >= 5 and w not in COSMETIC_DENY}


def among(c: Column, values) -> Column:
    values = tuple(sorted(values))
    return c.isin(T.literals(values)) if values else F.lit(False)


def _pattern(phrases) -> str:
    """Any of the phrases as whole words, those of more words first: from each place the longest
    phrase is taken, and what it holds isn't looked at again."""
    by_size = sorted(phrases, key=lambda p: (-len(p.split()), p))
    return "(?<= )(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in by_size) + ")(?= )"


def ingredients(normalized: Column, dictionaries: Dictionaries, identifying: bool = False) -> Column:
    """Sorted distinct canonical ingredients in normalised text."""
    table = dictionaries.aliases(identifying)
    if not table:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(F.concat(F.lit(" "), normalized, F.lit(" ")), F.lit(_pattern(table)), 0)
    canonical = T.map_of(tuple(table.items()))
    return F.array_sort(F.array_distinct(F.transform(found, lambda a: F.try_element_at(canonical, a))))


def leftover(normalized: Column, dictionaries: Dictionaries, identifying: bool = False) -> Column:
    """Words of normalised text that no ingredient took, in order."""
    table = dictionaries.aliases(identifying)
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    return T.words(F.regexp_replace(padded, _pattern(table), " ") if table else padded)


def detect_brand(normalized: Column, dictionaries: Dictionaries) -> Column:
    """The known brand of most words in normalised text, the leftmost of equals; null if none."""
    if not dictionaries.known:
        return F.lit(None).cast("string")
    known = T.map_of(tuple((b, True) for b in sorted(dictionaries.known)))
    ws = T.words(normalized)
    sizes = sorted({len(b.split()) for b in dictionaries.known}, reverse=True)
    at = lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws), F.lit(1))), lambda i: i + n - 1 <= F.size(ws)), lambda i: T.join(F.slice(ws, i, F.lit(n)))
    )
    hits = [F.filter(at(n), lambda p: F.coalesce(F.try_element_at(known, p), F.lit(False))) for n in sizes]
    return F.coalesce(*[F.get(h, F.lit(0)) for h in hits])


def is_cosmetic(brand: Column, dictionaries: Dictionaries, by_word: bool = False) -> Column:
    """Whether a normalised brand makes cosmetics; ``by_word``: or has a word of one that does."""
    out = among(brand, dictionaries.cosmetic)
    return out | F.exists(T.words(brand), lambda w: among(w, dictionaries.cosmetic_words())) if by_word else out


def within_edits(a: str, b: str, most: int) -> int:
    """Edit distance of two short strings, most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return min(row[-1], most + 1)


class Query:
    """What one search query asks for, worked out on the driver: dictionary aliases with a typo
    count, other words are required as they are."""

    def __init__(self, text: str, dictionaries: Dictionaries):
        self.text = text.strip()
        self.normalized = plain(text)
        self.dictionaries = dictionaries
        found, rest = self._exact(self.normalized.split())
        found, rest = self._typos(found, rest)
        self.ingredients = sorted(found)
        meaningful = [w for w in rest if w not in T.STOPWORDS and (len(w.encode()) > 1 or w in T.KEEP_SHORT)]
        #: Words that a product must all have; an ingredient counts as one word.
        self.required = sorted({c.replace(" ", "") for c in found} | set(meaningful))
        #: Phrases by which the query may be told.
        spelled = {self.normalized, self.normalized.replace(" ", "")}
        for c in found:
            spelled |= {c, c.replace(" ", ""), *dictionaries.aliases_for(c)}
        self.variants = sorted(v for v in spelled if v)
        words = [w for w in dict.fromkeys(self.normalized.split()) if w not in T.STOPWORDS and (len(w.encode()) > 1 or w in T.KEEP_SHORT)]
        self.tokens = words

    def _exact(self, words: list[str]) -> tuple[set[str], list[str]]:
        table = self.dictionaries.canonical
        longest = max((len(a.split()) for a in table), default=0)
        found, rest, i = set(), [], 0
        while i < len(words):
            n = next((n for n in range(min(longest, len(words) - i), 0, -1) if " ".join(words[i : i + n]) in table), 0)
            if n:
                found.add(table[" ".join(words[i : i + n])])
            else:
                rest.append(words[i])
            i += max(n, 1)
        return found, rest

    def _nearest(self, text: str, one_word: bool) -> str | None:
        n = len(text.encode())
        if n < 5:
            return None
        most = 2 if n >= 10 else 1
        table = {a: c for a, c in self.dictionaries.canonical.items() if len(a) >= 5 and self.dictionaries.category[c] != SEARCH_ONLY and (not one_word or " " not in a)}
        if text in table:
            return table[text]
        near = [(within_edits(text, a, most), i, c) for i, (a, c) in enumerate(table.items())]
        best = min(near, default=(most + 1, 0, None))
        return best[2] if best[0] <= most else None

    def _typos(self, found: set[str], rest: list[str]) -> tuple[set[str], list[str]]:
        kept = []
        for w in rest:
            if c := self._nearest(w, one_word=True):
                found = found | {c}
            else:
                kept.append(w)
        if not found and 1 <= len(self.normalized.split()) <= 3 and (c := self._nearest(self.normalized, one_word=False)):
            return {c}, []
        return found, kept
