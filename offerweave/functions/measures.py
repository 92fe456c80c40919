"""Units, forms, strengths, sizes and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from offerweave.functions.text import map_of, normalize_key, normalize_lookup, title_words

# Spellings of units, for keys.
UNITS = {
    "i u": "iu", "i j": "iu", "ij": "iu", "iu": "iu", "ije": "iu", "jm": "iu", "j m": "iu", "ie": "iu", "me": "iu",
    "μg": "mcg", "µg": "mcg", "mcg": "mcg", "ug": "mcg", "mikrogram": "mcg", "mikrograma": "mcg",
    "gr": "g", "gram": "g", "grama": "g", "kg": "kg", "l": "l", "litar": "l", "litra": "l", "ml": "ml", "mililitar": "ml", "mililitra": "ml",
}

# Spellings of units, for extraction from titles.
EXTRACT_UNITS = {
    "мг": "mg", "г": "g", "кг": "kg", "мкг": "mcg", "мл": "ml", "л": "l", "ме": "iu", "ије": "iu", "ијм": "iu",
    "μg": "mcg", "µg": "mcg", "ug": "mcg",
    "i.u.": "iu", "i.j.": "iu", "ij": "iu", "iu": "iu", "ije": "iu", "jm": "iu", "j.m.": "iu", "ie": "iu", "i u": "iu", "i j": "iu",
    "gr": "g", "gram": "g", "grama": "g", "miligram": "mg", "miligrama": "mg", "mikrogram": "mcg", "mikrograma": "mcg",
    "mililitar": "ml", "mililitra": "ml", "litar": "l", "litra": "l",
}

# Words for dosage forms. The two sides differ: keys unite creams with ointments and
# know powders, extraction keeps ointments apart and knows globules.
_FORMS = {
    "tablete": "tab tabl tableta tablete",
    "kapsule": "kap kaps kapsula kapsule caps capsule capsules softgel softgels cps",
    "sirup": "sirup", "sprej": "sprej spray", "kapi": "kapi drops", "gel": "gel gela",
    "losion": "losion lotion", "serum": "serum", "rastvor": "rastvor solution", "suspenzija": "suspenzija",
    "kesice": "kesica kesice", "ampule": "ampula ampule",
    "supozitorija": "supozitorija supozitorije suppository cepic cepici vaginaleta vaginalete vagitorija vagitorije vaginalna vaginalne ovula ovule pesar",
    "bombone": "bombone bombona gumene gumeni gumenih gumena gumedica gumedice pektinske pektinska pektinski gummy gummies",
}
_KEY_FORMS = {"krema": "krema krem cream mast ointment pomada pomast", "prah": "prah powder"}
_EXTRACT_FORMS = {"krema": "krema krem cream", "mast": "mast ointment", "supozitorija": _FORMS["supozitorija"] + " globula globule"}

POWDER_GRAMS = 400


def _aliases(*tables: dict[str, str]) -> dict[str, str]:
    return {word: form for table in tables for form, ws in table.items() for word in ws.split()}


KEY_FORMS = _aliases(_FORMS, _KEY_FORMS)
EXTRACT_FORMS = _aliases(_FORMS, _EXTRACT_FORMS)


def look_up(c: Column, table: dict[str, str]) -> Column:
    """``c`` by the table; what it lacks stays."""
    return F.coalesce(F.try_element_at(map_of(tuple(table.items())), c), c)


def key_unit(c: Column) -> Column:
    return look_up(normalize_key(c), UNITS)


def extract_unit(c: Column) -> Column:
    plain = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    tight = F.replace(plain, F.lit(" "), F.lit(""))
    pairs = map_of(tuple(EXTRACT_UNITS.items()))
    return F.coalesce(F.try_element_at(pairs, tight), F.try_element_at(pairs, plain), tight)


def key_form(c: Column) -> Column:
    return look_up(normalize_key(c), KEY_FORMS)


def extract_form(c: Column) -> Column:
    """Null for blank text."""
    return F.nullif(look_up(normalize_lookup(c), EXTRACT_FORMS), F.lit(""))


def compact(v: Column) -> Column:
    """A number without needless digits, six places at most."""
    return F.when(v.isNotNull(), F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", ""))


def strength(value: Column, unit: Column, ingredients: Column | None = None, known: bool = False) -> tuple[Column, Column]:
    """(value, unit) of a canonical strength, null if there is none. Masses are in mg; vitamin D3
    in mcg counts 40 iu each, and D3 or K2 in mg is no strength. ``ingredients`` are those that
    the strength belongs to, none if it isn't told; ``known`` says the unit is a key unit already."""
    u = unit if known else key_unit(unit)
    has = lambda name: F.coalesce(F.array_contains(ingredients, F.lit(name)), F.lit(False)) if ingredients is not None else F.lit(False)
    d3 = has("vitamin d3")
    base = F.when((u == "mcg") & d3, value * 40).when(u == "mcg", value / 1000).when(u == "g", value * 1000).otherwise(value)
    base_unit = F.when((u == "mcg") & d3, F.lit("iu")).when(u.isin("mcg", "g"), F.lit("mg")).otherwise(u)
    base = F.round(base, 6)
    ok = (value > 0) & (u != "") & ~((u == "mg") & (d3 | has("vitamin k2"))) & (base > 0)
    return F.when(ok, base), F.when(ok, base_unit)


def strength_key(value: Column, unit: Column, ingredients: Column | None = None, known: bool = False) -> Column:
    v, u = strength(value, unit, ingredients, known)
    return F.concat(compact(v), u)


def strength_display(value: Column, unit: Column, ingredients: Column | None = None, known: bool = False) -> Column:
    v, u = strength(value, unit, ingredients, known)
    return F.concat(compact(v), F.lit(" "), F.upper(u))


def bucket_grams(v: Column) -> Column:
    """Weights of powders to the nearest 250 g from 500 g on, to the nearest 50 g from 100 g on."""
    return F.when(v >= 500, F.round(v / 250) * 250).when(v >= 100, F.round(v / 50) * 50).otherwise(v)


def size_key(value: Column, unit: Column, known: bool = False) -> Column:
    """Millilitres as they are, grams in buckets; null without a size."""
    u = unit if known else key_unit(unit)
    v = F.when(u.isin("l", "kg"), value * 1000).otherwise(value)
    base = F.when(u == "l", F.lit("ml")).when(u == "kg", F.lit("g")).otherwise(u)
    v = F.when(base == "g", bucket_grams(v)).otherwise(v)
    return F.when((value > 0) & (u != ""), F.concat(compact(F.round(v, 6)), base))


def measure_display(value: Column, unit: Column, known: bool = False) -> Column:
    u = unit if known else key_unit(unit)
    return F.when((value > 0) & (F.coalesce(unit, F.lit("")) != ""), F.concat_ws(" ", compact(value), F.upper(u)))


def form_display(form: Column) -> Column:
    return F.nullif(title_words(key_form(form)), F.lit(""))


def quantity_facet(q: Column) -> Column:
    """Quantity with two decimals at most; null unless positive."""
    return F.when(q > 0, F.when(q == F.floor(q), F.format_string("%.0f", q)).otherwise(F.regexp_replace(F.format_string("%.2f", q), r"\.?0+$", "")))
