"""Entities of a product title: brand, form, dose, size, count, identity, names and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import measures as M
from offerweave.functions import text as T

# How titles write measures, counts and forms.
THOUSANDS = r"(?i)(?<![a-z0-9])(\d{1,3})[.,  ](\d{3})(?=\s*(?:iu|ij|i\.?\s?u\.?|i\.?\s?j\.?|j\.?\s?m\.?|mg|mcg|ug)\b)"
DOSE = r"(?i)(\d+(?:[.,]\d+)?)\s*(mcg|µg|μg|ug|mg|iu|ij|i\.?\s?u\.?|i\.?\s?j\.?|j\.?\s?m\.?)\.?(?![a-z])"
VOLUME = r"(?iU)(?<![/\d])(?<!/\d{1,9}[.,])(\d+(?:[.,]\d+)?)\s*(ml|l)\b"
WEIGHT = r"(?iU)(\d+(?:[.,]\d+)?)\s*(kg|g|gr|gram|grama)\b"
COUNT_UNITS = (
    r"mikrotablet\w*|mikrokapsul\w*|tabl\w*|tableta|tablete|tbl|kaps\w*|kapsula|kapsule|kap|caps\w*|capsule\w*|softgel\w*|cps|"
    r"drazej\w*|pastil\w*|sas\w*|vrecic\w*|kesic\w*|ampul\w*|komada|komad|kom|tab\w*"
)
COUNT = rf"(?iU)\b(\d{{1,4}})\s*({COUNT_UNITS})\b"
COUNT_PREFIX = r"(?iU)\b[axх×]\s*(\d{1,4})\b"
FORM = (
    r"(?iU)\b(tablete|tableta|tabl|tab|kapsule|kapsula|kaps|capsules|capsule|caps|softgel|softgels|cps|sirup|sprej|spray|kapi|drops|gel|gela|krema|krem|cream|mast|"
    r"losion|lotion|serum|rastvor|suspenzija|kesice|kesica|ampule|ampula|supozitorija|supozitorije|suppository|cepic|cepici|vaginaleta|vaginalete|vagitorija|"
    r"vagitorije|vaginalne|vaginalnih|ovula|ovule|globula|globule|pesar|bombone|bombona|gumene|gumeni|gumenih|gumena|gumedica|gumedice|pektinske|pektinska|"
    r"pektinski|gummy|gummies)\b"
)
IDENTITY_NOISE = [
    r"(?iU)\b\d+\s*[xх×]\s*\d+(?:[.,]\d+)?\s*(?:mg|mcg|ug|µg|μg|iu|ij|ml|l|kg|g|gr)\b",
    r"(?U)\b\d+\s*[xх×]\s*\d+\b",
    r"(?iU)\b[axх×]\s*\d+\b",
    r"(?U)\b\d+\s*[xх×]\b",
    DOSE,
    r"(?iU)\b\d+(?:[.,]\d+)?\s*(?:ml|l|kg|g|gr|gram|grama)\b",
    rf"(?iU)\b\d+\s*(?:{COUNT_UNITS}|obložen\w*|film\w*)\b",
    r"(?iU)\bspf\s*\d+\+?\b",
    r"(?U)\b\d+(?:[.,]\d+)?\s*%",
]
#: Counts above are doses, strengths that are written bare, brands of gummies only,
#: forms that a powder doesn't have.
MOST_COUNT = 500
BARE_IU = [400, 500, 600, 800, 1000, 1200, 1500, 2000, 2500, 3000, 4000, 5000, 5600, 6000, 7000, 10000, 20000, 25000, 50000]
BARE_MG = [100, 200, 250, 300, 500, 750, 1000, 1500, 2000, 3000, 4000]
GUMMY_BRANDS = ["gumedici", "gumedicic", "ivybears"]
SKIN_FORMS = ["krema", "krem", "gel", "serum", "losion", "mast", "sampon", "balzam", "sapun", "maska", "pena", "puder", "lak", "mleko", "emulzija", "fluid", "pasta"]
PROTEIN_WORDS = ["whey", "vegan", "izolat", "isolate", "protein"]


def plain_doses(title: Column) -> Column:
    """Lower case, and no thousands separators before the unit of a strength."""
    return F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), THOUSANDS, "$1$2")


def parse_number(raw: Column) -> Column:
    """A number as titles write it: with both marks points part thousands and the comma decimals, a
    comma alone parts decimals; null if it is none."""
    both = F.contains(raw, F.lit(",")) & F.contains(raw, F.lit("."))
    plain = F.when(both, F.replace(raw, F.lit("."), F.lit(""))).otherwise(raw)
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")


def _all(t: Column, pattern: str) -> Column:
    """(value, unit) of every place."""
    value, unit = (F.regexp_extract_all(t, F.lit(pattern), i) for i in (1, 2))
    return F.zip_with(value, unit, lambda v, u: F.struct(parse_number(v).alias("value"), M.extract_unit(u).alias("unit")))


def measures(t: Column) -> dict[str, Column]:
    """Dose and size in a title whose doses are plain."""
    first = lambda c: F.get(c, F.lit(0))
    dose = first(_all(t, DOSE))
    weights = _all(t, WEIGHT)
    small = F.when((first(weights)["unit"] == "g") & (first(weights)["value"] <= 5), first(weights))
    volume = first(_all(t, VOLUME))
    heavy = first(F.filter(weights, lambda w: (w["unit"] == "kg") | ((w["unit"] == "g") & (w["value"] > 5))))
    weight = F.when(heavy["unit"] == "kg", heavy["value"] * 1000).otherwise(heavy["value"])
    dose = F.coalesce(dose, small)
    return {
        "dosage_value": dose["value"],
        "dosage_unit": dose["unit"],
        "volume_value": F.when(volume.isNotNull(), volume["value"]).otherwise(weight),
        "volume_unit": F.when(volume.isNotNull(), volume["unit"]).when(heavy.isNotNull(), F.lit("g")),
    }


def bare_strength(t: Column, count: Column, allowed: list[int]) -> Column:
    """The largest number without a unit that is a usual strength and not the count."""
    found = F.transform(F.regexp_extract_all(t, F.lit(r"(?<!\d)(\d{3,6})(?!\d)"), 1), lambda x: x.try_cast("int"))
    usual = F.filter(found, lambda x: D.among(x, allowed) & (x != F.coalesce(count, F.lit(-1))))
    return F.array_max(usual).cast("double")


def _identity(d: D.Dictionaries) -> Column:
    """The product identity of _title, given _brand (normalised, '' if none)."""
    t = F.regexp_replace(plain_doses(F.col("title")), r"[®™©()\[\]/\\,;:!?]", " ")
    t = F.regexp_replace(t, r"(?U)([a-z])-(\d{1,2})\b", "$1$2")
    t = T.normalize_identity(reduce(lambda c, p: F.regexp_replace(c, p, " "), IDENTITY_NOISE, t))
    return t


def with_entities(titles: DataFrame, d: D.Dictionaries) -> DataFrame:
    """``titles`` (title) with brand, form, dosage_value, dosage_unit, quantity_value,
    quantity_unit, volume_value, volume_unit, core and normalized_name."""
    t = F.col("_plain")
    step = titles.withColumns({"_plain": plain_doses(F.col("title")), "_flat": T.normalize_identity(F.col("title"))})
    step = step.withColumns(
        {
            "_brand": F.coalesce(D.detect_brand(F.col("_flat"), d), F.lit("")),
            "_counts": F.filter(
                F.zip_with(
                    F.regexp_extract_all("title", F.lit(COUNT), 1),
                    F.regexp_extract_all("title", F.lit(COUNT), 2),
                    lambda n, u: F.struct(n.cast("int").alias("n"), F.lower(u).alias("unit")),
                ),
                lambda c: c["n"] <= MOST_COUNT,
            ),
            "_prefix": F.nullif(F.regexp_extract("title", COUNT_PREFIX, 1), F.lit("")).cast("int"),
            "_form": F.nullif(F.regexp_extract("title", FORM, 1), F.lit("")),
            "_only": D.ingredients(F.col("_flat"), d, identifying=True),
            "_stripped": _identity(d),
            **measures(t),
        }
    )
    count = F.get(F.col("_counts"), F.lit(0))
    of_count = M.extract_form(count["unit"])
    form = F.coalesce(M.extract_form(F.col("_form")), F.when(count.isNotNull() & ~of_count.isin("kom", "komad", "komada"), of_count))
    powder = (F.col("volume_unit") == "kg") | ((F.col("volume_unit") == "g") & (F.col("volume_value") >= M.POWDER_GRAMS))
    form = F.when(F.coalesce(powder, F.lit(False)) & form.isin(SKIN_FORMS), F.lit(None)).otherwise(form)
    form = F.coalesce(form, F.when(F.col("_brand").isin(GUMMY_BRANDS), F.lit("bombone")))
    few = F.when(F.col("_prefix") <= MOST_COUNT, F.col("_prefix"))
    step = step.withColumns(
        {
            "form": form,
            "quantity_value": F.coalesce(count["n"], few),
            "quantity_unit": F.coalesce(count["unit"], F.when(few.isNotNull(), F.lit("kom"))),
            "_all": D.ingredients(F.col("_stripped"), d),
            "_rest": D.leftover(F.col("_stripped"), d),
            "brand": F.nullif(T.python_title(F.col("_brand")), F.lit("")),
        }
    )
    step = step.withColumns(
        {
            "_iu": F.when(F.col("_only") == F.array(F.lit("vitamin d3")), bare_strength(t, F.col("quantity_value"), BARE_IU)),
            "_mg": F.when(F.col("_only") == F.array(F.lit("vitamin c")), bare_strength(t, F.col("quantity_value"), BARE_MG)),
            "_anchored": (F.size("_all") > 0) | D.is_cosmetic(F.col("_brand"), d, by_word=True),
        }
    )
    own = T.words(F.col("_brand"))
    single = {a for a in d.canonical if " " not in a}
    branded = lambda w: F.col("_anchored") & (F.array_contains(own, w) | D.among(w, d.strip | d.known))
    odd = lambda w: w.rlike(r"^\d+(?:[.,]\d+)*$") | (w.rlike(r"^(?:\d+[a-z]+|[a-z]+\d+\+?)$") & ~D.among(w, single))
    stop = lambda w: D.among(w, d.noise | d.forms)
    short = lambda w: (F.length(w) < 2) & ~w.isin("c", "d", "b", "k", "e")
    names = F.filter("_rest", lambda w: ~(branded(w) | stop(w) | odd(w) | short(w)))
    last = F.slice(F.filter("_rest", lambda w: ~(branded(w) | stop(w)) & (F.length(w) >= 2)), 1, 3)
    best = F.slice(F.concat("_all", names), 1, 5)
    extra = F.array_distinct(F.filter(T.words(F.col("_flat")), lambda w: w.isin(PROTEIN_WORDS) & ~F.array_contains(own, w)))
    core = T.join(F.when(F.size(best) > 0, best).otherwise(last))
    by_brand = F.when((F.col("_brand") != "") & ~D.is_cosmetic(F.col("_brand"), d, by_word=True), T.join(F.concat(own, extra)))
    core = F.when(F.length(core) >= 2, core).when(F.length(by_brand) >= 2, by_brand)
    step = step.withColumns(
        {
            "core": T.python_title(core),
            "dosage_unit": F.coalesce("dosage_unit", F.when(F.col("dosage_value").isNull(), F.when(F.col("_iu").isNotNull(), F.lit("iu")).when(F.col("_mg").isNotNull(), F.lit("mg")))),
            "dosage_value": F.coalesce("dosage_value", "_iu", "_mg"),
        }
    )
    step = step.withColumn("core", F.when(core.isNotNull(), F.col("core")))
    parts = F.filter(
        F.array(
            F.when(F.length("_brand") > 1, F.col("brand")),
            F.col("core"),
            F.when(F.col("dosage_unit").isNotNull(), F.concat_ws(" ", M.compact(F.col("dosage_value")), F.upper("dosage_unit"))),
            F.col("form"),
        ),
        lambda p: p.isNotNull(),
    )
    step = step.withColumn("normalized_name", F.when(F.size(parts) >= 2, T.join(parts)))
    kept = [c for c in step.columns if not c.startswith("_") or c in titles.columns]
    return step.select(*kept)


def reconcile(value: Column, unit: Column) -> tuple[Column, Column]:
    """Whether a stored dose is a size, and its unit: litres, millilitres or more than 5 g."""
    u = M.extract_unit(unit)
    return u.isin("ml", "l") | ((u == "g") & (F.coalesce(value, F.lit(0.0)) > 5)), u


def merge_standard(found: DataFrame, fields: list[str], prefix: str = "std_") -> DataFrame:
    """Stored attributes (``prefix`` + name) over extracted ones; zero and '' count as missing."""
    blank = lambda c, kind: F.nullif(c, F.lit("").cast(kind)) if kind == "string" else F.nullif(c, F.lit(0).cast(kind))
    kinds = dict(found.dtypes)
    return found.withColumns({f: F.coalesce(blank(F.col(prefix + f), kinds[prefix + f]), F.col(f)) for f in fields}).drop(*[prefix + f for f in fields])


def search_tokens(title: Column, brand: Column, core: Column, name: Column, form: Column, dose: Column, dose_unit: Column, volume: Column, volume_unit: Column, count: Column, canonicals: Column | None = None) -> Column:
    """Distinct search words in order: words and joined words of five fields, measures, count,
    then ingredients."""

    def of_text(c):
        n = T.normalize_lookup(c)
        joined = F.replace(n, F.lit(" "), F.lit(""))
        return F.concat(T.words(n), F.when((joined != n) & (n != ""), F.array(joined)).otherwise(F.array().cast("array<string>")))

    def of_measure(v, u):
        n, unit = M.compact(v), T.normalize_lookup(u)
        return F.when(v.isNotNull() & (unit != ""), F.array(n, unit, F.concat(n, unit))).otherwise(F.array().cast("array<string>"))

    counted = F.when(count > 0, F.array(count.cast("int").cast("string"))).otherwise(F.array().cast("array<string>"))
    lists = [*[of_text(c) for c in (title, brand, core, name, form)], of_measure(dose, dose_unit), of_measure(volume, volume_unit), counted]
    if canonicals is not None:
        lists.append(F.flatten(F.transform(canonicals, lambda c: F.concat(F.array(F.replace(c, F.lit(" "), F.lit(""))), F.split(c, " ")))))
    return F.array_distinct(F.filter(F.concat(*lists), lambda w: w != ""))


def standardized_title(name: Column, brand: Column, core: Column, title: Column, dose: Column, dose_unit: Column, volume: Column, volume_unit: Column, form: Column, count: Column) -> Column:
    """The normalised name, else brand, identity, measures, count and form."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    measure = lambda v, u: F.when(v.isNotNull() & (T.normalize_lookup(u) != ""), F.concat_ws(" ", M.compact(v), F.upper(T.normalize_lookup(u))))
    f, n = M.extract_form(form), count.cast("int").cast("string")
    pack = F.when(count > 0, F.when(f.isNotNull(), F.concat_ws(" ", n, f)).otherwise(F.concat(F.lit("x"), n))).otherwise(f)
    return F.coalesce(
        blank(name),
        F.concat_ws(" ", F.initcap(blank(brand)), F.coalesce(blank(core), blank(title)), measure(dose, dose_unit), measure(volume, volume_unit), pack),
    )
