"""Group keys: offers of one product share a key, whoever sells them.

The policy, in order: a given canonical identity; identifying ingredients with strength and form;
a line of measured goods whatever the brand; a distinctive name; brand and descriptor; else each
offer on its own. It is one chain of Column expressions over prepared columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import measures as M
from offerweave.functions import text as T

_NUMBER = r"^\d+(?:[.,]\d+)*$"
_CODE = r"^\d+[a-z]+$|^[a-z]+\d+\+?$"
_SEP = "::"

# Measures, counts and packs in a title.
TITLE_MEASURES = [
    r"(?i)\b\d+(?:[.,]\d+)?\s*(mg|mcg|ug|μg|µg|iu|ij|i\.?u\.?|i\.?j\.?|ml|l|g|gr|kg|%)\b",
    r"(?i)\b[axх×]?\d+\s*(mikrotablet\w*|tab\w*|tabl\w*|kaps\w*|caps\w*|softgel\w*|kom\w*|kesic\w*|ampul\w*|kapi)\b",
    r"(?i)\b[axх×]\d+\b|\b\d+[xх×]\b",
]


def _meaningful(ws: Column, d: D.Dictionaries, most: int, digits: bool = False, synonyms: bool = True) -> Column:
    """The first ``most`` words that name something; ``digits``: a single digit does too."""
    if synonyms:
        ws = F.transform(ws, lambda w: M.look_up(w, D.SYNONYMS))
    number = lambda w: w.rlike(_NUMBER) & (F.length(w) != 1) if digits else w.rlike(_NUMBER)
    short = lambda w: (F.octet_length(w) < 2) & ~D.among(w, T.KEEP_SHORT)
    keep = lambda w: ~(D.among(w, d.noise | d.forms) | number(w) | w.rlike(_CODE) | short(w))
    return F.slice(F.filter(ws, keep), 1, most)


def without_brands(ws: Column, d: D.Dictionaries) -> Column:
    return F.filter(ws, lambda w: ~D.among(w, d.strip - d.keep))


def residual_core(core: Column, d: D.Dictionaries) -> Column:
    """What tells lines of a brand apart: up to four words, in order of name."""
    ws = without_brands(T.words(T.normalize_key(core)), d)
    return T.join(F.array_sort(_meaningful(ws, d, 4)))


def identity_core(core: Column, d: D.Dictionaries) -> Column:
    """What names a product, brands included: up to five words, in order of place."""
    return T.join(_meaningful(T.words(T.normalize_key(core)), d, 5, digits=True))


def core_from_title(title: Column, d: D.Dictionaries) -> Column:
    """The first four words that name something, measures and brands left out."""
    t = reduce(lambda c, p: F.regexp_replace(c, p, " "), TITLE_MEASURES, F.lower(F.coalesce(title, F.lit(""))))
    return T.join(_meaningful(without_brands(T.words(T.normalize_key(t)), d), d, 4, synonyms=False))


def _parts(*columns: Column) -> Column:
    """Parts joined by the separator; null ones are left out, empty ones are not."""
    return F.array_join(F.filter(F.array(*columns), lambda c: c.isNotNull()), _SEP)


def with_group_key(offers: DataFrame, d: D.Dictionaries, use_canonical: bool = True) -> DataFrame:
    """``offers`` with group_key, group_display, group_method, group_residual, group_has_measure.

    Reads id, title, core, brand, canonical_identity, dosage_value, dosage_unit, volume_value,
    volume_unit and form; null counts as empty or zero.
    """
    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    value = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    blank = lambda c: F.nullif(c, F.lit(""))
    given = text("canonical_identity") if use_canonical and "canonical_identity" in offers.columns else F.lit("")
    # each step names what the next ones use more than once, so that no expression is repeated
    ready = offers.withColumns(
        {
            "_given_text": given,
            "_brand": T.normalize_key(F.col("brand")),
            "_form_key": T.normalize_key(text("form")),
            "_unit_key": T.normalize_key(text("volume_unit")),
            "_dose_key": T.normalize_key(text("dosage_unit")),
            "_title": T.normalize_key(F.col("title")),
            "_from_title": core_from_title(F.col("title"), d),
            "_dose": value("dosage_value"),
            "_volume": value("volume_value"),
        }
    )
    ready = ready.withColumns(
        {
            "_given": T.normalize_key(F.col("_given_text")),
            "_core": F.coalesce(blank(F.trim(text("core"))), F.col("_from_title")),
            "_form": blank(M.look_up(F.col("_form_key"), M.KEY_FORMS)),
            "_unit": M.look_up(F.col("_unit_key"), M.UNITS),
            "_dose_unit": M.look_up(F.col("_dose_key"), M.UNITS),
        }
    )
    ready = ready.withColumns(
        {
            "_core_key": T.normalize_key(F.col("_core")),
            "_strength": M.strength_key(F.col("_dose"), F.col("_dose_unit"), known=True),
            "_strength_shown": M.strength_display(F.col("_dose"), F.col("_dose_unit"), known=True),
            "_size": M.size_key(F.col("_volume"), F.col("_unit"), known=True),
            "_size_shown": blank(M.measure_display(F.col("_volume"), F.col("_unit"), known=True)),
            "_measured": (F.col("_dose") > 0) | F.col("_unit").isin("g", "kg"),
            "_form_shown": blank(T.title_words(F.col("_form"))),
            "_brand_shown": blank(T.title_words(F.trim(text("brand")))),
            "_tag": F.concat(F.lit("form:"), F.col("_form")),
        }
    )
    powder = (F.col("_unit") == "kg") | ((F.col("_unit") == "g") & (F.col("_volume") >= M.POWDER_GRAMS))
    liquid = (text("form") == "") & (F.col("_volume") > 0) & F.col("_unit").isin("ml", "l") & (F.col("_dose") <= 0)
    ready = ready.withColumns(
        {
            "_all": D.ingredients(F.col("_core_key"), d, identifying=True),
            "_residual": T.join(F.array_sort(_meaningful(without_brands(T.words(F.col("_core_key")), d), d, 4))),
            "_identity": T.join(_meaningful(T.words(F.col("_core_key")), d, 5, digits=True)),
            "_topical": ~powder
            & (D.among(F.col("_form_key"), D.TOPICAL) | F.exists(T.words(F.col("_title")), lambda w: D.among(w, D.TOPICAL)) | D.is_cosmetic(F.col("_brand"), d) | liquid),
        }
    )
    # a branded or named multivitamin is more than its ingredient
    bare = (F.col("_all") == F.array(F.lit("multivitamin"))) & ((F.col("_brand") != "") | (F.size(T.words(F.col("_core_key"))) > 1))
    own_words = T.words(F.col("_brand"))
    ready = ready.withColumns(
        {
            "_found": F.when(bare, F.array().cast("array<string>")).otherwise(F.col("_all")),
            "_sku": T.join(F.filter(T.words(F.col("_residual")), lambda w: ~F.array_contains(own_words, w))),
            "_residual_size": F.size(T.words(F.col("_residual"))),
            "_identity_size": F.size(T.words(F.col("_identity"))),
        }
    )
    alone = F.size("_found") == 1
    ready = ready.withColumns(
        {
            "_own": F.when(alone, M.strength_key(F.col("_dose"), F.col("_dose_unit"), F.col("_found"), known=True)),
            "_own_shown": F.when(alone, M.strength_display(F.col("_dose"), F.col("_dose_unit"), F.col("_found"), known=True)),
        }
    )
    found, residual, identity, brand, form = (F.col(c) for c in ("_found", "_residual", "_identity", "_brand", "_form"))
    suffix = (F.col("_strength"), F.col("_size"), F.col("_tag"))
    is_given = F.col("_given") != ""
    by_ingredient = (F.size(found) > 0) & ~F.col("_topical")
    by_line = ~F.col("_topical") & F.col("_measured") & (F.col("_residual_size") >= 2)
    distinctive = (F.col("_identity_size") >= 2) | ((F.col("_identity_size") == 1) & (F.length(identity) >= 6))
    by_name = ~F.col("_topical") & (distinctive | ((identity != "") & (identity == brand) & form.isNotNull()))
    by_brand = (brand != "") & ((residual != "") | form.isNotNull())
    rule = F.when(is_given, 0).when(by_ingredient, 1).when(by_line, 2).when(by_name, 3).when(by_brand, 4).otherwise(5)
    ready = ready.withColumn("_rule", rule)

    def choose(*values):
        out = values[-1]
        for i, v in reversed(list(enumerate(values[:-1]))):
            out = F.when(F.col("_rule") == i, v).otherwise(out)
        return out

    named = lambda c: F.concat_ws(" ", T.title_words(c), "_strength_shown", "_size_shown", "_form_shown")
    line = lambda r: F.coalesce(blank(F.concat_ws(" ", "_brand_shown", blank(T.title_words(r)), "_strength_shown", "_size_shown", "_form")), F.trim(text("title")))
    offer = F.concat(F.lit("offer:"), F.coalesce(blank(F.replace(text("id"), F.lit("product_"), F.lit(""))), F.col("_title")))
    keyed = ready.withColumns(
        {
            "group_key": choose(
                _parts(F.lit("core"), F.col("_given"), *suffix),
                _parts(F.concat(F.lit("ing:"), F.array_join(found, "+")), F.col("_own"), F.col("_tag")),
                _parts(F.lit("prod"), residual, *suffix),
                _parts(F.lit("core"), identity, *suffix),
                _parts(F.lit("sku"), brand, F.col("_sku"), *suffix),
                offer,
            ),
            "group_display": choose(
                named(F.col("_given_text")),
                F.concat_ws(" ", F.array_join(F.transform(found, T.title_words), " + "), "_own_shown", "_form"),
                line(residual),
                named(identity),
                line(F.col("_sku")),
                F.coalesce(blank(T.title_words(residual)), blank(T.title_words(F.col("_core"))), F.trim(text("title"))),
            ),
            "group_method": choose(*[F.lit(m) for m in ("brand-core", "ingredient", "brand-line", "brand-core", "brand-sku", "single")]),
            "group_residual": choose(F.col("_given"), F.lit(""), residual, identity, F.col("_sku"), residual),
            "group_has_measure": choose(F.col("_measured"), F.lit(False), F.lit(True), F.col("_measured"), F.col("_measured"), F.col("_measured")),
        }
    )
    return keyed.drop(*[c for c in keyed.columns if c.startswith("_") and c not in offers.columns])


def fold_sizeless(offers: DataFrame) -> DataFrame:
    """Unmeasured offers whose residual of two words or more names a measured line get one key."""
    lines = offers.filter("group_method = 'brand-line' and group_residual <> ''").select(F.col("group_residual").alias("_line")).distinct()
    open_ = F.col("group_method").isin("brand-sku", "single") & ~F.col("group_has_measure") & (F.size(T.words(F.col("group_residual"))) >= 2)
    keyed = offers.withColumn("_fold", _own_key(open_, F.col("group_residual")))
    joined = keyed.join(lines, F.col("_fold") == F.col("_line"), "left")
    return joined.withColumn("group_key", F.when(F.col("_line").isNotNull(), F.concat(F.lit("prod::"), "group_residual")).otherwise(F.col("group_key"))).drop("_line", "_fold")


def _own_key(folds: Column, key: Column) -> Column:
    """``key`` of offers that may fold; others get one of their own, so that they don't meet in one
    task."""
    return F.when(folds, key).otherwise(F.concat(F.lit("\u0001"), F.coalesce(F.col("id").cast("string"), F.lit(""))))


def fold_formless(offers: DataFrame) -> DataFrame:
    """Offers of an ingredient without a form join the form that most vendors sell, the smaller
    key among equals."""
    tag = "::form:"
    formed = (F.col("group_method") == "ingredient") & F.contains("group_key", F.lit(tag))
    base = F.substring_index("group_key", tag, 1)
    forms = offers.filter(formed).groupBy(base.alias("_base"), F.col("group_key").alias("_key")).agg(F.count_distinct("vendor_id").alias("_n"))
    best = forms.groupBy("_base").agg(F.min(F.struct(-F.col("_n"), "_key"))["_key"].alias("_best"))
    formless = (F.col("group_method") == "ingredient") & ~F.contains("group_key", F.lit(tag))
    joined = offers.withColumn("_fold", _own_key(formless, F.col("group_key"))).join(best, F.col("_fold") == F.col("_base"), "left")
    return joined.withColumn("group_key", F.coalesce("_best", "group_key")).drop("_base", "_best", "_fold")
