"""Categories and canonical identities of products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import text as T

COSMETICS, SUPPLEMENTS, OTC, SPORTS = "Cosmetics & Skincare", "Supplements & Vitamins", "OTC Medicines", "Sports Nutrition"
# Categories that only a vendor's label tells, general ones, forms of the skin and
# forms that tell a category, words of sports nutrition.
SPECIFIC = ["Sexual Health", "Baby & Mom", "Oral Care", "Hair Care", "Sun Care", "Medical Devices", "Sports Nutrition", "Personal Care"]
GENERAL = [COSMETICS, SUPPLEMENTS, OTC]
SKIN_FORMS = ["krema", "serum", "losion", "maska"]
FORM_CATEGORY = {
    COSMETICS: "krema serum losion gel", OTC: "mast",
    SUPPLEMENTS: "kapsule kapsul kapsuli capsula tablete tableti tbl tabs tablets pastila pastile bombone drazeja mikrotableta kesice",
}
SPORTS_WORDS = r"(?iU)\b(whey|sirutka|izolat|isolate|protein|proteini|kreatin|creatine|kazein|casein|gainer|bcaa|eaa|maltodekstrin|aminokiselin)\w*\b"


def with_category(products: DataFrame, d: D.Dictionaries, mapping: DataFrame, junk: list[str] = ()) -> DataFrame:
    """``products`` with canonical_category: the first rule that holds, null if none does.

    ``mapping`` (raw, canonical) is the table of vendors' labels; it is joined, not built in.
    """
    table = mapping.select(F.trim("raw").alias("_raw"), F.col("canonical").alias("_mapped")).dropDuplicates(["_raw"])
    rows = products.withColumn("_raw", F.trim(F.coalesce("category", F.lit("")))).join(table, "_raw", "left")
    of = F.coalesce(F.nullif(F.col("core"), F.lit("")), F.col("title"))
    rows = rows.withColumns({"_form": T.normalize_identity(F.col("form")), "_found": D.ingredients(T.normalize_identity(of), d)})
    kinds = {k: [c for c, v in d.category.items() if v in vs] for k, vs in ((SUPPLEMENTS, ["supplement"]), (OTC, ["otc-drug", "otc", "drug"]))}
    has = lambda k: F.exists("_found", lambda c: D.among(c, kinds[k]))
    by_form = F.lit(None).cast("string")
    for category, forms in FORM_CATEGORY.items():
        by_form = F.when(F.col("_form").isin(*forms.split()), F.lit(category)).otherwise(by_form)
    chosen = (
        F.when(F.col("_mapped").isin(*SPECIFIC), F.col("_mapped"))
        .when(F.col("_form").isin(*SKIN_FORMS), F.lit(COSMETICS))
        .when(has(SUPPLEMENTS), F.lit(SUPPLEMENTS))
        .when(has(OTC), F.lit(OTC))
        .when(F.coalesce(F.col("title"), F.lit("")).rlike(SPORTS_WORDS), F.lit(SPORTS))
        .when(D.is_cosmetic(T.normalize_identity(F.col("brand")), d, by_word=True), F.lit(COSMETICS))
        .when(F.col("_mapped").isin(*GENERAL), F.col("_mapped"))
        .otherwise(by_form)
    )
    return rows.withColumn("canonical_category", F.when(~D.among(F.col("_raw"), junk), chosen)).drop("_raw", "_mapped", "_form", "_found")


def with_canonical_identity(products: DataFrame, by_core: DataFrame, by_title: DataFrame) -> DataFrame:
    """``products`` with canonical_identity, set anew: by the normalised core for products with a
    measure, by the normalised title for probiotics; the title's wins. Tables have key, identity."""
    measured = (F.coalesce("volume_value", F.lit(0.0)) > 0) | (F.coalesce("dosage_value", F.lit(0.0)) > 0)
    counted = F.lower("title").rlike("probioti[kc]")
    a = by_core.select(F.col("key").alias("_core"), F.col("identity").alias("_by_core")).dropDuplicates(["_core"])
    b = by_title.select(F.col("key").alias("_title"), F.col("identity").alias("_by_title")).dropDuplicates(["_title"])
    rows = products.withColumns(
        {"_core": F.when(measured, T.normalize_identity(F.col("core"))), "_title": F.when(counted, T.normalize_identity(F.col("title")))}
    )
    joined = rows.join(a, "_core", "left").join(b, "_title", "left")
    return joined.withColumn("canonical_identity", F.coalesce("_by_title", "_by_core")).drop("_core", "_title", "_by_core", "_by_title")
