"""The ingestion job: scraped files to an enriched catalog, as one plan of DataFrame steps.

Only the merge with the old catalog and the look-ups shuffle; enrichment is a map over rows, and
rows whose title has not changed can keep what they have (``needs_processing``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import extract
from offerweave.functions import text as T
from offerweave.operators import categories, merge

STANDARD = ["brand", "form", "dosage_value", "dosage_unit", "quantity_value", "quantity_unit", "volume_value", "volume_unit"]


def by_file_vendor(rows: DataFrame, vendors: DataFrame) -> DataFrame:
    """Rows with vendor_id; a file's vendor is that of its first row, files of unknown ones go."""
    first = rows.groupBy("file").agg(F.min_by("vendor", "row").alias("_vendor"))
    named = vendors.select(F.col("id").alias("vendor_id"), F.col("name").alias("_vendor"))
    return rows.join(first, "file").join(named, "_vendor").drop("_vendor")


def import_snapshot(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """The catalog (title, vendor_id, price, category, link, thumbnail, photos, scraped_at and what
    else it has) after fresh rows: one row a title and vendor, rows that a sound snapshot lacks go."""
    new = merge.cheapest_titles(fresh, "row", "vendor_id")
    keys = ["title", "vendor_id"]
    kept = merge.delist(old, new, keys, "vendor_id")
    return merge.upsert(kept, new.select(*[c for c in new.columns if c in old.columns]), keys, overwrite=["price", "category", "link", "thumbnail", "photos", "scraped_at"])


def enrich(products: DataFrame, d: D.Dictionaries, standards: DataFrame | None = None) -> DataFrame:
    """Products (title, and whatever else) with entities, standards over them, and search tokens."""
    bare = products.drop("core", "normalized_name", "search_tokens", *STANDARD)
    found = extract.with_entities(bare, d)
    if standards is not None:
        found = extract.merge_standard(merge.standardize(found, standards, STANDARD), STANDARD)
    canonicals = D.ingredients(T.normalize_identity(F.col("title")), d)
    tokens = extract.search_tokens(
        *[F.col(c) for c in ("title", "brand", "core", "normalized_name", "form", "dosage_value", "dosage_unit", "volume_value", "volume_unit", "quantity_value")], canonicals
    )
    return found.withColumn("search_tokens", tokens)


def finish(products: DataFrame, d: D.Dictionaries, mapping: DataFrame, by_core: DataFrame, by_title: DataFrame, junk: list[str] = ()) -> DataFrame:
    """Categories and canonical identities, each worked out anew."""
    return categories.with_canonical_identity(categories.with_category(products, d, mapping, junk), by_core, by_title)
