"""Shop feeds as JSON text: one document per row (column ``json``, with ``vendor``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WOO = (
    "array<struct<name: string, permalink: string, prices: struct<price: string, currency_minor_unit: int>, categories: array<struct<name: string>>, "
    "images: array<struct<src: string, thumbnail: string>>>>"
)
_SHOPIFY = "struct<products: array<struct<title: string, handle: string, product_type: string, variants: array<struct<price: string>>, images: array<struct<src: string>>>>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows (json, file)."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("json"), F.col("_metadata.file_name").alias("file"))


def _images(images, field: str = "src"):
    return F.array_join(F.filter(F.transform(images, lambda i: i[field]), lambda u: u.isNotNull()), ", ")


def woo_products(pages: DataFrame) -> DataFrame:
    """Store API pages: the price is in minor units, the first category counts."""
    p = pages.select("vendor", F.explode(F.from_json("json", _WOO)).alias("p"))
    price = F.col("p.prices.price").try_cast("double") / F.pow(F.lit(10.0), F.coalesce("p.prices.currency_minor_unit", F.lit(2)))
    first = F.get(F.col("p.images"), F.lit(0))
    return p.select(
        F.col("p.name").alias("title"), price.alias("price"), F.coalesce(F.get(F.col("p.categories"), F.lit(0))["name"], F.lit("")).alias("category"),
        F.col("p.permalink").alias("link"), F.coalesce(first["thumbnail"], first["src"], F.lit("")).alias("thumbnail"), _images(F.col("p.images")).alias("photos"), "vendor",
    )


def shopify_products(pages: DataFrame, base: str = "https://") -> DataFrame:
    """products.json pages: the first variant's price, links from handles."""
    p = pages.select("vendor", "site", F.explode(F.from_json("json", _SHOPIFY)["products"]).alias("p"))
    return p.select(
        F.col("p.title").alias("title"), F.get(F.col("p.variants"), F.lit(0))["price"].try_cast("double").alias("price"), F.coalesce("p.product_type", F.lit("")).alias("category"),
        F.concat(F.lit(base), "site", F.lit("/products/"), "p.handle").alias("link"), F.coalesce(F.get(F.col("p.images"), F.lit(0))["src"], F.lit("")).alias("thumbnail"),
        _images(F.col("p.images")).alias("photos"), "vendor",
    )


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    """``rows``, or an error if there are none: an empty feed is a broken one."""
    if rows.isEmpty():
        raise ValueError(f"no rows in {what}")
    return rows
