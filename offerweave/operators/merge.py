"""Writes as snapshots: a new table from the old one and fresh rows.

Each is one full outer join on the key; on a row-level table format the same rules make a MERGE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DELIST_RATIO = 0.5


def latest(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_at", place).filter("_at = 1").drop("_at")


def cheapest_titles(rows: DataFrame, order: str, vendor: str = "vendor") -> DataFrame:
    """One row for each title of a vendor, case and outer blanks aside: the cheapest, the first by
    ``order`` among equals."""
    return latest(rows, [vendor, F.lower(F.trim("title"))], ["price", order])


def upsert(old: DataFrame, fresh: DataFrame, keys: list[str], overwrite: list[str] = (), fill: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """Old rows, and fresh ones over them: ``overwrite`` columns take the fresh value, null too;
    ``fill`` columns keep the old value where the fresh one is null; ``greatest`` the larger. Others
    keep the old value; in new rows all are fresh, those that ``fresh`` lacks are null."""
    a = old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns], F.lit(True).alias("_old"))
    b = fresh.select(*[F.col(c).alias(f"_n_{c}") for c in fresh.columns], F.lit(True).alias("_new"))
    match = None
    for k in keys:
        test = F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}"))
        match = test if match is None else match & test
    both = a.join(b, match, "full_outer")

    def value(c):
        o = F.col(f"_o_{c}")
        if c not in fresh.columns:
            return o
        n = F.col(f"_n_{c}")
        if c in keys:
            return F.when(F.col("_old"), o).otherwise(n)
        rule = n if c in overwrite else F.coalesce(n, o) if c in fill else F.greatest(n, o) if c in greatest else o
        return F.when(F.col("_old") & F.col("_new"), rule).when(F.col("_old"), o).otherwise(n)

    return both.select(*[value(c).alias(c) for c in old.columns])


def delist(old: DataFrame, fresh: DataFrame, keys: list[str], vendor: str, ratio: float = DELIST_RATIO) -> DataFrame:
    """Old rows that stay: those that ``fresh`` has, and all rows of vendors whose fresh rows are too
    few against the old ones (a broken scrape) or absent."""
    had = old.groupBy(vendor).agg(F.count(F.lit(1)).alias("_had"))
    has = fresh.groupBy(vendor).agg(F.count(F.lit(1)).alias("_has"))
    sound = had.join(has, vendor).filter(F.col("_has") >= ratio * F.col("_had")).select(vendor)
    gone = old.join(sound, vendor, "left_semi").join(fresh.select(*keys).distinct(), keys, "left_anti").select(*keys).distinct()
    return old.join(gone, keys, "left_anti").select(*old.columns)


def insert_absent(old: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def fill_blank(rows: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Blank text of ``rows`` from the row of ``source`` with the same key."""
    found = source.select(key, *[F.col(c).alias(f"_s_{c}") for c in columns])
    joined = rows.join(found, key, "left")
    return joined.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_s_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def drop_unpriced(rows: DataFrame, vendor: str, most: float = 0.5) -> DataFrame:
    """Without rows that have no price, save for vendors where more than ``most`` have none."""
    share = rows.groupBy(vendor).agg((F.count_if(~F.coalesce(F.col("price") > 0, F.lit(False))) / F.count(F.lit(1))).alias("_share"))
    kept = rows.join(share, vendor).filter(F.coalesce(F.col("price") > 0, F.lit(False)) | (F.col("_share") > most))
    return kept.select(*rows.columns)


def drop_repeats(rows: DataFrame, order: list) -> DataFrame:
    """One row for each title (case aside), vendor and price."""
    return latest(rows, [F.lower("title"), "vendor_id", "price"], order)


def clean_titles(rows: DataFrame) -> DataFrame:
    """Titles cleaned; of those that then collide within a vendor the smallest id stays."""
    from offerweave.functions.hygiene import clean_title

    return latest(rows.withColumn("title", clean_title(F.col("title"))), ["vendor_id", "title"], ["id"])


def standardize(rows: DataFrame, standards: DataFrame, fields: list[str]) -> DataFrame:
    """Attributes of the best standard row for each title (std_ columns): the original title is
    looked up before the standard one, then higher confidence and later update go first."""
    key = lambda c: F.lower(F.trim(c))
    views = standards.select(key("original_title").alias("_key"), F.lit(0).alias("_by"), "*").unionByName(standards.select(key("title").alias("_key"), F.lit(1).alias("_by"), "*"))
    best = latest(
        views.filter("_key is not null"), ["_key"], [F.col("_by"), F.col("confidence").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("title"), F.col("original_title")]
    ).select("_key", *[F.col(f).alias(f"std_{f}") for f in fields])
    return rows.withColumn("_key", key("title")).join(best, "_key", "left").drop("_key")


def best_standard(standards: DataFrame, title: str) -> DataFrame:
    """The standard of one title with the highest confidence."""
    t = title.strip().lower()
    found = standards.filter((F.lower(F.trim("original_title")) == t) | (F.lower(F.trim("title")) == t))
    return found.orderBy(F.col("confidence").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), "title").limit(1)
