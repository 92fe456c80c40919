"""Filters of offers and of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wanted(values) -> list[str]:
    """Trimmed lower-case values without blanks."""
    return sorted({v.strip().lower() for v in values or [] if v and v.strip()})


def folded(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def visible(offers: DataFrame) -> DataFrame:
    return offers.filter(F.col("price") > 0)


def by_values(offers: DataFrame, **values) -> DataFrame:
    """Exact, case-sensitive: every column named has one of its values; an empty list lets all pass."""
    for name, some in values.items():
        if some:
            offers = offers.filter(F.col(name).isin(*some))
    return offers


def hits_by(offers: DataFrame, **values) -> DataFrame:
    """Case-insensitive: one of the values within a column, all columns together."""
    for name, some in values.items():
        if some := wanted(some):
            offers = offers.filter(folded(F.col(name)).isin(*some))
    return offers


def groups_by(groups: DataFrame, products: str = "products", **values) -> DataFrame:
    """Groups of which one member satisfies all filters; members are kept whole."""
    active = {name: some for name, v in values.items() if (some := wanted(v))}
    if not active:
        return groups

    def fits(p):
        out = F.lit(True)
        for name, some in active.items():
            out = out & folded(p[name]).isin(*some)
        return out

    return groups.filter(F.exists(products, fits))


def price_overlap(groups: DataFrame, least: float | None = None, most: float | None = None) -> DataFrame:
    """Groups whose range of prices meets the one asked for."""
    if least is not None:
        groups = groups.filter(F.col("max_price") >= least)
    if most is not None:
        groups = groups.filter(F.col("min_price") <= most)
    return groups


def price_bounds(groups: DataFrame) -> DataFrame:
    """Least and greatest price, in hundreds; 0 and 50000 without groups."""
    return groups.agg(
        F.coalesce(F.floor(F.min("min_price") / 100) * 100, F.lit(0)).alias("low"),
        F.coalesce(F.ceil(F.max("max_price") / 100) * 100, F.lit(50_000)).alias("high"),
    )


def same(a: Column, b: Column) -> Column:
    """Equal, two nulls too."""
    return a.eqNullSafe(b)


def valid(rows: DataFrame, expires: str, as_of: Column, used: str | None = None) -> DataFrame:
    """Rows that have not expired and, if ``used`` is given, were not used."""
    out = rows.filter(F.col(expires) > as_of)
    return out.filter(F.col(used).isNull()) if used else out


def email_key(c: Column) -> Column:
    """SHA-256 of an address, outer blanks and case aside."""
    return F.sha2(F.lower(F.trim(c)), 256)
