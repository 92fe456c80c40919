"""Counts of values by facet, in long form (facet, value, n)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerweave.functions.measures import quantity_facet


def facets(rows: DataFrame, **columns: Column) -> DataFrame:
    """One pass: each row gives a (facet, value) for every column that isn't blank."""
    pairs = F.array(*[F.struct(F.lit(name).alias("facet"), F.trim(c.cast("string")).alias("value")) for name, c in columns.items()])
    long = rows.select(F.explode(pairs).alias("p")).select("p.facet", "p.value").filter("value <> ''")
    return long.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def result_facets(groups: DataFrame, products: str = "products") -> DataFrame:
    """Over the visible members of all groups, before any group filter."""
    p = groups.select(F.explode(products).alias("p")).select("p.*")
    return facets(
        p, vendor=F.col("vendor_name"), brand=F.col("brand"), dosage_unit=F.col("dosage_unit"), form=F.col("form"), category=F.col("category"), quantity=quantity_facet(F.col("quantity"))
    )


def top(counts: DataFrame, **limits: int) -> DataFrame:
    """The most frequent values of each facet named; others whole. Ties go by value."""
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("n").desc(), "value"))
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<string,int>")
    return counts.withColumn("_at", place).filter(F.coalesce(F.col("_at") <= F.try_element_at(table, F.col("facet")), F.lit(True))).drop("_at")


def as_map(counts: DataFrame) -> DataFrame:
    """One row: facet -> (value -> n)."""
    each = counts.groupBy("facet").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("values"))
    return each.agg(F.map_from_entries(F.collect_list(F.struct("facet", "values"))).alias("facets"))
