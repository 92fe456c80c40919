"""Profiles of a catalog and of its groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import text as T


def completeness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Number and percent of values of each column, in one pass."""
    total = F.count(F.lit(1))
    one = rows.agg(total.alias("_rows"), *[F.count(c).alias(c) for c in columns])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in columns])).alias("s")
    return one.select("_rows", stack).select("s.column", "s.filled", F.round(F.coalesce(F.try_divide(F.col("s.filled") * 100.0, F.col("_rows")), F.lit(0.0)), 2).alias("percent"))


def processing_rate(rows: DataFrame, done: Column) -> DataFrame:
    """Rows, rows done and percent; 0 percent of no rows."""
    n, k = F.count(F.lit(1)), F.count(F.when(done, 1))
    return rows.agg(n.alias("total"), k.alias("processed"), F.coalesce(F.try_divide(k * 100.0, n), F.lit(0.0)).alias("rate"))


def needs_processing(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a missing column and a title of more than five characters."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    return rows.filter(missing & (F.length("title") > 5))


def page_after(rows: DataFrame, after, limit: int, key: str = "id") -> DataFrame:
    """The next ``limit`` rows by key beyond ``after`` (null: from the start). The predicate reaches the
    scan and each task sends its first rows only."""
    rest = rows if after is None else rows.filter(F.col(key) > F.lit(after))
    return rest.orderBy(key).limit(limit)


def profile(rows: DataFrame, source: str, category: str) -> DataFrame:
    """Rows and distinct categories of each source."""
    return rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(category).alias("categories"))


def run_statistics(runs: DataFrame, status: str, products: str) -> DataFrame:
    """Runs and products by status, and the percent of all runs."""
    by = runs.groupBy(status).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.coalesce(products, F.lit(0))).alias("products"))
    total = runs.agg(F.count(F.lit(1)).alias("_runs"))
    return by.join(F.broadcast(total)).select(status, "runs", "products", F.round(F.col("runs") * 100.0 / F.col("_runs"), 2).alias("percent"))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    """Values by frequency and their percent of all rows."""
    n = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_rows"))
    return n.join(F.broadcast(total)).select(column, "n", F.round(F.col("n") * 100.0 / F.col("_rows"), 2).alias("percent"))


def group_audit(keyed: DataFrame, samples: int = 4) -> DataFrame:
    """Products, vendors, brands and sample titles of each group. Samples are the smallest titles;
    partial lists are cut in each task, so none grows with its group."""
    titles = keyed.groupBy("group_key", "title").agg(F.count(F.lit(1)).alias("_n"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("group_key").orderBy("title"))
    some = titles.withColumn("_at", place).filter(F.col("_at") <= samples).groupBy("group_key").agg(F.array_sort(F.collect_list("title")).alias("samples"))
    stats = keyed.groupBy("group_key", "group_method").agg(
        F.count(F.lit(1)).alias("products"), F.count_distinct("vendor_id").alias("vendors"), F.count_distinct(F.nullif(F.col("brand"), F.lit(""))).alias("brands")
    )
    return stats.join(some, "group_key")


def over_merged(audit: DataFrame) -> DataFrame:
    """Groups that may hold several products: two brands or more under one line or brand key."""
    return audit.filter((F.col("brands") >= 2) & F.col("group_method").isin("brand-line", "brand-sku")).orderBy(F.col("brands").desc(), F.col("products").desc(), "group_key")


def by_method(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("group_method").agg(F.count_distinct("group_key").alias("groups"), F.count(F.lit(1)).alias("products"))


def catch_alls(keyed: DataFrame, d: D.Dictionaries, least: int = 4) -> DataFrame:
    """Groups named by one word that hold several products: titles differ in more than brand, pack
    and form."""
    own = T.words(T.normalize_identity(F.coalesce(F.nullif(F.col("brand"), F.lit("")), F.col("group_display"))))
    pack = r"^(?:\d+[a-z]*|[axх]\d+)$"
    sign = T.join(F.array_sort(F.filter(T.words(T.normalize_identity(F.col("title"))), lambda w: ~F.array_contains(own, w) & ~w.rlike(pack) & ~D.among(w, d.forms))))
    rows = keyed.filter("group_method = 'brand-core'").withColumn("_sign", sign)
    stats = rows.groupBy("group_key").agg(F.min("group_display").alias("name"), F.count(F.lit(1)).alias("products"), F.count_distinct(F.nullif("_sign", F.lit(""))).alias("signs"))
    return stats.filter((F.size(F.split("name", " ")) == 1) & (F.col("products") >= least) & (F.col("signs") >= 2)).orderBy(F.col("products").desc(), "group_key")


def repeats(rows: DataFrame) -> DataFrame:
    """Titles (case aside) that a vendor lists more than once at one price."""
    return rows.groupBy(F.lower("title").alias("title"), "vendor_id", "price").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def counts(**tables: DataFrame) -> DataFrame:
    """Number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def sample(rows: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    return rows.orderBy(F.rand(seed)).limit(n)
