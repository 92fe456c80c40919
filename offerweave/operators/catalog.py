"""Whole-catalog jobs: snapshot of groups, featured groups, price watch, price history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions.groupkey import with_group_key
from offerweave.operators.grouping import group_offers

FEATURED_KEYS = ["core", "dosage_value", "dosage_unit", "volume_value", "volume_unit", "quantity", "form"]


def snapshot(offers: DataFrame, group: str = "group_key") -> DataFrame:
    """Cheapest price, its vendor (the first by name, then id, among equals) and number of offers of
    each group. Partial aggregates meet in the shuffle, so a hot group costs no task more."""
    cheapest = F.min(F.struct("price", "vendor_name", "id"))
    return offers.filter("price > 0").groupBy(group).agg(cheapest["price"].alias("min_price"), cheapest["vendor_name"].alias("vendor"), F.count(F.lit(1)).alias("offer_count"))


def catalog_snapshot(offers: DataFrame, d: D.Dictionaries) -> DataFrame:
    """The snapshot over the keys that search gives."""
    return snapshot(group_offers(offers.filter("price > 0"), d))


def featured_keys(offers: DataFrame, keys: list[str], limit: int | None, vendor: str = "vendor_id") -> DataFrame:
    """Groups by raw attributes that several vendors sell, not too many offers, best covered first;
    ties go by the keys. Null and blank text are one value."""
    kinds = dict(offers.dtypes)
    even = offers.filter("price > 0").withColumns({k: F.coalesce(k, F.lit("")) for k in keys if kinds[k] == "string"})
    stats = even.groupBy(*keys).agg(
        F.count_distinct(vendor).alias("vendor_count"), F.count(F.lit(1)).alias("product_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.avg("price").alias("avg_price")
    )
    kept = stats.filter((F.col("vendor_count") > 1) & (F.col("product_count") < 100) & F.expr("product_count div vendor_count < 5"))
    return kept if limit is None else kept.orderBy(F.col("vendor_count").desc(), *[F.col(k).asc_nulls_first() for k in keys]).limit(limit)


def top_offers(offers: DataFrame, groups: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` cheapest offers of each group, by price and id; keys match null-safe."""
    kinds = dict(offers.dtypes)
    even = offers.filter("price > 0").withColumns({c: F.coalesce(c, F.lit("")) for c in keys if kinds[c] == "string"})
    named = groups.select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    match = None
    for c in keys:
        test = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        match = test if match is None else match & test
    member = even.join(named, match).drop(*named.columns)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("price", "id"))
    return member.withColumn("_at", place).filter(F.col("_at") <= k).drop("_at")


def featured(offers: DataFrame, d: D.Dictionaries, limit: int = 20) -> DataFrame:
    """Best-covered groups with one offer a vendor; keys are those of search without a canonical
    identity, figures are over the offers shown."""
    best = featured_keys(offers.filter("core <> ''"), FEATURED_KEYS, limit)
    keyed = with_group_key(top_offers(offers, best, FEATURED_KEYS), d, use_canonical=False)
    place = F.row_number().over(Window.partitionBy("group_key", "vendor_id").orderBy("price", "id"))
    rows = keyed.withColumns({"_at": place, "_all": F.count(F.lit(1)).over(Window.partitionBy("group_key"))}).filter("_at = 1")
    groups = rows.groupBy("group_key").agg(
        F.min("group_display").alias("name"),
        F.count(F.lit(1)).alias("vendor_count"),
        F.max("_all").alias("product_count"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("price").alias("avg_price"),
        F.array_sort(F.collect_list(F.struct("price", "id", "title", "vendor_id", "vendor_name", "brand"))).alias("products"),
    )
    return groups.orderBy(F.col("vendor_count").desc(), "group_key").limit(limit)


def evaluate_watches(watches: DataFrame, snap: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(watches with new prices, history rows, alerts) of one run.

    A watch whose group is gone stays as it is. With a target an alert is given when the price
    first reaches it; without one, on any drop of more than a thousandth.
    """
    found = watches.join(snap, "group_key", "left")
    new, old, target = F.col("min_price"), F.col("last_price"), F.col("target_price")
    reached = target.isNotNull() & (new <= target) & (old.isNull() | (old > target))
    dropped = target.isNull() & old.isNotNull() & (new < old - 0.001)
    kind = F.when(reached, F.lit("target")).when(dropped, F.lit("drop"))
    judged = found.withColumn("kind", kind)
    updated = judged.withColumns({"last_price": F.coalesce("min_price", "last_price"), "last_vendor": F.when(new.isNotNull(), F.col("vendor")).otherwise(F.col("last_vendor"))}).select(*watches.columns)
    history = found.filter(new.isNotNull()).select("group_key", "min_price", "offer_count").distinct().withColumn("recorded_at", as_of)
    alerts = judged.filter("kind is not null").select(
        F.col("id").alias("watch_id"), "user_id", "kind", F.col("last_price").alias("old_price"), F.col("min_price").alias("new_price"), "vendor", as_of.alias("sent_at")
    )
    return updated, history, alerts


def recent(history: DataFrame, as_of: Column, days: int = 180, at: str = "recorded_at") -> DataFrame:
    return history.filter(F.col(at) > as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def trend(history: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """First and last value, bounds and direction of each key with two points or more."""
    stats = history.groupBy(key).agg(
        F.min_by(value, F.struct(at, value)).alias("first_value"), F.max_by(value, F.struct(at, value)).alias("last_value"), F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("points")
    )
    return stats.filter("points >= 2").withColumn("direction", F.signum(F.col("last_value") - F.col("first_value")).cast("int"))


def scaled(history: DataFrame, key: str, value: str) -> DataFrame:
    """Each point between 0 and 1 within its key; 0 where all points are equal."""
    of = Window.partitionBy(key)
    low, high = F.min(value).over(of), F.max(value).over(of)
    return history.withColumn("scaled", F.coalesce(F.try_divide(F.col(value) - low, high - low), F.lit(0.0)))


def drops(now: DataFrame, before: DataFrame, key: str = "group_key", price: str = "min_price") -> DataFrame:
    """Keys whose price fell, and by how many percent."""
    old = before.select(key, F.col(price).alias("old_price"))
    fell = now.select(key, price).join(old, key).filter(F.col(price) < F.col("old_price"))
    return fell.withColumn("drop_percent", F.round((F.col("old_price") - F.col(price)) / F.col("old_price") * 100))


def grouping_statistics(groups: DataFrame) -> DataFrame:
    """Averages over groups and the share that several vendors sell."""
    many = F.count_if(F.col("vendor_count") > 1)
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.avg("product_count").alias("avg_products"),
        F.avg("vendor_count").alias("avg_vendors"),
        many.alias("multi_vendor"),
        F.coalesce(F.try_divide(many * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("multi_vendor_percent"),
    )


def savings(groups: DataFrame) -> DataFrame:
    """Percent between the dearest and the cheapest offer of a group."""
    share = (F.col("max_price") - F.col("min_price")) / F.nullif(F.col("max_price"), F.lit(0.0)) * 100
    return groups.withColumn("savings_percent", F.coalesce(F.round(share), F.lit(0.0)))
