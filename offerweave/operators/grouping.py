"""Offers into groups: one offer a vendor, roll-up, score and order of groups."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import text as T
from offerweave.functions.groupkey import fold_formless, fold_sizeless, with_group_key


def with_rank(hits: DataFrame, *order: Column) -> DataFrame:
    """Position of each hit in the order given, from 0. One task numbers all: for result pages,
    not for whole catalogs; give whole catalogs a rank of their own."""
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def group_offers(offers: DataFrame, d: D.Dictionaries) -> DataFrame:
    """Keys, then both folds: what search and the catalog snapshot share.

    Each fold reads the offers twice, so keyed offers are kept (lost parts are worked out again).
    Unpersist them by ``spark.catalog.clearCache()`` when a job is done.
    """
    keyed = with_group_key(offers, d).persist(StorageLevel.MEMORY_AND_DISK)
    return fold_formless(fold_sizeless(keyed))


def cheapest_per_vendor(offers: DataFrame, group: str = "group_key", vendor: str = "vendor_id", order: tuple[str, ...] = ("price", "rank", "id")) -> DataFrame:
    """The first offer of each vendor in each group by ``order``; an offer without a vendor is its
    own. Adds _of_vendor and _first, the vendor's number of offers in the group and their best rank."""
    who = F.coalesce(F.nullif(F.col(vendor).cast("string"), F.lit("")), F.col("id").cast("string"))
    # partial aggregates: a hot group or vendor is reduced before it is shuffled
    place = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))])
    rest = [c for c in offers.columns if c != group]
    one = offers.groupBy(group, who.alias("_who")).agg(
        F.min(F.struct(place.alias("_place"), F.struct(*rest).alias("_row")))["_row"].alias("_row"), F.count(F.lit(1)).alias("_of_vendor"), F.min("rank").alias("_first")
    )
    return one.select(*[F.col(group) if c == group else F.col("_row")[c].alias(c) for c in offers.columns], "_of_vendor", "_first")


def roll_up(offers: DataFrame, group: str = "group_key", members: list[str] | None = None) -> DataFrame:
    """One row per group: vendors, offers and hidden offers, prices over one offer a vendor, the
    best rank, and members (struct of ``members``) in order of price, rank and id.

    A third of all offers in one group cost no more than a row per vendor: offers of a vendor are
    reduced before members are gathered.
    """
    one = cheapest_per_vendor(offers, group)
    lead = [F.col(c) for c in ("price", "rank", "id")]
    own = [F.col(c) for c in (members or []) if c not in ("price", "rank", "id")]
    return one.groupBy(group).agg(
        F.count(F.lit(1)).alias("vendor_count"),
        F.sum("_of_vendor").alias("product_count"),
        (F.sum("_of_vendor") - F.count(F.lit(1))).alias("hidden_offers"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.avg("price").alias("avg_price"),
        F.min("_first").alias("first_rank"),
        F.array_sort(F.collect_list(F.struct(*lead, *own))).alias("products"),
    )


def display_name(products: Column, key: Column) -> Column:
    """The first member's display, else the shortest normalised name, else the title, else the key."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    first = F.get(products, F.lit(0))
    names = F.filter(F.transform(products, lambda p: blank(p["normalized_name"])), lambda n: n.isNotNull())
    least = F.array_min(F.transform(names, lambda n, i: F.struct(F.octet_length(n).alias("n"), i.alias("i"), n.alias("name"))))
    return F.coalesce(blank(first["group_display"]), least["name"], blank(first["title"]), key)


def query_score(candidate: Column, query: D.Query) -> Column:
    """How well a text answers a query: whole, prefix, word and substring of the query or a variant
    of it, else by the number of its words found."""
    c = T.normalize_key(candidate)
    terms = list(dict.fromkeys([query.normalized, *query.variants]))
    scores = [F.lit(0)]
    for term in terms:
        scores.append(
            F.when(c == term, 1200)
            .when(c.startswith(term + " "), 1050)
            .when(F.contains(c, F.lit(f" {term} ")), 980)
            .when(F.contains(c, F.lit(term)), 900)
            .otherwise(0)
        )
    if query.tokens:
        hits = sum((F.contains(c, F.lit(t)).cast("int") for t in query.tokens), F.lit(0))
        scores.append(hits * 120)
        scores.append(F.when(hits == len(query.tokens), 700 + hits * 40).otherwise(0))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.when((c == "") | F.lit(query.normalized == ""), 0).otherwise(best)


def group_score(query: D.Query, name: Column, key: Column, products: Column) -> Column:
    """The best score of the group's name, key and first three members, each with its boost."""
    scored = lambda c, boost: F.when((s := query_score(c, query)) > 0, s + boost).otherwise(0)
    own = [scored(name, 80), scored(key, 30)]
    first = F.slice(products, 1, 3)
    fields = (("title", 70), ("brand", 55), ("normalized_name", 65), ("core", 50))
    of_member = F.transform(first, lambda p, i: F.greatest(*[scored(p[f], F.lit(b) + 40 - 10 * i) for f, b in fields]))
    return F.greatest(*own, F.coalesce(F.array_max(of_member), F.lit(0)))


#: Total order of groups: tiers of a hundred points, then vendors, score, rank, spread and key.
def group_order(key: str = "group_key") -> list[Column]:
    return [
        F.floor(F.col("match_score") / 100).desc(),
        F.col("vendor_count").desc(),
        F.col("match_score").desc(),
        F.col("first_rank").asc(),
        (F.col("max_price") - F.col("min_price")).desc(),
        F.col(key).asc(),
    ]


MEMBERS = ["title", "vendor_id", "vendor_name", "brand", "category", "form", "dosage_value", "dosage_unit", "quantity", "normalized_name", "core", "group_display"]


def grouped(hits: DataFrame, query: D.Query, d: D.Dictionaries) -> DataFrame:
    """Ranked hits as groups with name and score."""
    rolled = roll_up(group_offers(hits, d), members=MEMBERS)
    named = rolled.withColumn("name", display_name(F.col("products"), F.col("group_key")))
    return named.withColumn("match_score", group_score(query, F.col("name"), F.col("group_key"), F.col("products")))


def page(groups: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of ordered groups; beyond the end it is empty."""
    return groups.orderBy(*group_order()).offset(max(0, offset)).limit(max(0, limit))


def price_position(offers: DataFrame, group: str = "group_key") -> DataFrame:
    """Each offer against its group: distance from the mean, percentile, whether best or worst."""
    by_price = offers.groupBy(group, "price").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy(group)  # over distinct prices: a hot group counts by price first
    below = F.coalesce(F.sum("_n").over(of.orderBy("price").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = by_price.select(group, "price", F.when(F.sum("_n").over(of) > 1, below / (F.sum("_n").over(of) - 1)).otherwise(0.0).alias("percentile"))
    whole = offers.groupBy(group).agg(F.avg("price").alias("_avg"), F.min("price").alias("_min"), F.max("price").alias("_max"))
    named = [F.col(c) for c in offers.columns]
    joined = offers.join(ranked.withColumnsRenamed({group: "_g", "price": "_p"}), F.col(group).eqNullSafe(F.col("_g")) & F.col("price").eqNullSafe(F.col("_p")))
    joined = joined.drop("_g", "_p").join(whole.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(
        *named,
        (F.col("price") - F.col("_avg")).alias("diff_from_avg"),
        "percentile",
        (F.col("price") == F.col("_min")).alias("is_best_deal"),
        (F.col("price") == F.col("_max")).alias("is_worst_deal"),
        (F.col("_max") - F.col("_min")).alias("price_spread"),
    )
