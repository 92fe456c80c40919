"""What a catalog service answers, each call one plan over the offers.

Groups are given as DataFrames; only a page of them is ever collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions.measures import quantity_facet
from offerweave.operators import audit, catalog, facets, filters, grouping, search
from offerweave.plans.cache import ResultCache, filter_key

PAGE, PAGE_MOST, COMPARE, SUGGEST = 24, 60, 10, 8


@dataclass
class Page:
    groups: list
    total_groups: int
    total_products: int
    facets: dict
    offset: int
    limit: int


def clamp(limit: int | None, default: int = PAGE, most: int = PAGE_MOST) -> int:
    return min(limit if limit and limit > 0 else default, most)


class Catalog:
    """``offers`` as in schemas.PRODUCT. Persist them for a service: ``Catalog(offers.persist(), d)``."""

    def __init__(self, offers: DataFrame, dictionaries: D.Dictionaries, budget: int = 50_000, ttl: float = 300.0):
        self.offers, self.d = offers, dictionaries
        self.pages = ResultCache(budget, ttl, weigh=lambda p: sum(len(g["products"]) for g in p.groups))
        self.suggestions = ResultCache(500, ttl)

    def query(self, text: str) -> D.Query:
        return D.Query(text or "", self.d)

    def hits(self, text: str, brands: list[str] = (), categories: list[str] = (), limit: int | None = None) -> DataFrame:
        """Ranked hits; without a text the filters are browsed."""
        if (text or "").strip():
            return search.search(self.offers, self.query(text), limit)
        found = search.browse(self.offers, list(categories), list(brands), limit)
        return found.withColumn("rank", F.struct((-F.col("coverage")).alias("coverage"), "price", "id"))

    def search(self, text: str, brands: list[str] = (), categories: list[str] = (), limit: int = 5_000) -> tuple[DataFrame, DataFrame]:
        """(hits that pass the filters, facets of all hits)."""
        found = self.hits(text, brands, categories, limit)
        counts = facets.facets(
            found, vendor=F.col("vendor_name"), brand=F.col("brand"), dosage_unit=F.col("dosage_unit"), form=F.col("form"), category=F.col("category"), quantity=quantity_facet(F.col("quantity"))
        )
        return filters.hits_by(found, brand=brands, category=categories), counts

    def groups(self, text: str, brands: list[str] = (), categories: list[str] = ()) -> tuple[DataFrame, DataFrame]:
        """(groups that pass the filters, facets of all groups): facets come before the filters."""
        found = grouping.grouped(self.hits(text, brands, categories), self.query(text), self.d)
        return filters.groups_by(found, brand=brands, category=categories), facets.result_facets(found)

    def search_groups(self, text: str, brands: list[str] = (), categories: list[str] = (), offset: int = 0, limit: int | None = None) -> Page:
        """A page of groups; beyond the end it is empty but has totals and facets."""
        offset, limit = max(0, offset or 0), clamp(limit)
        key = (*filter_key(self.query(text).normalized or (text or "").lower(), brands, categories), offset, limit)
        if found := self.pages.get(key):
            return found
        groups, counts = self.groups(text, brands, categories)
        groups = groups.persist()
        try:
            totals = groups.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("vendor_count"), F.lit(0)).alias("p")).first()
            rows = [r.asDict(recursive=True) for r in grouping.page(groups, offset, limit).collect()] if offset < totals.n else []
            values: dict = {}
            for r in facets.top(counts, brand=200, vendor=200, quantity=200).collect():
                values.setdefault(r.facet, {})[r.value] = r.n
        finally:
            groups.unpersist()
        page = Page(rows, totals.n, totals.p, values, offset, limit)
        self.pages.put(key, page)
        return page

    def compare(self, text: str) -> Page:
        return self.search_groups(text, limit=COMPARE)

    def autocomplete(self, text: str, limit: int | None = None) -> list:
        limit, q = limit if limit and limit > 0 else SUGGEST, self.query(text)
        if not (q.normalized or q.text):
            return []
        key = (q.normalized or q.text.lower(), limit)
        if (found := self.suggestions.get(key)) is None:
            found = [r.asDict() for r in search.autocomplete(self.offers, q, limit).collect()]
            self.suggestions.put(key, found)
        return found

    def facets(self) -> DataFrame:
        """Counts over the whole catalog, unpriced offers included; brands are cut at 200."""
        counts = facets.facets(self.offers, vendor=F.col("vendor_name"), brand=F.col("brand"), category=F.col("category"), dosage_unit=F.col("dosage_unit"))
        return facets.top(counts, brand=200)

    def featured(self, limit: int = 20) -> DataFrame:
        return catalog.featured(self.offers, self.d, limit)

    def snapshot(self) -> DataFrame:
        return catalog.catalog_snapshot(self.offers, self.d)

    def watch(self, watches: DataFrame, as_of) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """One run of the price watch; without watches the catalog is not touched."""
        return None if watches.isEmpty() else catalog.evaluate_watches(watches, self.snapshot(), as_of)

    def processing(self, done) -> DataFrame:
        return audit.processing_rate(self.offers, done)


def vendor_directory(vendors: DataFrame, products: DataFrame, places: DataFrame) -> DataFrame:
    """Vendors with a priced product, with numbers of products and places."""
    priced = products.filter("price > 0").groupBy(F.col("vendor_id").alias("_v")).agg(F.count(F.lit(1)).alias("product_count"))
    where = places.groupBy(F.col("vendor_id").alias("_p")).agg(F.count(F.lit(1)).alias("location_count"))
    found = vendors.join(priced, F.col("id") == F.col("_v")).join(where, F.col("id") == F.col("_p"), "left").drop("_v", "_p")
    return found.withColumn("location_count", F.coalesce("location_count", F.lit(0)).cast("long")).orderBy("name")


def alerts_of(alerts: DataFrame, watches: DataFrame, user_id: str) -> DataFrame:
    """A user's alerts, latest first; the name is blank where the watch is gone."""
    names = watches.select(F.col("id").alias("watch_id"), "display_name", "group_key")
    found = alerts.filter(F.col("user_id") == user_id).join(names, "watch_id", "left")
    return found.withColumns({c: F.coalesce(c, F.lit("")) for c in ("display_name", "group_key")}).orderBy(F.col("sent_at").desc(), "watch_id")


def offers_of(groups: DataFrame) -> DataFrame:
    """Members of groups as rows, with their group's figures."""
    return groups.select("group_key", "vendor_count", "hidden_offers", "min_price", "max_price", F.explode("products").alias("p")).select("group_key", "vendor_count", "hidden_offers", "min_price", "max_price", "p.*")
