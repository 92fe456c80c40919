"""Vendor places: relevance, one place a spot, vendor names, distances, cities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerweave.functions import geo
from offerweave.functions import text as T

# Signs of a relevant place in a category's name, and in its own and its vendor's.
CATEGORY_SIGNS = ["pharm", "drug", "apotek", "apteka", "vitamin", "nutrition", "health food", "sporting goods", "cosmetic", "beauty supply"]
NAME_SIGNS = (
    "apotek|апотек|pharm|фарм|farmaci|drogerie|drugstore|benu|dr max|lilly|lily|srbotrade|zdravlja|vita|vitamin|suplement|supplement|protein|proteini|sport|"
    "fitness|fitlab|gym|pansport|titanium|superior"
)
WHOLE_NAMES = ["dm"]
NO_ADDRESS = ["", "rs", "serbia", "srbija"]
SOURCES = ["foursquare", "tomtom", "osm"]
GENERIC_WORDS = ["apoteka", "apoteke", "apotekarska", "ustanova", "pharmacy", "farmacija", "online", "shop", "store", "prodavnica", "srbija", "rs", "www", "web", "net", "e"]
GENERIC_NAMES = ["apoteka", "pharmacy", "drugstore", "drogerie", "chemist", "supplement", "suplementi", "vitamin", "sport", "sports", "fitness", "shop", "store"]


def relevant(categories: Column, name: Column, vendor: Column, allowed_ids: list[str] = ()) -> Column:
    """One category is allowed by id or by name, or the names tell."""
    by_id = lambda c: F.coalesce(F.coalesce(c["fsq_category_id"], c["id"]).isin(*allowed_ids), F.lit(False)) if allowed_ids else F.lit(False)
    by_name = lambda c: F.coalesce(F.lower(c["name"]).rlike("|".join(CATEGORY_SIGNS)), F.lit(False))
    both = F.lower(F.concat_ws(" ", name, vendor))
    return F.coalesce(F.exists(categories, lambda c: by_id(c) | by_name(c)), F.lit(False)) | both.rlike(NAME_SIGNS) | F.lower(F.coalesce(vendor, F.lit(""))).isin(*WHOLE_NAMES)


def one_per_spot(places: DataFrame) -> DataFrame:
    """Of a vendor's places in one cell the one that is described best: photos, address, phone, hours,
    source, then the latest and the smallest id."""
    told = lambda c: ~F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin(*NO_ADDRESS)
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    source = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")), F.lit(0))
    best = [
        F.coalesce(F.size("photos") > 0, F.lit(False)).desc(),
        told("address").desc(),
        told("formatted_address").desc(),
        some("phone").desc(),
        some("hours").desc(),
        F.when(source > 0, source).otherwise(4).asc(),
        F.col("fetched_at").desc_nulls_first(),
        F.col("id").asc(),
    ]
    place = F.row_number().over(Window.partitionBy("vendor_id", *geo.cell(F.col("latitude"), F.col("longitude"))).orderBy(*best))
    return places.withColumn("_at", place).filter("_at = 1").drop("_at")


def domain(url: Column) -> Column:
    """Host without www.; null if there is none."""
    full = F.when(url.rlike("(?i)^[a-z][a-z0-9+.-]*://"), url).otherwise(F.concat(F.lit("https://"), url))
    return F.nullif(F.regexp_replace(F.lower(F.try_parse_url(full, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def same_domain(a: Column, b: Column) -> Column:
    """Equal, or one is a subdomain of the other."""
    x, y = domain(a), domain(b)
    return F.coalesce((x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x)), F.lit(False))


def name_words(name: Column) -> Column:
    """Words of a vendor's name that tell it from others."""
    return F.array_distinct(F.filter(T.words(T.normalize_place(name)), lambda w: ~w.isin(*GENERIC_WORDS)))


def match_vendors(vendors: DataFrame, places: DataFrame) -> DataFrame:
    """(vendor_id, place_id) where a place looks like a vendor's: same domain or a subdomain; one name
    within the other (three characters of the vendor's, four of the place's unless generic); or all
    telling words of the vendor's name among the place's.

    Every test is an equi-join on something that a match must share, then verified: the last two
    labels of the domain, the three characters of the name within that the fewest names of the other
    side hold, its rarest telling word. Counted tables tell which these are, so a word that most
    names begin with brings nothing together; a name with a key that no name of the other side holds
    meets none. Each different name is worked on once. Joins are by sorting: the size of a file tells
    nothing of the rows that its names become, and a broadcast of these would fill the driver.
    """
    base = lambda d: F.array_join(F.slice(F.split(d, r"\."), -2, 2), ".")
    flat = lambda c: T.normalize_place(F.col(c))
    v = vendors.select(F.col("id").alias("vendor_id"), domain(F.col("website")).alias("_d"), flat("name").alias("_v"), name_words(F.col("name")).alias("_words"))
    p = places.select(F.col("id").alias("place_id"), domain(F.col("website")).alias("_s"), flat("name").alias("_p"))
    a = v.filter(F.contains("_d", F.lit("."))).withColumn("_k", base(F.col("_d")))
    b = p.filter(F.contains("_s", F.lit("."))).withColumn("_k", base(F.col("_s")))
    dot = F.lit(".")
    related = (F.col("_d") == F.col("_s")) | F.col("_d").endswith(F.concat(dot, "_s")) | F.col("_s").endswith(F.concat(dot, "_d"))
    by_domain = a.join(b.hint("merge"), "_k").filter(related).select("vendor_id", "place_id")
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.col(c).substr(i, F.lit(3))))

    def meet(inner, own, outer, have):
        """``inner`` rows by the rarest of their distinct keys ``own``, with all ``outer`` rows that have
        it; rows with a key that no ``outer`` row has go."""
        held = outer.withColumn("_k", F.explode(have))
        often = held.groupBy("_k").agg(F.count(F.lit(1)).alias("_often"))
        keys = inner.withColumn("_of", F.size(own)).withColumn("_k", F.explode(own)).join(often.hint("merge"), "_k")
        least = keys.groupBy(*inner.columns, "_of").agg(F.min(F.struct("_often", "_k"))["_k"].alias("_k"), F.count(F.lit(1)).alias("_met"))
        return least.filter("_met = _of").drop("_of", "_met").join(held.hint("merge"), "_k")

    vn, pn = v.select("_v", "_words").distinct(), p.select("_p").distinct().withColumn("_have", F.array_distinct(T.words(F.col("_p"))))
    within = meet(vn.filter(F.length("_v") >= 3).select("_v"), grams("_v"), pn.select("_p"), grams("_p")).filter(F.contains("_p", "_v"))
    plain = pn.filter((F.length("_p") >= 4) & ~F.col("_p").isin(*GENERIC_NAMES)).select("_p")
    around = meet(plain, grams("_p"), vn.select("_v"), grams("_v")).filter(F.contains("_v", "_p"))
    named = meet(vn.filter(F.size("_words") > 0), F.col("_words"), pn, F.col("_have")).filter(F.size(F.array_except("_words", "_have")) == 0)
    names = within.select("_v", "_p").unionByName(around.select("_v", "_p")).unionByName(named.select("_v", "_p")).distinct()
    by_name = names.join(v.select("vendor_id", "_v").hint("merge"), "_v").join(p.select("place_id", "_p").hint("merge"), "_p").select("vendor_id", "place_id")
    return by_domain.unionByName(by_name).distinct()


def prune(places: DataFrame, allowed: DataFrame) -> DataFrame:
    """Places that a run found again or that are allowed (vendor_id, source, source_id)."""
    return places.join(allowed.select("vendor_id", "source", "source_id").distinct(), ["vendor_id", "source", "source_id"], "left_semi")


def search_text(places: DataFrame, text: str) -> DataFrame:
    """Places whose name, address or city has all words of ``text``, accents and case aside."""
    whole = T.normalize_identity(F.concat_ws(" ", "name", "address", "locality"))
    from offerweave.functions.dictionaries import plain

    out = places.withColumn("_all", whole)
    for w in plain(text, ascii_only=True).split():
        out = out.filter(F.contains("_all", F.lit(w)))
    return out.drop("_all")


def colocated(places: DataFrame) -> DataFrame:
    """Spots with the number of places on them."""
    known = places.filter(geo.has_coordinates(F.col("latitude"), F.col("longitude")))
    return known.groupBy(geo.spot(F.col("latitude"), F.col("longitude")).alias("spot")).agg(F.count(F.lit(1)).alias("places"))


def nearest(places: DataFrame, lat: Column, lon: Column, by: list[str], limit: int | None = 300) -> DataFrame:
    """The nearest place of each ``by``, or without ``by`` the ``limit`` nearest (None: all), with the
    distance in metres; unknown places are left out."""
    known = places.filter(geo.has_coordinates(F.col("latitude"), F.col("longitude")))
    at = known.withColumn("distance_m", geo.haversine(F.col("latitude"), F.col("longitude"), lat, lon))
    if not by:
        near = at.orderBy(F.col("distance_m").asc_nulls_last(), "id")
        return near if limit is None else near.limit(limit)
    place = F.row_number().over(Window.partitionBy(*by).orderBy("distance_m", "id"))
    return at.withColumn("_at", place).filter("_at = 1").drop("_at")


def cities(places: DataFrame, aliases: dict[str, str] | None = None, city: str = "locality") -> DataFrame:
    """Number of places by city: spellings of one city count together, the most frequent is shown."""
    key = T.normalize_identity(F.col(city))
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        key = F.coalesce(F.try_element_at(table, key), key)
    spelled = places.withColumn("_key", key).filter("_key <> ''").groupBy("_key", F.trim(city).alias("_shown")).agg(F.count(F.lit(1)).alias("_n"))
    rolled = spelled.groupBy("_key").agg(F.sum("_n").alias("places"), F.min(F.struct(-F.col("_n"), "_shown"))["_shown"].alias("city"))
    return rolled.select("city", "places").orderBy(F.col("places").desc(), "city")


def best_place(places: DataFrame) -> DataFrame:
    """A vendor's best place by rating, popularity and name."""
    order = [F.col("rating").desc_nulls_last(), F.col("popularity").desc_nulls_last(), F.col("name").asc(), F.col("id").asc()]
    place = F.row_number().over(Window.partitionBy("vendor_id").orderBy(*order))
    return places.withColumn("_at", place).filter("_at = 1").drop("_at")


def category_names(categories: Column) -> Column:
    """Distinct names in order, case aside."""
    names = F.filter(F.transform(categories, lambda c: F.trim(F.coalesce(c["name"], F.lit("")))), lambda n: n != "")
    low = F.transform(names, F.lower)
    return F.filter(names, lambda n, i: F.array_position(low, F.lower(n)) == i + 1)


def photo_urls(photos: Column, size: str = "original") -> Column:
    """The url, or prefix, size and suffix together."""
    built = lambda p: F.when((p["prefix"] != "") & (p["suffix"] != ""), F.concat(p["prefix"], F.lit(size), p["suffix"]))
    return F.filter(F.transform(photos, lambda p: F.coalesce(F.nullif(p["url"], F.lit("")), built(p))), lambda u: u.isNotNull())
