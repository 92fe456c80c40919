"""The engine's queries over the driver's tables, and the same in DuckDB SQL.

An offer is a line item with its part and supplier: the supplier is the vendor, the part's name the
product, its brand, type and size are attributes, the extended price is the price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import geo, hygiene, trigram
from offerweave.functions import measures as M
from offerweave.functions import text as T
from offerweave.operators import audit, catalog, facets, filters, grouping, merge, places, search

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows of the driver's tables. The optimiser broadcasts the small sides by their size."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part, supplier = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.concat_ws("-", F.lpad("l_orderkey", 9, "0"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lpad("l_partkey", 8, "0"), F.lpad("l_suppkey", 6, "0")).alias("id"),
        F.col("p_name").alias("title"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").cast("string").alias("vendor_id"), F.col("s_name").alias("vendor_name"),
        F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("p_name").alias("core"), F.col("p_size").cast("double").alias("quantity"),
        F.col("p_name").alias("normalized_name"), F.split("p_name", " ").alias("search_tokens"), F.col("p_type").alias("form"), F.lit(0.0).alias("dosage_value"),
        F.lit("").alias("dosage_unit"), F.col("p_partkey").alias("part"),
    )


def cents(c):
    """Money as whole cents, so that sums don't depend on their order."""
    return F.round(c * 100).cast("long")


OFFERS = """
offers AS (
  SELECT lpad(CAST(l_orderkey AS VARCHAR), 9, '0') || '-' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '-' ||
         lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS id, p_name AS title, l_extendedprice AS price, CAST(l_suppkey AS VARCHAR) AS vendor_id, s_name AS vendor_name,
         p_brand AS brand, p_type AS category, p_name AS core, CAST(p_size AS DOUBLE) AS quantity, l_partkey AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""

GROUPS = (
    OFFERS
    + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY core, vendor_id ORDER BY price, id) AS place FROM offers WHERE price > 0),
groups AS (
  SELECT core AS group_key, count(DISTINCT vendor_id) AS vendor_count, count(*) AS product_count, count(*) - count(DISTINCT vendor_id) AS hidden_offers,
         min(price) FILTER (WHERE place = 1) AS min_price, max(price) FILTER (WHERE place = 1) AS max_price,
         CAST(sum(CAST(round(price * 100) AS BIGINT)) FILTER (WHERE place = 1) AS BIGINT) AS cents, min(id) AS first_rank
  FROM ranked GROUP BY core)"""
)


def groups(spark, sf_dir, **only) -> DataFrame:
    rows = filters.visible(filters.by_values(offers(spark, sf_dir), **only)).withColumns({"group_key": F.col("core"), "rank": F.col("id"), "group_display": F.col("core")})
    return grouping.roll_up(rows, members=grouping.MEMBERS)


def flat(g: DataFrame) -> DataFrame:
    total = F.aggregate(F.transform("products", lambda p: cents(p["price"])), F.lit(0).cast("long"), lambda a, b: a + b)
    return g.select("group_key", "vendor_count", "product_count", "hidden_offers", "min_price", "max_price", total.alias("cents"))


@query(
    f"""WITH {OFFERS}, few AS (SELECT * FROM offers WHERE price > 0 AND category = 'PROMO'),
n AS (SELECT core, count(DISTINCT vendor_id) AS n FROM few WHERE core <> '' GROUP BY core)
SELECT id, few.core AS core, vendor_name, price, coalesce(n, 1) AS coverage FROM few LEFT JOIN n ON few.core = n.core"""
)
def browse_by_category(spark, sf_dir):
    return search.browse(offers(spark, sf_dir), categories=["PROMO"]).select("id", "core", "vendor_name", "price", "coverage")


@query(f"WITH {GROUPS} SELECT group_key, vendor_count, product_count, hidden_offers, min_price, max_price, cents FROM groups")
def group_rollup_vendor_dedupe(spark, sf_dir):
    return flat(groups(spark, sf_dir))


@query(
    f"""WITH {GROUPS.replace("WHERE price > 0", "WHERE price > 0 AND category = 'PROMO'")}
SELECT group_key, vendor_count, product_count, hidden_offers, min_price, max_price, cents FROM groups ORDER BY vendor_count DESC, min_price, group_key LIMIT 20"""
)
def category_groups_top(spark, sf_dir):
    """Groups of one category with the cheapest offer per vendor, best covered first."""
    return flat(groups(spark, sf_dir, category=["PROMO"])).orderBy(F.col("vendor_count").desc(), "min_price", "group_key").limit(20)


@query(
    f"""WITH {GROUPS}, s AS (
  SELECT *, CASE WHEN group_key = 'red bolt' THEN 1280 WHEN starts_with(group_key, 'red bolt ') THEN 1130 WHEN contains(group_key, ' red bolt ') THEN 1060
    WHEN contains(group_key, 'red bolt') THEN 980
    WHEN contains(group_key, 'red') AND contains(group_key, 'bolt') THEN 890
    WHEN contains(group_key, 'red') OR contains(group_key, 'bolt') THEN 120 + 110 ELSE 0 END AS match_score FROM groups)
SELECT group_key, CASE WHEN match_score = 1280 THEN 1310 WHEN match_score = 0 THEN 0 ELSE match_score END AS match_score, vendor_count, min_price, max_price
FROM s ORDER BY CASE WHEN match_score = 1280 THEN 13 ELSE match_score // 100 END DESC, vendor_count DESC, match_score DESC, first_rank, max_price - min_price DESC, group_key LIMIT 25"""
)
def group_rank_tiers(spark, sf_dir):
    q = D.Query("red bolt", D.Dictionaries())
    g = groups(spark, sf_dir).withColumn("name", grouping.display_name(F.col("products"), F.col("group_key")))
    scored = g.withColumn("match_score", grouping.group_score(q, F.col("name"), F.col("group_key"), F.col("products")))
    return grouping.page(scored, 0, 25).select("group_key", "match_score", "vendor_count", "min_price", "max_price")


@query(
    f"""WITH {GROUPS} SELECT group_key, vendor_count, product_count, hidden_offers, min_price, max_price, cents FROM groups
WHERE EXISTS (SELECT 1 FROM ranked WHERE core = group_key AND place = 1 AND lower(brand) IN ('brand#1', 'brand#2') AND lower(category) = 'small')"""
)
def group_level_filter(spark, sf_dir):
    return flat(filters.groups_by(groups(spark, sf_dir), brand=["brand#1 ", "BRAND#2", ""], category=["Small"]))


@query(f"WITH {OFFERS} SELECT id, brand, category, price FROM offers WHERE lower(trim(brand)) IN ('brand#3') AND lower(trim(category)) IN ('promo', 'large')")
def hit_level_filter(spark, sf_dir):
    return filters.hits_by(offers(spark, sf_dir), brand=["BRAND#3"], category=["promo", "Large "]).select("id", "brand", "category", "price")


@query(
    f"""WITH {GROUPS} SELECT group_key, min_price, max_price FROM groups WHERE max_price >= 60000 AND min_price <= 930"""
)
def price_overlap_filter(spark, sf_dir):
    return filters.price_overlap(groups(spark, sf_dir), 60_000, 930).select("group_key", "min_price", "max_price")


@query(f"WITH {GROUPS} SELECT CAST(floor(min(min_price) / 100) * 100 AS BIGINT) AS low, CAST(ceil(max(max_price) / 100) * 100 AS BIGINT) AS high FROM groups")
def price_bounds(spark, sf_dir):
    return filters.price_bounds(groups(spark, sf_dir))


_FACETS = " UNION ALL ".join(
    f"SELECT '{name}' AS facet, trim(CAST({c} AS VARCHAR)) AS value, count(*) AS n FROM offers WHERE trim(coalesce(CAST({c} AS VARCHAR), '')) <> '' GROUP BY 2"
    for name, c in (("vendor", "vendor_name"), ("brand", "brand"), ("category", "category"), ("quantity", "CAST(quantity AS INTEGER)"))
)


@query(f"WITH {OFFERS} {_FACETS}")
def facets_long(spark, sf_dir):
    o = offers(spark, sf_dir)
    return facets.facets(o, vendor=F.col("vendor_name"), brand=F.col("brand"), category=F.col("category"), quantity=M.quantity_facet(F.col("quantity")))


@query(
    f"""WITH {OFFERS}, f AS ({_FACETS})
SELECT facet, value, n FROM f QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= CASE facet WHEN 'brand' THEN 15 WHEN 'vendor' THEN 8 ELSE 12 END"""
)
def facets_top(spark, sf_dir):
    return facets.top(facets_long(spark, sf_dir), brand=15, vendor=8, quantity=12, category=12)


@query(
    f"""WITH {GROUPS}, p AS (SELECT * FROM ranked WHERE place = 1)
SELECT 'vendor' AS facet, vendor_name AS value, count(*) AS n FROM p GROUP BY 2 UNION ALL SELECT 'brand', brand, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'category', category, count(*) FROM p GROUP BY 2 UNION ALL SELECT 'form', category, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'quantity', CAST(CAST(quantity AS INTEGER) AS VARCHAR), count(*) FROM p GROUP BY 2"""
)
def result_facets(spark, sf_dir):
    return facets.result_facets(groups(spark, sf_dir))


_KEYS = ["core", "brand", "quantity"]
_FEATURED = f"""WITH {OFFERS}, k AS (
  SELECT core, brand, quantity, count(DISTINCT vendor_id) AS vendor_count, count(*) AS product_count, min(price) AS min_price, max(price) AS max_price
  FROM offers WHERE price > 0 GROUP BY 1, 2, 3
  HAVING count(DISTINCT vendor_id) > 1 AND count(*) < 100 AND count(*) // count(DISTINCT vendor_id) < 5),
t AS (SELECT * FROM k ORDER BY vendor_count DESC, core, brand, quantity LIMIT 20)"""


@query(f"{_FEATURED} SELECT * FROM t")
def featured_groups(spark, sf_dir):
    return catalog.featured_keys(offers(spark, sf_dir), _KEYS, 20).drop("avg_price")


@query(
    f"""{_FEATURED} SELECT o.core AS core, o.brand AS brand, o.quantity AS quantity, id, price FROM offers o JOIN t ON o.core = t.core AND o.brand = t.brand AND o.quantity = t.quantity
WHERE price > 0 QUALIFY row_number() OVER (PARTITION BY o.core, o.brand, o.quantity ORDER BY price, id) <= 10"""
)
def featured_topk_per_group(spark, sf_dir):
    o = offers(spark, sf_dir)
    return catalog.top_offers(o, catalog.featured_keys(o, _KEYS, 20), _KEYS, 10).select(*_KEYS, "id", "price")


@query(
    f"""WITH {OFFERS} SELECT core AS group_key, min(price) AS min_price, arg_min(vendor_name, (price, vendor_name, id)) AS vendor, count(*) AS offer_count
FROM offers WHERE price > 0 GROUP BY core"""
)
def catalog_snapshot(spark, sf_dir):
    return catalog.snapshot(offers(spark, sf_dir), "core").withColumnRenamed("core", "group_key")


def _parts(spark, sf_dir) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.lpad("p_partkey", 8, "0").alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"),
        F.concat_ws(" ", "p_name", "p_type").alias("normalized_name"), F.col("p_name").alias("core"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("search_tokens"),
        F.col("p_brand").alias("vendor_name"), F.col("p_brand").alias("vendor_id"),
    )


def _grams(c: str) -> str:
    """Ordered trigrams of lower-cased words of letters and digits."""
    return f"flatten(list_transform(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{Nd}}]+'), lambda w: list_transform(range(1, CAST(length(w) AS BIGINT) + 2), lambda i: substring('  ' || w || ' ', i, 3))))"


def _overlap(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0))"


def _similarity(a: str, b: str) -> str:
    return _overlap(_grams(a), _grams(b))


def _word_similarity(needle: str, grams: str) -> str:
    """Over all runs of the ordered trigrams, none left out."""
    return (
        f"list_max(flatten(list_transform(range(1, CAST(len({grams}) AS BIGINT) + 1), lambda i: list_transform(range(i, CAST(len({grams}) AS BIGINT) + 1), "
        f"lambda j: {_overlap(_grams(needle), f'{grams}[i:j]')}))))"
    )


_CATALOG = """parts AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, p_name AS title, p_retailprice AS price, p_brand AS brand, p_name || ' ' || p_type AS normalized_name, p_name AS core,
         string_split(lower(p_name || ' ' || p_type), ' ') AS search_tokens, p_brand AS vendor_name FROM part)"""


@query(
    f"""WITH {_CATALOG} SELECT id, title,
  CASE WHEN lower(core) = 'red bolt' THEN 0 WHEN list_has_all(search_tokens, ['bolt', 'red']) THEN 1 WHEN contains(lower(normalized_name), 'red bolt') THEN 2
       WHEN contains(lower(core), 'red bolt') THEN 3 ELSE 4 END AS tier,
  round(greatest({_similarity("title", "'red bolt'")}, {_similarity("normalized_name", "'red bolt'")}), 6) AS relevance
FROM parts WHERE price > 0 AND (list_has_all(search_tokens, ['bolt', 'red']) OR contains(lower(title), 'red bolt') OR contains(lower(normalized_name), 'red bolt'))"""
)
def precise_search(spark, sf_dir):
    found = search.precise(_parts(spark, sf_dir), D.Query("red bolt", D.Dictionaries()))
    return found.select("id", "title", F.col("tier").cast("int").alias("tier"), F.round("relevance", 6).alias("relevance"))


@query(
    f"""WITH {_CATALOG}, g AS (SELECT *, {_grams("title")} AS grams, {_grams("normalized_name")} AS names FROM parts),
s AS (SELECT *, {_overlap("grams", _grams("'widgit'"))} AS like_title, {_word_similarity("'widgit'", "grams")} AS word_title, {_word_similarity("'widgit'", "names")} AS word_name FROM g)
SELECT id, title, 1 AS pass, round(greatest(like_title, word_title), 6) AS relevance FROM s
WHERE price > 0 AND (like_title >= 0.3 OR word_title >= 0.5 OR word_name >= 0.5)
  AND (SELECT count(*) FROM parts WHERE list_contains(search_tokens, 'widgit') OR contains(lower(normalized_name), 'widgit')) < 3"""
)
def fuzzy_search_gate(spark, sf_dir):
    found = search.search(_parts(spark, sf_dir), D.Query("widgit", D.Dictionaries()))
    return found.select("id", "title", F.col("pass").cast("int").alias("pass"), F.round("relevance", 6).alias("relevance"))


@query(
    f"""WITH {_CATALOG}, g AS (SELECT *, {_grams("title")} AS grams FROM parts),
f AS (SELECT id, title, price, vendor_name, round(1 - {_word_similarity("title", _grams("'giz'"))}, 6) AS distance FROM g WHERE price > 0 AND {_word_similarity("'giz'", "grams")} >= 0.3
  ORDER BY distance, id LIMIT 48)
SELECT id, title, price, vendor_name, distance FROM f QUALIFY row_number() OVER (PARTITION BY lower(trim(title)) ORDER BY distance, id) = 1 ORDER BY distance, id LIMIT 8"""
)
def autocomplete_dedupe(spark, sf_dir):
    return search.autocomplete(_parts(spark, sf_dir), D.Query("giz", D.Dictionaries()), 8).withColumn("distance", F.round("distance", 6)).select("id", "title", "price", "vendor_name", "distance")


@query(f"WITH {_CATALOG} SELECT id, round({_similarity('title', chr(39) + 'small rings' + chr(39))}, 6) AS similarity FROM parts")
def trigram_similarity(spark, sf_dir):
    return _parts(spark, sf_dir).select("id", F.round(trigram.similarity(F.col("title"), F.lit("small rings")), 6).alias("similarity"))


@query(f"WITH {_CATALOG} SELECT id FROM parts WHERE {_similarity('title', chr(39) + 'small rings' + chr(39))} >= 0.45")
def trigram_candidates(spark, sf_dir):
    p = _parts(spark, sf_dir)
    found = p.join(search.candidates(search.postings(p), "small rings", 0.45), "id")
    return found.filter(trigram.similarity(F.col("title"), F.lit("small rings")) >= 0.45).select("id")


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_name IS NOT NULL)
SELECT a.word AS word, b.word AS near, CAST(levenshtein(a.word, b.word) AS INTEGER) AS edits FROM w a JOIN w b ON a.word < b.word AND length(a.word) >= 3 WHERE levenshtein(a.word, b.word) <= 2"""
)
def bounded_edit_distance(spark, sf_dir):
    """Words at most two edits apart. Such words share a variant with at most two letters deleted, so
    variants are joined, not words with words."""
    w = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    drop = lambda ws: F.flatten(
        F.transform(ws, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(x.substr(F.lit(1), i - 1), x.substr(i + 1, F.length(x)))))
    )
    one = drop(F.array("word"))
    keys = w.withColumn("_v", F.explode(F.array_distinct(F.concat(F.array("word"), one, drop(one)))))
    pairs = keys.join(keys.select(F.col("word").alias("near"), "_v"), "_v").filter((F.col("word") < F.col("near")) & (F.length("word") >= 3)).select("word", "near").distinct()
    return pairs.withColumn("edits", F.levenshtein("word", "near", 2)).filter("edits >= 0")


@query(
    """SELECT p_partkey, CASE WHEN p_size * 20 >= 500 THEN CAST(round(p_size * 20 / 250.0) * 250 AS BIGINT) WHEN p_size * 20 >= 100 THEN CAST(round(p_size * 20 / 50.0) * 50 AS BIGINT)
ELSE p_size * 20 END || 'g' AS size_key FROM part"""
)
def size_bucket_key(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", M.size_key((F.col("p_size") * 20).cast("double"), F.lit("gr")).alias("size_key"))


@query(
    """SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN CAST(p_size * 40 AS VARCHAR) || 'iu' WHEN 'LARGE' THEN CAST(p_size * 1000 AS VARCHAR) || 'mg'
  WHEN 'PROMO' THEN NULL WHEN 'ECONOMY' THEN regexp_replace(printf('%.6f', p_size / 1000.0), '\\.?0+$', '') || 'mg' ELSE CAST(p_size AS VARCHAR) || 'iu' END AS strength_key FROM part"""
)
def strength_canonical(spark, sf_dir):
    unit = F.when(F.col("p_type").isin("SMALL", "ECONOMY"), "mcg").when(F.col("p_type") == "LARGE", "gr").when(F.col("p_type") == "PROMO", "mg").otherwise("i.j.")
    found = F.when(F.col("p_type").isin("SMALL", "PROMO"), F.array(F.lit("vitamin d3"))).otherwise(F.array().cast("array<string>"))
    return read(spark, sf_dir, "part").select("p_partkey", M.strength_key(F.col("p_size").cast("double"), unit, found).alias("strength_key"))


@query(
    """WITH k AS (SELECT p_name AS base, p_name || '::form:' || lower(p_type) AS key, count(DISTINCT p_brand) AS n FROM part WHERE p_size > 10 GROUP BY 1, 2),
b AS (SELECT base, key FROM k QUALIFY row_number() OVER (PARTITION BY base ORDER BY n DESC, key) = 1)
SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name || '::form:' || lower(p_type) ELSE coalesce(b.key, p_name) END AS group_key FROM part LEFT JOIN b ON b.base = p_name"""
)
def fold_dominant_variant(spark, sf_dir):
    from offerweave.functions.groupkey import fold_formless

    p = read(spark, sf_dir, "part")
    key = F.when(F.col("p_size") > 10, F.concat("p_name", F.lit("::form:"), F.lower("p_type"))).otherwise(F.col("p_name"))
    return fold_formless(p.select("p_partkey", F.col("p_partkey").alias("id"), F.col("p_brand").alias("vendor_id"), key.alias("group_key"), F.lit("ingredient").alias("group_method"))).select("p_partkey", "group_key")


@query(
    """WITH l AS (SELECT DISTINCT p_name AS line FROM part WHERE p_type = 'SMALL' AND p_size >= 40)
SELECT p_partkey, CASE WHEN p_type = 'SMALL' AND p_size >= 40 THEN 'prod::' || p_name || '::' || p_size || 'g' WHEN p_type IN ('PROMO', 'LARGE') AND p_size >= 5 AND l.line IS NOT NULL
THEN 'prod::' || p_name ELSE 'offer:' || p_partkey END AS group_key FROM part LEFT JOIN l ON l.line = p_name"""
)
def fold_sizeless_line(spark, sf_dir):
    from offerweave.functions.groupkey import fold_sizeless

    line = (F.col("p_type") == "SMALL") & (F.col("p_size") >= 40)
    rows = read(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_partkey").alias("id"),
        F.when(line, F.concat(F.lit("prod::"), "p_name", F.lit("::"), "p_size", F.lit("g"))).otherwise(F.concat(F.lit("offer:"), "p_partkey")).alias("group_key"),
        F.when(line, "brand-line").when(F.col("p_type") == "PROMO", "brand-sku").when(F.col("p_type") == "LARGE", "single").otherwise("ingredient").alias("group_method"),
        F.col("p_name").alias("group_residual"),
        (line | (F.col("p_size") < 5)).alias("group_has_measure"),
    )
    return fold_sizeless(rows).select("p_partkey", "group_key")


def _watches(spark, sf_dir):
    """A watch per user: the last price is that of their first event, some have a target."""
    e = read(spark, sf_dir, "events")
    first = e.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("last_price"))
    u = F.col("user_id")
    return first.select(
        F.concat(F.lit("w"), u).alias("id"), u.cast("string").alias("user_id"), F.concat(F.lit("g"), u % 100).alias("group_key"), F.lit("").alias("display_name"),
        F.when(u % 3 == 0, (u % 40).cast("double")).alias("target_price"), F.when(u % 5 != 0, F.col("last_price")).alias("last_price"), F.lit(None).cast("string").alias("last_vendor"),
    )


def _prices(spark, sf_dir):
    e = read(spark, sf_dir, "events").filter("event_type = 'purchase' and value > 30")
    return e.groupBy(F.concat(F.lit("g"), F.col("user_id") % 100).alias("group_key")).agg(
        F.min("value").alias("min_price"), F.min(F.struct("value", "user_id"))["user_id"].cast("string").alias("vendor"), F.count(F.lit(1)).alias("offer_count")
    )


_WATCH = """w AS (SELECT user_id, arg_min(value, (ts, event_id)) AS v FROM events GROUP BY 1),
watches AS (SELECT 'w' || user_id AS id, CAST(user_id AS VARCHAR) AS user_id, 'g' || (user_id % 100) AS group_key, CASE WHEN user_id % 3 = 0 THEN CAST(user_id % 40 AS DOUBLE) END AS target_price,
  CASE WHEN user_id % 5 <> 0 THEN v END AS last_price FROM w),
prices AS (SELECT 'g' || (user_id % 100) AS group_key, min(value) AS min_price, CAST(arg_min(user_id, (value, user_id)) AS VARCHAR) AS vendor, count(*) AS offer_count FROM events
  WHERE event_type = 'purchase' AND value > 30 GROUP BY 1)"""


@query(
    f"""WITH {_WATCH} SELECT id AS watch_id, user_id, CASE WHEN target_price IS NOT NULL THEN 'target' ELSE 'drop' END AS kind, last_price AS old_price, min_price AS new_price, vendor
FROM watches JOIN prices USING (group_key) WHERE (target_price IS NOT NULL AND min_price <= target_price AND (last_price IS NULL OR last_price > target_price))
OR (target_price IS NULL AND last_price IS NOT NULL AND min_price < last_price - 0.001)"""
)
def price_watch_alerts(spark, sf_dir):
    as_of = F.lit("2024-02-01").cast("timestamp")
    return catalog.evaluate_watches(_watches(spark, sf_dir), _prices(spark, sf_dir), as_of)[2].drop("sent_at")


@query(f"WITH {_WATCH} SELECT id, coalesce(min_price, last_price) AS last_price, vendor AS last_vendor FROM watches LEFT JOIN prices USING (group_key)")
def price_watch_update(spark, sf_dir):
    updated, _, _ = catalog.evaluate_watches(_watches(spark, sf_dir), _prices(spark, sf_dir), F.lit("2024-02-01").cast("timestamp"))
    return updated.select("id", "last_price", "last_vendor")


@query("SELECT event_id, user_id, value FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAYS")
def price_history_window(spark, sf_dir):
    return catalog.recent(read(spark, sf_dir, "events"), F.lit("2024-01-31").cast("timestamp_ntz"), 10, "ts").select("event_id", "user_id", "value")


@query(
    """SELECT user_id, arg_min(value, (ts, value)) AS first_value, arg_max(value, (ts, value)) AS last_value, min(value) AS low, max(value) AS high, count(*) AS points,
CAST(sign(arg_max(value, (ts, value)) - arg_min(value, (ts, value))) AS INTEGER) AS direction FROM events GROUP BY 1 HAVING count(*) >= 2"""
)
def price_trend(spark, sf_dir):
    return catalog.trend(read(spark, sf_dir, "events"), "user_id", "value", "ts")


@query(
    """SELECT s_suppkey, s_name, n_name, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS product_count,
(SELECT count(*) FROM customer WHERE c_nationkey = s_nationkey) AS location_count FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_extendedprice > 0)"""
)
def vendor_directory(spark, sf_dir):
    line, vendor = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    n = line.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("product_count"))
    places_ = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("location_count"))
    priced = line.filter("l_extendedprice > 0").select("l_suppkey")
    rows = vendor.join(priced, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    rows = rows.join(places_, F.col("s_nationkey") == F.col("c_nationkey"), "left").join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("s_suppkey", "s_name", "n_name", zero("product_count"), zero("location_count"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def stale_anti_join(spark, sf_dir):
    seen = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


def _spots(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("vendor_id"), F.when(F.col("event_id") % 4 == 0, "osm").when(F.col("event_id") % 4 == 1, "tomtom").when(F.col("event_id") % 4 == 2, "foursquare").otherwise("x").alias("source"),
        F.when(F.col("event_id") % 3 == 0, " Srbija ").otherwise(F.col("event_type")).alias("address"), F.lit("rs").alias("formatted_address"),
        F.when(F.col("value") > 15, "1").otherwise("").alias("phone"), F.lit("").alias("hours"), (F.col("user_id") % 7 / F.lit(1000.0)).alias("latitude"),
        (F.col("event_id") % 3 / F.lit(250.0)).alias("longitude"), F.lit(None).cast("array<string>").alias("photos"), F.col("ts").alias("fetched_at"),
    )


@query(
    """WITH p AS (SELECT event_id AS id, user_id AS vendor_id, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 4 END AS source, event_id % 3 <> 0 AS told, value > 15 AS phone,
  user_id % 7 / 1000.0 AS latitude, event_id % 3 / 250.0 AS longitude, ts FROM events)
SELECT id, vendor_id FROM p QUALIFY row_number() OVER (PARTITION BY vendor_id, floor(latitude * 500), floor(longitude * 500) ORDER BY told DESC, phone DESC, source, ts DESC NULLS FIRST, id) = 1"""
)
def cell_dedupe(spark, sf_dir):
    return places.one_per_spot(_spots(spark, sf_dir)).select("id", "vendor_id")


@query(
    """WITH d AS (SELECT doc_id, lower(text) AS t, source, n_chars FROM documents)
SELECT doc_id FROM d QUALIFY row_number() OVER (PARTITION BY t, source, n_chars ORDER BY doc_id DESC) = 1"""
)
def duplicates_delete(spark, sf_dir):
    """The key is a digest of the title, so that the shuffle holds no texts."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower("text"), 256).alias("title"), F.col("source").alias("vendor_id"), F.col("n_chars").alias("price"))
    return merge.drop_repeats(d, [F.col("doc_id").desc()]).select("doc_id")


@query("SELECT lower(p_name) AS title, p_brand AS vendor_id, p_retailprice AS price, count(*) AS n FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return audit.repeats(read(spark, sf_dir, "part").select(F.col("p_name").alias("title"), F.col("p_brand").alias("vendor_id"), F.col("p_retailprice").alias("price")))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, ts DESC, event_id) = 1")
def latest_per_key(spark, sf_dir):
    order = [F.col("value").desc(), F.col("ts").desc(), F.col("event_id")]
    return merge.latest(read(spark, sf_dir, "events"), ["user_id", "event_type"], order).select("user_id", "event_type", "event_id", "value")


def _halves(spark, sf_dir):
    """Orders that were there, and those of urgent priorities and of the last years anew."""
    o = read(spark, sf_dir, "orders")
    value = o.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_totalprice") > 50_000, F.col("o_totalprice")).alias("price"), F.col("o_orderpriority").alias("note"), "o_orderdate")
    since = F.lit("1999-01-01").cast("timestamp_ntz")
    old = value.filter(F.col("o_orderdate") < since).drop("o_orderdate")
    fresh = value.filter((F.col("o_orderdate") >= since) | (F.col("note") == "1-URGENT")).select("o_orderkey", "o_custkey", F.lit("N").alias("status"), (F.col("price") * 2).alias("price"))
    return old, fresh


@query(
    """WITH v AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS price, o_orderpriority AS note, o_orderdate FROM orders),
o AS (SELECT * FROM v WHERE o_orderdate < TIMESTAMP '1999-01-01'), n AS (SELECT o_orderkey, o_custkey, 'N' AS status, price * 2 AS price FROM v WHERE o_orderdate >= TIMESTAMP '1999-01-01' OR note = '1-URGENT')
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN n.o_orderkey IS NULL THEN o.status ELSE n.status END AS status,
coalesce(n.price, o.price) AS price, o.note AS note FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"""
)
def upsert_coalesce(spark, sf_dir):
    old, fresh = _halves(spark, sf_dir)
    return merge.upsert(old, fresh, ["o_orderkey"], overwrite=["status"], fill=["price"])


@query(
    """WITH o AS (SELECT l_suppkey AS vendor, l_partkey AS title, min(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2),
f AS (SELECT DISTINCT l_suppkey AS vendor, l_partkey AS title FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_extendedprice < 10 * s_acctbal),
r AS (SELECT vendor, count(*) AS had, (SELECT count(*) FROM f WHERE f.vendor = o.vendor) AS has FROM o GROUP BY 1)
SELECT o.vendor AS vendor, title, price FROM o JOIN r USING (vendor) WHERE has = 0 OR has < 0.5 * had OR EXISTS (SELECT 1 FROM f WHERE f.vendor = o.vendor AND f.title = o.title)"""
)
def delist_ratio_guard(spark, sf_dir):
    old = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("title")).agg(F.min("l_extendedprice").alias("price"))
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    fresh = read(spark, sf_dir, "lineitem").join(s, "l_suppkey").filter("l_extendedprice < 10 * s_acctbal").select(F.col("l_suppkey").alias("vendor"), F.col("l_partkey").alias("title")).distinct()
    return merge.delist(old, fresh, ["vendor", "title"], "vendor").select("vendor", "title", "price")


@query(
    """WITH l AS (SELECT l_suppkey AS vendor, l_orderkey, l_linenumber, l_partkey, CASE WHEN (l_partkey + l_suppkey) % 5 <= l_suppkey % 5 THEN l_extendedprice ELSE 0 END AS price FROM lineitem),
s AS (SELECT vendor, count(*) FILTER (WHERE price <= 0) / count(*) AS share FROM l GROUP BY 1)
SELECT vendor, l_orderkey, l_linenumber, l_partkey, price FROM l JOIN s USING (vendor) WHERE price > 0 OR share > 0.5"""
)
def unpriced_delete(spark, sf_dir):
    price = F.when((F.col("l_partkey") + F.col("l_suppkey")) % 5 <= F.col("l_suppkey") % 5, F.col("l_extendedprice")).otherwise(0.0)
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("vendor"), "l_orderkey", "l_linenumber", "l_partkey", price.alias("price"))
    return merge.drop_unpriced(rows, "vendor")


@query(
    """SELECT vendor, title, id, price FROM (SELECT p_brand AS vendor, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name || ' ' END AS title, p_partkey AS id, p_size AS price FROM part)
QUALIFY row_number() OVER (PARTITION BY vendor, lower(trim(title)) ORDER BY price, id) = 1"""
)
def cheapest_title(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" ")))
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("vendor"), title.alias("title"), F.col("p_partkey").alias("id"), F.col("p_size").alias("price"))
    return merge.cheapest_titles(rows, "id")


_LETTERS = "replace(replace(replace(replace(replace(lower(trim(coalesce(text, ''))), 'đ', 'dj'), 'ђ', 'dj'), 'љ', 'lj'), 'њ', 'nj'), 'џ', 'dz')"
_FROM, _TO = T.LATIN_SINGLE[0] + T.CYRILLIC_SINGLE[0], T.LATIN_SINGLE[1] + T.CYRILLIC_SINGLE[1]


@query(f"SELECT doc_id, sha256(trim(regexp_replace(translate({_LETTERS}, '{_FROM}', '{_TO}'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'))) AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_key(F.col("text")), 256).alias("normalized"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(translate({_LETTERS}, '{_FROM}', '{_TO}'), '[^0-9a-z]+', ' ', 'g'))) AS normalized FROM documents")
def normalize_lookup_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_lookup(F.col("text")), 256).alias("normalized"))


_STOP = "['" + "', '".join(T.STOPWORDS) + "']"


@query(
    f"""WITH n AS (SELECT doc_id, string_split(trim(regexp_replace(translate({_LETTERS}, '{_FROM}', '{_TO}'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')), ' ') AS w FROM documents)
SELECT doc_id, CAST(len(list_distinct(list_filter(w, lambda x: x <> '' AND NOT list_contains({_STOP}, x) AND (strlen(x) > 1 OR list_contains(['c', 'd', 'b', 'k', 'e', 'a'], x))))) AS INTEGER) AS tokens FROM n"""
)
def tokenize(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(T.tokenize(F.col("text"))).alias("tokens"))


@query(
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [replace(p_name, ' ', ''), lower(regexp_replace(p_brand, '#', '')), regexp_extract(lower(p_brand), '^[a-z]+'),
  regexp_extract(p_brand, '[0-9]+$'), lower(p_type), CAST(p_size AS VARCHAR), 'mg', CAST(p_size AS VARCHAR) || 'mg']))), ' ') AS tokens FROM part"""
)
def search_tokens(spark, sf_dir):
    from offerweave.functions.extract import search_tokens as tokens

    none = F.lit(None).cast("string")
    t = tokens(F.col("p_name"), F.col("p_brand"), none, F.col("p_type"), none, F.col("p_size").cast("double"), F.lit("mg"), F.lit(None).cast("double"), none, F.lit(None).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(t), " ").alias("tokens"))


@query(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ',50'
  WHEN 1 THEN CAST(p_size AS VARCHAR) || '.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || ' RSD' WHEN 2 THEN CAST(p_size AS VARCHAR) || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.25'
  WHEN 3 THEN CAST(1000 + p_partkey AS VARCHAR) || '.312' ELSE CAST(p_partkey AS VARCHAR) END AS raw, p_size * 1000 + p_partkey % 1000 AS v FROM part)
SELECT p_partkey, raw, CAST(CASE p_partkey % 5 WHEN 0 THEN v + 1 WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN 1000 + p_partkey ELSE p_partkey END AS DOUBLE) AS price FROM p"""
)
def price_parse(spark, sf_dir):
    size, tail, m = F.col("p_size").cast("string"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0"), F.col("p_partkey") % 5
    raw = (
        F.when(m == 0, F.concat(size, F.lit("."), tail, F.lit(",50"))).when(m == 1, F.concat(size, F.lit("."), tail, F.lit(" RSD"))).when(m == 2, F.concat(size, F.lit(","), tail, F.lit(".25")))
        .when(m == 3, F.concat((F.col("p_partkey") + 1000).cast("string"), F.lit(".312"))).otherwise(F.col("p_partkey").cast("string"))
    )
    return read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), hygiene.parse_price(raw).alias("price"))


@query(
    """WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' | shop.rs' AS t FROM pages)
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(t, ' \\| shop\\.rs$', ''), '&amp;', '&', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '\\s+', ' ', 'g'))
AS title FROM t"""
)
def title_clean(spark, sf_dir):
    raw = F.concat(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(" | shop.rs"))
    return read(spark, sf_dir, "pages").select("page_id", hygiene.clean_title(raw).alias("title"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INTEGER) > 50")
def json_exists(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("_p", F.array(F.from_json("props", "k int")))
    return e.filter(F.exists("_p", lambda p: p["k"] > 50)).select("event_id", F.get(F.col("_p"), F.lit(0))["k"].alias("k"))


@query(
    """WITH p AS (SELECT c_custkey AS id, c_nationkey AS nation, 42 + c_custkey % 400 / 100.0 AS lat, 19 + c_custkey % 370 / 100.0 AS lon FROM customer),
d AS (SELECT *, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(44.8 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(44.8)) * pow(sin(radians(20.5 - lon) / 2), 2)))) AS m FROM p)
SELECT nation, id, CAST(round(m) AS BIGINT) AS metres FROM d QUALIFY row_number() OVER (PARTITION BY nation ORDER BY round(m), id) = 1"""
)
def haversine_nearest(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), (42 + F.col("c_custkey") % 400 / 100.0).alias("latitude"), (19 + F.col("c_custkey") % 370 / 100.0).alias("longitude")
    )
    m = p.withColumn("metres", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.lit(44.8), F.lit(20.5))).cast("long"))
    return merge.latest(m, ["nation"], ["metres", "id"]).select("nation", "id", "metres")


@query("SELECT n_name AS city, count(*) AS places FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def city_rollup(spark, sf_dir):
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return places.cities(c.withColumn("locality", F.concat(F.lit(" "), "n_name")))


@query("SELECT count(*) AS total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS processed, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 100.0 / count(*) AS rate FROM orders")
def processing_stats(spark, sf_dir):
    return audit.processing_rate(read(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F")


_FILLED = {"text": "text", "lang": "lang", "long": "CASE WHEN n_chars > 1000 THEN 1 END"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"column\", count({c}) AS filled, round(count({c}) * 100.0 / count(*), 2) AS percent FROM documents" for n, c in _FILLED.items()))
def completeness(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("text", "lang", F.when(F.col("n_chars") > 1000, 1).alias("long"))
    return audit.completeness(d, ["text", "lang", "long"])


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 2) AS percent FROM orders GROUP BY 1")
def category_distribution(spark, sf_dir):
    return audit.distribution(read(spark, sf_dir, "orders"), "o_orderpriority")


@query(
    f"""WITH {OFFERS} SELECT id, round(percent_rank() OVER (PARTITION BY core ORDER BY price), 9) AS percentile, price = min(price) OVER (PARTITION BY core) AS is_best_deal,
price = max(price) OVER (PARTITION BY core) AS is_worst_deal, round(max(price) OVER (PARTITION BY core) - min(price) OVER (PARTITION BY core), 2) AS price_spread FROM offers"""
)
def offer_price_analysis(spark, sf_dir):
    found = grouping.price_position(offers(spark, sf_dir), "core")
    return found.select("id", F.round("percentile", 9).alias("percentile"), "is_best_deal", "is_worst_deal", F.round("price_spread", 2).alias("price_spread"))


@query(
    f"""WITH {GROUPS} SELECT count(*) AS groups, round(avg(product_count), 6) AS avg_products, round(avg(vendor_count), 6) AS avg_vendors, count(*) FILTER (WHERE vendor_count > 1) AS multi_vendor,
round(count(*) FILTER (WHERE vendor_count > 1) * 100.0 / count(*), 6) AS multi_vendor_percent FROM groups"""
)
def grouping_statistics(spark, sf_dir):
    s = catalog.grouping_statistics(groups(spark, sf_dir))
    return s.select("groups", *[F.round(c, 6).alias(c) for c in ("avg_products", "avg_vendors")], "multi_vendor", F.round("multi_vendor_percent", 6).alias("multi_vendor_percent"))


@query(f"WITH {GROUPS} SELECT group_key, CAST(round((max_price - min_price) / max_price * 100) AS INTEGER) AS savings_percent FROM groups")
def savings(spark, sf_dir):
    return catalog.savings(groups(spark, sf_dir)).select("group_key", F.col("savings_percent").cast("int").alias("savings_percent"))


@query(
    """SELECT 'prod::' || p_name AS group_key, count(*) AS products, count(DISTINCT p_type) AS vendors, count(DISTINCT p_brand) AS brands, array_to_string(list_sort(list(DISTINCT p_name || ' ' || p_type))[1:4], ',') AS samples
FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) >= 2"""
)
def over_merge_suspects(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(
        F.concat(F.lit("prod::"), "p_name").alias("group_key"), F.lit("brand-line").alias("group_method"), F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.col("p_type").alias("vendor_id"), F.col("p_brand").alias("brand"),
    )
    return audit.over_merged(audit.group_audit(p)).drop("group_method").withColumn("samples", F.array_join("samples", ","))


@query("SELECT 'region' AS \"table\", count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark, sf_dir):
    return audit.counts(**{n: read(spark, sf_dir, n) for n in ("region", "nation", "part", "lineitem")})


@query("SELECT p_partkey, host FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'shop.rs' WHEN 1 THEN 'www.shop.rs' ELSE 'a.shop.rs' END AS h, CASE p_partkey % 3 WHEN 2 THEN 'a.shop.rs' ELSE 'shop.rs' END AS host FROM part)")
def host_extract(spark, sf_dir):
    m = F.col("p_partkey") % 3
    url = F.when(m == 0, F.concat(F.lit("https://shop.rs/p/"), "p_partkey")).when(m == 1, F.concat(F.lit("www.shop.rs/p/"), "p_partkey")).otherwise("http://A.shop.rs/x?y=1")
    return read(spark, sf_dir, "part").select("p_partkey", places.domain(url).alias("host"))


TITLES = [
    "VITAMIN D3 2000 I.U. KAPSULE A30", "Vitamin C 1.000 mg 20 kesica", "Solgar Vitamin D3 2500IU rastvor 59ml", "DETRICAL 2000 TABLETE A60", "Vitamin C 1000 30 tableta",
    "GUMEDIĆI SA VITAMINOM C A60", "Magnezijum + B6 30 tableta", "Eucerin Q10 krema 50 ml", "Centrum Silver 60 tableta", "Ultimate Nutrition Iso Sensation 910 g",
]


@query()
def extract_entities(spark, sf_dir):
    """Entities of part names that are put into titles of a shop."""
    from offerweave.functions.extract import with_entities

    forms = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("p_partkey") % len(TITLES) + 1).cast("int"))
    return with_entities(read(spark, sf_dir, "part").select("p_partkey", forms.alias("title")), D.Dictionaries.small())


@query()
def group_key_full(spark, sf_dir):
    """Group keys over extracted entities, with both folds."""
    rows = extract_entities(spark, sf_dir).select(F.col("p_partkey").cast("string").alias("id"), (F.col("p_partkey") % 7).cast("string").alias("vendor_id"), "*")
    keyed = grouping.group_offers(rows.withColumn("canonical_identity", F.lit("")), D.Dictionaries.small())
    return keyed.select("id", "title", "group_key", "group_display", "group_method")


@query(
    """WITH p AS (SELECT page_id, CAST(page_id AS VARCHAR) AS i, page_id % 5 AS kind, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS own FROM pages)
    SELECT url, CASE kind WHEN 0 THEN 'P ' || i WHEN 1 THEN 'M & ' || i WHEN 2 THEN 'I ' || i WHEN 3 THEN 'R ' || i
            ELSE trim(replace(replace(replace(own, '&amp;', '&'), '&quot;', '"'), '&amp;', '&')) END AS title,
        CAST(CASE kind WHEN 0 THEN page_id * 10 WHEN 1 THEN page_id + 1 WHEN 2 THEN page_id * 100 WHEN 3 THEN (page_id + 1) * 1000 ELSE 0 END AS DOUBLE) AS price,
        CASE kind WHEN 0 THEN 'vitamini' WHEN 1 THEN 'nega' ELSE '' END AS category, CASE kind WHEN 0 THEN 'p.jpg' WHEN 1 THEN 'm.jpg' WHEN 2 THEN 'i.jpg' ELSE '' END AS thumbnail
    FROM p"""
)
def jsonld_extract(spark, sf_dir):
    """Products of pages into which one of four kinds of markup is put, of every fifth page none:
    JSON-LD, meta tags, microdata, JSON-LD without a usable price beside one shown on the page."""
    from offerweave.sources.html import parse_products

    i = F.col("page_id").cast("string")
    markup = [
        F.format_string('<script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"P %s","category":"vitamini","image":"p.jpg","offers":[{"price":"%s"}]}]}</script>', i, (F.col("page_id") * 10).cast("string")),
        F.format_string(
            '<meta property="og:title" content="M &amp; %s"><meta content="%s.50" property="product:price:amount"><meta property="product:category" content="nega"><meta name="og:image" content="m.jpg">', i, i
        ),
        F.format_string('<h2 itemprop="name" class="x">I %s</h2><meta itemprop="price" content="%s00"><link itemprop="image" content="i.jpg">', i, i),
        F.format_string(
            '<script type="application/ld+json">{"@type":"Product","name":"R %s","offers":{"price":"7"}}</script><p class="price"><span><bdi>%s.000,00&nbsp;RSD</bdi></span></p>', i, (F.col("page_id") + 1).cast("string")
        ),
    ]
    block = F.get(F.array(*markup), (F.col("page_id") % 5).cast("int"))
    return parse_products(read(spark, sf_dir, "pages").select("url", F.concat(F.coalesce(block, F.lit("")), "html").alias("html")))


@query()
def grouped_search(spark, sf_dir):
    """A whole search: hits, keys, folds, groups, scores, first page."""
    d = D.Dictionaries()
    o = offers(spark, sf_dir).withColumns({"volume_value": F.lit(0.0), "volume_unit": F.lit("")})
    q = D.Query("red bolt", d)
    found = grouping.page(grouping.grouped(search.search(o, q), q, d)).drop("products", "first_rank")
    return found.withColumn("avg_price", F.round("avg_price", 4))


@query()
def quick_search(spark, sf_dir):
    return search.quick_search(_parts(spark, sf_dir), "red bolt")


@query(f"WITH {GROUPS} SELECT group_key, vendor_count, product_count, min_price FROM groups ORDER BY vendor_count DESC, product_count DESC, group_key LIMIT 10 OFFSET 20")
def page_offset(spark, sf_dir):
    order = [F.col("vendor_count").desc(), F.col("product_count").desc(), F.col("group_key")]
    return groups(spark, sf_dir).orderBy(*order).offset(20).limit(10).select("group_key", "vendor_count", "product_count", "min_price")


@query(
    """WITH a AS (SELECT c_custkey, c_nationkey AS nation, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer),
s AS (SELECT nation, segment, count(*) AS n FROM a GROUP BY 1, 2)
SELECT c_custkey, n FROM a JOIN s ON a.nation = s.nation AND a.segment IS NOT DISTINCT FROM s.segment"""
)
def null_safe_keys(spark, sf_dir):
    a = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))
    s = a.groupBy(F.col("nation").alias("_n"), F.col("segment").alias("_s")).agg(F.count(F.lit(1)).alias("n"))
    return a.join(s, (F.col("nation") == F.col("_n")) & filters.same(F.col("segment"), F.col("_s"))).select("c_custkey", "n")


@query(
    """WITH st AS (SELECT upper(p_name) AS original_title, p_name || ' ' || p_type AS title, p_brand AS brand, p_size / 100.0 AS confidence FROM part),
k AS (SELECT lower(trim(original_title)) AS key, 0 AS prio, * FROM st UNION ALL SELECT lower(trim(title)), 1, * FROM st),
b AS (SELECT key, brand FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY prio, confidence DESC, title, original_title, brand) = 1),
t AS (SELECT p_partkey, CASE WHEN p_size > 25 THEN ' ' || p_name ELSE p_name || ' ' || p_type END AS title FROM part)
SELECT p_partkey, b.brand IS NOT NULL AS found FROM t LEFT JOIN b ON b.key = lower(trim(t.title))"""
)
def standard_lookup(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    std = p.select(F.upper("p_name").alias("original_title"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.col("p_brand").alias("brand"), (F.col("p_size") / 100.0).alias("confidence"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"))
    rows = p.select("p_partkey", F.when(F.col("p_size") > 25, F.concat(F.lit(" "), "p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type")).alias("title"))
    return merge.standardize(rows, std, ["brand"]).select("p_partkey", F.col("std_brand").isNotNull().alias("found"))


@query("SELECT o_custkey AS k, 'order' AS origin FROM (SELECT DISTINCT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)) UNION ALL SELECT c_custkey, 'customer' FROM customer WHERE c_acctbal > 0")
def insert_absent(spark, sf_dir):
    old = read(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    fresh = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit("order").alias("origin")).distinct()
    return merge.insert_absent(old, fresh, ["k"])


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 5000 THEN s_name ELSE n_name END AS phone FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def fill_blank(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).otherwise("").alias("phone"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("phone"))
    return merge.fill_blank(s, n, "nation", ["phone"]).select("s_suppkey", "phone")


@query("SELECT c_nationkey AS vendor_id, c_custkey AS id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name, c_custkey) = 1")
def best_place(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("vendor_id"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("rating"), F.lit(None).cast("double").alias("popularity"), F.col("c_name").alias("name"))
    return places.best_place(c).select("vendor_id", "id")


@query(
    """SELECT event_id, round(coalesce((value - min(value) OVER (PARTITION BY user_id)) / nullif(max(value) OVER (PARTITION BY user_id) - min(value) OVER (PARTITION BY user_id), 0), 0), 6) AS scaled FROM events"""
)
def price_scaled(spark, sf_dir):
    return catalog.scaled(read(spark, sf_dir, "events"), "user_id", "value").select("event_id", F.round("scaled", 6).alias("scaled"))


@query(
    """WITH a AS (SELECT l_partkey AS group_key, min(l_extendedprice) AS old_price FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY 1),
b AS (SELECT l_partkey AS group_key, min(l_extendedprice) AS min_price FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT group_key, min_price, old_price, round((old_price - min_price) / old_price * 100) AS drop_percent FROM a JOIN b USING (group_key) WHERE min_price < old_price"""
)
def price_drops(spark, sf_dir):
    line, at = read(spark, sf_dir, "lineitem"), F.lit("1998-01-01").cast("timestamp_ntz")
    least = lambda rows: rows.groupBy(F.col("l_partkey").alias("group_key")).agg(F.min("l_extendedprice").alias("min_price"))
    return catalog.drops(least(line.filter(F.col("l_shipdate") >= at)), least(line.filter(F.col("l_shipdate") < at)))


@query("SELECT printf('%.6f,%.6f', 42 + c_nationkey / 10.0, 19 + c_nationkey / 10.0) AS spot, count(*) AS places FROM customer GROUP BY 1")
def colocated_places(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select((42 + F.col("c_nationkey") / 10.0).alias("latitude"), (19 + F.col("c_nationkey") / 10.0).alias("longitude"))
    return places.colocated(c)


@query(
    """WITH v AS (SELECT DISTINCT p_brand AS vendor_id, lower(replace(p_brand, '#', ' ')) AS v FROM part), p AS (SELECT p_partkey AS place_id, lower(replace(p_name || ' ' || p_brand, '#', ' ')) AS p FROM part)
SELECT vendor_id, place_id FROM v JOIN p ON contains(p, v) OR list_has_all(string_split(p, ' '), string_split(v, ' '))"""
)
def vendor_place_match(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    v = part.select(F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("website")).distinct()
    p = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), F.lit("").alias("website"))
    return places.match_vendors(v, p)


#: A dictionary whose phrases are part names and words of them.
PART_WORDS = D.Dictionaries.of(
    [("alpha", "supplement", ["red bolt", "blue"]), ("beta", "otc", ["bolt"]), ("gamma", "cosmetic", ["red", "small gear"]), ("delta", "supplement", ["small"])],
    {"known": ["red bolt", "bolt", "small gear", "gear", "small"], "strip": ["hot"], "cosmetic": ["large"]},
    {"noise": ["new"], "forms": ["rod"]},
)


@query(
    """WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS w FROM part),
f AS (SELECT p_partkey, CASE WHEN p_name = 'red bolt' THEN ['alpha'] WHEN p_name = 'small gear' THEN ['gamma'] ELSE list_concat(
  CASE WHEN w[1] = 'red' THEN ['gamma'] WHEN w[1] = 'small' THEN ['delta'] WHEN w[1] = 'blue' THEN ['alpha'] ELSE [] END, CASE WHEN w[2] = 'bolt' THEN ['beta'] ELSE [] END) END AS found FROM w)
SELECT p_partkey, array_to_string(list_sort(found), ' ') AS found FROM f"""
)
def ingredient_detect(spark, sf_dir):
    found = D.ingredients(T.normalize_key(F.col("p_name")), PART_WORDS)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(found, " ").alias("found"))


@query(
    """SELECT p_partkey, CASE WHEN p_name IN ('red bolt', 'small gear') THEN p_name WHEN starts_with(p_name, 'small ') THEN 'small' WHEN ends_with(p_name, ' bolt') THEN 'bolt'
WHEN ends_with(p_name, ' gear') THEN 'gear' END AS brand FROM part"""
)
def brand_detect(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", D.detect_brand(T.normalize_identity(F.col("p_name")), PART_WORDS).alias("brand"))


@query(
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'Oral Care' WHEN p_name IN ('red bolt') OR (starts_with(p_name, 'blue')) OR (starts_with(p_name, 'small') AND p_name <> 'small gear') THEN 'Supplements & Vitamins'
WHEN ends_with(p_name, ' bolt') THEN 'OTC Medicines' WHEN starts_with(p_name, 'large') THEN 'Cosmetics & Skincare' WHEN p_type = 'LARGE' THEN 'OTC Medicines' END AS category FROM part WHERE p_type <> 'ECONOMY'
UNION ALL SELECT p_partkey, NULL FROM part WHERE p_type = 'ECONOMY'"""
)
def category_assign(spark, sf_dir):
    from offerweave.operators.categories import with_category

    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_name").alias("core"), F.col("p_type").alias("category"), F.split("p_name", " ")[0].alias("brand"), F.lit("").alias("form"))
    mapping = spark.sql("SELECT * FROM VALUES ('PROMO', 'Oral Care'), ('LARGE', 'OTC Medicines') AS m(raw, canonical)")
    return with_category(p, PART_WORDS, mapping, ["ECONOMY"]).select("p_partkey", F.col("canonical_category").alias("category"))


@query(
    """SELECT p_partkey, CASE WHEN p_size > 20 AND p_name = 'red bolt' THEN 'Line Red' WHEN p_size > 20 AND p_name = 'small gear' THEN 'Line Small' END AS identity FROM part"""
)
def canonical_identity(spark, sf_dir):
    from offerweave.operators.categories import with_canonical_identity

    p = read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("title"), F.initcap("p_name").alias("core"), F.when(F.col("p_size") > 20, F.lit(1.0)).alias("volume_value"), F.lit(0.0).alias("dosage_value"))
    by_core = spark.sql("SELECT * FROM VALUES ('red bolt', 'Line Red'), ('small gear', 'Line Small') AS m(key, identity)")
    return with_canonical_identity(p, by_core, by_core.limit(0)).select("p_partkey", F.col("canonical_identity").alias("identity"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CAST(date_diff('day', CAST(ts AS DATE), DATE '2024-02-05') AS INTEGER) AS days FROM events")
def time_format(spark, sf_dir):
    from offerweave.functions.dates import rfc3339

    return read(spark, sf_dir, "events").select("event_id", rfc3339(F.col("ts")).alias("at"), F.datediff(F.lit("2024-02-05").cast("date"), "ts").alias("days"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, replace(format('{:,}', CAST(floor(l_extendedprice + 0.5) AS BIGINT)), ',', '.') AS price FROM lineitem")
def price_format(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", hygiene.format_price(F.col("l_extendedprice")).alias("price"))


@query("SELECT c_custkey, sha256(lower(trim(c_name))) AS email_key FROM customer")
def email_key(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", filters.email_key(F.concat(F.lit(" "), F.upper("c_name"))).alias("email_key"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01' AND o_orderstatus <> 'F'")
def valid_rows(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("used", F.when(F.col("o_orderstatus") == "F", 1))
    return filters.valid(o, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), "used").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice > 1 AND length(trim(p_name)) >= 3 AND NOT starts_with(p_type, 'PROMO')")
def product_validity(spark, sf_dir):
    title = F.when(F.col("p_type") == "PROMO", "Placeholder").otherwise(F.col("p_name"))
    return read(spark, sf_dir, "part").filter(hygiene.is_product(title, F.col("p_retailprice"))).select("p_partkey")


@query(
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS link FROM pages) SELECT DISTINCT 'https://x.rs' || link AS link FROM l WHERE starts_with(link, '/A')"""
)
def sitemap_links(spark, sf_dir):
    """Links of a page put into a sitemap, read back and chosen by a pattern."""
    from offerweave.sources.html import product_links
    from offerweave.sources.html import sitemap_links as parse

    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    body = F.concat(F.lit("<urlset>"), F.array_join(F.transform(hrefs, lambda h: F.concat(F.lit("<url><loc>https://x.rs"), F.replace(h, F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))), ""), F.lit("</urlset>"))
    return product_links(parse(read(spark, sf_dir, "pages").select("url", body.alias("body"))), include=r"^https://x\.rs/A")


@query("SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'vitamin c' WHEN 'blue' THEN 'iron' ELSE split_part(p_name, ' ', 1) END AS expanded FROM part")
def expand_abbreviations(spark, sf_dir):
    first = F.split("p_name", " ")[0]
    short = F.when(first == "red", " VitC ").when(first == "blue", "FE").otherwise(first)
    return read(spark, sf_dir, "part").select("p_partkey", search.expand_abbreviation(short).alias("expanded"))


@query(
    """WITH k AS (SELECT 'core::' || split_part(p_name, ' ', 1) AS group_key, p_name || ' ' || p_size || 'mg rod' AS title, nullif(split_part(p_name, ' ', 2), 'rod') AS sign FROM part)
SELECT group_key, count(*) AS products, count(DISTINCT sign) AS signs FROM k GROUP BY 1 HAVING count(*) >= 4 AND count(DISTINCT sign) >= 2"""
)
def catch_all_groups(spark, sf_dir):
    """Groups by a part's first word: titles differ in the second, packs and forms don't count."""
    first = F.split("p_name", " ")[0]
    k = read(spark, sf_dir, "part").select(
        F.concat(F.lit("core::"), first).alias("group_key"), F.lit("brand-core").alias("group_method"), F.initcap(first).alias("group_display"), first.alias("brand"),
        F.concat("p_name", F.lit(" "), "p_size", F.lit("mg ROD")).alias("title"),
    )
    d = D.Dictionaries.of([], {}, {"forms": ["rod"]})
    return audit.catch_alls(k, d).select("group_key", "products", "signs")


@query(
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_name ELSE upper(p_type[1:1]) || lower(p_type[2:]) || ' ' || p_name || CASE WHEN p_size > 25 THEN ' ' || p_size || ' MG' ELSE '' END ||
CASE WHEN p_size % 2 = 0 THEN ' ' || p_size || ' tablete' ELSE ' tablete' END END AS title FROM part"""
)
def standardized_title(spark, sf_dir):
    from offerweave.functions.extract import standardized_title as title

    none, size = F.lit(None).cast("string"), F.col("p_size").cast("double")
    t = title(
        F.when(F.col("p_type") == "PROMO", F.col("p_name")), F.lower("p_type"), F.col("p_name"), none, F.when(F.col("p_size") > 25, size), F.lit("mg"), F.lit(None).cast("double"), none,
        F.lit("tab"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")),
    )
    return read(spark, sf_dir, "part").select("p_partkey", t.alias("title"))
