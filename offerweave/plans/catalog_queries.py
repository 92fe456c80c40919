"""More of the engine's queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import extract, hygiene
from offerweave.functions import measures as M
from offerweave.functions import text as T
from offerweave.operators import audit, catalog, filters, grouping, merge, places
from offerweave.plans import service
from offerweave.plans.queries import _CATALOG, _FROM, _LETTERS, _TO, OFFERS, SQL, TITLES, _halves, _similarity, offers, query, read
from offerweave.sources import maps


def _values(rows, columns: str) -> str:
    """A table of fixed cases in SQL."""
    one = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS c({columns})"


def _cycle(column, values):
    """The values in turn, by the number in ``column``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(column) % len(values) + 1).cast("int"))


#: Fixed cases: what each of TITLES holds: dose, unit, size, unit, form, count, unit, brand, core, name.
ENTITIES = [
    (2000.0, "iu", None, None, "kapsule", 30, "kom", None, "Vitamin D3", "Vitamin D3 2000 IU kapsule"),
    (1000.0, "mg", None, None, "kesice", 20, "kesica", None, "Vitamin C", "Vitamin C 1000 MG kesice"),
    (2500.0, "iu", 59.0, "ml", "rastvor", None, None, "Solgar", "Vitamin D3 Rastvor", "Solgar Vitamin D3 Rastvor 2500 IU rastvor"),
    (2000.0, "iu", None, None, "tablete", 60, "kom", None, "Vitamin D3", "Vitamin D3 2000 IU tablete"),
    (1000.0, "mg", None, None, "tablete", 30, "tableta", None, "Vitamin C", "Vitamin C 1000 MG tablete"),
    (None, None, None, None, "bombone", 60, "kom", "Gumedici", "Vitamin C", "Gumedici Vitamin C bombone"),
    (None, None, None, None, "tablete", 30, "tableta", None, "Magnezijum Vitamin B6", "Magnezijum Vitamin B6 tablete"),
    (None, None, 50.0, "ml", "krema", None, None, "Eucerin", "Koenzim Q10", "Eucerin Koenzim Q10 krema"),
    (None, None, None, None, "tablete", 60, "tableta", "Centrum", "Centrum Silver", "Centrum Centrum Silver tablete"),
    (None, None, 910.0, "g", None, None, None, "Ultimate Nutrition", "Ultimate Nutrition Iso Sensation", "Ultimate Nutrition Ultimate Nutrition Iso Sensation"),
]
#: Fixed cases: the group of each of TITLES: key, name, method.
KEYS = [
    ("ing:vitamin d3::2000iu::form:kapsule", "Vitamin D3 2000 IU kapsule", "ingredient"),
    ("ing:vitamin c::1000mg::form:kesice", "Vitamin C 1000 MG kesice", "ingredient"),
    ("ing:vitamin d3::2500iu::form:rastvor", "Vitamin D3 2500 IU rastvor", "ingredient"),
    ("ing:vitamin d3::2000iu::form:tablete", "Vitamin D3 2000 IU tablete", "ingredient"),
    ("ing:vitamin c::1000mg::form:tablete", "Vitamin C 1000 MG tablete", "ingredient"),
    ("ing:vitamin c::form:bombone", "Vitamin C bombone", "ingredient"),
    ("ing:magnezijum+vitamin b6::form:tablete", "Magnezijum + Vitamin B6 tablete", "ingredient"),
    ("sku::eucerin::koenzim::50ml::form:krema", "Eucerin Koenzim 50 ML krema", "brand-sku"),
    ("core::centrum silver::form:tablete", "Centrum Silver Tablete", "brand-core"),
    ("prod::iso sensation::1000g", "Ultimate Nutrition Iso Sensation 910 G", "brand-line"),
]
_numbered = lambda rows: [(i, t, *r) for i, (t, r) in enumerate(zip(TITLES, rows, strict=True))]

SQL["extract_entities"] = f"""SELECT p_partkey, title, CAST(dv AS DOUBLE) AS dosage_value, CAST(du AS VARCHAR) AS dosage_unit, CAST(vv AS DOUBLE) AS volume_value, CAST(vu AS VARCHAR) AS volume_unit,
form, CAST(qv AS INTEGER) AS quantity_value, qu AS quantity_unit, brand, core, normalized_name
FROM part JOIN {_values(_numbered(ENTITIES), "i, title, dv, du, vv, vu, form, qv, qu, brand, core, normalized_name")} ON p_partkey % {len(TITLES)} = i"""

SQL["group_key_full"] = f"""SELECT CAST(p_partkey AS VARCHAR) AS id, title, group_key, group_display, group_method
FROM part JOIN {_values(_numbered(KEYS), "i, title, group_key, group_display, group_method")} ON p_partkey % {len(TITLES)} = i"""

SQL["quick_search"] = f"""WITH {_CATALOG}, s AS (SELECT *, {_similarity("title", "'red bolt'")} AS sim FROM parts)
SELECT id, title, price, vendor_name AS vendor_id, vendor_name, brand, CAST(CASE WHEN title = 'red bolt' THEN 5000 WHEN starts_with(title, 'red bolt') THEN 4500 WHEN sim > 0.3 THEN round(3000 + sim * 1000)
  WHEN contains(title, 'red bolt') THEN 3500 WHEN contains(lower(normalized_name), 'red bolt') THEN 1500 ELSE 100 END AS INTEGER) AS relevance_score
FROM s WHERE sim > 0.2 OR contains(title, 'red bolt') OR contains(lower(normalized_name), 'red bolt') ORDER BY relevance_score DESC, price, id LIMIT 100"""

#: Keys of two-word names without dictionaries: a distinctive name with its form.
KEYED = (
    OFFERS
    + """,
keyed AS (SELECT *, 'core::' || lower(core) || '::form:' || lower(category) AS group_key,
  array_to_string(list_transform(string_split(lower(core || ' ' || category), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS group_display FROM offers WHERE price > 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY group_key, vendor_id ORDER BY price, id) AS place FROM keyed)"""
)

SQL["grouped_search"] = f"""WITH {KEYED}
SELECT group_key, count(DISTINCT vendor_id) AS vendor_count, count(*) AS product_count, count(*) - count(DISTINCT vendor_id) AS hidden_offers, min(price) FILTER (WHERE place = 1) AS min_price,
  max(price) FILTER (WHERE place = 1) AS max_price, round(avg(price) FILTER (WHERE place = 1), 4) AS avg_price, any_value(group_display) AS name, 1310 AS match_score
FROM firsts WHERE core = 'red bolt' GROUP BY group_key"""


def _keyed(spark, sf_dir):
    return offers(spark, sf_dir).withColumns({"volume_value": F.lit(0.0), "volume_unit": F.lit("")})


@query(f"WITH {KEYED} SELECT group_key, min(price) AS min_price, arg_min(vendor_name, (price, vendor_name, id)) AS vendor, count(*) AS offer_count FROM keyed GROUP BY group_key")
def catalog_snapshot_keys(spark, sf_dir):
    """The snapshot over the keys that search gives."""
    return catalog.catalog_snapshot(_keyed(spark, sf_dir), D.Dictionaries())


@query(
    f"""WITH {KEYED}, best AS (SELECT core, quantity, category, count(DISTINCT vendor_id) AS v, count(*) AS n FROM keyed GROUP BY 1, 2, 3 HAVING v > 1 AND n < 100 AND n // v < 5 ORDER BY v DESC, core, quantity, category LIMIT 20),
top AS (SELECT keyed.*, row_number() OVER (PARTITION BY core, quantity, category ORDER BY price, id) AS nth FROM keyed JOIN best USING (core, quantity, category)),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY group_key, vendor_id ORDER BY price, id) AS first, count(*) OVER (PARTITION BY group_key) AS all_ FROM top WHERE nth <= 10)
SELECT group_key, min(group_display) AS name, count(*) AS vendor_count, max(all_) AS product_count, min(price) AS min_price, max(price) AS max_price FROM rows_ WHERE first = 1
GROUP BY group_key ORDER BY vendor_count DESC, group_key LIMIT 20"""
)
def featured_by_key(spark, sf_dir):
    """Featured groups regrouped by key, figures over the offers shown."""
    return catalog.featured(_keyed(spark, sf_dir), D.Dictionaries()).drop("avg_price", "products")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey > 50 ORDER BY p_partkey LIMIT 100")
def page_after_key(spark, sf_dir):
    return audit.page_after(read(spark, sf_dir, "part").select("p_partkey", "p_name"), 50, 100, "p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_size % 3 = 0 OR p_type = 'PROMO') AND length(p_name) > 8")
def needs_processing(spark, sf_dir):
    p = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("core"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("form"))
    return audit.needs_processing(p.filter(F.length("title") > 8), ["core", "form"]).select("p_partkey")


@query("SELECT p_brand AS source, count(*) AS n, count(DISTINCT p_type) AS categories FROM part GROUP BY 1")
def standardization_profile(spark, sf_dir):
    return audit.profile(read(spark, sf_dir, "part").withColumnRenamed("p_brand", "source"), "source", "p_type")


@query("SELECT o_orderstatus AS status, count(*) AS runs, CAST(sum(o_custkey) AS BIGINT) AS products, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 2) AS percent FROM orders GROUP BY 1")
def run_statistics(spark, sf_dir):
    return audit.run_statistics(read(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "status", "o_custkey")


@query(
    """SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS watch_id, CASE WHEN user_id % 2 = 0 THEN 'watch ' || user_id ELSE '' END AS display_name,
CASE WHEN user_id % 2 = 0 THEN 'key ' || user_id ELSE '' END AS group_key FROM events WHERE event_type = 'click'"""
)
def alerts_left_watch(spark, sf_dir):
    """A user's alerts with their watches; those of watches that are gone have blank names."""
    e = read(spark, sf_dir, "events")
    alerts = e.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("watch_id"), F.col("event_type").alias("user_id"), F.col("ts").alias("sent_at"))
    users = e.select("user_id").distinct().filter("user_id % 2 = 0").withColumn("id", F.col("user_id").cast("string"))
    watches = users.select("id", F.concat(F.lit("watch "), "id").alias("display_name"), F.concat(F.lit("key "), "id").alias("group_key"))
    return service.alerts_of(alerts, watches, "click").select("id", "watch_id", "display_name", "group_key")


@query("SELECT event_id, c_name FROM events JOIN customer ON user_id = c_custkey WHERE ts > TIMESTAMP '2024-01-20 00:00:00'")
def session_users(spark, sf_dir):
    """Unexpired sessions with their users."""
    e = filters.valid(read(spark, sf_dir, "events"), "ts", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return e.join(read(spark, sf_dir, "customer"), F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank FROM part WHERE p_type = 'PROMO'")
def ordinal_rank(spark, sf_dir):
    p = read(spark, sf_dir, "part").filter("p_type = 'PROMO'")
    return grouping.with_rank(p, F.col("p_retailprice").desc(), F.col("p_partkey").asc()).select("p_partkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 37")
def hit_limit(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", "p_retailprice").orderBy("p_retailprice", "p_partkey").limit(37)


_BASE = "translate({}, '" + "".join(T.ACCENTED.values()) + "', '" + "".join(k * len(v) for k, v in T.ACCENTED.items()) + "')"


@query(f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({_BASE.format(f'translate({_LETTERS}, {chr(39)}{_FROM}{chr(39)}, {chr(39)}{_TO}{chr(39)})')}, '\\p{{M}}+', '', 'g'), '[^0-9a-z]+', ' ', 'g'))) AS normalized FROM documents")
def normalize_identity_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_identity(F.col("text")), 256).alias("normalized"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(translate(replace(lower(coalesce(text, '')), 'đ', 'dj'), '{T.LATIN_SINGLE[0]}', '{T.LATIN_SINGLE[1]}'), '[^0-9a-z]+', ' ', 'g'))) AS normalized FROM documents")
def normalize_place_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_place(F.col("text")), 256).alias("normalized"))


@query(f"SELECT doc_id, sha256(regexp_replace({_BASE.format('lower(text)')}, '\\p{{M}}+', '', 'g')) AS folded FROM documents WHERE text IS NOT NULL")
def fold_accents_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2(T.fold_accents(F.lower("text")), 256).alias("folded"))


#: Fixed cases: numbers as titles write them.
NUMBERS = [("1.234,5", 1234.5), ("2,5", 2.5), ("12", 12.0), ("0.75", 0.75), ("1.000,00", 1000.0)]


@query(f"SELECT p_partkey, raw, CAST(number AS DOUBLE) AS number FROM part JOIN {_values([(i, *r) for i, r in enumerate(NUMBERS)], 'i, raw, number')} ON p_partkey % {len(NUMBERS)} = i")
def parse_numbers(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_partkey", _cycle("p_partkey", [r for r, _ in NUMBERS]).alias("raw"))
    return rows.withColumn("number", extract.parse_number(F.col("raw")))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN p_size > 5 ELSE false END AS is_size FROM part")
def reconcile_dose(spark, sf_dir):
    """Stored doses that are sizes: litres, millilitres, more than 5 g."""
    p = read(spark, sf_dir, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("ml", "l", "g", "mg")]), (F.col("p_size") % 4 + 1).cast("int"))
    return p.select("p_partkey", extract.reconcile(F.col("p_size").cast("double"), unit)[0].alias("is_size"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END AS shown, p_size || ' MG' AS measure FROM part WHERE p_size > 0")
def display_formats(spark, sf_dir):
    p = read(spark, sf_dir, "part").filter("p_size > 0")
    return p.select("p_partkey", M.quantity_facet(F.col("p_size") / 2).alias("shown"), M.measure_display(F.col("p_size").cast("double"), F.lit("mg")).alias("measure"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand || ', ' || p_type WHEN p_size % 3 = 1 THEN p_type ELSE p_brand END AS address FROM part")
def address_parts(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    one, two = F.when(F.col("p_size") % 3 != 1, F.concat(F.lit(" "), "p_brand")), F.when(F.col("p_size") % 3 != 2, F.col("p_type")).otherwise(" ")
    return p.select("p_partkey", maps.full_address(one, two).alias("address"))


@query("SELECT p_partkey, upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS shown FROM part")
def humanized_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", maps.humanized(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("shown"))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 1")
def resolvable_links(spark, sf_dir):
    """Links; every third has a second host and goes."""
    link = F.when(F.col("page_id") % 3 == 0, F.lit(None)).when(F.col("page_id") % 3 == 1, F.lit("https://shop.rs/https://other.rs/p")).otherwise("https://shop.rs/p/one")
    return read(spark, sf_dir, "pages").filter(hygiene.is_resolvable(link)).select("page_id")


@query("SELECT p_partkey FROM part WHERE p_size % 4 = 0 OR p_size % 4 = 1")
def place_admissible(spark, sf_dir):
    """Places by category name, by the vendor's name, by neither."""
    names = F.when(F.col("p_size") % 4 == 0, F.lit("Pharmacy")).otherwise("Bakery")
    categories = F.array(F.struct(F.lit("x").alias("fsq_category_id"), F.lit("y").alias("id"), names.alias("name")))
    name = F.when(F.col("p_size") % 4 == 1, F.lit("Apoteka Centar")).otherwise("Pekara Centar")
    return read(spark, sf_dir, "part").filter(places.relevant(categories, name, F.lit("Centar"))).select("p_partkey")


@query(
    """WITH v AS (SELECT o_orderkey, o_custkey, o_orderstatus AS status, CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS price, o_orderpriority AS note, o_orderdate FROM orders),
o AS (SELECT * FROM v WHERE o_orderdate < TIMESTAMP '1999-01-01'), n AS (SELECT o_orderkey, o_custkey, price * 2 AS price FROM v WHERE o_orderdate >= TIMESTAMP '1999-01-01' OR note = '1-URGENT')
SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.o_custkey, n.o_custkey) AS o_custkey, o.status AS status, CASE WHEN n.o_orderkey IS NULL THEN o.price ELSE n.price END AS price, o.note AS note
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey"""
)
def upsert_overwrite(spark, sf_dir):
    """Fresh values replace old ones even where they are null."""
    old, fresh = _halves(spark, sf_dir)
    return merge.upsert(old, fresh.drop("status"), ["o_orderkey"], overwrite=["price"])
