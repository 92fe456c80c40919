from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.operators import filters, places
from offerweave.plans import service
from offerweave.plans.cache import ResultCache, filter_key
from offerweave.sources import maps
from tests.test_groups import frame

SMALL = D.Dictionaries.small()


class Clock:
    now = 0.0

    def __call__(self):
        return self.now


def test_cache():
    clock = Clock()
    c = ResultCache(10, 5, weigh=lambda v: v, clock=clock)
    c.put("a", 4), c.put("b", 4)
    assert c.get("a") == 4 and c.get("x") is None
    c.put("c", 4)  # b is the least recently used
    assert c.get("b") is None and c.get("a") == 4 and c.held == 8
    c.put("a", 1)
    assert c.held == 5
    c.put("big", 50)  # the newest entry stays, whatever its weight
    assert len(c) == 1 and c.get("big") == 50
    clock.now = 6
    assert c.get("big") is None and c.held == 0 and (c.hits, c.misses) == (3, 3)
    c.put("d", 1)
    clock.now = 20
    c.sweep()
    assert len(c) == 0
    off = ResultCache(10, 0)
    off.put("a", 1)
    assert off.get("a") is None
    assert filter_key("q", [" B", "a"], ["C "]) == filter_key("q", ["A", "b", ""], ["c"])


def test_cache_from_many_threads():
    c = ResultCache(20, 60)
    with ThreadPoolExecutor(50) as pool:
        list(pool.map(lambda i: (c.put(i % 30, i), c.get(i % 7)), range(2_000)))
    assert len(c) == c.held <= 20


def shop(spark):
    v = lambda n, b, p, **x: dict(core="vitamin c", title=n, normalized_name=n, brand=b, price=p, category="Supplements", search_tokens=["vitaminc"], **x)
    rows = [v("Vitamin C 500", "Now", 100.0, form="tablete"), v("Vitamin C 500", "Solgar", 90.0, form="tablete"), v("Vitamin C kesice", "Now", 70.0, form="kesice"), v("Vitamin C free", "Now", 0.0)]
    return service.Catalog(frame(spark, *rows, dict(core="centrum silver", title="Centrum Silver", brand="Centrum", category="Other", search_tokens=["centrum"])), SMALL)


def test_groups_and_pages(spark):
    c = shop(spark)
    page = c.search_groups("vitamin c")
    assert (page.total_groups, page.total_products) == (2, 3) and page.groups[0]["vendor_count"] == 2 and page.facets["brand"] == {"Now": 2, "Solgar": 1}
    assert c.search_groups(" Vitamin  C") is page  # the same query
    far = c.search_groups("vitamin c", offset=9)
    assert far.groups == [] and far.total_groups == 2 and far.facets == page.facets
    only = c.search_groups("vitamin c", brands=["solgar"])
    assert only.total_groups == 1 and len(only.groups[0]["products"]) == 2 and only.facets == page.facets  # the group is kept whole
    assert c.search_groups("", categories=["Other"]).groups[0]["group_key"] == "core::centrum silver" and c.search_groups("").total_groups == 0
    hits, counts = c.search("vitamin c", brands=["NOW"])
    assert hits.count() == 2 and {r.value for r in counts.filter("facet = 'brand'").collect()} == {"Now", "Solgar"}
    assert c.compare("vitamin c").limit == 10 and service.clamp(0) == 24 and service.clamp(99) == 60
    assert [r["title"] for r in c.autocomplete("vitam", 2)] == ["Vitamin C 500", "Vitamin C kesice"] and c.autocomplete(" ") == []
    assert {r.value for r in c.facets().filter("facet = 'category'").collect()} == {"Supplements", "Other"} and c.featured().count() >= 0
    members = service.offers_of(c.groups("vitamin c")[0])
    assert members.count() == 3 and "price" in members.columns
    spark.catalog.clearCache()


def test_watches_of_a_user(spark):
    c = shop(spark)
    key = c.groups("centrum silver")[0].first().group_key
    w = spark.createDataFrame([("w", "u", key, "Centrum", 150.0, 200.0, "")], "id string, user_id string, group_key string, display_name string, target_price double, last_price double, last_vendor string")
    as_of = F.lit("2024-01-01").cast("timestamp")
    assert c.watch(w.limit(0), as_of) is None
    _, history, alerts = c.watch(w, as_of)
    assert alerts.count() == history.count() == 1
    got = service.alerts_of(alerts, w.limit(0), "u").first()
    assert got.display_name == "" and got.kind == "target" and service.alerts_of(alerts, w, "x").count() == 0
    spark.catalog.clearCache()


def test_directory(spark):
    vendors = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    products = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 0.0), ("c", 1.0)], "vendor_id string, price double")
    where = spark.createDataFrame([("a",)], "vendor_id string")
    assert [tuple(r) for r in service.vendor_directory(vendors, products, where).collect()] == [("a", "A", 2, 1), ("c", "C", 1, 0)]


def test_vendor_names(spark):
    v = spark.createDataFrame([("1", "Lilly Drogerija", "https://www.lilly.rs"), ("2", "dm", None), ("3", "Dr Max", ""), ("4", "Apoteka", None)], "id string, name string, website string")
    p = spark.createDataFrame([("a", "Lilly drogerija 5", ""), ("b", "X", "http://shop.lilly.rs/a"), ("c", "dm drogerie markt", None), ("d", "Dr. Max Beograd", ""), ("e", "Max", None), ("f", "lilly", None), ("g", "Apoteka", ""), ("h", "y", "http://evillilly.rs")], "id string, name string, website string")
    got = sorted(map(tuple, places.match_vendors(v, p).collect()))
    assert got == [("1", "a"), ("1", "b"), ("1", "f"), ("2", "c"), ("3", "d"), ("4", "g")]


def test_vendor_names_are_never_broadcast(spark):
    """A file's size says little of its names' rows: 1.2 million part names in 5 MB filled a driver of 1 GB."""
    from offerweave.plans import queries

    plan = queries.vendor_place_match(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_vendor_names_that_repeat(spark):
    """Rows of one name all match, as brute force has it; a name with a part that no other has matches none."""
    names = ["blue ring", "ring", "blue", "ring blue 1", "blue ring 12", "rin", "ng blu", "x", "", "blue ring 1 q", "shop"]
    rows = [(str(i), n, None) for i, n in enumerate(names * 2)]
    kind = "id string, name string, website string"
    got = sorted(map(tuple, places.match_vendors(spark.createDataFrame(rows, kind), spark.createDataFrame(rows, kind)).collect()))
    want = []
    for i, a, _ in rows:
        for j, b, _ in rows:
            told = [w for w in a.split() if w not in places.GENERIC_WORDS]
            inside = len(b) >= 4 and b not in places.GENERIC_NAMES and b in a
            if len(a) >= 3 and a in b or inside or told and set(told) <= set(b.split()):
                want.append((i, j))
    assert got == sorted(want)


def test_more_places(spark):
    p = spark.createDataFrame([("1", "v", "osm", "s", "Benu Čukarica", "Ulica 1", "Beograd", 44.8, 20.4), ("2", "v", "osm", "t", "Lilly", "", "Niš", 44.8, 20.4), ("3", "v", "osm", "u", "x", "", "", 0.0, 0.0)], "id string, vendor_id string, source string, source_id string, name string, address string, locality string, latitude double, longitude double")
    assert [r.id for r in places.search_text(p, "cukarica BENU").collect()] == ["1"] and places.search_text(p, " ").count() == 3
    assert [tuple(r) for r in places.colocated(p).collect()] == [("44.800000,20.400000", 2)]
    assert places.prune(p, p.filter("id = '2'")).count() == 1
    t = lambda d, h, m: dict(date=d, hour=h, minute=m)
    import json

    h = json.dumps({"mode": "m", "timeRanges": [dict(startTime=t("2024-01-01", 8, 0), endTime=t("2024-01-01", 20, 5)), dict(startTime=t("2024-01-06", 9, 0), endTime=t("2024-01-07", 1, 0)), dict(startTime=t("", 25, 0), endTime=t("", 1, 0)), dict(startTime=t("", 7, 0), endTime=t("", 9, 0))]})
    df = spark.createDataFrame([(h,), ('{"mode":" 24h "}',), (None,)], "j string").select(maps.opening_hours(F.from_json("j", maps.OPENING)))
    assert [r[0] for r in df.collect()] == ["Pon 08:00-20:05\nSub 09:00-Ned 01:00\n07:00-09:00", "24h", ""]
    assert spark.range(1).select(maps.humanized(F.lit("fast_food")), maps.full_address(F.lit("a "), F.lit(""), F.lit(None), F.lit("b"))).first()[:] == ("Fast Food", "a, b")
    s = spark.createDataFrame([("2024-01-02", None), ("2024-01-02", "x"), ("2023-01-01", None)], "e string, u string").withColumn("e", F.col("e").cast("timestamp"))
    assert filters.valid(s, "e", F.lit("2024-01-01").cast("timestamp"), "u").count() == 1
