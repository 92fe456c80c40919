import json

import pytest
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.operators import audit, catalog, categories, facets, merge, places, search
from offerweave.plans import ingest
from offerweave.sources import html, maps, shops, snapshots, tables
from offerweave.streaming import ingest as stream

SMALL = D.Dictionaries.small()


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def test_facets(spark):
    df = spark.createDataFrame([("A", "mg", "kapsule", 30.0), ("B", "mg", "kapsule", 30.0), (" ", None, "", 0.0)], "v string, u string, f string, q double")
    from offerweave.functions.measures import quantity_facet

    got = facets.facets(df, vendor=F.col("v"), unit=F.col("u"), form=F.col("f"), quantity=quantity_facet(F.col("q")))
    assert rows(got) == [("form", "kapsule", 2), ("quantity", "30", 2), ("unit", "mg", 2), ("vendor", "A", 1), ("vendor", "B", 1)]
    assert rows(facets.top(got, vendor=1))[-1] == ("vendor", "A", 1) and facets.as_map(got).first()[0]["vendor"] == {"A": 1, "B": 1}


@pytest.mark.parametrize(
    "target,old,new,kind",
    [(100.0, 150.0, 100.0, "target"), (100.0, 90.0, 80.0, None), (100.0, None, 99.0, "target"), (100.0, 150.0, 101.0, None), (None, 100.0, 99.9995, None), (None, 100.0, 99.99, "drop"), (None, None, 5.0, None), (None, 100.0, 120.0, None)],
)
def test_watch_rules(spark, target, old, new, kind):
    w = spark.createDataFrame([("w1", "u", "g", "", target, old, "V0"), ("w2", "u", "gone", "", target, old, "V0")], "id string, user_id string, group_key string, display_name string, target_price double, last_price double, last_vendor string")
    snap = spark.createDataFrame([("g", new, "V1", 3)], "group_key string, min_price double, vendor string, offer_count long")
    updated, history, alerts = catalog.evaluate_watches(w, snap, F.lit("2024-01-01").cast("timestamp"))
    assert [r.kind for r in alerts.collect()] == ([kind] if kind else [])
    assert rows(updated, "id", "last_price", "last_vendor") == sorted([("w1", new, "V1"), ("w2", old, "V0")], key=str)
    assert rows(history, "group_key", "min_price", "offer_count") == [("g", new, 3)]


def test_featured_having(spark):
    data = [("a", f"v{i % 20}", float(i + 1), f"a{i:03}") for i in range(99)] + [("b", f"v{i % 25}", float(i + 1), f"b{i:03}") for i in range(100)] + [("c", f"v{i % 2}", 5.0, f"c{i}") for i in range(9)]
    data += [("d", f"v{i % 2}", 5.0, f"d{i:02}") for i in range(10)] + [("e", "v0", 1.0, "e1"), ("e", "v0", 1.0, "e2")]
    df = spark.createDataFrame(data, "core string, vendor_id string, price double, id string").withColumns({"dosage_unit": F.lit(None).cast("string")})
    got = catalog.featured_keys(df, ["core", "dosage_unit"], 10).collect()
    assert [(r.core, r.vendor_count, r.product_count) for r in got] == [("a", 20, 99), ("c", 2, 9)]
    top = catalog.top_offers(df, catalog.featured_keys(df, ["core", "dosage_unit"], 10), ["core", "dosage_unit"], 3)
    assert rows(top, "id") == [("a000",), ("a001",), ("a002",), ("c0",), ("c1",), ("c2",)]


def test_featured_plan(spark):
    cols = "id string, title string, price double, vendor_id string, vendor_name string, brand string, core string, dosage_value double, dosage_unit string, volume_value double, volume_unit string, quantity double, form string"
    df = spark.createDataFrame([(str(i), "Vitamin C", 10.0 + i, f"v{i % 3}", f"V{i % 3}", "", "Vitamin C", None, None, None, None, None, "tablete") for i in range(6)], cols)
    (g,) = catalog.featured(df, SMALL).collect()
    assert (g.group_key, g.vendor_count, g.product_count, g.min_price, g.max_price) == ("ing:vitamin c::form:tablete", 3, 6, 10, 12)


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", 1.0, 0.5, "x"), (2, "b", 2.0, 0.9, "y")], "k int, t string, p double, c double, keep string")
    new = spark.createDataFrame([(2, None, None, 0.4), (3, "n", 3.0, None)], "k int, t string, p double, c double")
    got = merge.upsert(old, new, ["k"], overwrite=["t"], fill=["p"], greatest=["c"])
    want = [(1, "a", 1.0, 0.5, "x"), (2, None, 2.0, 0.9, "y"), (3, "n", 3.0, None, None)]
    assert rows(got) == want and rows(merge.upsert(got, new, ["k"], overwrite=["t"], fill=["p"], greatest=["c"])) == want  # idempotent
    assert rows(merge.insert_absent(old, old.withColumn("k", F.col("k") + 1), ["k"]), "k") == [(1,), (2,), (3,)]
    filled = merge.fill_blank(spark.createDataFrame([("v", "", "1")], "id string, phone string, email string"), spark.createDataFrame([("v", "p", "e")], "id string, phone string, email string"), "id", ["phone", "email"])
    assert rows(filled) == [("v", "p", "1")]


@pytest.mark.parametrize("existing,fresh,left", [(10, 5, 5), (10, 4, 10), (0, 3, 0), (10, 0, 10)])
def test_delist_guard(spark, existing, fresh, left):
    old = spark.createDataFrame([(f"t{i}", "v") for i in range(existing)], "title string, vendor string")
    new = spark.createDataFrame([(f"t{i}", "v") for i in range(fresh)], "title string, vendor string")
    assert merge.delist(old, new, ["title", "vendor"], "vendor").count() == left


def test_standards(spark):
    std = spark.createDataFrame([("T", "orig", "B1", 0.5, 10.0), ("orig", "other", "B2", 0.9, 0.0), ("T", "orig", "B3", 0.7, 0.0)], "title string, original_title string, brand string, confidence double, dosage_value double")
    std = std.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    p = spark.createDataFrame([(" ORIG ", "own", 5.0), ("t", "own", 5.0), ("none", "own", 5.0)], "title string, brand string, dosage_value double")
    got = merge.standardize(p, std, ["brand", "dosage_value"])
    from offerweave.functions.extract import merge_standard

    assert rows(merge_standard(got, ["brand", "dosage_value"]), "title", "brand", "dosage_value") == sorted([(" ORIG ", "B3", 5.0), ("t", "B3", 5.0), ("none", "own", 5.0)], key=str)
    assert merge.best_standard(std, "orig").first().brand == "B2"


def test_places(spark):
    P = "id string, vendor_id string, vendor_name string, name string, source string, address string, formatted_address string, phone string, hours string, latitude double, longitude double, website string, locality string, rating double, popularity double"
    data = [("1", "v", "Benu", "Benu 1", "osm", "Srbija", "", "", "", 44.8001, 20.5, "https://www.benu.rs/x", "Beograd", 1.0, None), ("2", "v", "Benu", "Benu 2", "tomtom", "Ulica 1", "", "", "", 44.8002, 20.5, "", "beograd ", 5.0, 1.0),
            ("3", "v", "Benu", "Kafana", "foursquare", "Ulica 1", "", "", "", 45.5, 20.5, "http://shop.benu.rs", "Niš", None, 2.0), ("4", "w", "Nis", "x", "osm", "", "", "", "", 0.0, 20.0, None, "", 2.0, 1.0)]
    df = spark.createDataFrame(data, P).withColumns({"photos": F.lit(None).cast("array<string>"), "fetched_at": F.lit("2024-01-01").cast("timestamp"), "categories": F.from_json(F.lit('[{"name":"Pharmacy"}]'), "array<struct<fsq_category_id:string,id:string,name:string>>")})
    assert rows(places.one_per_spot(df), "id") == [("2",), ("3",), ("4",)]
    assert rows(places.best_place(df), "vendor_id", "id") == [("v", "2"), ("w", "4")]
    assert rows(places.nearest(df, F.lit(44.8), F.lit(20.5), ["vendor_id"]), "id") == [("1",)]
    assert rows(places.cities(df)) == [("Beograd", 2), ("Niš", 1)]
    assert rows(df.select("id", places.relevant(F.col("categories"), F.lit("x"), F.lit("y")), places.relevant(F.lit(None).cast(df.schema["categories"].dataType), F.col("name"), F.col("vendor_name"))), "id")
    got = {r[0]: r[1] for r in df.select("id", places.relevant(F.lit(None).cast(df.schema["categories"].dataType), F.col("name"), F.lit("q"))).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": False}
    vendors = spark.createDataFrame([("b", "Apoteka Benu", "benu.rs"), ("k", "Kafana", None)], "id string, name string, website string")
    assert rows(places.match_vendors(vendors, df)) == [("b", "1"), ("b", "2"), ("b", "3"), ("k", "3")] or rows(places.match_vendors(vendors, df)) == [("b", "1"), ("b", "2"), ("k", "3")]
    names = spark.createDataFrame([('[{"name":" A "},{"name":"a"},{"name":""},{"name":"B"}]',)], "j string").select(places.category_names(F.from_json("j", "array<struct<name:string>>"))).first()[0]
    assert names == ["A", "B"]


def test_categories_and_identities(spark):
    C = "id string, title string, category string, brand string, core string, form string, volume_value double, dosage_value double"
    data = [("1", "x", "Oralna", "", "vitamin c", "", 0.0, 0.0), ("2", "x", "", "", "Vitamin C", "Krema", 0.0, 0.0), ("3", "x", "", "", "vitamin c", "", 0.0, 0.0), ("4", "x", "", "", "ibuprofen", "", 0.0, 0.0), ("5", "Whey Protein", "Opste", "", "", "", 0.0, 0.0),
            ("6", "x", "", "Eucerin", "abc", "", 0.0, 0.0), ("7", "x", "Opste", "", "abc", "", 0.0, 0.0), ("8", "x", "", "", "abc", "mast", 0.0, 0.0), ("9", "x", "", "", "abc", "", 0.0, 0.0), ("10", "vitamin c", "Odeća", "", "vitamin c", "", 0.0, 0.0)]
    df = spark.createDataFrame(data, C)
    mapping = spark.createDataFrame([("Oralna", "Oral Care"), ("Opste", "OTC Medicines")], "raw string, canonical string")
    got = {r.id: r.canonical_category for r in categories.with_category(df, SMALL, mapping, ["Odeća"]).collect()}
    assert got == {"1": "Oral Care", "2": categories.COSMETICS, "3": categories.SUPPLEMENTS, "4": categories.OTC, "5": categories.SPORTS, "6": categories.COSMETICS, "7": categories.OTC, "8": categories.OTC, "9": None, "10": None}
    by = lambda k, v: spark.createDataFrame([(k, v)], "key string, identity string")
    p = spark.createDataFrame([("1", "ABC", "Iso", 900.0), ("2", "ABC", "Iso", None), ("3", "Probiotik X", "q", None)], "id string, title string, core string, volume_value double").withColumn("dosage_value", F.lit(None).cast("double"))
    assert rows(categories.with_canonical_identity(p, by("iso", "Line"), by("probiotik x", "Brand X")), "id", "canonical_identity") == [("1", "Line"), ("2", None), ("3", "Brand X")]


def test_audit(spark):
    k = spark.createDataFrame([("g", "brand-line", "t1", "v1", "b1"), ("g", "brand-line", "t2", "v2", "b2"), ("h", "single", "t", "v", "")], "group_key string, group_method string, title string, vendor_id string, brand string")
    a = audit.group_audit(k)
    assert rows(audit.over_merged(a), "group_key", "products", "vendors", "brands") == [("g", 2, 2, 2)] and rows(audit.by_method(k)) == [("brand-line", 1, 2), ("single", 1, 1)]
    c = spark.createDataFrame([(f"{i}", "core::ferin", "brand-core", t, "Ferin", "Ferin") for i, t in enumerate(["Ferin junior", "Ferin A30", "Ferin forte", "Ferin 60 kapsula"])], "id string, group_key string, group_method string, title string, brand string, group_display string")
    assert rows(audit.catch_alls(c, SMALL), "group_key", "products", "signs") == [("core::ferin", 4, 2)]
    assert audit.processing_rate(k.limit(0), F.lit(True)).first().rate == 0 and audit.sample(k, 2).count() == 2
    assert rows(audit.needs_processing(spark.createDataFrame([("long title", None), ("short", None), ("long title", "b")], "title string, brand string"), ["brand"])) == [("long title", None)]


def test_quick_search_order(spark):
    p = spark.createDataFrame([("1", "red bolt"), ("2", "red bolt x"), ("3", "big red bolts here and there and everywhere"), ("4", "unlike")], "id string, title string")
    p = p.withColumns({"price": F.lit(1.0), "vendor_id": F.lit("v"), "vendor_name": F.lit("V"), "brand": F.lit(""), "normalized_name": F.lit(""), "search_tokens": F.lit(None).cast("array<string>")})
    got = [(r.id, r.relevance_score) for r in search.quick_search(p, " Red bolt").collect()]
    assert got[0] == ("1", 5000) and got[1] == ("2", 4500) and got[2][0] == "3" and len(got) == 3
    assert search.quick_search(p, "red.", most=0.5).count() == 0
    assert [r[0] for r in spark.createDataFrame([("VitC",), ("x",)], "q string").select(search.expand_abbreviation(F.col("q"))).collect()] == ["vitamin c", "x"]


def test_csv_snapshots(spark, tmp_path):
    head = "title,price,category,link,thumbnail,photos,vendor,scrapedAt\n"
    (tmp_path / "a_x_2024-01-01.csv").write_text(head + "Old,1.000,c,l,t,p,A,2024\n")
    (tmp_path / "a_x_2024-01-02.csv").write_text(head + '"Vitamin ""C"",\nlong","1.200,50",c,https://a.rs/p,t,p,A,2024\n,5,c,l,t,p,A,2024\nshort,1\n"vitamin c 20",990,c,https://a.rs/q,t,p,A,2024\n')
    (tmp_path / "odd.csv").write_text(head + "Odd one,2.000,c,l,t,p,B,2024\n")
    files = snapshots.latest_files(snapshots.list_files(spark, str(tmp_path)))
    assert rows(files, "name") == [("a_x_2024-01-02.csv",), ("odd.csv",)]
    got = snapshots.fresh_rows(snapshots.read_csv(spark, [r.path for r in files.collect()]))
    assert rows(got, "title", "price", "vendor") == [("Odd one", 2000.0, "B"), ('Vitamin "C", long', 1201.0, "A"), ("vitamin c 20", 990.0, "A")]
    out = str(tmp_path / "out")
    snapshots.write_csv(got.select("title", "price"), out)
    assert rows(spark.read.csv(out, header=True, multiLine=True, quote='"', escape='"'), "title") == rows(got, "title")


def test_feeds(spark):
    woo = json.dumps([{"name": "A", "permalink": "l", "prices": {"price": "129900", "currency_minor_unit": 2}, "categories": [{"name": "c1"}, {"name": "c2"}], "images": [{"src": "s1", "thumbnail": "t1"}, {"src": "s2"}]}])
    shop = json.dumps({"products": [{"title": "B", "handle": "b", "product_type": "pt", "variants": [{"price": "12.5"}], "images": []}]})
    got = shops.woo_products(spark.createDataFrame([(woo, "V"), ("[]", "V"), (None, "V")], "json string, vendor string")).collect()
    assert [(r.title, r.price, r.category, r.thumbnail, r.photos) for r in got] == [("A", 1299.0, "c1", "t1", "s1, s2")]
    got = shops.shopify_products(spark.createDataFrame([(shop, "V", "x.rs")], "json string, vendor string, site string")).first()
    assert (got.title, got.price, got.link) == ("B", 12.5, "https://x.rs/products/b")
    with pytest.raises(ValueError):
        shops.require_rows(spark.createDataFrame([], "a int"), "feed")


def test_maps(spark):
    osm = json.dumps({"elements": [{"type": "node", "id": 1, "lat": 44.0, "lon": 20.0, "tags": {"name": "b", "phone": "1"}}, {"type": "way", "id": 2, "center": {"lat": 1.0, "lon": 2.0}, "tags": {"brand": "A"}}, {"type": "node", "id": 1, "lat": 44.0, "lon": 20.0, "tags": {"name": "b", "phone": "1"}}, {"type": "node", "id": 3, "tags": {"name": "c"}}]})
    assert [(r.id, r.name, r.latitude) for r in maps.osm_places(spark.createDataFrame([(osm,)], "json string")).collect()] == [("way/2", "A", 1.0), ("node/1", "b", 44.0)]
    tom = json.dumps({"results": [{"id": "t", "poi": {"name": "n"}, "position": {"lat": 1.0, "lon": 2.0}}, {"poi": {"name": "m"}, "position": {"lat": 1.0, "lon": 2.0}}, {"poi": {"name": "m"}, "position": {"lat": 1.0, "lon": 2.0}}]})
    assert rows(maps.tomtom_places(spark.createDataFrame([(tom,)], "json string")), "id") == [("m:1.0:2.0",), ("t",)]
    cells = spark.createDataFrame([(0.0, 0.0, 4.0, 4.0, 0, 50), (0.0, 0.0, 1.0, 1.0, 3, 50), (0.0, 0.0, 1.0, 1.0, 0, 49)], "south double, west double, north double, east double, depth int, found int")
    split, full = maps.split_cells(cells, 50, 3)
    assert split.count() == 4 and full.count() == 1 and rows(split)[0] == (0.0, 0.0, 2.0, 2.0, 1)


def test_product_pages(spark):
    ld = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    pages = [
        ("1", ld({"@graph": [{"@type": "WebPage"}, {"@type": ["Thing", "Product"], "name": "P &amp; Q", "offers": [{"price": "1299.00"}], "image": ["i1"]}]})),
        ("2", '<meta content="Og title" property="og:title"><meta property="product:price:amount" content="1.500,00">'),
        ("3", '<span itemprop="name">Micro</span><meta itemprop="price" content="75">'),
        ("4", ld({"@type": "Product", "name": "W", "offers": {"price": 10}}) + '<p class="price"><ins><bdi>2.100,00</bdi></ins></p>'),
        ("5", ld({"@type": "Product", "name": "Z", "offers": {"lowPrice": "5"}}) + '<p class="price"><bdi>0,00</bdi></p>'),
        ("6", "<title>Only &lt;title&gt;</title><script type='application/ld+json'>{broken</script>"),
        ("7", None),
    ]
    got = {r.url: (r.title, r.price) for r in html.parse_products(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got == {"1": ("P & Q", 1299.0), "2": ("Og title", 1500.0), "3": ("Micro", 75.0), "4": ("W", 2100.0), "5": ("Z", 5.0), "6": ("Only <title>", 0.0), "7": ("", 0.0)}
    site = spark.createDataFrame([("r", "User-agent: *\nSitemap: https://a/s.xml"), ("s", "<sitemapindex><loc>https://a/1.xml</loc></sitemapindex>"), ("u", "<urlset><loc> https://a/p?x=1&amp;y=2 </loc><loc>https://a/blog</loc></urlset>")], "url string, body string")
    links = html.sitemap_links(site)
    assert rows(links) == [("https://a/1.xml", "sitemap"), ("https://a/blog", "page"), ("https://a/p?x=1&y=2", "page"), ("https://a/s.xml", "sitemap")]
    assert rows(html.product_links(links, include="/p", exclude="blog")) == [("https://a/p?x=1&y=2",)]


def test_tables(spark, tmp_path):
    import zipfile

    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Brand</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Title</t></si><si><r><t>Vit</t></r><r><t>amin</t></r></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    assert rows(tables.read_xlsx(spark, str(tmp_path / "a.xlsx"), ["title"], ["brand", "form"])) == [("Vitamin", "7", None)]
    e = spark.createDataFrame([("c1", "supplement", ["A b", "x"], 0), ("c2", "otc", ["a B", "y"], 1)], "canonical string, category string, aliases array<string>, ordinal int")
    assert rows(tables.alias_table(e)) == [("a b", "c1", "supplement"), ("x", "c1", "supplement"), ("y", "c2", "otc")]
    (tmp_path / "ing.json").write_text(json.dumps({"ingredients": [{"canonical": "Vitamin Ž", "category": "supplement", "aliases": ["Vit ž"]}]}))
    assert D.Dictionaries.load(spark, str(tmp_path / "ing.json")).canonical == {"vit z": "vitamin z"}
    p = spark.createDataFrame([("1", None, None, "v")], "id string, title string, price double, vendor_id string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    got = tables.catalog_scan(p, spark.createDataFrame([("v", "V")], "id string, name string")).first()
    assert (got.title, got.price, got.vendor_name, got.updated_at) == ("", 0.0, "V", "2024-01-01T00:00:00Z")


def test_ingestion(spark):
    C = "title string, vendor_id string, price double, category string, link string, thumbnail string, photos string, scraped_at string, brand string"
    old = spark.createDataFrame([("Solgar Vitamin C 500 mg", "a", 10.0, "", "", "", "", "1", "Kept"), ("Gone", "a", 5.0, "", "", "", "", "1", ""), ("Stays", "b", 5.0, "", "", "", "", "1", "")], C)
    raw = spark.createDataFrame([("f1", 0, "Solgar Vitamin C 500 mg", "A", 12.0), ("f1", 1, "solgar vitamin c 500 MG", "other", 9.0), ("f1", 2, "New D3 2000 IU", "A", 7.0), ("f2", 0, "x", "Unknown", 1.0)], "file string, row int, title string, vendor string, price double")
    raw = raw.withColumns({c: F.lit("n") for c in ("category", "link", "thumbnail", "photos", "scraped_at")})
    fresh = ingest.by_file_vendor(raw, spark.createDataFrame([("a", "A"), ("b", "B")], "id string, name string"))
    got = ingest.import_snapshot(old, fresh)
    assert rows(got, "title", "vendor_id", "price", "brand") == sorted([("New D3 2000 IU", "a", 7.0, None), ("Stays", "b", 5.0, ""), ("solgar vitamin c 500 MG", "a", 9.0, None)], key=str)
    rich = ingest.enrich(got, SMALL).collect()
    assert {r.core for r in rich} == {"Vitamin C", "Vitamin D3 New", "Stays"} and all("brand" in r.asDict() for r in rich)


def test_stream(spark, tmp_path):
    drops, where, checkpoint = tmp_path / "in", str(tmp_path / "cat"), str(tmp_path / "cp")
    drops.mkdir()
    head = "title,price,category,link,thumbnail,photos,vendor,scrapedAt\n"
    (drops / "1.csv").write_text(head + "Vitamin C,1.000,c,https://a/1,t,p,A,x\n")
    stream.run_ingest(stream.read_drops(spark, str(drops), 1), where, checkpoint).awaitTermination()
    (drops / "2.csv").write_text(head + "Vitamin C,900,c,https://a/1,t,p,A,x\nVitamin D,500,c,https://a/2,t,p,A,x\n")
    stream.run_ingest(stream.read_drops(spark, str(drops), 1), where, checkpoint).awaitTermination()
    assert rows(spark.read.parquet(f"{where}/version=1"), "title", "price") == [("Vitamin C", 900.0), ("Vitamin D", 500.0)]


def test_trend_and_scale(spark):
    h = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 3.0), ("a", 3, 4.0), ("b", 1, 1.0)], "k string, t int, v double")
    assert rows(catalog.trend(h, "k", "v", "t"), "k", "first_value", "last_value", "direction") == [("a", 5.0, 4.0, -1)]
    assert rows(catalog.scaled(h, "k", "v"), "k", "t", "scaled") == [("a", 1, 1.0), ("a", 2, 0.0), ("a", 3, 0.5), ("b", 1, 0.0)]
    now, before = (spark.createDataFrame([("g", p)], "group_key string, min_price double") for p in (75.0, 100.0))
    assert rows(catalog.drops(now, before), "drop_percent") == [(25.0,)]


def test_windowed_lows(spark, tmp_path):
    P = "ts timestamp, k string, v double"
    spark.createDataFrame([("2024-01-01 01:00:00", "a", 5.0), ("2024-01-01 02:00:00", "a", 3.0), ("2024-01-02 01:00:00", "a", 9.0)], "ts string, k string, v double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    low = stream.lowest_by_window(spark.readStream.schema(P).parquet(str(tmp_path / "in")), "ts", "k", "v")
    low.writeStream.format("memory").queryName("lows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("lows"), "k", "low", "points") == [("a", 3.0, 2), ("a", 9.0, 1)]


def test_copies_and_dumps(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "src" / "t"))
    assert rows(snapshots.copy_tables(spark, str(tmp_path / "src"), str(tmp_path / "dst"), ["t"])) == [("t", 3)]
    p = spark.createDataFrame([("1", "V", "k", "single", "d", 1, "f", "b", "c", "t")], "id string, vendor_name string, group_key string, group_method string, group_display string, group_size int, form string, brand string, core string, title string")
    snapshots.write_groups(p, p.groupBy("group_key").count(), str(tmp_path / "dump"))
    assert spark.read.csv(str(tmp_path / "dump" / "products"), header=True).count() == 1 and spark.read.json(str(tmp_path / "dump" / "groups")).first()["count"] == 1


def test_unpriced_and_titles(spark):
    data = [("a", 0.0), ("a", 1.0), ("a", None), ("b", 0.0), ("b", 1.0), ("b", 2.0)]
    df = spark.createDataFrame(data, "vendor string, price double")
    assert rows(merge.drop_unpriced(df, "vendor")) == sorted(data[:3] + data[4:], key=str)
    t = spark.createDataFrame([(1, "v", "X &amp; Y"), (2, "v", "X & Y"), (3, "w", "X & Y - Apoteka Z")], "id int, vendor_id string, title string")
    assert rows(merge.clean_titles(t)) == [(1, "v", "X & Y"), (3, "w", "X & Y")]
