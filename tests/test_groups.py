import pytest
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions.groupkey import core_from_title, fold_formless, fold_sizeless, with_group_key
from offerweave.operators import filters, grouping, search

SMALL = D.Dictionaries.small()
COLUMNS = (
    "id string, title string, price double, vendor_id string, vendor_name string, brand string, normalized_name string, core string, canonical_identity string, dosage_value double, "
    "dosage_unit string, volume_value double, volume_unit string, form string, category string, quantity double, search_tokens array<string>"
)


def offer(i, **x):
    base = dict(id=str(i), title="", price=100.0, vendor_id=f"v{i}", vendor_name=f"V{i}", brand="", normalized_name="", core="", canonical_identity="", dosage_value=0.0, dosage_unit="",
                volume_value=0.0, volume_unit="", form="", category="", quantity=0.0, search_tokens=None)
    return tuple((base | x).values())


def frame(spark, *offers):
    return spark.createDataFrame([offer(i, **o) for i, o in enumerate(offers)], COLUMNS)


def keys(spark, *offers):
    found = with_group_key(frame(spark, *offers), SMALL).collect()
    return [(r.group_key, r.group_method, r.group_display) for r in sorted(found, key=lambda r: int(r.id))]


D3 = dict(core="Vitamin D3", dosage_value=2000.0, dosage_unit="iu")


def test_ingredient_keys(spark):
    a, b, c, d, e = keys(
        spark, D3 | dict(brand="NOW", form="kapsule"), D3 | dict(brand="Solgar", form="kaps"), D3 | dict(form="tablete"),
        dict(core="Vitamin D3", dosage_value=50.0, dosage_unit="mcg", form="kapsule"), dict(core="Vitamin C", dosage_value=1.0, dosage_unit="g"),
    )
    assert a == b == ("ing:vitamin d3::2000iu::form:kapsule", "ingredient", "Vitamin D3 2000 IU kapsule")
    assert c[0] != a[0] and d[0] == a[0] and e[0] == "ing:vitamin c::1000mg"


def test_cosmetics_stay_with_their_brand(spark):
    a, b, c, d = keys(
        spark, dict(core="Koenzim Q10", form="kapsule"), dict(core="Q10", title="Q10 krema", brand="Nivea", form="krema", volume_value=50.0, volume_unit="ml"),
        dict(core="Vitamin C", title="Balea Vitamin C", brand="Balea"), dict(core="micelarna voda", brand="Garnier", volume_value=250.0, volume_unit="ml"),
    )
    assert a[0].startswith("ing:") and b[0].startswith("sku:") and not c[0].startswith("ing:") and d[0].startswith("sku::garnier::")


def test_lines_and_sizes(spark):
    line = lambda core, g, **x: dict(core=core, volume_value=float(g), volume_unit="g", **x)
    a, b, c, d, e = keys(spark, line("Iso Sensation", 910), line("Ultimate Nutrition Iso Sensation", 908), line("Iso Sensation", 2270), line("Prostar Kazein", 1000), line("Caseine Prostar", 1000))
    assert a[0] == b[0] == "prod::iso sensation::1000g" and c[0] == "prod::iso sensation::2250g" and d[0] == e[0] and a[1] == "brand-line"


def test_names_brands_and_single_offers(spark):
    a, b, c, d, e, f, g, h = keys(
        spark, dict(core="Centrum Silver", brand="Centrum"), dict(core="Centrum Multivitamin", brand="Centrum"), dict(core="Multivitamin"), dict(core="Ferin", brand="Ferin", form="kapsule"),
        dict(core="Nuk", brand="Nuk"), dict(core="x", title="Neki proizvod"), dict(canonical_identity="Kaltex Daily", core="Vitamin C", form="kapsule"), dict(title="Solgar Osteocare 500 mg 60 tableta"),
    )
    assert a[0] == "core::centrum silver" and b[0] == "core::centrum multivitamin" and c[:2] == ("ing:multivitamin", "ingredient")
    assert d == ("core::ferin::form:kapsule", "brand-core", "Ferin Kapsule") and e[0] == "sku::nuk::" and f[:2] == ("offer:5", "single")
    assert g == ("core::kaltex daily::form:kapsule", "brand-core", "Kaltex Daily Kapsule") and h[0].startswith("core::osteocare")


def test_core_from_title(spark):
    rows = spark.createDataFrame([("Solgar Osteocare Original 500 mg 60 tableta A30",)], "t string")
    assert rows.select(core_from_title(F.col("t"), SMALL)).first()[0] == "osteocare original"


def test_folds(spark):
    rows = [("a", "prod::x y::900g", "brand-line", "x y", True, "1"), ("b", "sku::b::x y", "brand-sku", "x y", False, "2"), ("c", "offer:c", "single", "x y", False, "3"),
            ("d", "sku::b::x y::50ml", "brand-sku", "x y", True, "4"), ("e", "offer:e", "single", "x", False, "5"),
            ("f", "ing:c", "ingredient", "", False, "6"), ("g", "ing:c::form:tab", "ingredient", "", False, "7"), ("h", "ing:c::form:kap", "ingredient", "", False, "8"),
            ("i", "ing:c::form:kap", "ingredient", "", False, "8"), ("j", "ing:d", "ingredient", "", False, "9")]
    df = spark.createDataFrame(rows, "id string, group_key string, group_method string, group_residual string, group_has_measure boolean, vendor_id string")
    once = fold_formless(fold_sizeless(df))
    got = {r.id: r.group_key for r in once.collect()}
    assert got["b"] == got["c"] == "prod::x y" and got["d"].endswith("50ml") and got["e"] == "offer:e"
    assert got["f"] == "ing:c::form:kap" and got["j"] == "ing:d"  # equal vendors: the smaller key
    twice = {r.id: r.group_key for r in fold_formless(fold_sizeless(once)).collect()}
    assert twice == got


def test_vendor_dedupe(spark):
    x = dict(core="omega 3", form="kapsule", dosage_value=1000.0, dosage_unit="mg")
    hits = frame(spark, x | dict(price=1000.0, vendor_id="A"), x | dict(price=1100.0, vendor_id="A"), x | dict(price=1200.0, vendor_id="B"))
    q = D.Query("omega 3", SMALL)
    (g,) = grouping.grouped(grouping.with_rank(hits, F.col("id")), q, SMALL).collect()
    assert (g.vendor_count, g.product_count, g.hidden_offers, g.min_price, g.max_price, g.avg_price) == (2, 3, 1, 1000, 1200, 1100)
    assert [p.price for p in g.products] == [1000, 1200]


def test_formless_offers_join(spark):
    x = dict(core="vitamin c", dosage_value=500.0, dosage_unit="mg")
    hits = frame(spark, x | dict(form="tablete"), x | dict(form="tablete"), x)
    (g,) = grouping.grouped(grouping.with_rank(hits, F.col("id")), D.Query("vitamin c", SMALL), SMALL).collect()
    assert g.vendor_count == 3


def test_tiers_rank_coverage(spark):
    m = dict(core="magnezijum", title="Magnezijum 375 mg", dosage_value=375.0, dosage_unit="mg", form="kapsule")
    hits = frame(spark, dict(core="vitamin c", title="Vitamin C", dosage_value=500.0, dosage_unit="mg", form="tablete"), dict(core="magnezijum", title="Magnezijum kesice", form="kesice"), m, m)
    got = grouping.page(grouping.grouped(grouping.with_rank(hits, F.col("id")), D.Query("magnezijum", SMALL), SMALL)).collect()
    assert got[0].group_key == "ing:magnezijum::375mg::form:kapsule" and got[-1].group_key == "ing:vitamin c::500mg::form:tablete"


def test_pages_are_the_whole_list(spark):
    hits = grouping.with_rank(frame(spark, *[dict(core=f"product {chr(97 + i)}xyz") for i in range(7)]), F.col("id"))
    g = grouping.grouped(hits, D.Query("product", SMALL), SMALL).cache()
    whole = [r.group_key for r in g.orderBy(*grouping.group_order()).collect()]
    assert sum(([r.group_key for r in grouping.page(g, o, 3).collect()] for o in (0, 3, 6, 9)), []) == whole and len(whole) == 7


@pytest.mark.parametrize("text,score", [("red bolt", 1200), ("red bolt x", 1050), ("a red bolt x", 980), ("hered bolts", 900), ("bolt of red", 780), ("bolt", 120), ("", 0), (None, 0)])
def test_query_score(spark, text, score):
    row = spark.createDataFrame([(text,)], "c string")
    assert row.select(grouping.query_score(F.col("c"), D.Query("red bolt", D.Dictionaries()))).first()[0] == score


def catalog(spark):
    t = lambda s: s.lower().split()
    rows = [("Fervex kesice", 300.0), ("Ferin tablete", 200.0), ("Magnezijum citrat", 500.0), ("Magnezijum B6", 400.0), ("Magnezijum gel", 450.0), ("Gratis", 0.0)]
    return frame(spark, *[dict(title=n, normalized_name=n, core=n.split()[0], price=p, search_tokens=t(n)) for n, p in rows])


def test_search_gate(spark):
    titles = lambda q: [r.title for r in search.search(catalog(spark), D.Query(q, SMALL)).orderBy("rank").collect()]
    assert titles("magnezijum") == ["Magnezijum B6", "Magnezijum gel", "Magnezijum citrat"] or set(titles("magnezijum")) == {"Magnezijum B6", "Magnezijum gel", "Magnezijum citrat"}
    assert titles("fervex")[0] == "Fervex kesice"
    assert "Fervex kesice" in titles("fervx")  # a typo finds nothing exact
    assert titles("100%") == [] and titles("gratis") == []


def test_filters(spark):
    hits = frame(spark, dict(core="aaa bbb", brand="X ", category="C"), dict(core="aaa bbb", brand="Y", category="D"), dict(core="ccc ddd", brand="Y", category="C")).withColumn("rank", F.col("id").cast("int"))
    g = grouping.grouped(hits, D.Query("a", SMALL), SMALL)
    assert {r.group_key for r in filters.groups_by(g, brand=["x"], category=["c"]).collect()} == {"core::aaa bbb"}
    assert filters.groups_by(g, brand=["x"], category=["d"]).count() == 0
    assert filters.groups_by(g, brand=[" "]).count() == 2
    assert filters.hits_by(hits, brand=["x", "z"]).count() == 1 and filters.by_values(hits, brand=["x"]).count() == 0


def test_snapshot_agrees_with_search(spark):
    from offerweave.operators.catalog import catalog_snapshot

    hits = frame(spark, *[dict(core=c, price=p, form=f) for c, p, f in [("vitamin c", 5.0, "tablete"), ("vitamin c", 4.0, ""), ("centrum silver", 9.0, ""), ("centrum silver", 9.0, ""), ("magnezijum", 0.0, "")]])
    snap = {r.group_key: (r.min_price, r.offer_count) for r in catalog_snapshot(hits, SMALL).collect()}
    groups = grouping.grouped(filters.visible(hits).withColumn("rank", F.col("id").cast("int")), D.Query("x", SMALL), SMALL).collect()
    assert snap == {g.group_key: (g.min_price, g.product_count) for g in groups}
