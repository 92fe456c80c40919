import pytest
from pyspark.sql import functions as F

from offerweave.functions import dates, geo, hygiene, trigram
from offerweave.functions import dictionaries as D
from offerweave.functions import extract as X
from offerweave.functions import measures as M
from offerweave.functions import text as T

SMALL = D.Dictionaries.small()


def of(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, c {kind}").orderBy("i").select(fn(F.col("c"))).collect()]


def test_normalisers_differ(spark):
    s = ["Čaj protiv кашља 200ML", "Café_Naïve-đ", None, "  Љубав,  Џем "]
    assert of(spark, T.normalize_key, s) == ["caj protiv kaslja 200ml", "café naïve dj", "", "ljubav dzem"]
    assert of(spark, T.normalize_lookup, s) == ["caj protiv kaslja 200ml", "caf na ve dj", "", "ljubav dzem"]
    assert of(spark, T.normalize_identity, s) == ["caj protiv kaslja 200ml", "cafe naive dj", "", "ljubav dzem"]
    assert of(spark, T.normalize_place, s)[0] == "caj protiv 200ml"


def test_tokens_and_titles(spark):
    assert of(spark, T.tokenize, ["krema za lice c a x X lice", "", None]) == [["krema", "lice", "c"], [], []]
    assert of(spark, T.title_words, ["vitamin d3 500 iu", "šampon"]) == ["Vitamin D3 500 Iu", "Šampon"]
    assert of(spark, T.python_title, ["b12x o'neil"]) == ["B12X O'Neil"]


def test_driver_side_normaliser_agrees(spark):
    s = ["Čaj протИв_x-Y", "É ö 12½", "a\tb"]
    assert [D.plain(x) for x in s] == of(spark, T.normalize_key, s)


def test_trigrams(spark):
    row = spark.createDataFrame([("word", "two words")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = row.select(F.size(trigram.trigrams(a)), trigram.similarity(a, b), trigram.word_similarity(a, b), trigram.similarity(F.lit(""), b), trigram.word_similarity(F.lit(None).cast("string"), b)).first()
    assert got[0] == 5 and got[1] == pytest.approx(0.363636, abs=1e-6) and got[2] == pytest.approx(0.8) and got[3] == 0 and got[4] == 0


def test_word_similarity_against_all_extents(spark):
    def grams(s):
        import re

        return [f"  {w} "[i : i + 3] for w in re.findall(r"[^\W_]+", s.lower()) for i in range(len(w) + 1)]

    def brute(a, b):
        want, have = set(grams(a)), grams(b)
        return max((len(want & set(have[i:j])) / len(want | set(have[i:j])) for i in range(len(have)) for j in range(i + 1, len(have) + 1)), default=0)

    pairs = [("magnezium", "magnezijum citrat 60 kapsula"), ("vit c", "vitamin c 1000"), ("abc", "xyz"), ("aaa", "aaaa aa a"), ("red bolt", "bolt red bolt")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", trigram.word_similarity(F.col("a"), F.col("b"))).collect()
    for a, b, s in got:
        assert s == pytest.approx(brute(a, b)), (a, b)


@pytest.mark.parametrize(
    "raw,price",
    [("33.746,30", 33746), ("1.390", 1390), ("1445.312", 1445), ("1,000.00", 1000), ("1.533.179", 1533179), ("", 0), (None, 0), ("RSD 99", 99), ("1,234", 1234), ("12.5", 13), ("abc", 0)],
)
def test_price(spark, raw, price):
    assert of(spark, hygiene.parse_price, [raw]) == [price]


def test_titles_and_links(spark):
    s = ["&scaron;&amp;amp; &#269;&#x10d; &bad; x - Apoteka Milica", "Foo | apothecary.rs", "a &#0; b", "x ​ y", None, "Bar - GymBeam", "&#128512;"]
    assert of(spark, hygiene.clean_title, s) == ["š& čč &bad; x", "Foo", "a &#0; b", "x y", "", "Bar", "😀"]
    links = ["https://a.rs/p/1", "https://a.rshttps://a.rs/p", "https://a.rs/sr/brendovi/", "https://a.rs/proizvodjaci/x", None]
    assert of(spark, hygiene.is_resolvable, links) == [True, False, False, False, True]
    rows = [("Vitamin C", 2.0), ("ab", 2.0), ("test", 5.0), ("testing kit", 5.0), ("Vitamin", 1.0), ("Vitamin", float("nan")), ("Vitamin", float("inf")), (None, 3.0), ("Vitamin", None)]
    df = spark.createDataFrame(rows, "t string, p double").select(hygiene.is_product(F.col("t"), F.col("p")))
    assert [r[0] for r in df.collect()] == [True, False, False, True, False, False, False, False, False]
    assert of(spark, hygiene.format_price, [1234567.5, 12.0], "double") == ["1.234.568", "12"]


def test_measures(spark):
    d3 = F.array(F.lit("vitamin d3"))
    lit = lambda v, u: (F.lit(float(v)), F.lit(u))
    got = spark.range(1).select(
        M.strength_key(*lit(50, "mcg"), d3), M.strength_key(*lit(2000, "I.U."), d3), M.strength_key(*lit(500, "mg"), d3), M.strength_key(*lit(1, "g")), M.strength_key(*lit(5000, "mcg")),
        M.strength_key(*lit(0, "mg")), M.strength_key(*lit(5, "%")), M.size_key(*lit(908, "g")), M.size_key(*lit(910, "g")), M.size_key(*lit(2270, "g")), M.size_key(*lit(0.25, "l")),
        M.size_key(*lit(99.5, "g")), M.size_key(*lit(125, "g")), M.quantity_facet(F.lit(2.5)), M.quantity_facet(F.lit(0.0)), M.strength_display(*lit(1.5, "g")), M.compact(F.lit(None).cast("double")),
    ).first()
    assert list(got) == ["2000iu", "2000iu", None, "1000mg", "5mg", None, None, "1000g", "1000g", "2250g", "250ml", "99.5g", "150g", "2.5", None, "1500 MG", None]
    assert of(spark, M.key_form, ["MAST", "softgels", "xyz", None]) == ["krema", "kapsule", "xyz", ""]
    assert of(spark, M.extract_form, ["mast", "globule", ""]) == ["mast", "supozitorija", None]
    assert of(spark, M.extract_unit, ["i. u.", "мг", "µg", None]) == ["iu", "mg", "mcg", ""]


@pytest.mark.parametrize(
    "text,found",
    [("NOW Vitamin D3 2000IU 60 kapsula", ["vitamin d3"]), ("Magnezijum + B6 30 tableta", ["magnezijum", "vitamin b6"]), ("Bioderma Sensibio micelarna voda", []), ("C vitamin c", ["vitamin c"]), ("", [])],
)
def test_ingredients(spark, text, found):
    assert of(spark, lambda c: D.ingredients(T.normalize_key(c), SMALL), [text]) == [found]


def test_greedy_longest_match(spark):
    d = D.Dictionaries.of([("a b", "supplement", ["a b"]), ("b c", "supplement", ["b c"]), ("b", "cosmetic", ["b"]), ("a b c d", "supplement", ["a b c d"])], {}, {})
    s = ["a b c", "a b c d b", "x b c b", "ab b"]
    assert of(spark, lambda c: D.ingredients(c, d), s) == [["a b"], ["a b c d", "b"], ["b", "b c"], ["b"]]
    assert of(spark, lambda c: D.leftover(c, d), s) == [["c"], [], ["x"], ["ab"]]
    assert of(spark, lambda c: D.ingredients(c, d, identifying=True), s)[2] == ["b c"]
    assert D.Query("a b c", d).required == ["ab", "c"]


def test_brands(spark):
    s = ["solgar ultimate nutrition whey", "nutrition ultimate", "la roche posay x", ""]
    assert of(spark, lambda c: D.detect_brand(c, SMALL), s) == ["ultimate nutrition", None, "la roche posay", None]
    assert of(spark, lambda c: D.is_cosmetic(c, SMALL, by_word=True), ["roche posay", "solgar", "posay x"]) == [True, False, True]


def test_queries():
    assert D.Query("vitamin c", SMALL).required == ["vitaminc"]
    assert D.Query("solgar magnezijum", SMALL).required == ["magnezijum", "solgar"]
    assert D.Query("magnesium", SMALL).required == ["magnezijum"]
    assert D.Query("magnezium", SMALL).required == ["magnezijum"]
    assert D.Query("vitmin c", SMALL).required == ["vitaminc"]
    assert D.Query("krema za lice", SMALL).required == ["krema", "lice"]
    assert "ascorbic acid" in D.Query("vitamin c", SMALL).variants
    assert D.within_edits("abc", "abcdef", 2) == 3 and D.within_edits("kitten", "sitting", 3) == 3


ENTITIES = [
    ("VITAMIN D3 2000 I.U. KAPSULE A30", dict(dosage_value=2000, dosage_unit="iu", quantity_value=30, form="kapsule", core="Vitamin D3")),
    ("Vitamin C 1.000 mg 20 kesica", dict(dosage_value=1000, dosage_unit="mg", quantity_value=20)),
    ("Vitamin C 1 000 mg", dict(dosage_value=1000, dosage_unit="mg")),
    ("Solgar Vitamin D3 400 IJ 100 kapsula", dict(dosage_value=400, dosage_unit="iu", quantity_value=100, brand="Solgar")),
    ("Solgar Vitamin D3 2500IU rastvor 59ml", dict(dosage_value=2500, volume_value=59, volume_unit="ml")),
    ("DETRICAL 2000 TABLETE A60", dict(dosage_value=2000, dosage_unit="iu", quantity_value=60)),
    ("Vitamin C 1000 30 tableta", dict(dosage_value=1000, dosage_unit="mg", quantity_value=30)),
    ("Vitamin C 500 + D3 1000 tableta", dict(dosage_value=None)),
    ("GUMEDIĆI SA VITAMINOM C A60", dict(brand="Gumedici", form="bombone", quantity_value=60)),
    ("Vitamin D3, 90kap", dict(core="Vitamin D3")),
    ("Now vitamin C-1000 100 tableta", dict(core="Vitamin C", brand="Now")),
    ("Vitamin D-3 2000 IU", dict(core="Vitamin D3")),
    ("Sirup 10 mg/5ml 100ml", dict(dosage_value=10, volume_value=100, volume_unit="ml")),
    ("Whey 2,27 kg cookies & cream", dict(volume_value=2270, volume_unit="g", form=None)),
    ("Kreatin 3 g kesice", dict(dosage_value=3, dosage_unit="g", volume_value=None)),
    (None, dict(brand=None, core=None, dosage_value=None, form=None)),
]


def test_entities(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ENTITIES)], "i int, title string")
    for r in X.with_entities(rows, SMALL).collect():
        for k, v in ENTITIES[r.i][1].items():
            assert r[k] == v, (r.title, k, r[k], v)


def test_search_tokens_and_titles(spark):
    row = spark.createDataFrame([("Solgar Vitamin D3 2000IU 60 caps", "Solgar", "Vitamin D3", "Solgar Vitamin D3 2000 IU kapsule", "kapsule", 2000.0, "iu", None, None, 60)], "t string, b string, c string, n string, f string, d double, du string, v double, vu string, q int")
    c = [F.col(x) for x in row.columns]
    tokens = row.select(X.search_tokens(*c, F.array(F.lit("vitamin d3")))).first()[0]
    assert {"solgar", "vitamin", "d3", "2000iu", "2000", "60", "vitamind3"} <= set(tokens) and len(tokens) == len(set(tokens))
    t, b, core, n, f, dv, du, vv, vu, q = c
    assert row.select(X.standardized_title(n, b, core, t, dv, du, vv, vu, f, q)).first()[0] == "Solgar Vitamin D3 2000 IU kapsule"
    assert row.select(X.standardized_title(F.lit(""), b, core, t, dv, du, vv, vu, f, q)).first()[0] == "Solgar Vitamin D3 2000 IU 60 kapsule"


def test_geo_and_dates(spark):
    got = spark.range(1).select(
        geo.haversine(F.lit(44.8), F.lit(20.5), F.lit(45.25), F.lit(19.85)), geo.spot(F.lit(1.0), F.lit(2.5)), geo.has_coordinates(F.lit(0.0), F.lit(2.0)),
        dates.rfc3339(F.lit("2024-01-02 03:04:05").cast("timestamp")), dates.rfc3339(F.lit(None).cast("timestamp")), dates.price_age(F.lit("2024-01-01"), F.lit("2024-01-16")), dates.price_age(F.lit("2024-01-01"), F.lit("2024-01-02")),
    ).first()
    assert got[0] == pytest.approx(71_700, rel=0.01) and got[1:] == ("1.000000,2.500000", False, "2024-01-02T03:04:05Z", "", "pre 2 nedelje", "juče")
