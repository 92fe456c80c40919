"""Precise and fuzzy search, browse and autocomplete over a catalog.

Trigram work is prepared as columns of the rows that a cheaper test lets through. At scale give
``candidates`` a postings table (trigram, id): it finds rows that share enough trigrams by an
equi-join, so that similarity is worked out for these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerweave.functions import dictionaries as D
from offerweave.functions import text as T
from offerweave.functions import trigram as G

FUZZY_BELOW = 3
LIKE, LIKE_WORD, LIKE_TYPING = 0.3, 0.5, 0.3


def browse(offers: DataFrame, categories: list[str] | None = None, brands: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Offers of the categories and brands (exact) by how many vendors have their product, then by
    price and id. Without a filter there is nothing to browse."""
    if not categories and not brands:
        return offers.filter(F.lit(False)).withColumn("coverage", F.lit(1).cast("long"))
    from offerweave.operators.filters import by_values, visible

    some = by_values(visible(offers), category=categories, brand=brands)
    vendors = some.filter(F.col("core") != "").groupBy("core").agg(F.count_distinct("vendor_id").alias("_n"))
    ranked = some.join(vendors, "core", "left").withColumn("coverage", F.coalesce("_n", F.lit(1).cast("long"))).drop("_n")
    ranked = ranked.orderBy(F.col("coverage").desc(), F.col("price").asc(), F.col("id").asc())
    return ranked if limit is None else ranked.limit(limit)


def _prepared(offers: DataFrame, query: str) -> DataFrame:
    return offers.withColumns(
        {
            "_want": G.trigrams(F.lit(query)),
            "_title": G.ordered_trigrams(F.col("title")),
            "_name": G.ordered_trigrams(F.col("normalized_name")),
            "_core": G.trigrams(F.col("core")),
        }
    )


def _bare(df: DataFrame) -> DataFrame:
    return df.drop("_want", "_title", "_name", "_core")


def precise(offers: DataFrame, query: D.Query) -> DataFrame:
    """Rows with all concepts of the query, or with its text in title, name or core, with a tier
    (0 best) and a relevance."""
    q = query.normalized or query.text.lower()
    concepts = T.contains_all(F.col("search_tokens"), query.required)
    in_title, in_name, in_core = (T.contains_text(F.col(c), query.text) for c in ("title", "normalized_name", "core"))
    found = offers.filter((F.col("price") > 0) & (concepts | in_title | in_name | in_core))
    tier = F.when(F.lower("core") == q, 0).when(concepts, 1).when(in_name, 2).when(in_core, 3).otherwise(4)
    ready = _prepared(found, q)
    title, name = F.array_distinct("_title"), F.array_distinct("_name")
    relevance = F.greatest(G.overlap(title, F.col("_want")), G.overlap(name, F.col("_want")), G.overlap(F.col("_core"), F.col("_want")), G.word_overlap(F.col("_want"), F.col("_title")))
    return _bare(ready.withColumns({"tier": tier, "relevance": relevance}))


def fuzzy(offers: DataFrame, query: D.Query) -> DataFrame:
    """Rows whose title, name or core is like the query, with a relevance."""
    q = query.normalized or query.text.lower()
    # a row that is like the query shares that part of the query's trigrams: a cheap test before
    shared = lambda c: F.size(F.array_intersect(F.col("_want"), F.col(c)))
    n = F.size("_want")
    near = _prepared(offers.filter("price > 0"), q).filter((shared("_title") >= LIKE * n) | (shared("_core") >= LIKE * n) | (shared("_name") >= LIKE_WORD * n))
    ready = near.withColumns(
        {
            "_s_title": G.overlap(F.array_distinct("_title"), F.col("_want")),
            "_s_core": G.overlap(F.col("_core"), F.col("_want")),
            "_w_title": G.word_overlap(F.col("_want"), F.col("_title")),
            "_w_name": G.word_overlap(F.col("_want"), F.col("_name")),
        }
    )
    like = ready.filter((F.col("_s_core") >= LIKE) | (F.col("_s_title") >= LIKE) | (F.col("_w_title") >= LIKE_WORD) | (F.col("_w_name") >= LIKE_WORD))
    scored = like.withColumn("relevance", F.greatest("_s_title", "_s_core", "_w_title"))
    return _bare(scored).drop("_s_title", "_s_core", "_w_title", "_w_name")


def search(offers: DataFrame, query: D.Query, limit: int | None = None) -> DataFrame:
    """Precise hits, and if they are fewer than three and the query is one concept, fuzzy ones after
    them. The count gates the second pass inside one plan. ``rank`` orders the hits: a struct, so
    that no task has to number them all (``with_rank`` numbers a page)."""
    first = precise(offers, query)
    if limit is not None:
        first = first.orderBy("tier", F.col("relevance").desc(), "price", "id").limit(limit)
    hits = first.withColumn("pass", F.lit(0))
    if len(query.required) <= 1:
        few = first.limit(FUZZY_BELOW).agg((F.count(F.lit(1)) < FUZZY_BELOW).alias("_few"))
        second = fuzzy(offers, query).withColumns({"tier": F.lit(5), "pass": F.lit(1)})
        second = second.join(F.broadcast(few), F.col("_few")).drop("_few").join(first.select("id"), "id", "left_anti")
        hits = hits.unionByName(second)
    return hits.withColumn("rank", F.struct("pass", "tier", (-F.col("relevance")).alias("irrelevance"), "price", "id"))


def autocomplete(offers: DataFrame, query: D.Query, limit: int = 8, overfetch: int = 6) -> DataFrame:
    """Distinct titles nearest to what was typed: the nearest ``limit * overfetch`` rows first, then
    one row a title, then ``limit`` of these. Ties go by id."""
    q = query.normalized or query.text.lower()
    ready = offers.filter("price > 0").withColumns({"_want": G.trigrams(F.lit(q)), "_title": G.ordered_trigrams(F.col("title"))})
    concepts = T.contains_all(F.col("search_tokens"), query.required)
    ready = ready.filter(concepts | (F.size(F.array_intersect("_want", "_title")) >= LIKE_TYPING * F.size("_want")))
    ready = ready.withColumn("_near", G.word_overlap(F.col("_want"), F.col("_title")))
    ready = ready.filter(T.contains_all(F.col("search_tokens"), query.required) | (F.col("_near") >= LIKE_TYPING))
    # the distance has the title as its first argument: how much of the title the query covers
    ready = ready.withColumns({"_set": F.array_distinct("_title"), "_typed": G.ordered_trigrams(F.lit(q))})
    near = ready.withColumn("distance", F.lit(1.0) - G.word_overlap(F.col("_set"), F.col("_typed")))
    first = near.select("id", "title", "price", "vendor_name", "distance").orderBy("distance", "id").limit(limit * overfetch)
    one = first.groupBy(F.lower(F.trim("title")).alias("_key")).agg(F.min(F.struct("distance", "id", "title", "price", "vendor_name")).alias("_first"))
    return one.select("_first.*").orderBy("distance", "id").limit(limit)


def postings(offers: DataFrame, column: str = "title") -> DataFrame:
    """(trigram, id, size): an index to look rows up by trigram; ``size`` is the row's number."""
    grams = G.trigrams(F.col(column))
    return offers.select("id", F.size(grams).alias("size"), F.explode(grams).alias("trigram"))


def candidates(index: DataFrame, text: str, least: float) -> DataFrame:
    """(id) of rows whose similarity to ``text`` can reach ``least``: an equi-join and a count."""
    spark = index.sparkSession
    want = spark.range(1).select(F.explode(G.trigrams(F.lit(text))).alias("trigram"))
    total = spark.range(1).select(F.size(G.trigrams(F.lit(text)))).first()[0]  # of the query's text alone
    both = index.join(F.broadcast(want), "trigram").groupBy("id", "size").agg(F.count(F.lit(1)).alias("_both"))
    return both.filter(F.col("_both") >= least * (F.col("size") + total - F.col("_both"))).select("id")


# Abbreviations of a whole query.
ABBREVIATIONS = {
    "vitc": "vitamin c", "vitd": "vitamin d", "vitb": "vitamin b", "vit": "vitamin", "d3": "vitamin d3", "b12": "vitamin b12", "k2": "vitamin k2",
    "calc": "calcium", "mag": "magnesium", "zn": "zinc", "fe": "iron", "prob": "probiotic", "omega3": "omega-3", "coq10": "coenzyme q10",
    "bcaa": "branched chain amino acids",
}


def expand_abbreviation(c: Column) -> Column:
    from offerweave.functions.measures import look_up

    return look_up(F.lower(F.trim(c)), ABBREVIATIONS)


def quick_search(offers: DataFrame, text: str, least: float | None = None, most: float | None = None, vendors: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The older one-pass search: the first test that holds scores a row, similarity before the
    start of a word; then by price and id."""
    q = text.strip().lower()
    literal = "".join("\\" + c if not c.isalnum() and c != " " else c for c in q)
    some = offers
    if least is not None:
        some = some.filter(F.col("price") >= least)
    if most is not None:
        some = some.filter(F.col("price") <= most)
    if vendors is not None:
        some = some.filter(F.col("vendor_id").isin(*vendors))
    ready = some.withColumns({"_want": G.trigrams(F.lit(q)), "_have": G.trigrams(F.col("title"))}).withColumn("_like", G.overlap(F.col("_have"), F.col("_want")))
    title = F.lower(F.coalesce("title", F.lit("")))
    token = F.coalesce(F.array_contains("search_tokens", F.lit(q)), F.lit(False))
    word, inside = title.rlike(r"(?U)\b" + literal), F.contains(title, F.lit(q))
    in_name, in_brand = T.contains_text(F.col("normalized_name"), q), T.contains_text(F.col("brand"), q)
    start = title.startswith(q)
    score = (
        F.when(title == q, 5000)
        .when(start, 4500)
        .when(token, 4000)
        .when(F.col("_like") > 0.3, F.round(3000 + F.col("_like") * 1000).cast("int"))
        .when(word, 3500)
        .when(inside, 2000)
        .when(in_name, 1500)
        .when(in_brand, 1000)
        .otherwise(100)
    )
    hit = start | token | (F.col("_like") > 0.2) | word | inside | in_name | in_brand
    found = ready.filter(hit).withColumn("relevance_score", score)
    return found.select("id", "title", "price", "vendor_id", "vendor_name", "brand", "relevance_score").orderBy(F.col("relevance_score").desc(), "price", "id").limit(limit)
