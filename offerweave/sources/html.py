"""Product pages and sitemaps as text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerweave.functions.hygiene import decode_entities, parse_price


def sitemap_links(pages: DataFrame) -> DataFrame:
    """(link, kind) of sitemaps (url, body): kind is ``sitemap`` for links of an index, else ``page``.
    Links in robots.txt count as sitemaps."""
    locs = F.transform(F.regexp_extract_all("body", F.lit(r"(?is)<loc>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</loc>"), 1), F.trim)
    robots = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)
    index = F.col("body").rlike("(?i)<sitemapindex")
    both = F.concat(F.transform(locs, lambda u: F.struct(u.alias("link"), index.alias("_index"))), F.transform(robots, lambda u: F.struct(u.alias("link"), F.lit(True).alias("_index"))))
    rows = pages.select(F.explode(both).alias("l")).select(decode_entities(F.col("l.link")).alias("link"), F.when(F.col("l._index"), "sitemap").otherwise("page").alias("kind"))
    return rows.distinct()


def product_links(links: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    out = links.filter("kind = 'page'")
    if include:
        out = out.filter(F.col("link").rlike(include))
    if exclude:
        out = out.filter(~F.col("link").rlike(exclude))
    return out.select("link")


def _find_product(node):
    """The first node of type Product, depth first, also inside @graph and lists."""
    if isinstance(node, list):
        return next((p for x in node if (p := _find_product(x))), None)
    if isinstance(node, dict):
        kind = node.get("@type")
        if "Product" in (kind if isinstance(kind, list) else [kind]):
            return node
        return next((p for x in node.values() if isinstance(x, (dict, list)) and (p := _find_product(x))), None)
    return None


def _offer_price(offers) -> str:
    for o in offers if isinstance(offers, list) else [offers]:
        if isinstance(o, dict):
            for key in ("price", "lowPrice"):
                if o.get(key) not in (None, ""):
                    return str(o[key])
            if (inner := o.get("priceSpecification")) and (p := _offer_price(inner)):
                return p
    return ""


def _text(x) -> str:
    x = x[0] if isinstance(x, list) and x else x
    x = (x.get("name") or x.get("url") or "") if isinstance(x, dict) else x
    return "" if x is None or isinstance(x, (list, bool)) else str(x)


def _json_ld_products(blocks: pd.Series) -> pd.DataFrame:
    out = []
    for texts in blocks:
        found = None
        for t in texts if texts is not None else []:
            try:
                found = _find_product(json.loads(re.sub(r"[\x00-\x1f]", " ", t)))
            except ValueError:
                continue
            if found:
                break
        found = found or {}
        out.append((_text(found.get("name")), _offer_price(found.get("offers")), _text(found.get("category")), _text(found.get("image"))))
    return pd.DataFrame(out, columns=["title", "price", "category", "image"])


def json_ld_product(blocks: Column) -> Column:
    """The product of a page's JSON-LD blocks; nodes nest without bound, so no path finds it."""
    return F.pandas_udf(_json_ld_products, "title string, price string, category string, image string")(blocks)


def _meta(html: Column, name: str) -> Column:
    """Content of the meta tag with this property or name, whichever attribute comes first."""
    a = F.regexp_extract(html, rf"(?is)<meta[^>]*(?:property|name)=[\"']{re.escape(name)}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1)
    b = F.regexp_extract(html, rf"(?is)<meta[^>]*content=[\"']([^\"']*)[\"'][^>]*(?:property|name)=[\"']{re.escape(name)}[\"']", 1)
    return F.coalesce(F.nullif(a, F.lit("")), F.nullif(b, F.lit("")))


def page_title(html: Column) -> Column:
    return F.trim(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def parse_products(pages: DataFrame) -> DataFrame:
    """Products of pages (url, html): JSON-LD, then meta tags, then microdata. A price that the shop
    renders on the page goes before the others if it is positive."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    blocks = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), 1)
    rows = pages.withColumn("_ld", json_ld_product(blocks))
    html = F.col("html")
    prop = lambda n: blank(F.regexp_extract(html, rf"(?is)itemprop=[\"']{n}[\"'][^>]*content=[\"']([^\"']*)[\"']", 1))
    name = blank(F.regexp_replace(F.regexp_extract(html, r"(?is)itemprop=[\"']name[\"'][^>]*>(.*?)<", 1), "<[^>]+>", ""))
    rendered = F.regexp_extract(html, r"(?is)<p class=[\"'][^\"']*price[^\"']*[\"'][^>]*>.*?(?:<ins[^>]*>)?.*?<bdi>\s*([\d.,]+)", 1)
    magento = F.regexp_extract(html, r"(?is)data-price-amount=[\"']([\d.]+)[\"'][^>]*data-price-type=[\"']finalPrice[\"']", 1)
    stated = F.coalesce(blank(F.col("_ld.price")), blank(magento), _meta(html, "product:price:amount"), _meta(html, "og:price:amount"), prop("price"))
    number = F.when(stated.rlike(r"^\d+(\.\d+)?$"), F.floor(stated.try_cast("double") + 0.5)).otherwise(parse_price(stated))
    shown = parse_price(rendered)
    return rows.select(
        "url",
        decode_entities(F.coalesce(blank(F.col("_ld.title")), _meta(html, "og:title"), name, blank(page_title(html)))).alias("title"),
        F.when(shown > 0, shown).otherwise(F.coalesce(number, F.lit(0.0))).alias("price"),
        F.coalesce(blank(F.col("_ld.category")), _meta(html, "product:category"), F.lit("")).alias("category"),
        F.coalesce(blank(F.col("_ld.image")), _meta(html, "og:image"), prop("image"), F.lit("")).alias("thumbnail"),
    )
