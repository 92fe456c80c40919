"""Map services' answers as places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OSM = (
    "struct<elements: array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>>"
)
_TOMTOM = (
    "struct<results: array<struct<id: string, poi: struct<name: string, phone: string, url: string, categories: array<string>>, "
    "address: struct<freeformAddress: string, municipality: string, postalCode: string, countrySubdivision: string>, position: struct<lat: double, lon: double>>>>"
)


def _tag(*names):
    """The first tag that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(F.col("e.tags"), F.lit(n))), F.lit("")) for n in names], F.lit(""))


def osm_places(answers: DataFrame) -> DataFrame:
    """Named elements with coordinates, one row for each id, in order of name."""
    e = answers.select(F.explode(F.from_json("json", _OSM)["elements"]).alias("e"))
    lat, lon = F.coalesce("e.lat", "e.center.lat"), F.coalesce("e.lon", "e.center.lon")
    street = F.trim(F.concat_ws(" ", F.nullif(_tag("addr:street"), F.lit("")), F.nullif(_tag("addr:housenumber"), F.lit(""))))
    rows = e.select(
        F.concat_ws("/", "e.type", "e.id").alias("id"), _tag("name", "name:sr", "brand", "operator").alias("name"), lat.alias("latitude"), lon.alias("longitude"),
        street.alias("address"), _tag("addr:city", "addr:place").alias("locality"), _tag("addr:postcode").alias("postcode"), _tag("phone", "contact:phone").alias("phone"),
        _tag("website", "contact:website").alias("website"), _tag("opening_hours").alias("hours"), _tag("amenity", "shop", "healthcare").alias("kind"),
    )
    kept = rows.filter("name <> '' and latitude is not null and longitude is not null")
    one = kept.groupBy("id").agg(F.min(F.struct(*[c for c in kept.columns if c != "id"])).alias("r")).select("id", "r.*")
    return one.orderBy(F.lower("name"), "id")


def tomtom_places(answers: DataFrame) -> DataFrame:
    """Results, one row for each id; without an id, for each name and spot."""
    r = answers.select(F.explode(F.from_json("json", _TOMTOM)["results"]).alias("r"))
    key = F.coalesce(F.nullif(F.col("r.id"), F.lit("")), F.concat_ws(":", "r.poi.name", "r.position.lat", "r.position.lon"))
    rows = r.select(
        key.alias("id"), F.col("r.poi.name").alias("name"), F.col("r.position.lat").alias("latitude"), F.col("r.position.lon").alias("longitude"),
        F.col("r.address.freeformAddress").alias("address"), F.col("r.address.municipality").alias("locality"), F.col("r.address.postalCode").alias("postcode"),
        F.col("r.poi.phone").alias("phone"), F.col("r.poi.url").alias("website"), F.array_join("r.poi.categories", ", ").alias("kind"),
    )
    return rows.groupBy("id").agg(F.min(F.struct(*[c for c in rows.columns if c != "id"])).alias("r")).select("id", "r.*")


def split_cells(cells: DataFrame, full: int, deepest: int) -> tuple[DataFrame, DataFrame]:
    """(quarters of cells that came back full and may be split, cells that are full at the deepest
    level). Cells have south, west, north, east, depth and found."""
    full_cells = cells.filter(F.col("found") >= full)
    mid_lat, mid_lon = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
    box = lambda s, w, n, e: F.struct(s.alias("south"), w.alias("west"), n.alias("north"), e.alias("east"))
    s, w, n, e = (F.col(c) for c in ("south", "west", "north", "east"))
    quarters = F.array(box(s, w, mid_lat, mid_lon), box(s, mid_lon, mid_lat, e), box(mid_lat, w, n, mid_lon), box(mid_lat, mid_lon, n, e))
    split = full_cells.filter(F.col("depth") < deepest).select(F.explode(quarters).alias("q"), (F.col("depth") + 1).alias("depth")).select("q.*", "depth")
    return split, full_cells.filter(F.col("depth") >= deepest)


#: Days of the week from Sunday.
DAYS = ["Ned", "Pon", "Uto", "Sre", "Čet", "Pet", "Sub"]
OPENING = "struct<mode: string, timeRanges: array<struct<startTime: struct<date: string, hour: int, minute: int>, endTime: struct<date: string, hour: int, minute: int>>>>"


def opening_hours(hours):
    """Lines of days and hours of an OPENING struct; its mode if there is none."""
    clock = lambda t: F.when(t["hour"].between(0, 23) & t["minute"].between(0, 59), F.format_string("%02d:%02d", t["hour"], t["minute"]))
    days = F.array(*[F.lit(d) for d in DAYS])

    def day(t):
        date = t["date"].try_cast("date")
        return F.when(F.trim(F.coalesce(t["date"], F.lit(""))) == "", F.lit("")).when(date.isNotNull(), F.get(days, F.dayofweek(date) - 1)).otherwise(t["date"])

    def line(r):
        a, b, x, y = clock(r["startTime"]), clock(r["endTime"]), day(r["startTime"]), day(r["endTime"])
        to = F.when((y == "") | (x == y), b).otherwise(F.concat_ws(" ", y, b))
        return F.when(a.isNotNull() & b.isNotNull(), F.trim(F.concat(x, F.lit(" "), a, F.lit("-"), to)))

    lines = F.filter(F.transform(hours["timeRanges"], line), lambda x: x.isNotNull())
    return F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.trim(hours["mode"]), F.lit(""))


def full_address(*parts):
    """Parts that aren't blank, joined by commas."""
    return F.concat_ws(", ", *[F.nullif(F.trim(F.coalesce(p, F.lit(""))), F.lit("")) for p in parts])


def humanized(value):
    """fast_food as Fast Food."""
    ws = F.filter(F.split(F.replace(F.coalesce(value, F.lit("")), F.lit("_"), F.lit(" ")), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")
