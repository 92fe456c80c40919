"""Scraped files: the latest of each shard as rows, rows as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerweave.functions.hygiene import clean_title, is_product, is_resolvable, parse_price
from offerweave.schemas import SNAPSHOT_CSV

_DATED = r"^(.*)_(\d{4}-\d{2}-\d{2})\.csv$"


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> DataFrame:
    """(path, name) of the files in a folder; names only, no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path")
    return files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))


def latest_files(files: DataFrame) -> DataFrame:
    """The file with the latest date of each shard; a name without a date is its own shard."""
    dated = F.regexp_extract("name", _DATED, 2)
    shard = F.when(dated != "", F.regexp_extract("name", _DATED, 1)).otherwise(F.col("name"))
    place = F.row_number().over(Window.partitionBy(shard).orderBy(dated.desc(), "name"))
    return files.withColumn("_at", place).filter("_at = 1").drop("_at")


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of files with a header: quotes doubled inside quotes, lines within them kept. Rows that
    are short or without a title are left out. Adds the file's name."""
    schema = SNAPSHOT_CSV + ", _bad string"
    rows = spark.read.schema(schema).csv(paths, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    whole = rows.filter("_bad is null or size(split(_bad, ',')) >= 8").filter(F.trim(F.coalesce("title", F.lit(""))) != "")
    return whole.drop("_bad").withColumn("file", F.col("_metadata.file_name"))


def fresh_rows(raw: DataFrame) -> DataFrame:
    """Clean products of scraped rows: titles and prices parsed, junk and dead links left out."""
    ready = raw.withColumns({"title": clean_title(F.col("title")), "price": parse_price(F.col("price"))})
    return ready.filter(is_product(F.col("title"), F.col("price")) & is_resolvable(F.col("link")))


def write_csv(rows: DataFrame, path: str, partition: list[str] = (), mode: str = "overwrite") -> None:
    """Files with a header; text with commas, quotes or line ends is quoted."""
    rows.write.mode(mode).partitionBy(*partition).csv(path, header=True, quote='"', escape='"')


def write_groups(products: DataFrame, groups: DataFrame, folder: str) -> None:
    """A dump for review: products as CSV, groups as JSON."""
    columns = ["id", "vendor_name", "group_key", "group_method", "group_display", "group_size", "form", "brand", "core", "title"]
    write_csv(products.select(*columns), f"{folder}/products")
    groups.write.mode("overwrite").json(f"{folder}/groups")


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> DataFrame:
    """Copy Parquet tables; the number of rows of each copy."""
    from offerweave.operators.audit import counts

    for name in names:
        spark.read.parquet(f"{source}/{name}").write.mode("overwrite").parquet(f"{target}/{name}")
    return counts(**{name: spark.read.parquet(f"{target}/{name}") for name in names})
