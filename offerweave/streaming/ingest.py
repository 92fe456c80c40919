"""Snapshots as a stream: file drops merged into the catalog, watches judged as prices come.

An extension: the batch jobs in operators/ are the semantics, these run them per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerweave.operators.merge import cheapest_titles, upsert
from offerweave.schemas import SNAPSHOT_CSV
from offerweave.sources.snapshots import fresh_rows


def read_drops(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over files that appear in a folder."""
    return spark.readStream.schema(SNAPSHOT_CSV).options(header=True, multiLine=True, quote='"', escape='"', maxFilesPerTrigger=files_per_batch).csv(folder)


def merge_batch(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The catalog (title, vendor, price, category, link) after one batch."""
    fresh = fresh_rows(batch).withColumn("_order", F.monotonically_increasing_id())
    one = cheapest_titles(fresh, "_order").select("title", "vendor", "price", "category", "link")
    return upsert(old, one, ["title", "vendor"], overwrite=["price", "category", "link"])


def run_ingest(drops: DataFrame, catalog: str, checkpoint: str):
    """Merge all drops that are there and stop. Each batch writes a new version of the catalog; a
    batch that is run again writes the same version, so a lost driver does no harm."""

    def merge(batch: DataFrame, number: int):
        spark = batch.sparkSession
        if number == 0:
            old = spark.createDataFrame([], "title string, vendor string, price double, category string, link string")
        else:
            old = spark.read.parquet(f"{catalog}/version={number - 1}")
        merge_batch(old, batch).write.mode("overwrite").parquet(f"{catalog}/version={number}")

    return drops.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def lowest_by_window(prices: DataFrame, at: str, key: str, value: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Lowest value and number of points of each key in each window; points later than ``late`` are
    left out once the watermark has passed."""
    return prices.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.min(value).alias("low"), F.count(F.lit(1)).alias("points"))
