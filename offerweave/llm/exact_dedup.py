"""Exact dedup by content sort, in DataFrame operations only.

Texts are range-partitioned by sampled splitters, sorted externally, and each run of neighbours
that are equal in full is one copy group. A splitter holds the head of a text, its digest and a
salt, not the text, so what the driver samples stays small however long texts are. The salt, dealt by doc_id,
keeps a group that holds a third of all rows from landing in one task: each salted part finds its
own smallest id and size, and the parts (at most ``salts`` a group, without their text) are then
combined by digest. There are as many salts as shuffle partitions, so a hot group spreads as wide as
the cluster is told to work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from offerweave.llm.shared import table

#: The least number of salts.
SALTS = 32
#: Characters of a text that splitters hold; the digest orders texts that share them.
HEAD = 64


def normalised(text):
    """Null as empty; every run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text equals empty text. The smallest id of a group stays; a null id counts as larger than
    any other and stays only if its group has no other id. Repeated rows with the id that stays
    each count in ``group_size`` and are each marked kept. An empty table gives no rows. Other
    columns are ignored, whatever their names. ``salts`` changes the plan, not the rows; if it is
    None, spark.sql.shuffle.partitions says it, or SALTS if that is less.
    """
    salts = salts or max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_norm"))
    rows = rows.select(
        "*",
        F.substring("_norm", 1, HEAD).alias("_head"),
        F.sha2("_norm", 256).alias("text_sha256"),
        F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"),
    )
    spread = rows.repartitionByRange("_head", "text_sha256", "_salt")
    part = Window.partitionBy("_head", "text_sha256", "_salt", "_norm")
    runs = spread.select(
        "_id",
        F.min("_id").over(part).alias("_least"),
        F.count(F.lit(1)).over(part).alias("_n"),
        F.row_number().over(part.orderBy(F.col("_id").asc_nulls_last())).alias("_at"),
        "text_sha256",
    )
    runs = table(runs)
    groups = (
        runs.filter("_at = 1")
        .groupBy("text_sha256")
        .agg(F.min("_least").alias("keep_id"), F.sum("_n").alias("group_size"))
    )
    joined = runs.select("_id", "text_sha256").join(table(groups), "text_sha256")
    return joined.select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
