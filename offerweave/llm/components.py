"""Connected components by alternating large and small stars, in DataFrame operations.

Each round every node points its larger neighbours to its smallest one (large star), then its
smaller neighbours and itself to the smallest (small star). Rounds end when the edges no longer
change; their number grows with the logarithm of the component size. Each step is a written table,
so lineage stays short, and both inputs of each join are plain exchanges that adaptive execution
can split where one node has very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerweave.llm.shared import table


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b, long); root is the smallest node.

    Rows with a null end and loops are left out; an edge may be given twice or in both directions.
    """
    now = table(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before, state = None, _state(now)
    while state != before and state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least("u", F.min("v")).alias("r")))
        large = table(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("r").alias("v")).distinct())
        least = table(large.groupBy("u").agg(F.min("v").alias("r")))
        moved = large.join(least, "u").filter("v <> r").select(F.col("v").alias("u"), F.col("r").alias("v"))
        now = table(moved.unionByName(least.select("u", F.col("r").alias("v"))).distinct())
        before, state = state, _state(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
