"""Connected components by alternating large-star and small-star rounds.

Each round is joins and partial aggregates over the edges; nothing is
collected, and each round is written to the shared checkpoint folder.  The
rounds needed grow with the logarithm of the largest component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoofscope.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours of a node move to its smallest neighbour.
    Small: smaller neighbours of a node, and the node, do."""
    if large:
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    low = around.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
    met = around.join(low, "u")
    moved = met.filter(F.col("v") > F.col("u")) if large else met
    out = moved.select(F.col("v").alias("u"), F.col("low").alias("v"))
    if not large:
        out = out.union(low.select("u", F.col("low").alias("v")))
    return out.filter(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: every node that an edge (a, b) names, with the smallest node
    of its component.  Self-links, repeated and reversed edges are welcome;
    edges with a NULL end are not edges."""
    e = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        e = staged(_star(_star(e, True), False))
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
