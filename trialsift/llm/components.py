"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialsift.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of every node to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    low = low.select("n", F.least("n", "m").alias("m"))
    larger = both.where(F.col("v") > F.col("u"))
    return larger.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the smallest of them."""
    low = edges.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    moved = edges.join(low, F.col("u") == F.col("n")).where(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
        low.select(F.col("n").alias("u"), F.col("m").alias("v"))
    )


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node that an edge joins to another.

    Nodes may be of any type with an order.  Edges with a NULL end, loops and repeated edges change
    nothing; an empty table has no components.  Each round is one written table, so a lost executor
    costs at most a round; the number of rounds grows as the logarithm of the longest path.  A hub's
    edges are reduced to their minimum before the shuffle, and joined back by a join that Spark
    splits when one key is hot.
    """
    x, y = F.col(a), F.col(b)
    plain = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    current = cut_lineage(plain.distinct())
    mark = _mark(current)
    while mark[0]:
        # Written between the halves: each of them reads its input twice.
        spread = cut_lineage(_large_star(current).distinct())
        current = cut_lineage(_small_star(spread).distinct())
        last, mark = mark, _mark(current)
        if mark == last:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
