"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b`` of one type with an order, e.g. longs or structs).

    ``root`` is the smallest node reachable.  Alternating large-star and small-star steps: the
    first hangs each larger neighbour of a node on the smallest one, the second each
    smaller.  Both keep the components, the number of links never grows, and the
    rounds needed follow the logarithm of the longest path.  A centre with very many neighbours makes a
    join's key common on one side only, which adaptive execution splits.  Every round is written to
    the checkpoint folder, and ends when a round leaves the links as they were.
    """
    down = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    links = checkpoint(links.where("a <> b").select(*down("a", "b")).distinct())
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    last = sign(links)
    while last[0]:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = links.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least.withColumnRenamed("a", "u"), "u")
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(mins, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = checkpoint(small.union(mins.select("a", "m")).distinct())
        now = sign(links)
        if now == last:
            break
        last = now
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("b", "b"))
