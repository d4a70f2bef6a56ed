"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tickloom.functions.lineage import cut


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join of two narrow tables, which adaptive execution splits where a key is hot.

    Chains of many small joins would else each leave a broadcast table, its job and its threads on the driver.
    """
    return left.join(right.hint("merge"), on, how)


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A written table and its number of rows, which the write itself counts."""
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, seen.get["n"]


def _stars(links: DataFrame) -> bool:
    """Whether every node hangs on one other node, which itself hangs on none."""
    up = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    down = links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    seen = up.unionByName(down).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): component is the smallest node that it reaches.

    Two steps keep what is connected connected: every node hangs its larger neighbours on its smallest neighbour, then its
    smaller ones.  They alternate until only stars are left, whose centres are their smallest nodes; links that are stars
    from the start need no step.  The number of rounds grows with the logarithm of the longest path.  Both steps are an
    aggregate, combined before its shuffle, and a merge join of narrow rows.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(links):
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = merge_join(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Links now lead from a larger to a smaller node.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = merge_join(large, least, "a")
        links = cut(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
