"""Connected components of an edge table, by alternating large and small stars.

Each round rewires every vertex to the least neighbour it knows; after a
number of rounds that grows with the logarithm of the graph's size all
components are stars.  Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _mark(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return int(r["n"]), int(r["h"])


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with what ``least`` (a, m, n) says of their ``a``.  The centre of
    a large star is broadcast, so its edges stay where they are."""
    if total <= common.hot_limit(total):  # no vertex can be hot
        return edges.join(least.drop("n"), "a")
    return common.join_groups(edges, least, ["a"], "n", total).drop("n")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node
    of the component.  Loops, repeats and nulls in the input don't matter; an
    empty table gives an empty result."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = common.stash(edges, "edges")
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.filter("b > a"), least, 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, low, 2 * mark[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = common.stash(small, "edges")
        now = _mark(new)
        common.unstash(edges)
        edges = new
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
