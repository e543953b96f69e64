"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node u onto its smallest one m: those above u, or (small) those below it and u itself.

    The minimum is a partial aggregate and comes back to the pairs by a join that adaptive execution can split, so a
    node with very many neighbours does not end in one task.
    """
    if small:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        own = low.select("u", "m")
        return pairs.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own.select("u", F.col("m").alias("v"))).distinct()
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected(links: DataFrame, rounds: int = 100) -> DataFrame:
    """rep, component: each linked node with the smallest node of its component; links have columns a and b.

    Pairs are kept as (u, v) with u > v. It ends when a round changes nothing, which is when every pair leads to the
    smallest node. Each round is written to shared storage.
    """
    now = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "pairs")
    for _ in range(rounds):
        # done: all pairs are stars, that is no centre hangs on another node and no node hangs on two
        centres, leaves = now.select(F.col("v").alias("x")).distinct(), now.groupBy("u").count()
        if centres.join(leaves, F.col("x") == F.col("u"), "left_semi").isEmpty() and leaves.filter("count > 1").isEmpty():
            return now.select(F.col("u").alias("rep"), F.col("v").alias("component"))
        now = materialize(_star(_star(now, False), True), "pairs")
    raise RuntimeError("components did not settle")
