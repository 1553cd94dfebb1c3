"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmatide.session import staged


def _least(links: DataFrame, group: str, value: str) -> DataFrame:
    return links.groupBy(group).agg(F.least(F.min(value), F.col(group)).alias("least"))


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the node's least neighbour."""
    both = links.union(links.select("v", "u")).toDF("node", "other")
    return (
        both.join(_least(both, "node", "other"), "node")
        .filter("other > node")
        .select(F.col("other").alias("u"), F.col("least").alias("v")).distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    joined = links.join(links.groupBy("u").agg(F.min("v").alias("least")), "u")
    return (
        joined.select(F.col("v").alias("u"), F.col("least").alias("v"))
        .union(joined.select("u", F.col("least").alias("v")))
        .filter("u > v").distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable, for every node with a link to another.

    ``links`` has two long columns, without nulls; direction, repeats and links of a node to
    itself don't matter. Stars are joined until nothing changes, in a number of rounds that
    grows with the logarithm of the longest path. Each round aggregates before it joins, and
    is written to the shared folder, so that lineage stays short and a lost executor costs one
    round. Nothing but a row count and a checksum reaches the driver.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    seen = None
    while True:
        now = staged(_small_star(_large_star(now)), "stars")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v", "v").distinct())
