"""Connected components over a table of links, by alternating star steps on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmint.llm.staging import stage, unstage


def _large_star(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Link every larger neighbour of a node to the node's smallest neighbour or itself; the written minima come second.

    A node with many larger neighbours is a skewed key here. A written table joins as a plain shuffle, which adaptive
    execution can split.
    """
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(links: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u")
    rest = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every node that has a link: columns node and component.

    ``links`` has long columns u and v. Every step is a join and an aggregation on node ids, and every round is a
    written table in the shared folder; the driver sees a count and a checksum, never links or nodes. A node with
    many links is a skewed join key, which adaptive execution splits.
    """
    ends = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    current, mark = stage(ends, "links"), None
    while True:
        large, least = _large_star(current)
        stepped = stage(_small_star(large), "links")
        unstage(current, least)
        current = stepped
        found = current.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("u % 1000003 * 31 + v % 1000003"))).first()
        if tuple(found) == mark or not found[0]:
            break
        mark = tuple(found)
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
