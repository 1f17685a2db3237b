"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.session import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is hung on the node's smallest one."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return (
        links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        .union(least.select("u", F.col("m").alias("v")))
    )


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every node of `links` (u, v; any order) that is not its component's smallest.

    Every round is written to shared storage, so a lost executor repeats one round at most.
    Repeated links and links of a node to itself are allowed.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links, before = stored(links, "links"), None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark
        if mark[0] == 0:
            continue
        links = stored(_small_star(_large_star(links).distinct()).distinct(), "links")
