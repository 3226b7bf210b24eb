"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.settle import settled


def components(links: DataFrame, a: str, b: str, edges_at_most: int | None = None) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node with a link to another.

    Each turn joins a node's larger neighbours, then its smaller ones, to the smallest of
    them, until nothing changes: a logarithmic number of turns. Neighbours are reduced
    to their minimum before a shuffle and joined with it after, so a node may have any
    number of links. Null ends and links of a node to itself count for nothing. A turn makes at
    most twice as many rows as it reads. ``edges_at_most``: a count that ``links`` cannot exceed.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct()
    )
    edges, before = settled(edges, "components", edges_at_most), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("u"), "v", "m")
        edges = settled(
            small.select("u", F.col("m").alias("v"))
            .unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(),
            "components", 2 * now[0])
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
