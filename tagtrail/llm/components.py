"""Connected components of a table of links, without collecting nodes or links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tagtrail.session import staged


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node that has a link; the component is the smallest node that links lead to.

    Each round points every neighbour of a node to the smallest node around it (large star), then every node to its
    smallest smaller neighbour (small star). Groups are reduced by ``min`` before the shuffle, a hub with very many
    links is only ever an aggregate and a join key. Rounds end when no edge changes; each is a written table.
    """
    edges = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = staged(moved.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
