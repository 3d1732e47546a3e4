"""Connected components of a graph that is held as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tables import keep


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = keep(_lowest(both).select("u", F.least("u", "m").alias("m")), "lowest")
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. In ``edges``, u > v."""
    low = keep(_lowest(edges), "lowest")
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Component of every node that has a link.

    ``links`` has two bigint columns, the ends of a link in either order; rows
    with a null, loops and repeated rows are ignored. Returns ``node`` and
    ``component``, the smallest node that can be reached from it (itself
    included), one row per node; no links give no rows.

    Large-star and small-star steps alternate until nothing changes. A step only
    takes minima, combined before the shuffle and written, and joins the links with
    them: a plain join of two tables, in which adaptive execution splits the links of
    a node that has very many. Every round is a written table.
    """
    a, b = links.columns
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges, before = keep(edges, "links"), None
    while True:
        size = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(size) == before or not size[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(size)
        edges = keep(_small_star(_large_star(edges)), "stars")
