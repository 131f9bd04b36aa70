"""Connected components of a link table by contraction.

A round lets every vertex of the contracted graph point to its smallest neighbour (or itself),
shortens the pointers once, renames the ends of all links to what they point to and drops
links that became loops. Links, and with them the work, shrink from round to round. Tables
are written to the shared folder after each round; nothing but a row count comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.session import stage, unstage


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)``: every node of a link with the smallest node of its component.

    Loops and repeated or reversed links don't matter; links with a null end are left out.
    Without links the result is empty. The result is read from the shared folder.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    edges = stage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mapping = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to"))
        nearest = stage(nearest)
        second = nearest.select(F.col("node").alias("to"), F.col("to").alias("root"))
        point = stage(nearest.join(second, "to").select("node", "root"))
        at_a = point.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = point.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        renamed = edges.join(at_a, "a").join(at_b, "b").filter("ra <> rb")
        rest = stage(renamed.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if mapping is None:
            new = point
        else:
            follow = point.select(F.col("node").alias("root"), F.col("root").alias("__next"))
            joined = mapping.join(follow, "root", "left")
            new = stage(joined.select("node", F.coalesce("__next", "root").alias("root")))
            unstage(mapping, point)
        unstage(edges, nearest)
        edges, mapping = rest, new
    return mapping if mapping is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
