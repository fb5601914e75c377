"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import join_hot, written


def _star(edges: DataFrame, both: bool, total: int) -> DataFrame:
    """Links (a, b), a > b: large star (``both``) moves larger neighbours to the smallest, small star the others."""
    if both:
        edges = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    joined = join_hot(edges, least, ["a"], "n", total=2 * total)
    if both:
        m = F.least("a", "m")
        moved = joined.filter("b > a").select(F.col("b").alias("a"), m.alias("b"))
    else:
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of any orderable type → (node, label): the smallest node that each linked node reaches.

    Each round is two grouped joins over at most as many links as before and the rounds grow with the
    logarithm of the longest chain; no group is ever held in one task, and a node with a large share of all links
    does not bring them into one.  Empty links give an empty table; loops and nulls are left out; repeated links count
    once.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    while True:
        total = edges.count()
        large = written(_star(edges, True, total), "edges")
        after = written(_star(large, False, total), "edges")
        if after.count() == total and after.exceptAll(edges).isEmpty():
            break
        edges = after
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
