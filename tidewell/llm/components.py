"""Connected components of an edge list that may be larger than any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b: long, any order, repeats allowed).

    Large-star and small-star rounds in turn: every node's larger neighbours, then all its neighbours and itself, are
    tied to its smallest neighbour. Edges never grow beyond their first number, and each round is cut, so a lost
    executor costs a round at most.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = cut(edges, "components")
    while True:
        # large star: for node u with smallest neighbour m (or itself), each larger neighbour v gets the edge (v, m)
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u")
        larger = current.select(F.col("a").alias("v"), F.col("b").alias("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # small star: for node u, each smaller neighbour and u itself get an edge to the smallest of them
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        following = cut(smaller, "components")
        # done when the edges are stars: no node is both a child and a root, and no child has two roots
        roots = following.select(F.col("b").alias("a")).distinct()
        if following.join(roots, "a", "left_semi").isEmpty() and following.groupBy("a").count().filter("count > 1").isEmpty():
            return following.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("a").alias("node"), F.col("a").alias("component")))
        current = following
