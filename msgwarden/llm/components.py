"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes in `links` (a, b: long): `component` is the smallest node reachable.

    Every round hangs each node's larger neighbours, then its smaller ones, on the smallest node it sees; the links end
    as stars after about log2(diameter) rounds. A round is two aggregates of minima, combined before the shuffle, and two
    joins whose hot nodes are split by the skew join; no node's neighbours are gathered. Null ends are ignored.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, state = kept(edges), None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(b % 1000003)")).first()
        if found == state or not found[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select("b", "b").distinct()
            )
        state, edges = found, kept(_small_star(_large_star(edges)))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("at"), F.least("a", "least").alias("least"))
    return both.where("b > a").join(least, F.col("a") == F.col("at")).select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("at"), "least")
    moved = edges.join(least, F.col("a") == F.col("at")).where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least).distinct()
