"""Connected components of an edge table, as alternating star contractions.

Large star: every node's larger neighbours are tied to the smallest node among
its neighbours and itself. Small star: a node's smaller neighbours and itself are
tied to the smallest of them. Repeated until the table stays as it is; each round
is a map-side combined minimum and an equi join, and the table is written to the
shared folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component is its smallest node."""
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, state = None, _state(now)
    while state != before:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter("a <> m").select("a", F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        now = stage(small, "edges")
        before, state = state, _state(now)
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
