"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v); root is the smallest node of its component.

    Each round joins every node's larger neighbours to its smallest one (large star),
    then its smaller neighbours (small star); rounds grow with the logarithm of the
    longest path. Every half round combines before the shuffle and is a written table.
    """
    pair = lambda a, b: [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    edges = written(edges.filter("u <> v").select(*pair("u", "v")).distinct(), "edges")
    before = _signature(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").filter("v <> m").select(*pair("v", "m")).union(least.select("u", "m"))
        edges = written(small.distinct(), "edges")
        after = _signature(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
