"""Density clusters over a grid whose crowded cells need no pairs of points.

Cells have a diagonal of eps: points of one cell are neighbours of each other. A cell of
`least` points or more is all core; only points of sparser cells are compared with those
of the cells around. Whether two cells' cores are within eps is told from the boxes around
them, then around finer and finer parts of them where the boxes leave it open.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import written

#: Parts of a box along each side, a round; rounds after which boxes are as good as points.
PARTS, ROUNDS = 8, 15
BROADCAST_ROWS = 100_000


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _offsets(d: int) -> list[tuple[int, ...]]:
    """Cells that can have a point within eps of one of the cell at 0."""
    far = 1 + math.isqrt(d)
    return [o for o in product(range(-far, far + 1), repeat=d) if sum(max(abs(i) - 1, 0) ** 2 for i in o) <= d]


def _around(cell: str, offsets: Sequence[tuple[int, ...]]) -> Column:
    """The cells at these offsets from an array column."""
    each = [F.array(*[F.col(cell)[i] + F.lit(v).cast("long") for i, v in enumerate(o)]) for o in offsets]
    return F.explode(F.array(*each))


def _squared(a: str, b: str, d: int) -> Column:
    return reduce(lambda x, y: x + y, [(F.col(a)[i] - F.col(b)[i]) ** 2 for i in range(d)])


def _near(some: DataFrame, others: DataFrame, d: int, eps: float) -> DataFrame:
    """(id, others' columns) of points of `some` and of others within eps; others have cell and y."""
    met = some.select("id", "x", _around("cell", _offsets(d)).alias("cell")).join(others, "cell")
    return met.filter(_squared("x", "y", d) <= eps * eps).drop("x", "y", "cell")


def _boxes(points: DataFrame, part: Column, d: int) -> DataFrame:
    """(cell, part, lo, hi): the box around the points of each part of a cell."""
    ends = [f(F.col("x")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(d)]
    out = points.groupBy("cell", part.alias("part")).agg(*ends)
    return out.select("cell", "part", F.array(*[f"lo{i}" for i in range(d)]).alias("lo"), F.array(*[f"hi{i}" for i in range(d)]).alias("hi"))


def _linked_cells(core: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """(a, b) of cells with cores within eps of each other; a pair of cells comes once."""
    part = lambda n: F.transform("x", lambda v: F.floor(v * (float(PARTS**n) / side)))
    side_of = lambda df, n: df.withColumnsRenamed({"cell": n, "part": f"{n}_part", "lo": f"{n}_lo", "hi": f"{n}_hi"})
    half = [o for o in _offsets(d) if o > (0,) * d]
    boxes = written(_boxes(core, part(0), d), "boxes")
    pairs = side_of(boxes, "a").select("*", _around("a", half).alias("b")).join(side_of(boxes, "b"), "b")
    linked = None
    for n in range(ROUNDS + 1):
        gap = reduce(lambda x, y: x + y, [F.greatest(F.lit(0.0), F.col("a_lo")[i] - F.col("b_hi")[i], F.col("b_lo")[i] - F.col("a_hi")[i]) ** 2 for i in range(d)])
        most = reduce(lambda x, y: x + y, [F.greatest(F.col("a_hi")[i] - F.col("b_lo")[i], F.col("b_hi")[i] - F.col("a_lo")[i]) ** 2 for i in range(d)])
        told = written(pairs.withColumns({"__gap": gap, "__most": most}).filter(F.col("__gap") <= eps * eps).select("a", "b", "a_part", "b_part", ((F.col("__most") <= eps * eps) | F.lit(n == ROUNDS)).alias("sure")), "told")
        sure = told.filter("sure").select("a", "b").distinct()
        linked = sure if linked is None else linked.unionByName(sure)
        open_ = written(told.filter("not sure").join(sure, ["a", "b"], "left_anti").select("a", "b", "a_part", "b_part"), "open")
        if open_.isEmpty():
            break
        cells = open_.select(F.col("a").alias("cell")).union(open_.select("b")).distinct()
        finer = written(_boxes(core.join(_hinted(written(cells, "cells")), "cell", "left_semi"), part(n + 1), d), "boxes")
        within = finer.withColumn("whole", F.transform("part", lambda v: F.floor(v / PARTS)))
        sides = {c: side_of(within, c).withColumnRenamed("whole", f"{c}_whole") for c in ("a", "b")}
        pairs = open_.withColumnsRenamed({"a_part": "a_whole", "b_part": "b_whole"}).join(sides["a"], ["a", "a_whole"]).join(sides["b"], ["b", "b_whole"])
    return linked.distinct()


def density_clusters(points: DataFrame, key: str, coords: Sequence[str], eps: float, least: int) -> DataFrame:
    """(key, cluster): DBSCAN; cluster is the cluster's smallest core key, -1 for noise.

    A point counts itself among its neighbours; a point near cores of several clusters joins
    the one of the smallest core key. Points with a null or NaN coordinate are noise. Keys
    are different numbers.
    """
    d = len(coords)
    side = eps / math.sqrt(d) * (1 - 1e-12)
    x = F.array(*[F.col(c).cast("double") for c in coords])
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords])
    pts = written(points.filter(whole).select(F.col(key).alias("id"), x.alias("x")).withColumn("cell", F.transform("x", lambda v: F.floor(v / side))), "points")
    dense = _hinted(written(pts.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("cell"), "dense"))
    sparse = written(pts.join(dense, "cell", "left_anti"), "sparse")
    counts = _near(sparse, pts.select("cell", F.col("x").alias("y")), d, eps).groupBy("id").agg(F.count("*").alias("n"))
    able = written(counts.filter(F.col("n") >= least).select("id"), "able")
    core = written(pts.join(dense, "cell", "left_semi").select("id", "x", "cell").unionByName(sparse.join(able, "id", "left_semi").select("id", "x", "cell")), "core")
    cells = written(core.groupBy("cell").agg(F.min("id").alias("node")), "cells")
    name = lambda c: cells.select(F.col("cell").alias(c), F.col("node").alias(f"{c}_node"))
    links = _linked_cells(core, d, side, eps).join(name("a"), "a").join(name("b"), "b").select(F.col("a_node").alias("u"), F.col("b_node").alias("v"))
    roots = connected_components(links).withColumnRenamed("node", "of")
    label = written(cells.join(roots, F.col("node") == F.col("of"), "left").select("cell", F.coalesce("root", "node").alias("label")), "labels")
    inside = core.select("id", "cell").join(_hinted(label), "cell").select("id", "label")
    rest = sparse.join(able, "id", "left_anti")
    border = _near(rest, core.select("cell", F.col("x").alias("y")).join(_hinted(label), "cell"), d, eps).groupBy("id").agg(F.min("label").alias("label"))
    found = inside.unionByName(border)
    return points.select(F.col(key).alias("__of")).join(found, F.col("__of") == F.col("id"), "left").select(F.col("__of").alias(key), F.coalesce("label", F.lit(-1)).alias("cluster"))
