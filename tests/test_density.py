"""Density clusters against all pairs in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import density as D


def plain(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo, label[i] = [i], i
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                label[j] = i
                todo.append(j)
    for i in np.flatnonzero(~core):
        own = label[near[i] & core]
        label[i] = own.min() if len(own) else -1
    return label.tolist()


@pytest.mark.parametrize(("d", "n", "eps", "least"), [(1, 120, 0.02, 3), (2, 300, 0.08, 4), (3, 200, 0.25, 5), (2, 150, 0.3, 2)])
def test_clusters_equal_all_pairs(spark, d, n, eps, least):
    rng = np.random.default_rng(d * n)
    x = np.concatenate([rng.random((n - 60, d)), rng.normal(0.5, eps / 3, (40, d)), np.repeat(rng.random((4, d)), 5, axis=0)])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, " + ", ".join(f"x{i} double" for i in range(d)))
    got = {r["id"]: r["cluster"] for r in D.density_clusters(df, "id", [f"x{i}" for i in range(d)], eps, least).collect()}
    assert [got[i] for i in range(len(x))] == plain(x, eps, least)


def test_crowds_end_without_their_pairs(spark):
    crowd = spark.range(100_000).select("id", F.lit(0.5).alias("a"), F.lit(0.5).alias("b"))
    wide = spark.range(100_000, 160_000).select("id", (F.lit(0.9) + F.rand(1) * 0.1).alias("a"), (F.lit(0.9) + F.rand(2) * 0.1).alias("b"))
    few = spark.createDataFrame([(200_000, 0.55, 0.5), (200_001, 0.2, 0.2), (200_002, None, 0.5), (200_003, 0.5, float("nan"))], "id long, a double, b double")
    got = D.density_clusters(crowd.unionByName(wide).unionByName(few), "id", ["a", "b"], 0.06, 5).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert {r["cluster"]: r["n"] for r in got} == {0: 100_001, 100_000: 60_000, -1: 3}


def test_no_points(spark):
    df = spark.createDataFrame([], "id long, a double")
    assert D.density_clusters(df, "id", ["a"], 1.0, 2).count() == 0
