"""Components, subclusters, motifs, preprocessing and silhouettes against NumPy."""

import numpy as np
import pytest
from oracle import DATA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from chronolith.operators import grams as G
from chronolith.operators import ml as M
from chronolith.plans import queries as plans


def traces(spark, n=60, d=7, seed=0, far=1e5):
    rng = np.random.default_rng(seed)
    x = far + rng.normal(size=(n, 3)) @ rng.normal(size=(3, d)) * [3] + rng.normal(size=(n, d)) * 0.1
    return x, spark.createDataFrame([(i, i % 4, [float(v) for v in t]) for i, t in enumerate(x)], "trial long, cluster int, trace array<double>").repartition(3)


def plain(x, k):
    mean = x.mean(0)
    u, s, vt = np.linalg.svd(x - mean, full_matrices=False)
    loads = vt[:k].T
    loads = loads * np.sign(loads[np.abs(loads).argmax(0), np.arange(k)])
    return mean, loads, (s**2 / (s**2).sum())[:k]


def test_components_equal_a_singular_value_decomposition_even_far_from_0(spark):
    x, df = traces(spark)
    mean, loads, shares = plain(x, 3)
    model, scored = G.fit_components(df.unionByName(df.limit(1).withColumn("trace", F.lit(None).cast("array<double>"))), "trace", 3)
    assert np.allclose(model.mean, mean) and np.allclose(model.loads, loads, atol=1e-5) and np.allclose(model.shares, shares, atol=1e-6)
    got = {r["trial"]: r["pcs"] for r in scored.filter("trace is not null").collect()}
    assert np.allclose([got[i] for i in range(len(x))], (x - mean) @ loads, atol=1e-4)
    assert np.allclose([r["importance"] for r in G.time_importance(model, spark, 2).orderBy("t").collect()], np.abs(loads[:, :2]).mean(1), atol=1e-5)


def test_traces_without_spread_have_no_shares(spark):
    df = spark.createDataFrame([(1, [2.0, 2.0]), (2, [2.0, 2.0])], "trial long, trace array<double>")
    assert G.fit_components(df, "trace", 2)[0].shares.tolist() == [0, 0]
    with pytest.raises(ValueError):
        G.fit_components(df.filter("false"), "trace", 1)


def test_lag_components_equal_those_of_all_windows(spark):
    x, df = traces(spark, 9, 12)
    windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(t, 5) for t in x])
    mean, loads, _ = plain(windows, 2)
    got = {(r["trial"], r["start"]): r["pcs"] for r in G.lag_components(df, "trace", 5, 2).collect()}
    want = {(i, s): (t[s : s + 5] - mean) @ loads for i, t in enumerate(x) for s in range(8)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-4) for k in want)


def one_parent(x, k, components):
    mean, loads, _ = plain(x, components)
    p = (x - mean) @ loads
    lo, hi = p[:, 0].min(), p[:, 0].max()
    c = np.zeros((k, components))
    c[:, 0] = lo + (hi - lo) * (np.arange(k) + 0.5) / k
    while True:
        sub = ((p[:, None] - c[None]) ** 2).sum(2).argmin(1)
        fresh = np.array([p[sub == j].mean(0) if (sub == j).any() else c[j] for j in range(k)])
        if np.allclose(fresh, c, atol=1e-9):
            return sub
        c = fresh


def test_subclusters_of_all_parents_equal_one_parent_at_a_time(spark):
    x, df = traces(spark, 160, far=10)
    few = spark.createDataFrame([(900, 77, [0.0] * 7), (901, None, [1.0] * 7), (902, 1, None)], "trial long, cluster int, trace array<double>")
    got = {r["trial"]: r["sub"] for r in G.subclusters(df.unionByName(few), 3).collect()}
    assert len(got) == 163 and got[900] is None and got[901] is None and got[902] is None
    for c in range(4):
        assert [got[i] for i in range(c, 160, 4)] == one_parent(x[c::4], 3, 3).tolist()


def test_a_thousand_parents_in_one_job(spark):
    df = spark.range(4000).select((F.col("id") % 1000).alias("cluster"), F.array(*[F.sin(F.col("id") * (j + 1)) + F.when(F.col("id") % 2000 < 1000, 9).otherwise(0) for j in range(4)]).alias("trace"), "id")
    got = G.subclusters(df, 2, components=2).groupBy("cluster").agg(F.count_distinct("sub").alias("subs"), F.count_distinct(F.when(F.col("id") % 2000 < 1000, F.col("sub"))).alias("near")).collect()
    assert len(got) == 1000 and {(r["subs"], r["near"]) for r in got} == {(2, 1)}


def test_motifs_that_were_planted_are_found_and_the_residual_never_grows(spark):
    rng = np.random.default_rng(4)
    shapes = np.array([[0, 1, 3, 1, 0, 0, 0, 0], [0, 0, 0, 0, 0, 2, 2, 0], [1, 0, 0, 0, 0, 0, 0, 1.0]])
    w = rng.random((200, 3)) * (rng.random((200, 3)) < 0.6)
    df = spark.createDataFrame([(i, [float(v) for v in t]) for i, t in enumerate(w @ shapes)], "trial long, x array<double>").repartition(3)
    m = G.fit_motifs(df, "x", 3, tol=1e-10)
    unit = shapes / np.sqrt((shapes**2).sum(1, keepdims=True))
    assert sorted(np.abs(m.shapes @ unit.T).argmax(1).tolist()) == [0, 1, 2] and (m.shapes @ unit.T).max(1).min() > 0.999
    assert m.explained > 0.9999 and all(b <= a * (1 + 1e-9) + 1e-9 for a, b in zip(m.residuals, m.residuals[1:], strict=False))
    got = {r["trial"]: r["w"] for r in df.withColumn("w", G.motif_weights(F.col("x"), m)).collect()}
    assert np.allclose(np.array([got[i] for i in range(200)]) @ m.shapes, w @ shapes, atol=1e-2) and min(min(v) for v in got.values()) >= 0


def test_nonnegative_least_squares_by_all_supports():
    import itertools

    rng = np.random.default_rng(1)
    h = rng.random((3, 6))
    x = rng.normal(size=(20, 6))
    got = G.nonnegative(h @ h.T, x @ h.T, np.zeros((20, 3)))
    for row, w in zip(x, got, strict=True):
        best = min(((row - np.where(np.isin(np.arange(3), s), 1, 0) * 0 @ h) if not s else row - np.maximum(np.linalg.lstsq(h[list(s)].T, row, rcond=None)[0], 0) @ h[list(s)] for n in range(4) for s in itertools.combinations(range(3), n)), key=lambda e: e @ e)
        e = row - w @ h
        assert e @ e <= best @ best + 1e-9


def test_preprocessor_fills_scales_and_projects(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(50, 5)) * [1, 2, 3, 4, 0] + 5
    holes = rng.random((50, 5)) < 0.2
    holes[:, 4] = False
    rows = [[i, *[None if h else float(v) for v, h in zip(r, hs, strict=True)]] for i, (r, hs) in enumerate(zip(x, holes, strict=True))]
    df = spark.createDataFrame(rows, "trial long, a double, b double, c double, d double, e double")
    got = {r["trial"]: r["features"] for r in G.fit_preprocessor(df, ["a", "b", "c"], ["d", "e"], 2).transform(df).collect()}
    filled = np.where(holes, [np.median(x[~holes[:, j], j]) for j in range(5)], x)
    std = np.where(filled.std(0) > 0, filled.std(0), 1)
    z = (filled - filled.mean(0)) / std
    mean, loads, _ = plain(z[:, :3], 2)
    assert np.allclose([got[i] for i in range(50)], np.c_[(z[:, :3] - mean) @ loads, z[:, 3:]], atol=1e-6)


def plain_silhouette(x, c):
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        same = (c == c[i]) & (np.arange(len(x)) != i)
        if not same.any():
            out.append(0.0)
            continue
        a, b = far[i, same].mean(), min(far[i, c == k].mean() for k in set(c.tolist()) - {c[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_euclidean_silhouette(spark):
    x, df = traces(spark, 70, far=1)
    c = np.array([9 if i == 5 else -1 if i % 10 == 0 else i % 3 for i in range(70)])
    labelled = df.withColumn("cluster", F.when(F.col("trial") == 5, 9).when(F.col("trial") % 10 == 0, -1).otherwise((F.col("trial") % 3).cast("int")))
    assert abs(M.silhouette(labelled, "trace", squared=False) - plain_silhouette(x[c >= 0], c[c >= 0])) < 1e-9
    v = labelled.withColumn("features", array_to_vector("trace"))
    assert M.silhouette(v, squared=False, most=10) == M.silhouette(v)
    assert M.silhouette(v.withColumn("cluster", F.lit(1)), squared=False) is None


def test_queries_of_components_show_their_values(spark):
    rows = {r["trial"]: r["trace"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select(F.col("vec_id").alias("trial"), F.col("embedding").cast("array<double>").alias("trace")).collect()}
    x = np.array([rows[k] for k in sorted(rows)])
    mean, loads, shares = plain(x, 32)
    run = lambda n: plans.queries()[n](spark, DATA).toPandas()
    assert np.allclose(run("ml05_time_importance").sort_values("t")["importance"], np.abs(loads[:, :5]).mean(1), atol=1e-5)
    got = run("ml04_components").sort_values("component")
    assert np.allclose(got["variance"], shares, atol=1e-5)
