"""Numeric expectations on small literal tables."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from chronolith.functions import scalars as S
from chronolith.functions import signal as G
from chronolith.operators import aggregate as A
from chronolith.operators import frames as P
from chronolith.operators import joins as J
from chronolith.operators import ml as M
from chronolith.operators import stats as H
from chronolith.operators import windows as W
from chronolith.operators.frames import DataError
from chronolith.sources import io as IO


def test_responder_aggregates(spark):
    rows = [(1, i, v, 0.0, 0.0, 1.0, 0.0, 1, 3) for i, v in enumerate([10.0, 20.0, 80.0, 90.0, 30.0])]
    df = spark.createDataFrame(rows, "trial int, frame int, value double, eye_x double, eye_y double, prob_x double, prob_y double, on_idx int, off_idx int")
    r = A.responder_aggregates(P.epoch_flags(df), ["trial"], fps=40).first()
    assert r["before_mean"] == 10 and math.isclose(r["during_mean"], 190 / 3)
    assert math.isclose(r["high_fraction"], 2 / 3) and math.isclose(r["rise_speed"], 190 / 3 - 10)
    assert r["direction_cos"] == 1 and r["direction_consistency"] == 1


def test_epoch_flags(spark):
    df = spark.createDataFrame([(i, 1, 3) for i in range(5)] + [(9, None, None)], "frame int, on_idx int, off_idx int")
    got = [tuple(r)[3:] for r in P.epoch_flags(df).orderBy("frame").collect()]
    assert got == [(1, 0, 0), (0, 1, 0), (0, 1, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0)]


def test_keys_and_labels(spark):
    df = spark.createDataFrame([(" a ", "3", "2"), ("b", "4.0", "0")], "animal string, number string, score string")
    assert [tuple(r) for r in IO.read_labels(df, ["animal"], ["number"], "score").orderBy("number").collect()] == [("a", 3, 2), ("b", 4, 0)]
    with pytest.raises(Exception, match="whole number"):
        IO.read_labels(spark.createDataFrame([("a", "1", "-1")], df.schema), ["animal"], ["number"], "score").collect()
    with pytest.raises(DataError):
        IO.read_labels(df.union(df), ["animal"], ["number"], "score")
    with pytest.raises(DataError):
        P.require(df, ["absent"])


def test_contingency(spark):
    rows = [("a", 2, True), ("a", 1, True), ("b", 2, True), ("b", 1, False), ("c", 4, False)]
    s = A.subject_responses(spark.createDataFrame(rows, "subject string, trial int, hit boolean"), [2, 4], [1, 3])
    r = A.contingency_counts(s).first()
    assert (r["a"], r["b"], r["c"], r["d"]) == (1, 1, 0, 1)
    assert {tuple(x) for x in A.contingency_table(s).collect()} >= {("all", "all", 3), ("true", "all", 2)}


def test_latency_censors(spark):
    rows = [(k, i / 10, v) for k, t in (("x", [0.0, 0.1, 0.2, 0.4, 0.5]), ("y", [0.0, 0.05, 0.07, 0.09, 0.5])) for i, v in enumerate(t)]
    got = W.latency(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], "t", "v", 0.3).orderBy("k").collect()
    assert [r["event"] for r in got] == [True, False]


def test_benjamini_hochberg(spark):
    p = [0.001, 0.01, 0.2, None, 0.05]
    q = [r["q"] for r in W.benjamini_hochberg(spark.createDataFrame(list(enumerate(p)), "id int, p double"), "p", "id").orderBy("id").collect()]
    assert q[3] is None and np.allclose([q[0], q[1], q[4], q[2]], [0.004, 0.02, 0.05 * 4 / 3, 0.2])


def test_tails(spark):
    df = spark.createDataFrame([(12.7062, 1.0), (4.30265, 2.0), (2.57058, 5.0), (2.22814, 10.0), (1.97601, 149.0)], "t double, df double")
    assert np.allclose([r[0] for r in df.select(H.t_two_sided(F.col("t"), F.col("df"))).collect()], 0.05, atol=1e-4)
    z = spark.createDataFrame([(1.959964,)], "z double").select(H.normal_sf(F.col("z"))).first()[0]
    assert math.isclose(z, 0.025, abs_tol=1e-6)
    b = spark.createDataFrame([(1, 10), (5, 10)], "k long, n long").select(H.binomial_two_sided(F.col("k"), F.col("n")))
    assert np.allclose([r[0] for r in b.collect()], [22 / 1024, 1.0])


def test_signed_rank_counts():
    assert H.signed_rank_counts(3) == [1, 1, 1, 2, 1, 1, 1]
    assert sum(H.signed_rank_counts(20)) == 2**20


def test_cluster_permutation_finds_the_signal(spark):
    rng = np.random.default_rng(0)
    rows = [(s, t, float(rng.normal(3 if 4 <= t < 9 else 0))) for s in range(14) for t in range(15)]
    got = H.cluster_permutation(spark.createDataFrame(rows, "subject int, frame int, diff double"), 99, threshold=2.0).collect()
    best = min(got, key=lambda r: r["p"])
    assert best["p"] <= 0.05 and best["start"] <= 5 and best["end"] >= 7


def test_cox_sign_and_mixed_spline(spark):
    rng = np.random.default_rng(1)
    rows = [(s, g, float(round(rng.exponential(1 if g == "A" else 3), 2)), True) for s in range(60) for g in ("A", "B") for _ in range(2)]
    r = H.cox_binary(spark.createDataFrame(rows, "subject int, grp string, latency double, event boolean")).first()
    assert r["hr"] > 1.5 and r["ci_low"] > 1 and r["p"] < 0.01
    rows = [(s, t, g, s * 1.0 + (2.0 if g == "A" else 0.0) + float(rng.normal(0, 0.1))) for s in range(10) for t in range(8) for g in ("A", "B")]
    got = H.mixed_spline(spark.createDataFrame(rows, "subject int, frame int, grp string, value double"), 8).collect()
    assert all(abs(r["difference"] - 2) < 0.2 and r["low"] < 2.1 for r in got)


def _partial_likelihood(rows, beta, ties):
    out = 0.0
    for time in {r[2] for r in rows if r[3]}:
        risk = [r for r in rows if r[2] >= time]
        dead = [r for r in risk if r[2] == time and r[3]]
        w = lambda part: sum(math.exp(beta * (r[1] == "A")) for r in part)
        out += beta * sum(r[1] == "A" for r in dead)
        out -= sum(math.log(w(risk) - (i / len(dead) if ties == "efron" else 0) * w(dead)) for i in range(len(dead)))
    return out


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_maximises_the_partial_likelihood(spark, ties):
    rng = np.random.default_rng(3)
    rows = [(s, g, float(rng.integers(1, 6 if g == "A" else 9)), bool(rng.random() < 0.8)) for s in range(4) for g in "AB" for _ in range(12)]
    r = H.cox_binary(spark.createDataFrame(rows, "subject int, grp string, latency double, event boolean"), ties=ties).first()
    total = lambda b: sum(_partial_likelihood([x for x in rows if x[0] == s], b, ties) for s in range(4))
    assert total(r["beta"]) >= max(total(r["beta"] + d) for d in (-1e-3, 1e-3))
    h = 1e-3
    curve = -(total(r["beta"] + h) - 2 * total(r["beta"]) + total(r["beta"] - h)) / h**2
    assert math.isclose(r["ci_high"] / r["hr"], math.exp(1.96 / math.sqrt(curve)), rel_tol=1e-3)


def test_cox_of_groups_that_part_entirely(spark):
    rows = [(s, g, 1.0 if g == "A" else 5.0, True) for s in range(6) for g in "AB"]
    assert H.cox_binary(spark.createDataFrame(rows, "subject int, grp string, latency double, event boolean")).first()["beta"] == 20


def test_spline_basis_and_tail():
    b = H.spline_basis(40, 6)
    t = np.arange(40) / 39
    assert b.shape == (40, 6) and (b >= -1e-12).all() and math.isclose(b[-1].sum(), 1) and b[0].sum() == 0
    for k in range(4):  # cubics lie in the span of the constant and the basis
        fit = np.c_[np.ones(40), b]
        assert np.abs(fit @ np.linalg.lstsq(fit, t**k, rcond=None)[0] - t**k).max() < 1e-9
    assert np.allclose([H.chi2_sf(3.841459, 1), H.chi2_sf(5.991465, 2), H.chi2_sf(11.0705, 5), H.chi2_sf(12.59159, 6)], 0.05, atol=1e-6)


def test_mixed_spline_equals_a_dense_fit(spark):
    rng = np.random.default_rng(5)
    rows = [(s, t, g, 0.3 * s + (math.sin(t / 3) if g == "A" else 0.0) + float(rng.normal(0, 0.2))) for s in range(6) for t in range(12) for g in "AB"]
    got = H.mixed_spline(spark.createDataFrame(rows, "subject int, frame int, grp string, value double"), 12, knots=5).orderBy("frame").collect()
    base = np.c_[np.ones(12), H.spline_basis(12, 5)]
    x = np.array([np.r_[base[t], base[t] * (g == "A")] for _, t, g, _ in rows])
    y, z = np.array([r[3] for r in rows]), np.array([[r[0] == s for s in range(6)] for r in rows], float)

    def fit(ratio):
        v = np.eye(len(y)) + ratio * z @ z.T
        vi = np.linalg.inv(v)
        a = x.T @ vi @ x
        b = np.linalg.solve(a, x.T @ vi @ y)
        e = y - x @ b
        var = e @ vi @ e / (len(y) - x.shape[1])
        return -0.5 * ((len(y) - x.shape[1]) * math.log(var) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(a)[1]), b, np.linalg.inv(a) * var

    _, b, cov = max((fit(r) for r in np.geomspace(1e-1, 1e3, 300)), key=lambda f: f[0])
    assert np.allclose([r["difference"] for r in got], base @ b[6:], atol=1e-4)
    wald = b[7:] @ np.linalg.solve(cov[7:, 7:], b[7:])
    assert math.isclose(got[0]["wald"], wald, rel_tol=1e-2) and got[0]["wald_df"] == 5 and got[0]["wald_p"] < 1e-6


def test_best_mixture_prefers_the_true_number(spark):
    rng = np.random.default_rng(7)
    rows = [(i, Vectors.dense(rng.normal(8 * (i % 2), 1, 2).tolist())) for i in range(120)]
    out, table = M.best_mixture(spark.createDataFrame(rows, ["id", "features"]), [1, 2, 3])
    best, tried = table.filter("best").first(), table.collect()
    assert best["k"] == 2 and best["bic"] == min(r["bic"] for r in tried if r["silhouette"] is not None)
    assert len({(r["id"] % 2, r["cluster"]) for r in out.collect()}) == 2


def test_diagonal_mixture_goes_on_until_it_rests(spark):
    x = np.round(np.random.default_rng(0).normal(0, 1, 40), 3)  # overlapping components, 231 rounds
    m, v, w = x.mean() + np.array([-0.5, 0.5]) * x.std(), np.full(2, x.var()), np.full(2, 0.5)
    want, rounds = -math.inf, 0
    while True:
        parts = np.log(w) - 0.5 * np.log(2 * math.pi * v) - (x[:, None] - m) ** 2 / (2 * v)
        each = np.logaddexp.reduce(parts, axis=1)
        if each.sum() - want <= 1e-5 * abs(each.sum()):
            break
        want, rounds, r = each.sum(), rounds + 1, np.exp(parts - each[:, None])
        w, m = r.mean(0), r.T @ x / r.sum(0)
        v = r.T @ x**2 / r.sum(0) - m**2
    assert rounds > 200
    out, ll = M.diagonal_mixture(spark.createDataFrame([(i, float(a)) for i, a in enumerate(x)], "id int, a double").coalesce(1), ["a"], 2)
    assert math.isclose(ll, want, rel_tol=1e-9)
    assert {r["id"]: r["cluster"] for r in out.collect()} == dict(enumerate(parts.argmax(1).tolist()))


def test_diagonal_mixture_refuses_values_that_are_not_finite(spark):
    with pytest.raises(ValueError, match="finite"):
        M.diagonal_mixture(spark.createDataFrame([(1.0,), (2.0,), (math.nan,)], "a double"), ["a"], 2)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"rows": [{"a": 1, "b": "x"}, {"a": 2, "b": null}]}', [(1, "x"), (2, None)]),
        ('[{"a": 1, "b": "x"}]', [(1, "x")]),
        ('{"row_index_to_meta": {"10": {"a": 3, "b": "z"}, "2": {"a": 1, "b": "x"}}}', [(1, "x"), (3, "z")]),
        ('{"column_order": ["b", "c", "a"], "data": [["x", 0, 1], ["y"]]}', [(1, "x"), (None, "y")]),
        ('{"columns": ["b", "a"], "rows": [["x", 1]]}', [(1, "x")]),
        ('{"columns": ["b"], "data": [["x"]]}', [(None, "x")]),
    ],
)
def test_metadata_layouts(spark, text, want):
    got = IO.metadata_rows(spark.createDataFrame([(text,)], "meta string"), "meta", "a: int, b: string").orderBy("row").collect()
    assert [(r["a"], r["b"]) for r in got] == want


@pytest.mark.parametrize(
    ("codes", "value", "want"),
    [
        ('{"0": "low"}', "0", "low"),
        ('{"lookup": {"0": "low"}}', "0.0", "low"),
        ('{"values": ["high", "low"], "codes": [1, 0]}', "1", "high"),
        ('{"labels": ["low", "high"], "codes": [1]}', "1", "high"),
        ('["low", "high"]', "1", "high"),
        ('{"low": 0, "high": 1}', "1", "high"),
        ('{"0": "low"}', "9", "9"),
        ("[]", "9", "9"),
        (None, "9", "9"),
        ('{"0": "low"}', None, None),
    ],
)
def test_code_maps(spark, codes, value, want):
    df = spark.createDataFrame([(value, codes)], "c string, codes string")
    assert df.select(S.decode(F.col("c"), F.col("codes")).alias("x")).first()["x"] == want


def test_wide_and_stacked_trials(spark):
    df = spark.createDataFrame([("t1", 1.0, 2.0, None), ("t2", 3.0, None, None)], "id string, v_0 double, v_1 double, v_2 double")
    assert [r["trace"] for r in IO.wide_trials(df, "v_", {"id": F.col("id")}).orderBy("id").collect()] == [[1.0, 2.0], [3.0]]
    with pytest.raises(DataError):
        IO.series_columns(["v_0", "v_2"], "v_")


def test_zscore_and_embedding(spark):
    t = spark.createDataFrame([([float(i) for i in range(10)],), ([5.0] * 10,)], "trace array<double>")
    z = [r[0] for r in t.select(S.zscore(F.col("trace"), F.slice("trace", 1, 5))).collect()]
    assert abs(np.mean(z[0][:5])) < 1e-9 and abs(np.std(z[0][:5]) - 1) < 1e-9 and z[1] == [0.0] * 10
    assert t.select(F.size(W.lag_embedding("trace", 4))).first()[0] == 7


def test_savgol_keeps_polynomials(spark):
    x = [0.5 * i * i - i for i in range(12)]
    df = spark.createDataFrame([(x,)], "trace array<double>")
    assert np.allclose(df.select(G.savgol(F.col("trace"), 5, 2)).first()[0], x)
    flat = spark.createDataFrame([([3.0] * 40,)], "trace array<double>")
    assert np.allclose(flat.select(G.lowpass(F.col("trace"), 2.0, 40.0)).first()[0], 3.0)


def test_density_clusters(spark):
    pts = [(i, 0.01 * i, 0.0) for i in range(6)] + [(10 + i, 5 + 0.01 * i, 0.0) for i in range(6)] + [(99, 2.5, 2.5)]
    got = {r["id"]: r["cluster"] for r in M.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), "id", ["x", "y"], 0.02, 3).collect()}
    assert {got[i] for i in range(6)} == {0} and {got[10 + i] for i in range(6)} == {10} and got[99] == -1


def test_density_clusters_of_a_long_path(spark):
    keys = np.random.default_rng(1).permutation(200).tolist()
    pts = [(k, 0.01 * i, 0.0) for i, k in enumerate(keys)]
    got = M.density_clusters(spark.createDataFrame(pts, "id long, x double, y double"), "id", ["x", "y"], 0.0101, 3).collect()
    assert len(got) == 200 and {r["cluster"] for r in got} == {min(keys[1:-1])}


def test_splits(spark):
    df = spark.createDataFrame([(s, t, int((s + t) % 3 == 0)) for s in range(12) for t in range(5)], "subject int, trial int, label int")
    assert M.leaking_subjects(M.balanced_split(df, 0.25)).isEmpty()
    counts = {r["split"]: r["count"] for r in M.stratified_split(df, "label", ["subject", "trial"]).groupBy("split").count().collect()}
    assert sum(counts.values()) == 60 and abs(counts["train"] - 42) <= 2
    folds = M.group_folds(df, 4).groupBy("subject").agg(F.count_distinct("fold").alias("n")).filter("n > 1")
    assert folds.isEmpty()


def test_join_contracts(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, v double")
    b = spark.createDataFrame([(1, 2.0), (2, 5.0)], "k int, v double")
    got = {r["k"]: (r["v"], r["v_mismatch"]) for r in J.merge_summary(a, b, ["k"], ["v"]).collect()}
    assert got == {1: (2.0, 0), 2: (5.0, 1)}
    with pytest.raises(DataError):
        J.join_one_to_one(a.union(a), b, ["k"])
    with pytest.raises(Exception, match="without a label"):
        J.join_labels(a, b.filter("k = 1").withColumnRenamed("v", "label"), ["k"], drop_missing=False).collect()
