"""Cluster permutation tests by p against NumPy, and the summary of all sections."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import stats as H


def sign(perm, subject):
    return 1.0 if perm == 0 or hashlib.md5(f"67|{perm}|{subject}".encode()).hexdigest()[0] < "8" else -1.0


def t_p(t, df):
    x = np.linspace(0, math.atan(abs(t) / math.sqrt(df)), 4001)
    y = np.cos(x) ** (df - 1)
    area = np.trapezoid(y, x)
    full = math.sqrt(math.pi) * math.gamma(df / 2) / (2 * math.gamma((df + 1) / 2))
    return 1 - area / full


def t_stat(x):
    s = x.std(ddof=1)
    if s <= 1e-12:
        return (math.copysign(math.inf, x.mean()), 0.0) if abs(x.mean()) > 1e-12 else (0.0, 1.0)
    t = x.mean() / (s / math.sqrt(len(x)))
    return t, t_p(t, len(x) - 1)


def rank_stat(x):
    every, x = len(x), x[x != 0]
    n = len(x)
    if every < 2 or not n:
        return None
    a = np.abs(x)
    ranks = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    low = min(ranks[x > 0].sum(), ranks[x < 0].sum())
    if n == every and len(set(a)) == n:
        sums = np.array([0])
        for r in range(1, n + 1):
            sums = np.concatenate([sums, sums + r])
        return low, min(1.0, 2 * (sums <= low).mean())
    tied = sum((a == v).sum() ** 3 - (a == v).sum() for v in set(a))
    var = n * (n + 1) * (2 * n + 1) / 24 - tied / 48
    z = (abs(low - n * (n + 1) / 4) - 0.5) / math.sqrt(var)
    return low, min(1.0, math.erfc(z / math.sqrt(2)))


def runs(stats, alpha):
    out = []
    for s in (1, -1):
        frames = [f for f, (v, p) in sorted(stats.items()) if p < alpha and v * s > 0]
        for f in frames:
            if out and out[-1][2] == s and out[-1][1] == f - 1:
                out[-1][1] = f
            else:
                out.append([f, f, s])
    return sorted((a, b, s, sum(abs(stats[f][0]) for f in range(a, b + 1))) for a, b, s in out)


@pytest.mark.parametrize("method", ["t", "wilcoxon"])
def test_clusters_equal_numpy(spark, method):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(9, 12)), 3)
    x[:, 3:6] += 1.2
    x[:, 8:10] -= 1.5
    x[2:5, 7] = 0.25  # ties
    x[0, 4] = x[1, 4] = 0
    x[:, 11] = 0
    rows = [(s, f, float(x[s, f])) for s in range(9) for f in range(12) if (s, f) != (4, 2)] + [(4, 2, None), (1, 20, 3.0)]
    df = spark.createDataFrame(rows, "subject long, frame int, diff double")
    one = t_stat if method == "t" else rank_stat
    perms, alpha = 40, 0.1
    stats = []
    for perm in range(perms + 1):
        flips = np.array([sign(perm, s) for s in range(9)])
        each = {f: one(np.array([x[s, f] * flips[s] for s in range(9) if (s, f) != (4, 2)])) for f in range(12)}
        stats.append({f: v for f, v in each.items() if v is not None})
    clusters, times = H.cluster_test(df, perms, alpha=alpha, method=method)
    got = {r["frame"]: r for r in times.collect()}
    assert got.keys() == stats[0].keys()
    for f, (v, p) in stats[0].items():
        assert math.isclose(got[f]["statistic"], v, rel_tol=1e-9, abs_tol=1e-9) and abs(got[f]["p"] - p) < 1e-5
    tops = [max((m for *_, m in runs(s, alpha)), default=0.0) for s in stats[1:]]
    want = [(i + 1, a, b, b - a + 1, s, m, (1 + sum(t >= m - 1e-9 for t in tops)) / (perms + 1)) for i, (a, b, s, m) in enumerate(runs(stats[0], alpha))]
    found = sorted(tuple(r) for r in clusters.collect())
    assert len(found) == len(want) >= 1
    for g, w in zip(found, want, strict=True):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:])
    assert {f: r["cluster_id"] for f, r in got.items() if r["cluster_id"]} == {f: w[0] for w in want for f in range(w[1], w[2] + 1)}


def test_a_cluster_test_of_no_other_kind(spark):
    with pytest.raises(ValueError):
        H.cluster_test(spark.createDataFrame([(1, 1, 1.0)], "subject long, frame int, diff double"), method="z")


def test_summary_of_all_sections(spark):
    clusters = spark.createDataFrame([(1, 2, 4, 3, 1, 9.0, 0.01), (2, 6, 6, 1, -1, 2.0, 0.4), (3, 8, 9, 2, -1, 7.0, 0.01)], "cluster_id int, start int, end int, length int, sign int, mass double, p_cluster double")
    survival = spark.createDataFrame([(50.0, 4.0, 0.045, 3, None)], "threshold double, chi2 double, p double, median_a int, median_b int")
    hazards = spark.createDataFrame([(50.0, 2.0, 1.1, 3.0, 0.02, True)], "threshold double, hr double, ci_low double, ci_high double, p double, best boolean")
    spline = spark.createDataFrame([(0, 1.0, 5.0, 0.1), (1, -3.0, 5.0, 0.1)], "frame int, difference double, wald double, wald_p double")
    got = {(r["section"], r["item"], r["figure"]): r["value"] for r in H.summary_rows(clusters, survival, hazards, spline).collect()}
    assert got["clusters", "all", "clusters"] == 3 and got["clusters", "all", "significant"] == 2
    assert got["clusters", "1", "start"] == 2 and got["clusters", "2", "start"] == 8 and ("clusters", "3", "start") not in got
    assert got["survival", "50.0", "median_b"] is None and got["hazard", "50.0", "best"] == 1
    assert (got["spline", "all", "peak_difference"], got["spline", "all", "peak_frame"]) == (3.0, 1.0)
    assert H.summary_rows(clusters.filter("false")).filter(F.col("value") > 0).count() == 0
    with pytest.raises(ValueError):
        H.summary_rows()
