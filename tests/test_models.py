"""Logistic models, folds, searches and networks against NumPy."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import ml as M
from chronolith.operators import models as O


def table(spark, n=240, subjects=9, seed=1, constant=False):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        s = i % subjects
        x = rng.normal(size=3) * [1, 5, 0.1] + [0, 40, 0.02 * s]
        y = int(rng.random() < 1 / (1 + np.exp(-(1.5 * x[0] + 0.2 * (x[1] - 40) + s / 4 - 1))))
        rows.append((i, s, [*map(float, x), *([7.0] if constant else [])], y, float(1 + i % 3)))
    return spark.createDataFrame(rows, "trial long, subject long, features array<double>, label int, weight double").repartition(3)


def plain_logistic(x, y, w, reg, balanced):
    """Newton steps on scaled features, in NumPy: weights and bias on features as they are."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 1e-6, std, 1)
    z = np.column_stack([(x - mean) / std, np.ones(len(x))])
    if balanced:
        w = w * np.where(y == 1, w.sum() / (2 * w[y == 1].sum()), w.sum() / (2 * w[y == 0].sum()))
    pen = np.append(np.full(x.shape[1], reg), 0)
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(pen) + 1e-12 * np.eye(len(b)), z.T @ (w * (p - y)) + pen * b)
    return b[:-1] / std, b[-1] - (b[:-1] / std) @ mean


def arrays(df):
    r = df.orderBy("trial").collect()
    return np.array([x["features"] for x in r]), np.array([x["label"] for x in r]), np.array([x["weight"] for x in r]), np.array([x["subject"] for x in r])


@pytest.mark.parametrize("constant", [False, True])
def test_all_models_of_a_pass_equal_models_fitted_alone(spark, constant):
    df = table(spark, constant=constant)
    folded = df.withColumn("fold", (F.col("subject") % 3).cast("int"))
    x, y, w, subject = arrays(df)
    each = [O.Candidate(f, reg, b) for f in (None, 0, 1, 2) for reg in (0.01, 3.0) for b in (False, True)]
    got = O.fit_logistic(O.example_table(folded, "features", "label", "weight"), each)
    for c, m in zip(each, got, strict=True):
        rows = subject % 3 != c.fold if c.fold is not None else np.ones(len(y), bool)
        want = plain_logistic(x[rows], y[rows], w[rows], c.reg, c.balanced)
        assert np.allclose(m.weights, want[0], atol=1e-6) and abs(m.bias - want[1]) < 1e-5


def test_a_step_that_overshoots_is_halved(spark):
    rows = [(i, i % 4, [float(1000 if i == 0 else i % 5)], int(i % 5 > 2 or i == 0), 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "trial long, subject long, features array<double>, label int, weight double")
    (m,) = O.fit_logistic(O.example_table(df, "features", "label"), [O.Candidate(None, 1e-6)])
    x, y, w, _ = arrays(df)
    p = 1 / (1 + np.exp(-np.clip(x @ m.weights + m.bias, -500, 500)))
    assert abs((p - y).sum()) < 1e-4 and abs(((p - y) * (x[:, 0] - x.mean()) / x.std()).sum() + 1e-6 * m.weights[0] * x.std()) < 1e-4


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])


def ap(y, p):
    out, seen = 0.0, 0
    for t in sorted(set(p), reverse=True):
        hits = y[p >= t].sum()
        out += (hits - seen) / y.sum() * hits / (p >= t).sum()
        seen = hits
    return out


def test_leaving_subjects_out_pools_the_scores_of_all_folds(spark):
    df = table(spark)
    x, y, w, subject = arrays(df)
    want = np.zeros(len(y))
    for part in np.array_split(np.unique(subject), 5):
        out = np.isin(subject, part)
        c, b = plain_logistic(x[~out], y[~out], np.ones((~out).sum()), 1.0, False)
        want[out] = 1 / (1 + np.exp(-(x[out] @ c + b)))
    scored = O.leave_subjects_out(df, "features", "label", ["trial"])
    got = {r["trial"]: r["prob"] for r in scored.collect()}
    assert {r["folds_by"] for r in scored.collect()} == {"subject"}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-6)
    assert abs(M.auroc(scored, "label", "prob").first()[0] - auc(y, want)) < 1e-9
    assert abs(M.average_precision(scored, "label", "prob").first()[0] - ap(y, want)) < 1e-9


def test_folds_of_one_class_are_left_out_and_stratified_folds_step_in(spark):
    df = table(spark)
    one = df.withColumn("label", F.when(F.col("subject") < 2, 0).otherwise(F.col("label")))  # the first fold has one class
    got = O.leave_subjects_out(one, "features", "label", ["trial"]).select("fold").distinct().collect()
    assert sorted(r["fold"] for r in got) == [1, 2, 3, 4]
    split = df.withColumn("label", (F.col("subject") >= 4).cast("int"))  # every fold has one class
    scored = O.leave_subjects_out(split, "features", "label", ["trial"])
    assert {r["folds_by"] for r in scored.collect()} == {"label"} and scored.count() == df.count()
    shares = scored.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()
    assert len(shares) == 5 and max(r["n"] for r in shares) - min(r["n"] for r in shares) <= 1 and max(r["pos"] for r in shares) - min(r["pos"] for r in shares) <= 1


@pytest.mark.parametrize("change", [lambda d: d.withColumn("label", F.lit(1)), lambda d: d.withColumn("subject", F.lit(4)), lambda d: d.filter("false")])
def test_nothing_to_evaluate_is_an_error(spark, change):
    with pytest.raises(ValueError):
        O.leave_subjects_out(change(table(spark, 30)), "features", "label", ["trial"])


def test_a_search_has_a_row_for_each_draw_and_marks_the_best(spark):
    df = M.group_folds(table(spark), 4)
    draws = O.drawn(5, seed=3)
    assert draws == O.drawn(5, seed=3) and len({d[1] for d in draws}) == 5
    got = sorted(O.random_search(df, draws, "features", "label", "weight").collect(), key=lambda r: r["candidate"])
    rows = df.orderBy("trial").collect()
    x, y, w, _ = arrays(df)
    fold = np.array([r["fold"] for r in rows])
    for r, (i, reg, balanced) in zip(got, draws, strict=True):
        f1s, accs = [], []
        for k in range(4):
            t = fold != k
            c, b = plain_logistic(x[t], y[t], w[t], reg, balanced)
            p = (x[~t] @ c + b >= 0).astype(int)
            f1, rec = [], []
            for c_ in (0, 1):
                tp = ((p == c_) & (y[~t] == c_)).sum()
                f1.append(2 * tp / max(1, (p == c_).sum() + (y[~t] == c_).sum()))
                rec.append(tp / (y[~t] == c_).sum())
            f1s.append(np.mean(f1))
            accs.append(np.mean(rec))
        assert (r["candidate"], r["reg"], r["balanced"], r["folds"]) == (i, reg, balanced, 4)
        assert np.allclose([r["macro_f1_mean"], r["macro_f1_std"], r["balanced_accuracy_mean"], r["balanced_accuracy_std"]], [np.mean(f1s), np.std(f1s, ddof=1), np.mean(accs), np.std(accs, ddof=1)])
    best = max(got, key=lambda r: (r["macro_f1_mean"], -r["candidate"]))
    assert [r["candidate"] for r in got if r["best"]] == [best["candidate"]]


def test_metrics_of_one_class(spark):
    t = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.9), (1, 1, 0.9), (1, 0, 0.2)], "fold int, label int, prob double")
    got = {r["fold"]: r for r in O.fold_metrics(t, ["fold"]).collect()}
    assert got[0]["balanced_accuracy"] == 0.5 and abs(got[0]["macro_f1"] - (2 / 3) / 2) < 1e-12 and got[1]["macro_f1"] == got[1]["balanced_accuracy"] == 1


def test_network_gradients_equal_finite_differences():
    rng = np.random.default_rng(0)
    sizes = [3, 5, 4, 3]
    flat = rng.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 * 3 + 3)
    x, y, w = rng.normal(size=(20, 3)), rng.integers(0, 3, 20), rng.random(20)
    got = O.network_sums(flat, sizes, x, y, w)[1:]
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = 1e-6
        want = (O.network_sums(flat + e, sizes, x, y, w)[0] - O.network_sums(flat - e, sizes, x, y, w)[0]) / 2e-6
        assert abs(got[i] - want) < 1e-5


def test_a_weight_of_two_is_two_rows(spark):
    df = table(spark, 90)
    once = O.example_table(df.withColumn("weight", F.lit(2.0)), "features", "label", "weight")
    twice = O.example_table(df.union(df), "features", "label")
    a, b = O.fit_network(once, [4], 2, reg=0.05, tol=1e-2), O.fit_network(twice, [4], 2, reg=0.05, tol=1e-2)
    assert a[1] and b[1]
    x = np.array([r["features"] for r in df.collect()])
    assert np.allclose(a[0].probabilities(x), b[0].probabilities(x), atol=1e-3)


def test_a_network_learns_what_no_line_parts_and_class_weights_count(spark):
    r = random.Random(2)
    points = [(r.uniform(-1, 1), r.uniform(-1, 1)) for _ in range(300)]
    df = spark.createDataFrame([(i, [a, b], int(a * b > 0)) for i, (a, b) in enumerate(points)], "trial long, features array<double>, label int")
    rows = O.example_table(df, "features", "label", keep=["trial"])
    net, rest = O.fit_network(rows, [8, 8], 2, reg=1e-4, seed=5, tol=1e-3)
    assert rest
    scored = O.network_scores(rows, net, ["trial"])
    assert scored.filter("predicted = y").count() > 270 and scored.count() == 300
    heavy, _ = O.fit_network(rows, [3], 2, reg=1e-3, class_weights=[1.0, 50.0], seed=5, tol=1e-2)
    light, _ = O.fit_network(rows, [3], 2, reg=1e-3, class_weights=[50.0, 1.0], seed=5, tol=1e-2)
    count = lambda n: O.network_scores(rows, n).filter("predicted = 1").count()
    assert count(heavy) > count(light)


def test_folds_of_subjects_are_those_of_an_array_split(spark):
    df = spark.createDataFrame([(s,) for s in range(13) for _ in range(s % 3 + 1)] + [(None,)], "subject long")
    got = defaultdict(set)
    for r in O.subject_folds(df, 5).collect():
        got[r["fold"]].add(r["subject"])
    assert [sorted(got[k]) for k in range(5)] == [list(map(int, p)) for p in np.array_split(np.arange(13), 5)]
    assert math.isclose(O.subject_folds(df, 50).select("fold").distinct().count(), 13)
