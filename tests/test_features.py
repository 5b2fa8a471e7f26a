"""The trial feature table against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from chronolith.operators import features as FE
from chronolith.operators import grams as G

FPS, ON, LAG = 10.0, 12, 5


def crossing(t, v, threshold):
    for i in range(len(v)):
        if v[i] >= threshold:
            return t[i] if i == 0 or v[i] == v[i - 1] else t[i - 1] + (threshold - v[i - 1]) / (v[i] - v[i - 1]) * (t[i] - t[i - 1])
    return None


def test_table_and_component_figures(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 40)).cumsum(1) * 0.4
    x[:, ON:] += 2
    x[5, ON:] = -9  # never at its threshold
    df = spark.createDataFrame([(i, [float(v) for v in t]) for i, t in enumerate(x)], "trial long, trace array<double>")
    table = FE.feature_table(df, "trial", "trace", ON, FPS, k=1.0)
    got = {r["trial"]: r.asDict() for r in table.collect()}
    t = (np.arange(40) - ON) / FPS
    n = np.arange(40)
    spectrum = np.fft.fft(x, axis=1) * np.where(n == 0, 1, np.where(n < 20, 2, np.where(n == 20, 1, 0)))
    env = np.abs(np.fft.ifft(spectrum, axis=1))
    area = lambda tt, v: ((v[1:] + v[:-1]) / 2 * np.diff(tt)).sum()
    for i in range(6):
        v, during = x[i], t >= 0
        base = v[~during]
        threshold = base.mean() + base.std()
        speed = np.abs(np.gradient(v, 1 / FPS))
        above = v[during] >= threshold
        starts = np.flatnonzero(above & ~np.concatenate([[False], above[:-1]]))
        gaps = np.diff(t[during][starts])
        want = {
            "threshold": threshold,
            "latency": crossing(t[during], v[during], threshold),
            "peak_to_baseline": v[during].max() - base.mean(),
            "during_mean": v[during].mean(),
            "auc_diff": area(t[during], v[during]) - area(t[~during], base),
            "excursions": len(starts),
            "inter_excursion_mean": gaps.mean() if len(gaps) else None,
            "inter_excursion_std": gaps.std() if len(gaps) else None,
            "envelope_var": env[i][during].var(),
            "envelope_tmax": t[during][env[i][during].argmax()],
            "velocity_max_abs": speed.max(),
            "velocity_tmax_abs": t[speed.argmax()],
            "velocity_total_abs": area(t, speed),
        }
        for k, w in want.items():
            assert (got[i][k] is None) if w is None else np.isclose(got[i][k], w), (i, k, got[i][k], w)
    model = G.fit_lag_components(df, "trace", LAG, 2)
    thresholds = table.select("trial", "threshold").filter("trial <> 4")

    found = {r["trial"]: r for r in FE.component_features(df, "trial", "trace", ON, FPS, thresholds, LAG).collect()}
    for i in range(6):
        pcs = (np.lib.stride_tricks.sliding_window_view(x[i], LAG) - model.mean) @ model.loads
        at = t[np.clip(np.arange(len(pcs)) + LAG // 2, 0, 39)]
        one = (at >= 0) & (at <= 1), (at > 1) & (at <= 2)
        want = [area(at[one[0]], pcs[one[0], 0]), area(at[one[1]], pcs[one[1], 0]), pcs[:, 0].max(), crossing(at, pcs[:, 0], got[i]["threshold"]) if i != 4 else None, np.sqrt((np.diff(pcs, axis=0) ** 2).sum(1)).sum()]
        for w, name in zip(want, FE.COMPONENT_FIGURES, strict=True):
            assert (found[i][name] is None) if w is None else np.isclose(found[i][name], w), (i, name)


def test_traces_of_one_value(spark):
    df = spark.createDataFrame([(1, [1.0] * 20)], "trial long, trace array<double>")
    r = FE.feature_table(df, "trial", "trace", 8, 10.0).first()
    assert r["excursions"] == 0 and r["velocity_total_abs"] == 0 and r["inter_excursion_mean"] is None
    c = FE.component_features(df, "trial", "trace", 8, 10.0, df.select("trial", F.lit(0.5).alias("threshold")), 4).first()
    assert c["pc_path_length"] == 0 and c["pc1_time_to_threshold"] is None
