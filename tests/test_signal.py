"""The low-pass filter against a sample-by-sample form, and code maps with repeated codes."""

import numpy as np
from pyspark.sql import functions as F

from chronolith.functions import scalars as S
from chronolith.functions import signal as G


def plain(x, cutoff, fps):
    pad = min(12, len(x) - 1)
    if pad < 1:
        return x
    y = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    for _ in range(2):
        for b, a in G.butterworth(cutoff, fps):
            out = []
            for i in range(len(y)):
                u = lambda k: y[max(k, 0)]
                before = lambda k: out[k] if k >= 0 else y[0] * b.sum() / a.sum()
                out.append(sum(b[j] * u(i - j) for j in range(len(b))) - sum(a[j] * before(i - j) for j in range(1, len(a))))
            y = np.array(out)
        y = y[::-1]
    return y[pad : pad + len(x)]


def test_lowpass_of_traces_of_many_lengths(spark):
    rng = np.random.default_rng(0)
    traces = [rng.normal(size=n).cumsum() for n in (40, 1, 40, 7, 2, 33, 40)]
    df = spark.createDataFrame([(i, [float(v) for v in t]) for i, t in enumerate([*traces, []])], "trial long, trace array<double>").coalesce(1)
    got = {r["trial"]: r["s"] for r in df.withColumn("s", G.lowpass(F.col("trace"), 5.0, 40.0)).collect()}
    for i, t in enumerate(traces):
        assert np.allclose(got[i], plain(t, 5.0, 40.0))
    assert got[7] == []
    still = G._lowpassed(np.full((1, 30), 4.0), G.butterworth(5.0, 40.0))
    assert np.allclose(still, 4.0)


def test_the_first_of_repeated_codes_counts(spark):
    listed, paired = S.LISTED[0], S.PAIRED[0]
    df = spark.createDataFrame([(f'{{"{listed}": ["a", "b", "c", "d"], "{paired}": ["1", "2", "1", null]}}',)], "codes string")
    assert df.select(S.code_map(F.col("codes")).alias("m")).first()["m"] == {"1": "a", "2": "b"}
