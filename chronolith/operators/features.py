"""Feature tables of traces: aggregates and array functions, with Welch bands where asked."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import signal as G
from . import windows as W_
from .grams import fit_lag_components, lag_series
from .percentiles import column_medians
from .store import written

# Names and edges of the scorer's frequency bands, in Hz.
BANDS = (("vlow", 0.0, 0.5), ("low", 0.5, 1.0), ("mid", 1.0, 3.0), ("high", 3.0, 5.0), ("vhigh", 5.0, 10.0))
EPS = 1e-10


def band_sums(trace: Column, fps: float, bands: Sequence[tuple[float, float]], segment: int = 256) -> Column:
    """Sums of the Welch densities in each half-open band."""

    @F.pandas_udf(G.DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in G._traces(s):
            if not len(x):
                out.append([0.0] * len(bands))
                continue
            f, p = G._welch(np.nan_to_num(x), fps, segment)
            out.append([float(p[(f >= a) & (f < b)].sum()) for a, b in bands])
        return pd.Series(out)

    return run(trace)


def signal_features(trials: DataFrame, keys: Sequence[str], trace: str, on: int, off: int, fps: float, measurements: bool = False) -> DataFrame:
    """keys and 13 features of each trace against its baseline; with measurements all 37 figures behind them."""
    t = F.col(trace)
    x = trials.select(*keys, F.slice(t, 1, on).alias("b"), F.slice(t, on + 1, off - on).alias("d"), F.slice(t, off + 1, F.greatest(F.lit(0), F.size(t) - off)).alias("a"))
    edges = [(lo, hi) for _, lo, hi in BANDS]
    x = x.withColumns({"pb": band_sums(F.col("b"), fps, edges), "pd": band_sums(F.col("d"), fps, edges)})
    m = {f"{n}_{k}": f(F.col(c)) for n, c in (("before", "b"), ("during", "d"), ("after", "a")) for k, f in (("mean", S.array_mean), ("std", S.array_std))}
    auc = {n: S.array_area(F.col(c)) / F.greatest(F.lit(1), F.size(c)) for n, c in (("before", "b"), ("during", "d"), ("after", "a"))}
    x = x.select(*keys, "b", "d", "pb", "pd", *[c.alias(n) for n, c in m.items()], *[c.alias(f"auc_{n}") for n, c in auc.items()], F.array_max("d").alias("during_max"))
    c = F.col
    base, spread, shift = c("before_mean"), c("before_std") + EPS, c("during_mean") - c("before_mean")
    total = lambda p: S.array_sum(c(p))
    out = {
        "mean_shift_z": shift / spread,
        "std_ratio": c("during_std") / spread,
        "peak_z": (c("during_max") - base) / spread,
        "auc_ratio": c("auc_during") / (c("auc_before") + EPS),
        **{f"power_ratio_{n}": c("pd")[i] / (c("pb")[i] + EPS) for i, (n, _, _) in enumerate(BANDS)},
        "total_power_ratio": total("pd") / (total("pb") + EPS),
        "frac_above_baseline": F.size(F.filter("d", lambda v: v > c("before_mean") + 2 * c("before_std"))) / F.greatest(F.lit(1), F.size("d")),
        "persistence": (c("after_mean") - base) / (shift + EPS),
        "time_to_peak_frac": (F.array_position("d", c("during_max")) - 1) / F.greatest(F.lit(1), F.size("d")),
    }
    if measurements:
        out |= {n: c(n) for n in (*m, "during_max", "auc_before", "auc_during", "auc_after")}
        out |= {"mean_shift": shift, "mean_ratio": c("during_mean") / (base + EPS), "peak_over_baseline": c("during_max") / (base + EPS), "after_vs_before_mean": c("after_mean") / (base + EPS)}
        out |= {f"{e}_{n}_power": c(p)[i] for e, p in (("before", "pb"), ("during", "pd")) for i, (n, _, _) in enumerate(BANDS)}
    return x.select(*keys, *[v.alias(n) for n, v in out.items()])


def impute_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and NaN values and nulls as the column's median, 0 where it has none."""
    bad = lambda n: F.col(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))
    clean = df.withColumns({n: F.when(~bad(n), F.col(n).cast("double")) for n in columns})
    row = column_medians(clean, columns)
    return clean.withColumns({n: F.coalesce(F.col(n), F.lit(row[n] if row[n] is not None else 0.0)) for n in columns})


def preprocess(trials: DataFrame, trace: str, on: int, window: int = 5, order: int = 2) -> DataFrame:
    """Traces smoothed, then z-scored by their samples before the stimulus."""
    smooth = trials.withColumn(trace, G.savgol(F.col(trace), window, order))
    return smooth.withColumn(trace, S.zscore(F.col(trace), F.slice(trace, 1, on)))


def feature_table(trials: DataFrame, key: str, trace: str, on: int, fps: float, k: float = 3.0, bands: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """One row a trial from z-scored traces: latency, peak, rise, decay, areas, excursions, velocity, envelope, SNR, bands.

    Figures are of the samples from `on` on, but baseline_*, auc_before and velocity_max_abs,
    velocity_tmax_abs and velocity_total_abs, which are of the whole trial.
    """
    trials = written(trials, "traces")  # read once for the envelope, once for the bands
    v = trials.withColumn("__env", G.hilbert_envelope(F.col(trace)))
    long = v.select(key, F.posexplode(F.arrays_zip(F.col(trace).alias("v"), F.col("__env").alias("env"))).alias("i", "x")).select(key, "i", F.col("x.v").alias("v"), F.col("x.env").alias("env"))
    long = long.withColumns({"t": (F.col("i") - on) / F.lit(fps), "velocity": W_.velocity("v", [key], "i", 1 / fps)})
    before, during = F.col("i") < on, F.col("i") >= on
    base = long.groupBy(key).agg(
        F.avg(F.when(before, F.col("v"))).alias("baseline_mean"), F.stddev_pop(F.when(before, F.col("v"))).alias("baseline_std"), F.regr_slope(F.when(before, F.col("v")), F.when(before, F.col("t"))).alias("baseline_slope")
    ).withColumn("threshold", F.col("baseline_mean") + k * F.when(F.col("baseline_std") > 0, F.col("baseline_std")).otherwise(1.0))
    moved = W_.with_previous(long.withColumn("speed", F.abs("velocity")), [key], "t", "speed")
    first_fastest = F.min_by("t", F.struct((-F.col("speed")).alias("v"), F.col("t").alias("t")))
    whole = moved.groupBy(key).agg(F.max("speed").alias("velocity_max_abs"), first_fastest.alias("velocity_tmax_abs"), W_.trapezoid("t", "speed").alias("velocity_total_abs"))
    d = W_.with_previous(long.filter(during), [key], "t", "v").join(base, key)
    onsets = d.filter((F.col("v") >= F.col("threshold")) & (F.col("prev_v").isNull() | (F.col("prev_v") < F.col("threshold"))))
    gap = F.col("t") - F.lag("t").over(W.partitionBy(key).orderBy("t"))
    gaps = onsets.withColumn("gap", gap).groupBy(key).agg(F.avg("gap").alias("inter_excursion_mean"), F.stddev_pop("gap").alias("inter_excursion_std"))
    out = d.groupBy(key).agg(
        *[F.first(c).alias(c) for c in ("baseline_mean", "baseline_std", "baseline_slope", "threshold")],
        W_.first_crossing("t", "v", F.col("threshold")).alias("latency"),
        F.max("v").alias("peak"),
        F.min_by("t", F.struct((-F.col("v")).alias("v"), F.col("t").alias("t"))).alias("peak_time"),
        F.avg((F.col("v") > F.col("threshold")).cast("double")).alias("duty_cycle"),
        W_.trapezoid("t", "v").alias("auc_during"),
        F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"),
        F.max(F.abs("velocity")).alias("velocity_max"),
        F.avg(F.abs("velocity")).alias("velocity_mean"),
        F.max("env").alias("envelope_max"),
        F.avg("env").alias("envelope_mean"),
        F.var_pop("env").alias("envelope_var"),
        F.min_by("t", F.struct((-F.col("env")).alias("v"), F.col("t").alias("t"))).alias("envelope_tmax"),
        F.avg("v").alias("during_mean"),
        F.count_if((F.col("v") >= F.col("threshold")) & (F.col("prev_v").isNull() | (F.col("prev_v") < F.col("threshold")))).alias("excursions"),
    )
    area = W_.areas(long.filter(before), [key], "t", "v").withColumnRenamed("area", "auc_before")
    rise = W_.rise_and_decay(long.filter(during), [key], "t", "v", 0.0).select(key, "rise_time", "half_life")
    out = out.join(area, key, "left").join(rise, key, "left").withColumns({"snr": S.safe_ratio(F.col("rms"), F.when(F.col("baseline_std") > 0, F.col("baseline_std")).otherwise(1.0)), "auc_ratio": S.safe_ratio(F.col("auc_during"), F.col("auc_before")), "auc_after": F.lit(None).cast("double")})
    out = out.join(whole, key, "left").join(gaps, key, "left")
    out = out.withColumns({"peak_to_baseline": F.col("peak") - F.col("baseline_mean"), "auc_diff": F.col("auc_during") - F.col("auc_before")})
    if bands:
        b = trials.select(key, G.welch_bands(F.slice(trace, on + 1, F.size(trace) - on), fps, [*bands]).alias("w"))
        n = len(bands)
        out = out.join(b.select(key, *[F.col("w")[i].alias(f"bandpower_{i}") for i in range(n)], *[F.col("w")[n + i].alias(f"bandpower_ratio_{i}") for i in range(n)]), key, "left")
    return out


#: Figures of component_features, in order.
COMPONENT_FIGURES = ("pc1_auc_0_1", "pc1_auc_1_2", "pc1_max", "pc1_time_to_threshold", "pc_path_length")


def component_features(trials: DataFrame, key: str, trace: str, on: int, fps: float, thresholds: DataFrame, lag: int, k: int = 2, split: float = 1.0) -> DataFrame:
    """(key, COMPONENT_FIGURES) of each trial's component series, on the times of its windows' middle samples.

    Areas of the first component within [0, split] and (split, 2 split] seconds after `on`, its
    largest value, the first time at the trial's threshold(key, threshold), between samples
    by line, and the length of the path in the first two components. A trial shorter than a
    window has nulls, one without a threshold no time.
    """
    model = fit_lag_components(trials, trace, lag, k)

    def figures(series: np.ndarray, threshold: float | None) -> list[float | None]:
        t = (np.minimum(np.arange(len(series)) + lag // 2, len(series) + lag - 2) - on) / fps
        v = series[:, 0]
        area = lambda m: float(((v[m][1:] + v[m][:-1]) / 2 * np.diff(t[m])).sum())
        crossing = None
        hit = np.flatnonzero(v >= threshold) if threshold is not None else []
        if len(hit):
            i = hit[0]
            crossing = float(t[i]) if i == 0 or v[i] == v[i - 1] else float(t[i - 1] + min(1.0, max(0.0, (threshold - v[i - 1]) / (v[i] - v[i - 1]))) * (t[i] - t[i - 1]))
        path = float(np.sqrt((np.diff(series[:, :2], axis=0) ** 2).sum(1)).sum()) if series.shape[1] > 1 else None
        return [area((t >= 0) & (t <= split)), area((t > split) & (t <= 2 * split)), float(v.max()), crossing, path]

    @F.pandas_udf("array<double>")
    def run(series: pd.Series, threshold: pd.Series) -> pd.Series:
        none = [None] * len(COMPONENT_FIGURES)
        return pd.Series([none if s is None or not len(s) else figures(np.stack(s), None if pd.isna(x) else x) for s, x in zip(series, threshold, strict=True)])

    rows = trials.select(key, lag_series(F.col(trace).cast("array<double>"), model).alias("__series")).join(thresholds.select(key, "threshold"), key, "left")
    found = rows.select(key, run("__series", F.col("threshold").cast("double")).alias("__f"))
    return found.select(key, *[F.col("__f")[i].alias(n) for i, n in enumerate(COMPONENT_FIGURES)])
