"""Signal kernels over trace arrays, many traces to an Arrow batch."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

DOUBLES = ArrayType(DoubleType())


def savgol_window(ms: float, fps: float, order: int) -> int:
    """Odd number of samples for a window in milliseconds, more than the polynomial's order."""
    n = max(int(round(ms / 1000 * fps)), order + 2)
    return n if n % 2 else n + 1


def savgol_matrix(window: int, order: int) -> np.ndarray:
    """Row i gives the fitted polynomial at position i of a window."""
    x = np.arange(window) - window // 2
    a = np.vander(x, order + 1, increasing=True)
    return a @ np.linalg.pinv(a)


def _traces(s: pd.Series) -> list[np.ndarray]:
    return [np.array([np.nan if v is None else v for v in (x if x is not None else [])], float) for x in s]


def savgol(trace: Column, window: int, order: int) -> Column:
    """Savitzky-Golay smoothing; the ends are the end windows' own fits. Shorter traces stay."""
    m = savgol_matrix(window, order)
    return _savgol_udf(m)(trace)


def _savgol_udf(m: np.ndarray):
    window, half = len(m), len(m) // 2

    @F.pandas_udf(DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in _traces(s):
            if len(x) >= window:
                inner = np.lib.stride_tricks.sliding_window_view(x, window) @ m[half]
                x = np.r_[(m @ x[:window])[:half], inner, (m @ x[-window:])[half + 1 :]]
            out.append(x)
        return pd.Series(out)

    return run


def savgol_native(trace: Column, window: int, order: int) -> Column:
    """The inner part of savgol as an array expression: sums of slices by fixed weights."""
    weights = savgol_matrix(window, order)[window // 2]
    w = F.array(*[F.lit(float(c)) for c in weights])
    count = F.greatest(F.size(trace) - window, F.lit(0))
    dot = lambda i: F.aggregate(F.zip_with(F.slice(trace, i + 1, F.lit(window)), w, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), count), dot)


def butterworth(cutoff: float, fps: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Third-order low-pass sections (b, a) by the bilinear transform."""
    k = math.tan(math.pi * cutoff / fps)
    one = (np.array([k, k]) / (1 + k), np.array([1, (k - 1) / (k + 1)]))
    n = 1 + k + k * k
    two = (np.array([k * k, 2 * k * k, k * k]) / n, np.array([1, 2 * (k * k - 1) / n, (1 - k + k * k) / n]))
    return [one, two]


def _filtered(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Rows of x, all a step at a time."""
    for b, a in sections:
        start = x[:, :1]
        u = np.hstack([start, start, x])
        fed = sum(b[j] * u[:, 2 - j : u.shape[1] - j] for j in range(len(b)))
        y = np.repeat(start * (b.sum() / a.sum()), u.shape[1], axis=1)
        for i in range(x.shape[1]):
            y[:, i + 2] = fed[:, i] - sum(a[j] * y[:, i + 2 - j] for j in range(1, len(a)))
        x = y[:, 2:]
    return x


def _lowpassed(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Traces of one length, a row each."""
    pad = min(12, x.shape[1] - 1)
    if pad < 1:
        return x
    y = np.hstack([2 * x[:, :1] - x[:, pad:0:-1], x, 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]])
    return _filtered(_filtered(y, sections)[:, ::-1], sections)[:, ::-1][:, pad : pad + x.shape[1]]


def lowpass(trace: Column, cutoff: float, fps: float) -> Column:
    """Zero-phase third-order Butterworth low-pass: forward, then backward, ends mirrored about their value."""
    return _lowpass_udf(cutoff, fps)(trace)


def _lowpass_udf(cutoff: float, fps: float):
    sections = butterworth(cutoff, fps)

    @F.pandas_udf(DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        traces = list(_traces(s))
        sizes = np.array([len(x) for x in traces])
        out: list[np.ndarray] = [np.zeros(0)] * len(traces)
        for n in set(sizes.tolist()) - {0}:
            at = np.flatnonzero(sizes == n)
            for k, x in zip(at.tolist(), _lowpassed(np.stack([traces[k] for k in at]), sections), strict=True):
                out[k] = x
        return pd.Series(out)

    return run


def _envelope(x: np.ndarray) -> np.ndarray:
    n = len(x)
    if not n:
        return x
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def _envelope_udf():
    @F.pandas_udf(DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([_envelope(np.nan_to_num(x)) for x in _traces(s)])

    return run


def hilbert_envelope(trace: Column) -> Column:
    return _envelope_udf()(trace)


def clipped_envelope(trace: Column, fps: float, seconds: float = 0.25) -> Column:
    """Nulls as 0, clipped to 0-100, Hilbert envelope, centred mean over `seconds`."""
    w = max(1, round(seconds * fps))
    clean = F.transform(trace, lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(x, F.lit(0.0)))))
    e = hilbert_envelope(clean)

    @F.pandas_udf(DOUBLES)
    def smooth(s: pd.Series) -> pd.Series:
        out = []
        for x in _traces(s):
            c = np.r_[0, np.cumsum(x)]
            i = np.arange(len(x))
            lo, hi = np.maximum(0, i - w // 2), np.minimum(len(x), i + (w - 1) // 2 + 1)
            out.append((c[hi] - c[lo]) / np.maximum(1, hi - lo))
        return pd.Series(out)

    return smooth(e)


def _welch(x: np.ndarray, fps: float, segment: int = 256) -> tuple[np.ndarray, np.ndarray]:
    n = min(segment, len(x))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    step = max(1, n - n // 2)
    parts = np.lib.stride_tricks.sliding_window_view(x, n)[::step]
    parts = (parts - parts.mean(1, keepdims=True)) * w
    p = (np.abs(np.fft.rfft(parts, axis=1)) ** 2).mean(0) / (fps * (w**2).sum())
    p[1 : (len(p) - 1 if n % 2 == 0 else len(p))] *= 2
    return np.fft.rfftfreq(n, 1 / fps), p


def welch_bands(trace: Column, fps: float, bands: list[tuple[float, float]]) -> Column:
    """Power of each band, then its share of all: Hann, half overlap, constant detrend, one-sided."""
    return _welch_udf(fps, bands)(trace)


def _welch_udf(fps: float, bands: list[tuple[float, float]]):
    @F.pandas_udf(DOUBLES)
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in _traces(s):
            if len(x) < 4:
                out.append(None)
                continue
            f, p = _welch(np.nan_to_num(x), fps)
            total = np.trapezoid(p, f)
            power = [float(np.trapezoid(p[m], f[m])) if (m := (f >= a) & (f <= b)).any() else 0.0 for a, b in bands]
            out.append(power + [v / total if total > 0 else math.nan for v in power])
        return pd.Series(out)

    return run


def register(spark, fps: float = 40.0, window: int = 5, order: int = 2, cutoff: float = 5.0, bands: Sequence[tuple[float, float]] = ((0.0, 5.0), (5.0, 20.0))) -> None:
    """For SQL: savgol, lowpass, hilbert_envelope, welch_bands with these settings; hankel and segments as table functions; normal, chi-square and t tails."""
    for name, kernel in {"savgol": _savgol_udf(savgol_matrix(window, order)), "lowpass": _lowpass_udf(cutoff, fps), "hilbert_envelope": _envelope_udf(), "welch_bands": _welch_udf(fps, [*bands])}.items():
        spark.udf.register(name, kernel)

    @F.udtf(returnType="start: int, window: array<double>")
    class Hankel:
        def eval(self, trace: list, length: int):
            for i in range(len(trace or []) - length + 1):
                yield i, trace[i : i + length]

    @F.udtf(returnType="segment: string, first: int, last: int")
    class Segments:
        def eval(self, fps: float, latency: float, frames: int):
            clamp = lambda f: max(0, min(frames, int(f)))
            base = clamp(round(30 * fps))
            start = max(base, clamp(round((30 + max(0.0, latency)) * fps)))
            end = clamp(start + round((30 + max(0.0, latency)) * fps))
            yield "baseline", 0, base
            yield "odor", start, end
            yield "post", end, clamp(end + round(30 * fps))

    spark.udtf.register("hankel", Hankel)
    spark.udtf.register("segments", Segments)
    k = "(1 / (1 + 0.2316419 * abs(z)))"
    poly = f"(0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    p = f"(exp(-z * z / 2) / sqrt(2 * pi()) * {k} * {poly})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normal_sf(z DOUBLE) RETURNS DOUBLE RETURN CASE WHEN z >= 0 THEN {p} ELSE 1 - {p} END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION chi2_1_sf(x DOUBLE) RETURNS DOUBLE RETURN 2 * normal_sf(sqrt(x))")
    theta = "atan(abs(t) / sqrt(df))"
    terms = f"transform(sequence(0, 200), i -> CASE WHEN i IN (0, 200) THEN 1D WHEN i % 2 = 1 THEN 4D ELSE 2D END * pow(cos({theta} * i / 200), df - 1))"
    whole = "transform(sequence(0, 200), i -> CASE WHEN i IN (0, 200) THEN 1D WHEN i % 2 = 1 THEN 4D ELSE 2D END * pow(cos(pi() / 2 * i / 200), df - 1))"
    total = lambda a: f"aggregate({a}, 0D, (s, x) -> s + x)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION t_two_sided(t DOUBLE, df DOUBLE) RETURNS DOUBLE RETURN 1 - {total(terms)} * {theta} / ({total(whole)} * pi() / 2)")
