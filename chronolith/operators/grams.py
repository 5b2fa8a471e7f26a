"""Components, subclusters and motifs of traces, from Gram blocks that Spark sums.

Traces have one length d. A task sums counts, sums and cross products of its rows on Arrow
batches; what is added up is d * d numbers a group. Few groups meet in the driver, many
(one a parent cluster) are solved in tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: Groups whose blocks a task holds at once.
HELD = 64
#: Rows of models that are broadcast; more are shuffled.
BROADCAST_ROWS = 10_000
DOUBLES = "array<double>"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def gram_blocks(df: DataFrame, trace: str, by: str | None = None, lag: int | None = None) -> DataFrame:
    """(by, shift, v): for each group the count, sums and cross products of its traces, or of their windows of `lag` samples, less shift.

    shift is a trace of the table, which keeps the sums small where traces are far from 0.
    """
    rows = df.filter(F.col(trace).isNotNull()).select((F.col(by) if by else F.lit(0)).alias("g"), F.col(trace).cast(DOUBLES).alias("x"))
    head = rows.head()
    if head is None:
        return rows.select("g", F.col("x").alias("shift"), F.col("x").alias("v"))
    shift = np.array(head["x"], float) if lag is None else np.full(lag, float(np.mean(head["x"])))
    kind = dict(rows.dtypes)["g"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), schema), pa.array(list(held.values()), pa.list_(pa.float64()))], ["g", "v"])

        for b in batches:
            schema, groups, x = b.schema.field(0).type, np.array(b.column(0).to_pylist(), object), _matrix(b.column(1))
            for g in dict.fromkeys(groups.tolist()):
                own = x[groups == g]
                if lag is not None:
                    own = np.lib.stride_tricks.sliding_window_view(own, lag, axis=1).reshape(-1, lag)
                own = own - shift
                block = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                held[g] = held[g] + block if g in held else block
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    parts = rows.mapInArrow(run, f"g {kind}, v array<double>")
    sums = parts.groupBy("g").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    return sums.select("g", F.array(*[F.lit(float(s)) for s in shift]).alias("shift"), "v")


@dataclass(frozen=True)
class Components:
    """Mean trace, loadings (samples x components, the largest of each positive) and the share of the variance of each."""

    mean: np.ndarray
    loads: np.ndarray
    shares: np.ndarray


def components_of(v: np.ndarray, shift: np.ndarray, k: int) -> Components:
    """Components of one group's block; fewer than two rows, or no spread, give shares of 0."""
    d = len(shift)
    n, s, g = v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)
    mean = s / max(n, 1)
    cov = (g - n * np.outer(mean, mean)) / max(n - 1, 1)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, loads = np.maximum(values[::-1], 0), vectors[:, ::-1][:, :k]
    signs = np.sign(loads[np.abs(loads).argmax(0), np.arange(loads.shape[1])])
    total = values.sum()
    return Components(shift + mean, loads * np.where(signs == 0, 1, signs), values[:k] / total if total > 0 else np.zeros(min(k, d)))


def projected(trace: Column, model: Components) -> Column:
    """Scores of a trace column, an array."""

    @F.pandas_udf(DOUBLES)
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        has = x.notna().to_numpy()
        out = np.full(len(x), None, object)
        if has.any():
            scores = (np.stack([np.asarray(t, float) for t in x[has]]) - model.mean) @ model.loads
            out[has] = pd.Series(list(scores)).to_numpy()
        return pd.Series(out)

    return run(trace)


def fit_components(df: DataFrame, trace: str, k: int) -> tuple[Components, DataFrame]:
    """k components of the traces, and df with their scores `pcs`; a null trace counts for nothing and has no scores."""
    block = gram_blocks(df, trace).head()
    if block is None:
        raise ValueError("components need rows")
    model = components_of(np.array(block["v"]), np.array(block["shift"]), k)
    return model, df.withColumn("pcs", projected(F.col(trace).cast(DOUBLES), model))


def explained(model: Components, spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, float(x)) for i, x in enumerate(model.shares)], "component int, variance double")


def time_importance(model: Components, spark, top: int) -> DataFrame:
    """(t, importance): mean absolute loading over the first components; one row a time point."""
    loads = np.abs(model.loads[:, :top]).mean(1)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(loads)], "t int, importance double")


def fit_lag_components(trials: DataFrame, trace: str, lag: int, k: int) -> Components:
    """Components of all overlapping windows of `lag` samples; windows are never rows of a table."""
    block = gram_blocks(trials, trace, lag=lag).head()
    if block is None:
        raise ValueError("components need rows")
    return components_of(np.array(block["v"]), np.array(block["shift"]), k)


def lag_series(trace: Column, model: Components) -> Column:
    """Scores of a trace's windows in order: an array of arrays."""
    lag = len(model.mean)

    @F.pandas_udf(f"array<{DOUBLES}>")
    def run(x: pd.Series) -> pd.Series:
        def one(t) -> list | None:
            if t is None or len(t) < lag:
                return None if t is None else []
            return list((np.lib.stride_tricks.sliding_window_view(np.asarray(t, float), lag) - model.mean) @ model.loads)

        return x.map(one)

    return run(trace)


def lag_components(trials: DataFrame, trace: str, lag: int, k: int, key: str = "trial") -> DataFrame:
    """(trial, start, pcs): components of every trial's overlapping windows of `lag` samples."""
    model = fit_lag_components(trials, trace, lag, k)
    return trials.select(key, F.posexplode(lag_series(F.col(trace).cast(DOUBLES), model)).alias("start", "pcs"))


def _models(blocks: DataFrame, k: int) -> DataFrame:
    """(g, mean, loads) of each group's components, solved in tasks; loads sample by sample."""
    kind = dict(blocks.dtypes)["g"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [components_of(np.array(v.as_py()), np.array(s.as_py()), k) for s, v in zip(b.column(1), b.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.list_(pa.float64())) for x in ([m.mean for m in found], [m.loads.ravel() for m in found])]], ["g", "mean", "loads"])

    return blocks.select("g", "shift", "v").mapInArrow(run, f"g {kind}, mean {DOUBLES}, loads {DOUBLES}")


def _hinted(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def subclusters(df: DataFrame, k: int, trace: str = "trace", cluster: str = "cluster", components: int = 3, least: int | None = None, rounds: int = 300) -> DataFrame:
    """df with `sub` 0 .. k - 1, clusters inside every parent cluster at once.

    Each parent has components of its own rows; k means of their scores start evenly along
    the first component and move until none does, all parents in one aggregation a round.
    Parents of fewer than `least` rows (k if None), and rows of no parent or no trace, have
    sub null. `rounds` without rest is an error.
    """
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "rows")
    inside = rows.filter(F.col(cluster).isNotNull() & F.col(trace).isNotNull()).select("__row", F.col(cluster).alias("g"), F.col(trace).cast(DOUBLES).alias("x"))
    blocks = written(gram_blocks(inside, "x", "g").filter(F.col("v")[0] >= (k if least is None else least)), "blocks")
    models = written(_models(blocks, components), "models")

    @F.pandas_udf(DOUBLES)
    def score(x: pd.Series, mean: pd.Series, loads: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        c = np.stack(x.to_numpy()) - np.stack(mean.to_numpy())
        return pd.Series(list(np.einsum("nd,ndk->nk", c, np.stack(loads.to_numpy()).reshape(len(x), c.shape[1], -1))))

    scored = written(inside.join(_hinted(models), "g").select("__row", "g", score("x", "mean", "loads").alias("pcs")), "scores")
    ends = scored.groupBy("g").agg(F.min(F.col("pcs")[0]).alias("lo"), F.max(F.col("pcs")[0]).alias("hi"))
    dims = scored.select(F.size("pcs").alias("d")).head()
    zero = [F.lit(0.0)] * ((dims["d"] if dims else 1) - 1)
    start = F.array(*[F.array(F.col("lo") + (F.col("hi") - F.col("lo")) * ((j + 0.5) / k), *zero) for j in range(k)])
    centres = written(ends.select("g", start.alias("centres")), "centres")

    def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
        far = F.transform("centres", lambda c: F.aggregate(F.zip_with(c, "pcs", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x))
        return points.join(_hinted(centres), "g").withColumn("__far", far).withColumn("sub", (F.array_position("__far", F.array_min("__far")) - 1).cast("int"))

    for _ in range(rounds):
        sums = nearest(scored, centres).groupBy("g", "sub").agg(vector_to_array(Summarizer.mean(array_to_vector("pcs"))).alias("m"))
        moved = sums.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("sub", "m"))).alias("at"))  # k entries a parent
        fresh = centres.join(moved, "g").select("g", F.col("centres").alias("old"), F.transform("centres", lambda c, j: F.coalesce(F.col("at")[j], c)).alias("centres"))
        fresh = written(fresh, "centres")
        drift = F.aggregate(F.zip_with(F.flatten("old"), F.flatten("centres"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: F.greatest(a, x))
        far = fresh.agg(F.max(drift)).first()[0]
        centres = fresh.select("g", "centres")
        if not far or far < 1e-9:
            break
    else:
        raise RuntimeError(f"subclusters still move after {rounds} rounds")
    found = nearest(scored, centres).select(F.col("__row").alias("__at"), "sub")
    return rows.join(found, F.col("__row") == F.col("__at"), "left").drop("__row", "__at")


def nonnegative(gram: np.ndarray, against: np.ndarray, w: np.ndarray, tol: float = 1e-12, sweeps: int = 10_000) -> np.ndarray:
    """Rows w >= 0 that minimise w gram w' - 2 w against', by coordinates in turn until none moves; never worse than the start."""
    size = np.maximum(np.diag(gram), 1e-300)
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(size)):
            fresh = np.maximum(0, w[:, j] + (against[:, j] - w @ gram[:, j]) / size[j]) if size[j] > 1e-300 else np.zeros(len(w))
            most = max(most, float(np.abs(fresh - w[:, j]).max(initial=0)))
            w[:, j] = fresh
        if most <= tol * max(1.0, float(np.abs(w).max(initial=0))):
            break
    return w


@dataclass(frozen=True)
class Motifs:
    """Motifs (motifs x samples, of length 1), the share of the sum of squares that they explain, and the residual of each round."""

    shapes: np.ndarray
    explained: float
    residuals: list[float]


def fit_motifs(df: DataFrame, trace: str, rank: int, tol: float = 1e-6, rounds: int = 500) -> Motifs:
    """Nonnegative factors of nonnegative traces (negative values count as 0): weights and shapes in turn, each by least squares.

    A round finds every row's weights in its task and sums weights' and weights-by-traces'
    Gram blocks; the residual never grows, and rounds end where it rests. Shapes start from
    the eigenvectors of the traces' Gram matrix. `rounds` without rest is an error.
    """
    rows = written(df.filter(F.col(trace).isNotNull()).select(F.transform(F.col(trace).cast(DOUBLES), lambda x: F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0)))).alias("x")), "traces")
    block = gram_blocks(rows, "x").head()
    if block is None:
        raise ValueError("motifs need rows")
    shift, v = np.array(block["shift"]), np.array(block["v"])
    d = len(shift)
    n, s, g = v[0], v[1 : d + 1], v[d + 1 :].reshape(d, d)
    gram = g + np.outer(s, shift) + np.outer(shift, s) + n * np.outer(shift, shift)
    total = float(np.trace(gram))
    values, vectors = np.linalg.eigh(gram)
    shapes = np.zeros((rank, d))
    for j in range(rank):
        u = vectors[:, -1 - j % d]
        up, down = np.maximum(u, 0), np.maximum(-u, 0)
        shapes[j] = (up if up @ up >= down @ down else down) + 1e-3 * (1 + np.cos(np.arange(d) * (j + 1))) * np.abs(u).max()
    residuals: list[float] = []
    for _ in range(rounds):
        shapes = shapes / np.maximum(np.sqrt((shapes**2).sum(1, keepdims=True)), 1e-300)

        def run(batches: Iterable[pa.RecordBatch], h: np.ndarray = shapes) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(rank * rank + rank * d)
            for b in batches:
                x = _matrix(b.column(0))
                w = nonnegative(h @ h.T, x @ h.T, np.zeros((len(x), rank)))
                sums += np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([list(sums)], pa.list_(pa.float64()))], ["v"])

        got = rows.mapInArrow(run, f"v {DOUBLES}").agg(Summarizer.sum(array_to_vector("v")).alias("v")).first()["v"].toArray()
        ww, wx = got[: rank * rank].reshape(rank, rank), got[rank * rank :].reshape(rank, d)
        residuals.append(max(0.0, float(total - 2 * (wx * shapes).sum() + np.trace(ww @ shapes @ shapes.T))))
        if len(residuals) > 1 and residuals[-2] - residuals[-1] <= tol * max(total, 1e-300):
            order = np.argsort(-(np.diag(ww)), kind="stable")
            return Motifs(shapes[order], 1 - residuals[-1] / total if total else 0.0, residuals)
        shapes = nonnegative(ww, wx.T, shapes.T.copy()).T
    raise RuntimeError(f"motifs still change after {rounds} rounds")


def motif_weights(trace: Column, motifs: Motifs) -> Column:
    """Nonnegative weights of each motif in a trace."""
    h = motifs.shapes

    @F.pandas_udf(DOUBLES)
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        m = np.maximum(np.nan_to_num(np.stack([np.asarray(t, float) for t in x])), 0)
        return pd.Series(list(nonnegative(h @ h.T, m @ h.T, np.zeros((len(m), len(h))))))

    return run(trace)


@dataclass(frozen=True)
class Preprocessor:
    """Medians for nulls, scaling by population deviations, components of the trace columns."""

    trace: Sequence[str]
    scalars: Sequence[str]
    medians: dict[str, float]
    means: dict[str, float]
    deviations: dict[str, float]
    components: Components

    def _scaled(self, columns: Sequence[str]) -> Column:
        filled = [(c, F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(self.medians[c]))) for c in columns]
        return F.array(*[(x - F.lit(self.means[c])) / F.lit(self.deviations[c]) for c, x in filled]) if columns else F.array().cast(DOUBLES)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `features`: scores of the components, then the scaled scalars."""
        return df.withColumn("features", F.concat(projected(self._scaled(self.trace), self.components), self._scaled(self.scalars)))


def fit_preprocessor(df: DataFrame, trace: Sequence[str], scalars: Sequence[str], components: int) -> Preprocessor:
    """Learned from df, training rows; a column without values has median 0, one without spread a deviation of 1."""
    from .percentiles import column_medians

    columns = [*trace, *scalars]
    medians = {c: 0.0 if m is None else m for c, m in column_medians(df, columns).items()}
    filled = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(medians[c])) for c in columns}
    row = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(filled.values()) for n, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    means, deviations = ({c: float(row[f"{n}{i}"] or other) for i, c in enumerate(columns)} for n, other in (("m", 0.0), ("d", 1.0)))
    model = Preprocessor(trace, scalars, medians, means, deviations, Components(np.zeros(len(trace)), np.eye(len(trace), components), np.zeros(components)))
    block = gram_blocks(df.select(model._scaled(trace).alias("x")), "x").head()
    if block is None:
        return model
    return Preprocessor(trace, scalars, medians, means, deviations, components_of(np.array(block["v"]), np.array(block["shift"]), components))
