"""Classifiers whose fits are sums over partitions: many logistic models at once, and a weighted network.

A step of a fit broadcasts the models' coefficients, sums losses, gradients and curvatures
over the rows of each partition on Arrow batches, and adds the partitions up in Spark; the
driver solves systems of the size of a model. All models of a search share every pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written
from .windows import global_rank

#: Gradients, as shares of the rows' weight, at which a fit ends; steps without that are an error.
STILL, STEPS = 1e-8, 100
#: Steps in which a network's loss must fall.
PATIENCE = 10
#: Rows whose values are worked on at once, and rows of a task at least, as every step is a job.
BLOCK, TASK_ROWS = 4096, 100_000


def example_table(df: DataFrame, features: str, label: str, weight: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, x array, y double, w double, fold int) of the rows that have a label, written once for all passes; fold is 0 where there is none."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(0)
    rows = df.filter(F.col(label).isNotNull()).select(*keep, F.col(features).alias("x"), F.col(label).cast("double").alias("y"), w.alias("w"), fold.alias("fold"))
    table = written(rows, "examples")
    return table.coalesce(1 + table.count() // TASK_ROWS)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, w, fold) of some rows each."""
    for whole in batches:
        for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False)
            yield flat.reshape(b.num_rows, -1), *[b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3)]


def summed(rows: DataFrame, sums: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], models: int) -> np.ndarray:
    """Sums (models x figures) over an example table; `sums` gives those of some rows, for all models."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for block in _blocks(batches):
            total = total + sums(*block)
        if isinstance(total, np.ndarray):
            yield pa.RecordBatch.from_arrays([pa.array(range(models), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["model", "v"])

    parts = rows.select("x", "y", "w", "fold").mapInArrow(run, "model int, v array<double>")
    got = parts.groupBy("model").agg(Summarizer.sum(array_to_vector("v")).alias("v")).orderBy("model").collect()
    return np.array([r["v"].toArray() for r in got])


@dataclass(frozen=True)
class Candidate:
    """A logistic model learned from all folds but one (none if None); balanced: classes count alike."""

    fold: int | None = None
    reg: float = 1.0
    balanced: bool = False


@dataclass(frozen=True)
class Logistic:
    weights: np.ndarray
    bias: float


def _fold_sums(rows: DataFrame, d: int) -> dict[int, np.ndarray]:
    """Fold -> sums (class 0, class 1) x (rows, weight, x ..., x^2 ...)."""
    out: dict[int, np.ndarray] = {}
    wide = rows.groupBy("fold", "y").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), Summarizer.sum(array_to_vector("x")).alias("s"), Summarizer.sum(array_to_vector(F.transform("x", lambda v: v * v))).alias("q"))
    for r in wide.collect():
        out.setdefault(r["fold"], np.zeros((2, 2 + 2 * d)))[int(r["y"])] = [r["n"], r["weight"], *r["s"].toArray(), *r["q"].toArray()]
    return out


def fit_logistic(rows: DataFrame, candidates: Sequence[Candidate]) -> list[Logistic | None]:
    """The candidates' models, fitted together over an example table of labels 0 and 1, by Newton steps.

    Each minimises the weighted log loss and reg / 2 times the squares of its weights, for
    features scaled to a deviation of 1 in the rows that it learns from (a deviation of 0
    counts as 1). None for a candidate whose training rows, or the rows of whose fold, are
    of one class alone.
    """
    head = rows.select(F.size("x").alias("d")).head()
    if head is None:
        return [None] * len(candidates)
    d = head["d"]
    by_fold = _fold_sums(rows, d)
    everything = sum(by_fold.values())
    centre = everything[:, 2 : 2 + d].sum(0) / everything[:, 0].sum()
    chosen, penalty, classes = [], [], []
    for i, c in enumerate(candidates):
        own = by_fold.get(c.fold, np.zeros_like(everything)) if c.fold is not None else np.zeros_like(everything)
        rest = everything - own
        if (rest[:, 0] == 0).any() or (c.fold is not None and (own[:, 0] == 0).any()):
            continue
        n = rest[:, 0].sum()
        mean = rest[:, 2 : 2 + d].sum(0) / n
        var = rest[:, 2 + d :].sum(0) / n - mean**2
        chosen.append(i)
        penalty.append(np.append(c.reg * np.where(var > 1e-12, var, 1.0), 0.0))
        classes.append(rest[:, 1].sum() / (2 * rest[:, 1]) if c.balanced else np.ones(2))
    m = len(chosen)
    out: list[Logistic | None] = [None] * len(candidates)
    if not m:
        return out
    penalty, classes = np.array(penalty), np.array(classes)
    left_out = np.array([-1 if candidates[i].fold is None else candidates[i].fold for i in chosen])
    total = everything[:, 1].sum()

    def sums_at(beta: np.ndarray) -> np.ndarray:
        def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray) -> np.ndarray:
            z = np.column_stack([x - centre, np.ones(len(x))])
            score = z @ beta.T
            weight = w[:, None] * classes[:, y.astype(int)].T * (fold[:, None] != left_out)
            loss = (weight * (np.logaddexp(0, score) - y[:, None] * score)).sum(0)
            p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
            grad = (weight * (p - y[:, None])).T @ z
            bend = weight * p * (1 - p)
            curve = np.array([(z * bend[:, [k]]).T @ z for k in range(m)]).reshape(m, -1)
            return np.column_stack([loss, grad, curve])

        return summed(rows, sums, m)

    beta = best = np.zeros((m, d + 1))
    step, low = np.zeros_like(beta), np.full(m, np.inf)
    for _ in range(STEPS):
        s = sums_at(beta)
        loss = s[:, 0] + (penalty * beta**2).sum(1) / 2
        worse = loss > low + 1e-12 * np.abs(low)
        grad = s[:, 1 : d + 2] + penalty * beta
        curve = s[:, d + 2 :].reshape(m, d + 1, d + 1) + np.array([np.diag(p) for p in penalty])
        ridge = 1e-10 * np.trace(curve, axis1=1, axis2=2)[:, None, None] * np.eye(d + 1)
        fresh = -np.linalg.solve(curve + ridge, grad[:, :, None])[:, :, 0]
        still = (np.abs(grad).max(1) < STILL * total) & ~worse
        # A step that raised the loss is halved from where it began.
        step = np.where(worse[:, None], step / 2, np.where(still[:, None], 0.0, fresh))
        best = np.where(worse[:, None], best, beta)
        low = np.where(worse, low, loss)
        if (still | (np.abs(step).max(1) < 1e-12)).all():
            for k, i in enumerate(chosen):
                out[i] = Logistic(best[k, :d], float(best[k, d] - best[k, :d] @ centre))
            return out
        beta = best + step
    raise RuntimeError(f"logistic models still move after {STEPS} steps")


def logistic_scores(rows: DataFrame, models: Sequence[tuple[dict, Logistic]], on: Sequence[str]) -> DataFrame:
    """rows joined by the `on` columns to models, one row for each of them, with `prob`; a model comes with its values of named columns."""
    names = list(models[0][0]) if models else []
    kinds = {k: "int" if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else "double" if isinstance(v, float) else "boolean" if isinstance(v, bool) else "string" for k, v in (models[0][0].items() if models else ())}
    table = rows.sparkSession.createDataFrame([(*key.values(), [float(v) for v in m.weights], m.bias) for key, m in models], ", ".join([*(f"{n} {kinds[n]}" for n in names), "__w array<double>", "__b double"]))
    joined = rows.join(F.broadcast(table), list(on)) if on else rows.join(F.broadcast(table), F.lit(True))
    dot = F.aggregate(F.zip_with("x", "__w", lambda a, b: a * b), F.col("__b"), lambda a, v: a + v)
    return joined.withColumn("prob", 1 / (1 + F.exp(-dot))).drop("__w", "__b")


def subject_folds(df: DataFrame, folds: int, subject: str = "subject") -> DataFrame:
    """df with `fold`: subjects in order, cut into folds whose numbers of subjects differ by one at most. A row a subject meets in a task."""
    ids = df.select(subject).filter(F.col(subject).isNotNull()).distinct()
    n = ids.count()
    if n < 2:
        raise ValueError("at least two subjects are needed")
    k = min(folds, n)
    size, more = divmod(n, k)
    i = F.row_number().over(W.orderBy(subject)) - 1
    fold = F.when(i < more * (size + 1), F.floor(i / (size + 1))).otherwise(more + F.floor((i - more * (size + 1)) / size)).cast("int")
    return df.join(ids.withColumn("fold", fold), subject)


def stratified_folds(df: DataFrame, folds: int, label: str, keys: Sequence[str], seed: int = 67) -> DataFrame:
    """df with `fold`: the rows of each label in the order of a hash, in turn, so that folds have like shares of labels."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    ranked = global_rank(df.withColumns({"__label": F.col(label), "__order": order}), ["__label", "__order"], "__rank")
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__label", "__order", "__rank")


def out_of_fold(df: DataFrame, features: str, label: str, keys: Sequence[str], reg: float = 1.0, weight: str | None = None) -> DataFrame:
    """(keys, fold, label, prob): each row's score by the model that hasn't seen its fold; folds of one class, in or out, are left out."""
    rows = example_table(df, features, label, weight, keys)
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    models = fit_logistic(rows, [Candidate(f, reg) for f in folds])
    able = [({"fold": f}, m) for f, m in zip(folds, models, strict=True) if m]
    if not able:
        return rows.limit(0).select(*keys, "fold", F.col("y").cast("int").alias("label"), F.lit(0.0).alias("prob"))
    return logistic_scores(rows, able, ["fold"]).select(*keys, "fold", F.col("y").cast("int").alias("label"), "prob")


def leave_subjects_out(df: DataFrame, features: str, label: str, keys: Sequence[str], subject: str = "subject", folds: int = 5, seed: int = 67) -> DataFrame:
    """(keys, fold, label, prob, folds_by) of rows that folds of whole subjects score, or, where none can, stratified folds.

    Labels are 0 or 1 and both occur; there are two subjects at least. folds_by says which
    folds were used.
    """
    if df.select(label).filter(F.col(label).isNotNull()).distinct().limit(2).count() < 2:
        raise ValueError("at least two different labels are needed")
    scored = written(out_of_fold(subject_folds(df, folds, subject), features, label, keys), "scored")
    if not scored.isEmpty():
        return scored.withColumn("folds_by", F.lit("subject"))
    n = df.filter(F.col(label).isNotNull()).count()
    scored = written(out_of_fold(stratified_folds(df, min(5, max(2, n // 2)), label, keys, seed), features, label, keys), "scored")
    if scored.isEmpty():
        raise ValueError("no fold has both classes within and without")
    return scored.withColumn("folds_by", F.lit("label"))


def fold_metrics(scored: DataFrame, by: Sequence[str], label: str = "label", prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """by, n, accuracy, macro_f1, balanced_accuracy of binary scores; a class without rows has no recall and counts in neither mean, F1 of 0 / 0 is 0."""
    hit = F.col(prob) >= threshold
    cells = scored.groupBy(*by).agg(*[F.count_if((F.col(label) == y) & (hit if p else ~hit)).alias(f"c{y}{p}") for y in (0, 1) for p in (0, 1)], F.count("*").alias("n"))
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"c{k}{k}"), 2 * F.col(f"c{k}{k}") + F.col("c01") + F.col("c10")), F.lit(0.0)) for k in (0, 1)]
    recall = [F.try_divide(F.col(f"c{k}{k}"), F.col(f"c{k}0") + F.col(f"c{k}1")) for k in (0, 1)]
    there = sum((r.isNotNull().cast("int") for r in recall[1:]), recall[0].isNotNull().cast("int"))
    balanced = (F.coalesce(recall[0], F.lit(0.0)) + F.coalesce(recall[1], F.lit(0.0))) / there
    return cells.select(*by, "n", ((F.col("c00") + F.col("c11")) / F.col("n")).alias("accuracy"), ((f1[0] + f1[1]) / 2).alias("macro_f1"), balanced.alias("balanced_accuracy"))


def drawn(n: int, seed: int = 67, low: float = 1e-3, high: float = 1e2) -> list[tuple[int, float, bool]]:
    """(candidate, reg, balanced): reg falls evenly on a logarithmic scale; a seed gives the same draws everywhere."""
    rng = np.random.default_rng(seed)
    return [(i, float(math.exp(rng.uniform(math.log(low), math.log(high)))), bool(rng.integers(2))) for i in range(n)]


def random_search(df: DataFrame, draws: Sequence[tuple[int, float, bool]], features: str, label: str, weight: str | None = None) -> DataFrame:
    """A row a draw: reg, balanced, folds, means and sample deviations of macro-F1 and balanced accuracy over df's folds, and which draw is best.

    All draws and folds are fitted together. Best is the largest mean macro-F1, of equal
    ones the first draw.
    """
    rows = example_table(df, features, label, weight)
    folds = sorted(r["fold"] for r in rows.select("fold").distinct().collect())
    each = [(i, f, reg, balanced) for i, reg, balanced in draws for f in folds]
    models = fit_logistic(rows, [Candidate(f, reg, balanced) for _, f, reg, balanced in each])
    able = [({"candidate": i, "fold": f}, m) for (i, f, _, _), m in zip(each, models, strict=True) if m]
    table = df.sparkSession.createDataFrame([*draws], "candidate int, reg double, balanced boolean")
    scored = logistic_scores(rows, able, ["fold"]).select("candidate", "fold", F.col("y").cast("int").alias("label"), "prob")
    per = fold_metrics(scored, ["candidate", "fold"])
    stats = [f(c).alias(f"{c}_{n}") for c in ("macro_f1", "balanced_accuracy") for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    out = table.join(per.groupBy("candidate").agg(F.count("*").alias("folds"), *stats), "candidate", "left")
    first = F.row_number().over(W.orderBy(F.desc_nulls_last("macro_f1_mean"), "candidate"))  # a row a draw
    return out.withColumn("best", first == 1)


def seeded_comparison(df: DataFrame, features: str, label: str, keys: Sequence[str], seeds: Sequence[int], test: float = 0.2, subject: str = "subject", reg: float = 1.0) -> DataFrame:
    """(strategy, metric, runs, mean, std, low, high): accuracy, macro-F1 and balanced accuracy on held-out rows of several seeds.

    For every seed a hash holds out a share of the subjects (group), of each label's rows
    (stratified) or of all rows (random).
    """
    base = df.filter(F.col(label).isNotNull())
    share = lambda seed, *cols: F.pmod(F.xxhash64(F.lit(f"split{seed}"), *cols), F.lit(1 << 30)) / float(1 << 30)
    runs = [(s, seed) for seed in seeds for s in ("group", "stratified", "random")]
    k = max(2, round(1 / test))
    parts = []
    for seed in seeds:
        ranked = stratified_folds(base, k, label, keys, seed)
        parts += [base.withColumn("fold", (share(seed, subject) >= test).cast("int")), ranked.withColumn("fold", (F.col("fold") != 0).cast("int")), base.withColumn("fold", (share(seed, *keys) >= test).cast("int"))]
    scored = []
    for (strategy, seed), part in zip(runs, parts, strict=True):
        held = out_of_fold_zero(part, features, label, reg)
        if held is not None:
            scored.append(held.select(F.lit(strategy).alias("strategy"), F.lit(int(seed)).alias("seed"), "label", "prob"))
    if not scored:
        raise ValueError("no split has both classes on both sides")
    every = scored[0]
    for s in scored[1:]:
        every = every.unionByName(s)
    per = fold_metrics(every, ["strategy", "seed"])
    long = per.select("strategy", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("accuracy", "macro_f1", "balanced_accuracy")])).alias("x")).select("strategy", "x.*")
    return long.groupBy("strategy", "metric").agg(F.count("v").alias("runs"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def out_of_fold_zero(df: DataFrame, features: str, label: str, reg: float = 1.0) -> DataFrame | None:
    """(label, prob) of the rows of fold 0 by a model of all others, None where one side has one class."""
    rows = example_table(df, features, label)
    (model,) = fit_logistic(rows, [Candidate(0, reg)])
    return logistic_scores(rows, [({"fold": 0}, model)], ["fold"]).select(F.col("y").cast("int").alias("label"), "prob") if model else None


@dataclass(frozen=True)
class Network:
    """Layers (weights, bias): rectified units, then the classes' softmax; inputs are scaled first."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    centre: np.ndarray
    scale: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return np.exp(_forward(self.layers, (x - self.centre) / self.scale)[-1])


def _forward(layers: Sequence[tuple[np.ndarray, np.ndarray]], x: np.ndarray) -> list[np.ndarray]:
    """Inputs and the outputs of each layer; the last are logarithms of probabilities."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0) if i < len(layers) - 1 else z - np.logaddexp.reduce(z, axis=1, keepdims=True))
    return out


def _split(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:], strict=False):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def network_sums(flat: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(loss, gradient ...) of weighted rows."""
    layers = _split(flat, sizes)
    outs = _forward(layers, x)
    loss = -(w * outs[-1][np.arange(len(y)), y]).sum()
    back = np.exp(outs[-1])
    back[np.arange(len(y)), y] -= 1
    back *= w[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(outs[i].T @ back).ravel(), back.sum(0), *parts]
        if i:
            back = (back @ layers[i][0].T) * (outs[i] > 0)
    return np.concatenate([[loss], *parts])


def fit_network(rows: DataFrame, hidden: Sequence[int], classes: int, reg: float = 1e-4, class_weights: Sequence[float] | None = None, seed: int = 67, tol: float = 1e-4, steps: int = 500) -> tuple[Network, bool]:
    """(network, whether its steps came to rest) over an example table whose labels are 0 .. classes - 1.

    Minimises the mean log loss, rows counted by weight and class weight, and reg / 2 times
    the squares of the layers' weights a unit of weight, by limited-memory quasi-Newton
    steps; a step's loss and gradient are one sum over the rows. Rows of weight 2 are two
    rows. Rests where the largest gradient falls below tol, or the loss by less than tol of
    itself in PATIENCE steps, as at the kinks of rectified units, whose gradient never fades.
    """
    kind = np.ones(classes) if class_weights is None else np.asarray(class_weights, float)
    v = F.col("x")
    head = rows.select(F.size(v).alias("d")).head()
    if head is None:
        raise ValueError("a network needs rows to learn from")
    d = head["d"]
    stat = rows.agg(F.sum("w").alias("weight"), Summarizer.sum(array_to_vector(F.transform(v, lambda a: a * F.col("w")))).alias("s"), Summarizer.sum(array_to_vector(F.transform(v, lambda a: a * a * F.col("w")))).alias("q")).first()
    centre = stat["s"].toArray() / stat["weight"]
    var = stat["q"].toArray() / stat["weight"] - centre**2
    scale = np.where(var > 1e-12, np.sqrt(np.maximum(var, 0)), 1.0)
    sizes = [d, *hidden, classes]
    rng = np.random.default_rng(seed)
    flat = np.concatenate([np.concatenate([rng.uniform(-1, 1, a * b) * math.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)])
    decay = np.concatenate([np.concatenate([np.full(a * b, reg), np.zeros(b)]) for a, b in zip(sizes, sizes[1:], strict=False)])
    total = summed(rows, lambda x, y, w, fold: np.array([[(w * kind[y.astype(int)]).sum()]]), 1)[0, 0]

    def at(point: np.ndarray) -> tuple[float, np.ndarray]:
        s = summed(rows, lambda x, y, w, fold: network_sums(point, sizes, (x - centre) / scale, y.astype(int), w * kind[y.astype(int)])[None], 1)[0] / total
        return s[0] + (decay * point**2).sum() / 2 / total, s[1:] + decay * point / total

    moves: list[tuple[np.ndarray, np.ndarray]] = []
    loss, grad = at(flat)
    losses = [loss]
    for _ in range(steps):
        if np.abs(grad).max() < tol or (len(losses) > PATIENCE and losses[-1 - PATIENCE] - loss < tol * loss):
            return Network(_split(flat, sizes), centre, scale), True
        q, kept = grad.copy(), []
        for s, y in reversed(moves):
            a = s @ q / (y @ s)
            kept.append(a)
            q -= a * y
        if moves:
            s, y = moves[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(moves, reversed(kept), strict=True):
            q += s * (a - y @ q / (y @ s))
        size = 1.0 if moves else min(1.0, 1 / np.abs(grad).sum())
        while True:
            fresh = flat - size * q
            fresh_loss, fresh_grad = at(fresh)
            if fresh_loss <= loss - 1e-4 * size * (grad @ q) or size < 1e-10:
                break
            size /= 2
        if size < 1e-10:
            if not moves:
                return Network(_split(flat, sizes), centre, scale), True  # no way down from here
            moves = []  # the curvature misled; begin anew along the gradient
            continue
        s, y = fresh - flat, fresh_grad - grad
        if s @ y > 1e-12:
            moves = [*moves[-9:], (s, y)]
        flat, loss, grad = fresh, fresh_loss, fresh_grad
        losses.append(loss)
    return Network(_split(flat, sizes), centre, scale), False


def network_scores(rows: DataFrame, network: Network, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, y, predicted, probs) of an example table's rows."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            p = shared.value.probabilities(x) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in (*keep, "y")], pa.array(p.argmax(1).astype(np.int32)), pa.array(list(p), pa.list_(pa.float64()))], [*keep, "y", "predicted", "probs"])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keep, "y")), "predicted int, probs array<double>"])
    return rows.select(*keep, "y", "x").mapInArrow(run, schema)
