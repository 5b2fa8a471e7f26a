"""Normalisation, lag components, clustering, classifiers, splits and sweeps over Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .density import density_clusters  # noqa: F401
from .grams import explained, fit_components, fit_motifs, fit_preprocessor, lag_components, motif_weights, subclusters, time_importance  # noqa: F401
from .percentiles import exact_percentiles, percentile_columns
from .store import written
from .windows import global_rank, lag_embedding, running_sums


def normalize(df: DataFrame, columns: Sequence[str], mode: str, fit: DataFrame | None = None) -> DataFrame:
    """Columns by zscore (population deviation) or minmax, as in the whole table or in fit (training rows); a range of 0 counts as 1."""
    if mode == "none":
        return df
    low, wide = (F.avg, F.stddev_pop) if mode == "zscore" else (F.min, lambda c: F.max(c) - F.min(c))
    row = (df if fit is None else fit).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", low), ("b", wide))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(row[f"a{i}"] or 0.0)) / F.lit(row[f"b{i}"] or 1.0) for i, c in enumerate(columns)})


def projection_matrix(projected: DataFrame, points: int, key: str = "trial") -> DataFrame:
    """(trial, flat): the first `points` windows' components, component by component."""
    pairs = F.array_sort(F.collect_list(F.struct("start", "pcs")))
    series = F.slice(F.transform(pairs, lambda x: x["pcs"]), 1, points)
    g = projected.filter(F.col("start") < points).groupBy(key).agg(series.alias("s"))
    by_component = F.transform(F.sequence(F.lit(0), F.size(F.col("s")[0]) - 1), lambda i: F.transform("s", lambda x: x[i]))
    return g.select(key, F.flatten(by_component).alias("flat"))


def with_measurements(df: DataFrame, trace: str, columns: Sequence[str], weight: float) -> DataFrame:
    """Traces with measurement columns behind them: means for nulls, z-scored, weighted."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(means[c] or 0.0)) for c in columns})
    z = normalize(filled, columns, "zscore")
    return z.withColumn(trace, F.concat(F.col(trace), F.array(*[weight * F.col(c) for c in columns])))


#: Rows of whose distances the Euclidean silhouette takes every one; the table of them is broadcast.
SILHOUETTE_ROWS = 20_000


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster", squared: bool = True, most: int = SILHOUETTE_ROWS) -> float | None:
    """Mean silhouette without noise (-1); None with fewer than two clusters.

    squared takes squared Euclidean distances, for which sums of clusters suffice. Plain
    ones need every pair of rows: tasks compare theirs with a broadcast table of at most
    `most` rows; larger tables fall back on squared ones.
    """
    inside = df.filter(F.col(cluster) >= 0)
    if inside.select(cluster).distinct().limit(2).count() < 2:
        return None
    if not squared:
        kind = dict(df.dtypes)[features]
        points = inside.select(F.col(cluster).cast("long").alias("c"), (vector_to_array(features) if kind == "vector" else F.col(features).cast("array<double>")).alias("x"))
        if points.limit(most + 1).count() <= most:
            return _plain_silhouette(points)
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(inside.withColumn(cluster, F.col(cluster).cast("double")))


def _plain_silhouette(points: DataFrame) -> float:
    rows = written(points, "points")
    table = rows.toArrow()
    x, label = table["x"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), table["c"].to_numpy()
    names = np.unique(label)
    shared = points.sparkSession.sparkContext.broadcast((x, (label[:, None] == names).astype(float), names))

    def run(batches):
        every, one_hot, known = shared.value
        sizes = one_hot.sum(0)
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                own = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                far = np.sqrt(np.maximum(0, ((own[:, None, :] - every[None]) ** 2).sum(2))) @ one_hot
                at = np.searchsorted(known, b.column(0).to_numpy())
                i = np.arange(b.num_rows)
                inner = far[i, at] / np.maximum(sizes[at] - 1, 1)
                means = far / sizes
                means[i, at] = np.inf
                outer = means.min(1)
                s = np.where(sizes[at] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(s)], ["s"])

    return rows.mapInArrow(run, "s double").agg(F.avg("s")).first()[0]


def best_kmeans(df: DataFrame, least: int, most: int, seed: int = 67, features: str = "features") -> DataFrame:
    """df with `cluster` by the k of the best silhouette."""
    best = None
    for k in range(max(2, least), max(2, most) + 1):
        out = KMeans(k=k, seed=seed, featuresCol=features, predictionCol="cluster").fit(df).transform(df)
        score = silhouette(out, features)
        if score is not None and (best is None or score > best[0]):
            best = score, out
    return best[1] if best else df.withColumn("cluster", F.lit(0))


def mixture_grid(df: DataFrame, ks: Sequence[int], seed: int = 67, features: str = "features", dim: int = 2) -> DataFrame:
    """(k, log_likelihood, bic, aic) of full-covariance Gaussian mixtures."""
    n = df.count()
    rows = []
    for k in ks:
        ll = GaussianMixture(k=k, seed=seed, featuresCol=features).fit(df).summary.logLikelihood
        free = k * (dim + dim * (dim + 1) / 2) + k - 1
        rows.append((k, ll, free * math.log(n) - 2 * ll, 2 * free - 2 * ll))
    return df.sparkSession.createDataFrame(rows, "k int, log_likelihood double, bic double, aic double")


def gaussian_likelihood(df: DataFrame, features: str, dim: int) -> float:
    """Log likelihood of one Gaussian with the rows' own mean and covariance."""
    v = vector_to_array(F.col(features))
    x = df.select(*[v[i].alias(f"x{i}") for i in range(dim)])
    row = x.agg(F.count("*"), *[F.covar_pop(f"x{i}", f"x{j}") for i in range(dim) for j in range(dim)]).first()
    if not row[0]:
        return 0.0
    spread = np.array(row[1:], float).reshape(dim, dim) + 1e-12 * np.eye(dim)
    return float(-row[0] / 2 * (dim * math.log(2 * math.pi) + np.linalg.slogdet(spread)[1] + dim))


def best_mixture(df: DataFrame, ks: Sequence[int], kinds: Sequence[str] = ("full", "diag"), seed: int = 67, features: str = "features", dim: int = 2) -> tuple[DataFrame, DataFrame]:
    """(df with `cluster`, table of the candidates) by the mixture of the least BIC.

    Ties go to the higher silhouette; one cluster is chosen only where no candidate has two.
    """
    n, tried = df.count(), []
    for kind in kinds:
        for k in ks:
            if k == 1 and kind == "full":
                out, ll, free = df.withColumn("cluster", F.lit(0)), gaussian_likelihood(df, features, dim), dim + dim * (dim + 1) / 2
            elif kind == "full":
                model = GaussianMixture(k=k, seed=seed, featuresCol=features, predictionCol="cluster", probabilityCol="__p").fit(df)
                out, ll, free = model.transform(df).drop("__p"), model.summary.logLikelihood, k * (dim + dim * (dim + 1) / 2) + k - 1
            else:
                names = [f"__v{i}" for i in range(dim)]
                wide = df.withColumn("__v", vector_to_array(features)).withColumns({c: F.col("__v")[i] for i, c in enumerate(names)})
                out, ll = diagonal_mixture(wide, names, k)
                out, free = out.drop("__v", *names), 2 * dim * k + k - 1
            tried.append((kind, k, ll, free * math.log(max(n, 1)) - 2 * ll, silhouette(out, features), out))
    order = sorted(range(len(tried)), key=lambda i: (tried[i][3], -math.inf if tried[i][4] is None else -tried[i][4]))
    best = next((i for i in order if tried[i][4] is not None), order[0])
    table = df.sparkSession.createDataFrame([(*t[:5], i == best) for i, t in enumerate(tried)], "kind string, k int, log_likelihood double, bic double, silhouette double, best boolean")
    return tried[best][5], table


def diagonal_mixture(df: DataFrame, columns: Sequence[str], k: int) -> tuple[DataFrame, float]:
    """(df with cluster, log likelihood) of a diagonal mixture by EM, until the likelihood rests; a round takes one row of sums from each task.

    A variance is at least a thousandth of its column's, as a component on a single row
    would have a likelihood without bound. As it has one and no round lowers it, it comes
    to rest, after hundreds of rounds where components overlap. NaN and infinity are an error.
    """
    rows = written(df, "mixture")
    stats = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("v", F.var_pop))]).first()
    m = np.array([[stats[f"m{i}"] + (j - (k - 1) / 2) * math.sqrt(stats[f"v{i}"] or 1.0) for i in range(len(columns))] for j in range(k)])
    least = [max(1e-3 * (stats[f"v{i}"] or 0.0), 1e-6) for i in range(len(columns))]
    v = np.array([[max(stats[f"v{i}"] or 0.0, least[i]) for i in range(len(columns))]] * k)
    w = np.full(k, 1 / k)

    def log_parts() -> list[Column]:
        def one(j: int) -> Column:
            terms = [F.lit(-0.5 * math.log(2 * math.pi * v[j, i])) - (F.col(c) - float(m[j, i])) ** 2 / float(2 * v[j, i]) for i, c in enumerate(columns)]
            return reduce(lambda a, b: a + b, terms, F.lit(math.log(max(w[j], 1e-300))))

        return [one(j) for j in range(k)]

    known = rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])).select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    sums = ["ll", "n"] + [f"r{j}" for j in range(k)] + [f"s{j}_{i}_{p}" for p in (1, 2) for j in range(k) for i in range(len(columns))]

    def part(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums of a round."""
        total = np.zeros(len(sums))
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1)
            each = np.log(np.maximum(w, 1e-300)) - 0.5 * np.log(2 * np.pi * v).sum(1) - sum((x[:, i, None] - m[:, i]) ** 2 / (2 * v[:, i]) for i in range(x.shape[1]))
            lse = np.logaddexp.reduce(each, axis=1)
            r = np.exp(each - lse[:, None])
            total += np.concatenate([[lse.sum(), len(x)], r.sum(0), (r.T @ x).ravel(), (r.T @ x**2).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([a]) for a in total], sums)

    ll = -math.inf
    while True:
        of_tasks = known.mapInArrow(part, ", ".join(f"{c} double" for c in sums))  # with the figures of this round
        s = dict(zip(sums, np.array(of_tasks.collect()).reshape(-1, len(sums)).sum(0).tolist(), strict=True))
        if not math.isfinite(s["ll"]):
            raise ValueError("a mixture of values that aren't finite")
        if not s["n"] or s["ll"] - ll <= 1e-5 * abs(s["ll"]):
            break
        ll = s["ll"]
        for j in range(k):
            r = max(s[f"r{j}"], 1e-9)
            w[j] = r / s["n"]
            for i in range(len(columns)):
                m[j, i] = s[f"s{j}_{i}_1"] / r
                v[j, i] = max(s[f"s{j}_{i}_2"] / r - m[j, i] ** 2, least[i])
    parts = F.array(*log_parts())
    return rows.withColumn("cluster", (F.array_position(parts, F.array_max(parts)) - 1).cast("int")), ll


def membership(df: DataFrame, cluster: str = "cluster", sub: str = "sub") -> DataFrame:
    return df.groupBy(cluster, sub).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(cluster)))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row `ari` from the counts of pairs of labels."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    both = cells.agg(two("n").alias("both"), F.sum("n").alias("total"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(two("n").alias("left"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(two("n").alias("right"))
    one = both.join(left, F.lit(True)).join(right, F.lit(True))  # three tables of one row
    chance = F.col("left") * F.col("right") / (F.col("total") * (F.col("total") - 1) / 2)
    return one.select(F.try_divide(F.col("both") - chance, (F.col("left") + F.col("right")) / 2 - chance).alias("ari"))


def calinski_harabasz(samples: DataFrame, key: str = "trial", cluster: str = "cluster", dim: str = "t", value: str = "v") -> DataFrame:
    """One row `score` over long samples: between over within dispersion, by their degrees of freedom."""
    cells = samples.groupBy(cluster, dim).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    whole = cells.groupBy(dim).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("g"))
    j = cells.join(whole, dim)
    s = j.agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.count_distinct(cluster).alias("k"), (F.sum("n") / F.count_distinct(dim)).alias("rows"))
    return s.select(((F.col("between") / (F.col("k") - 1)) / (F.col("within") / (F.col("rows") - F.col("k")))).alias("score"))


def expand_by_weight(df: DataFrame, weight: str) -> DataFrame:
    """Each row as many times as its weight rounds to, once at least."""
    n = F.greatest(F.lit(1), F.bround(weight).cast("int"))
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def balanced_split(trials: DataFrame, test_size: float, subject: str = "subject", label: str = "label", validation_size: float | None = None) -> DataFrame:
    """trials with `split`: subjects in order of rate, every n-th to test, then every n-th of the rest to validation.

    Only one row a subject meets in a task.
    """
    rates = trials.groupBy(subject).agg(F.avg(label).alias("rate"))
    place = lambda df: df.withColumn("n", F.row_number().over(W.orderBy("rate", subject)) - 1)
    r = place(rates).withColumn("split", F.when(F.col("n") % int(1 / test_size) == 0, "test").otherwise("train"))
    if validation_size:
        rest = place(r.filter("split = 'train'").drop("n")).withColumn("split", F.when(F.col("n") % int(1 / validation_size) == 0, "validation").otherwise("train"))
        r = r.filter("split = 'test'").unionByName(rest)
    return trials.join(r.select(subject, "split"), subject)


def leaking_subjects(df: DataFrame, subject: str = "subject", split: str = "split") -> DataFrame:
    return df.groupBy(subject).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], shares: tuple[float, float] = (0.70, 0.85), seed: int = 67) -> DataFrame:
    """df with `split` train, validation or test in exact shares of each label, in the order of a hash."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    ranked = global_rank(df.withColumns({"__label": F.col(label), "__order": order}), ["__label", "__order"], "__rank")
    sizes = df.groupBy(F.col(label).alias("__of")).agg(F.count("*").alias("__all"))  # a row a label
    before = sizes.withColumn("__before", F.coalesce(F.sum("__all").over(W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranked.join(F.broadcast(before), F.col("__label").eqNullSafe(F.col("__of")))
    at = (F.col("__rank") - 1 - F.col("__before")) / F.col("__all")
    split = F.when(at < shares[0], "train").when(at < shares[1], "validation").otherwise("test")
    return placed.withColumn("split", split).drop("__label", "__order", "__rank", "__of", "__all", "__before")


def group_folds(df: DataFrame, folds: int, group: str = "subject") -> DataFrame:
    """df with `fold`: groups by size, in turn there and back, so that folds are even and no group is split."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    i = F.row_number().over(W.orderBy(F.desc("n"), group)) - 1
    turn, step = F.floor(i / folds), i % folds
    fold = F.when(turn % 2 == 0, step).otherwise(folds - 1 - step).cast("int")
    return df.join(sizes.withColumn("fold", fold).select(group, "fold"), group)


def average_precision(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One row `ap`: step-wise average precision; rows meet by score first."""
    s = scored.groupBy(score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    t = running_sums(s, score, ["pos", "n"], descending=True)
    return t.agg(F.try_divide(F.sum(F.col("pos") * F.col("pos_sum") / F.col("n_sum")), F.sum("pos").cast("double")).alias("ap"))


def auroc(scored: DataFrame, label: str, score: str) -> DataFrame:
    """One row `auroc` by ranks, ties counted half; rows meet by score first."""
    s = scored.groupBy(score).agg(F.sum(label).alias("pos"), (F.count("*") - F.sum(label)).alias("neg"))
    t = running_sums(s, score, ["neg"]).withColumn("below", F.col("neg_sum") - F.col("neg"))
    return t.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg").cast("double")).alias("auroc"))


def fit_discriminant(df: DataFrame, columns: Sequence[str], label: str = "label") -> tuple[np.ndarray, float]:
    """(weights, cut) of a two-class linear discriminant from class means and the pooled covariance."""
    p = len(columns)
    s = df.groupBy(label).agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)], *[F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns)]).orderBy(label).collect()
    n = [r["n"] for r in s]
    mean = [np.array([r[f"s{i}"] for i in range(p)]) / r["n"] for r in s]
    within = sum(np.array([[r[f"g{i}_{j}"] for j in range(p)] for i in range(p)]) - r["n"] * np.outer(m, m) for r, m in zip(s, mean, strict=True))
    w = np.linalg.solve(within / max(1, sum(n) - 2) + 1e-9 * np.eye(p), mean[1] - mean[0])
    return w, float(w @ (mean[0] + mean[1]) / 2 - math.log(n[1] / n[0]))


def discriminant_scores(df: DataFrame, columns: Sequence[str], weights: np.ndarray, cut: float) -> DataFrame:
    score = reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(columns, weights, strict=True)]) - cut
    return df.withColumn("score", score).withColumn("predicted", (F.col("score") > 0).cast("int"))


def estimator(name: str, weight: str | None = None, seed: int = 67, inputs: int = 2):
    """A classifier by name: logreg, rf, gbt, mlp (no weights: expand rows instead)."""
    w = {"weightCol": weight} if weight else {}
    if name == "logreg":
        return LogisticRegression(maxIter=50, regParam=1e-3, **w)
    if name == "rf":
        return RandomForestClassifier(numTrees=50, maxDepth=6, seed=seed, **w)
    if name == "gbt":
        return GBTClassifier(maxIter=15, maxDepth=4, seed=seed, **w)
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[inputs, 8, 2], maxIter=60, seed=seed)
    raise ValueError(name)


def forest_importances(train: DataFrame, columns: Sequence[str], features: str = "features", weight: str | None = "weight", seed: int = 67) -> DataFrame:
    """(feature, importance, place): a forest's importances, which add up to 1, and their order."""
    model = estimator("rf", weight, seed).setFeaturesCol(features).fit(train)
    rows = sorted(zip(columns, model.featureImportances.toArray().tolist(), strict=True), key=lambda r: (-r[1], r[0]))
    return train.sparkSession.createDataFrame([(c, float(v), i + 1) for i, (c, v) in enumerate(rows)], "feature string, importance double, place int")


def one_versus_rest(seed: int = 67) -> OneVsRest:
    return OneVsRest(classifier=GBTClassifier(maxIter=8, maxDepth=3, seed=seed))


def train_models(df: DataFrame, names: Sequence[str], keys: Sequence[str], features: str = "features", weight: str = "weight", inputs: int = 2) -> tuple[dict, DataFrame]:
    """Fitted models on split = train, and (keys, split, model, label, predicted, prob) of every row."""
    train = df.filter("split = 'train'")
    models, parts = {}, []
    for n in names:
        rows = expand_by_weight(train, weight) if n == "mlp" else train
        models[n] = estimator(n, None if n == "mlp" else weight, inputs=inputs).setFeaturesCol(features).fit(rows)
        out = models[n].transform(df)
        parts.append(out.select(*keys, "split", F.lit(n).alias("model"), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("prob")))
    return models, reduce(DataFrame.unionByName, parts)


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    out = model.transform(df).withColumn("prob", vector_to_array("probability")[1])
    return out.withColumn("predicted", (F.col("prob") >= threshold).cast("int"))


def cross_validate(df: DataFrame, name: str, folds: int, features: str = "features", weight: str | None = None) -> DataFrame:
    """(fold, label, predicted, prob) of every row, each from a model that didn't see its fold."""
    parts = []
    for k in range(folds):
        model = estimator(name, weight).setFeaturesCol(features).fit(df.filter(F.col("fold") != k))
        out = model.transform(df.filter(F.col("fold") == k))
        parts.append(out.select("fold", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("predicted"), vector_to_array("probability")[1].alias("prob")))
    return reduce(DataFrame.unionByName, parts)


def sweep(df: DataFrame, params: Sequence[float], fractions: Sequence[float] = (1.0,), features: str = "features") -> DataFrame:
    """(reg, fraction, train_f1, test_f1): regularisation path and learning curve of logistic regression."""
    train, test = df.filter("split = 'train'"), df.filter("split <> 'train'")
    f1 = MulticlassClassificationEvaluator(metricName="f1")
    rows = []
    for r in params:
        for f in fractions:
            part = train if f >= 1 else train.filter(F.pmod(F.xxhash64("subject", "trial"), F.lit(1000)) < int(1000 * f))
            m = LogisticRegression(maxIter=30, regParam=r, featuresCol=features).fit(part)
            rows.append((float(r), float(f), f1.evaluate(m.transform(part)), f1.evaluate(m.transform(test))))
    return df.sparkSession.createDataFrame(rows, "reg double, fraction double, train_f1 double, test_f1 double")


def gated_scores(df: DataFrame, features: str = "features", seed: int = 67) -> DataFrame:
    """df with p_react and score 0-5: a gate for any reaction times intensities among those that react."""
    gate = GBTClassifier(maxIter=10, maxDepth=3, seed=seed, featuresCol=features, labelCol="react").fit(df.withColumn("react", (F.col("intensity") > 0).cast("double")))
    kind = RandomForestClassifier(numTrees=30, maxDepth=5, seed=seed, featuresCol=features, labelCol="kind").fit(df.filter("intensity > 0").withColumn("kind", F.col("intensity").cast("double")))
    g = gate.transform(df).withColumn("p_react", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
    k = kind.transform(g).withColumn("__k", vector_to_array("probability")).drop("rawPrediction", "probability", "prediction")
    joint = F.concat(F.array(1 - F.col("p_react")), F.transform(F.slice("__k", 2, 5), lambda p: p * F.col("p_react")))
    return k.withColumn("score", (F.array_position(joint, F.array_max(joint)) - 1).cast("int")).drop("__k")


def pseudo_labels(df: DataFrame, value: str, gate: float = 0.42, cuts: Sequence[float] = (0.27, 0.53, 0.73, 0.87)) -> DataFrame:
    """df with `pseudo` 0-5: 0 below the gate's percentile, then by percentiles of those above it."""
    zero = (exact_percentiles(df, value, [gate]).first() or {"percentile": None})["percentile"]
    above = df.filter(F.col(value) > F.lit(zero))
    row = percentile_columns(above, value, {f"q{i}": c for i, c in enumerate(cuts)}).first()
    qs = row.asDict() if row else {}
    level = reduce(lambda a, i: a + (F.col(value) > F.lit(qs.get(f"q{i}"))).cast("int"), range(len(cuts)), F.lit(1))
    return df.withColumn("pseudo", F.when(F.col(value) <= zero, 0).otherwise(level))


