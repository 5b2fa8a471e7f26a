"""Queries of the signal kernels, feature tables, clustering and classifiers."""

from __future__ import annotations


from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import signal as G
from ..operators import aggregate as A
from ..operators import features as FE
from ..operators import ml as M
from ..operators import models as O
from ..operators.windows import cumulative_variance, time_bins
from . import fixtures as X
from .fixtures import FRAMES, PREDICTIONS, SAMPLES, TRACES, with_
from .registry import R, query
from .stat_queries import _nsf, _t2

_K = "dataset, subject, trial"
_C = F.col


def _summed(df, column: str):
    """(trial, n, total, moment) of a trace column, to show it in a few figures."""
    total = F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
    return df.select("trial", F.size(column).cast("long").alias("n"), total.alias("total"), F.array_max(column).alias("top"))


_INNER = G.savgol_matrix(5, 2)[2]
_FIT = G.savgol_matrix(5, 2)


def _savgol_sql() -> str:
    dot = lambda row, start: " + ".join(f"({float(c)!r}) * trace[{start} + {i}]" for i, c in enumerate(row))
    head = ", ".join(dot(_FIT[i], 1) for i in (0, 1))
    tail = ", ".join(dot(_FIT[i], 60) for i in (3, 4))
    inner = dot(_INNER, "i")
    return with_(TRACES) + f"""SELECT trial, CAST(len(s) AS BIGINT) AS n, {R('list_sum(s)', 'total')}, {R('list_max(s)', 'top')} FROM (SELECT trial, list_concat([{head}], list_concat(list_transform(range(1, 61), lambda i: {inner}), [{tail}])) AS s FROM traces)"""


@query(_savgol_sql())
def g01_savgol(spark, sf):
    return _summed(X.traces(spark, sf).withColumn("s", G.savgol(_C("trace"), G.savgol_window(100, 40, 2), 2)), "s")


@query(with_(TRACES) + f"SELECT trial, CAST(60 AS BIGINT) AS n, {R('list_sum(s)', 'total')}, {R('list_max(s)', 'top')} FROM (SELECT trial, list_transform(range(1, 61), lambda i: " + " + ".join(f"({float(c)!r}) * trace[i + {k}]" for k, c in enumerate(_INNER)) + ") AS s FROM traces)")
def g01_savgol_native(spark, sf):
    return _summed(X.traces(spark, sf).withColumn("s", G.savgol_native(_C("trace"), 5, 2)), "s")


@query()
def g02_lowpass(spark, sf):
    return _summed(X.traces(spark, sf).withColumn("s", G.lowpass(_C("trace"), 5.0, 40.0)), "s")


def _hilbert_sql() -> str:
    n = 64
    # The discrete Hilbert transform of an even length, by its kernel: 2 / n cot(pi k / n) for odd k.
    kernel = f"CASE WHEN (a.t - b.t) % 2 = 0 THEN 0 ELSE 2.0 / {n} * cos(pi() * (a.t - b.t) / {n}) / sin(pi() * (a.t - b.t) / {n}) END"
    return (
        with_(SAMPLES)
        + f""", h AS (SELECT a.trial, a.t, max(a.v) AS v, sum(b.v * {kernel}) AS h FROM samples a JOIN samples b ON a.trial = b.trial AND a.t <> b.t GROUP BY a.trial, a.t)
SELECT trial, count(*) AS n, {R('sum(sqrt(v * v + h * h))', 'total')}, {R('max(sqrt(v * v + h * h))', 'top')} FROM h GROUP BY trial"""
    )


@query(_hilbert_sql())
def g03_hilbert_envelope(spark, sf):
    return _summed(X.traces(spark, sf).withColumn("s", G.hilbert_envelope(_C("trace"))), "s")


@query()
def g04_clipped_envelope(spark, sf):
    scaled = X.traces(spark, sf).withColumn("trace", F.transform("trace", lambda x: 50 + 200 * x))
    return _summed(scaled.withColumn("s", G.clipped_envelope(_C("trace"), 40.0)), "s")


def _dft(view: str, lo: int, n: int, fps: float) -> str:
    """PSD of one Hann-windowed segment of n samples from lo, frequency by frequency."""
    return f"""{view}w AS (SELECT trial, t - {lo} AS i, v - avg(v) OVER (PARTITION BY trial) AS x, 0.5 - 0.5 * cos(2 * pi() * (t - {lo}) / {n}) AS w FROM samples WHERE t >= {lo} AND t < {lo + n}),
{view} AS (SELECT trial, k, k * {fps} / {n} AS f, (pow(sum(x * w * cos(2 * pi() * k * i / {n})), 2) + pow(sum(x * w * sin(2 * pi() * k * i / {n})), 2)) / ({fps} * sum(w * w)) * CASE WHEN k = 0 OR 2 * k = {n} THEN 1 ELSE 2 END AS p
 FROM {view}w, range(0, {n // 2 + 1}) r(k) GROUP BY trial, k)"""


_BANDS = [(0.0, 5.0), (5.0, 20.0)]


@query(
    with_(SAMPLES, _dft("psd", 0, 64, 40.0))
    + ", seg AS (SELECT trial, f, p, lead(f) OVER w AS f2, lead(p) OVER w AS p2 FROM psd WINDOW w AS (PARTITION BY trial ORDER BY f)), tot AS (SELECT trial, sum((f2 - f) * (p + p2) / 2) AS total, "
    + ", ".join(f"sum((f2 - f) * (p + p2) / 2) FILTER (WHERE f >= {a} AND f2 <= {b}) AS b{i}" for i, (a, b) in enumerate(_BANDS))
    + f" FROM seg GROUP BY trial) SELECT trial, {R('b0', 'power_0')}, {R('b1', 'power_1')}, {R('b0 / total', 'ratio_0')}, {R('b1 / total', 'ratio_1')} FROM tot"
)
def g05_welch_bands(spark, sf):
    w = X.traces(spark, sf).select("trial", G.welch_bands(_C("trace"), 40.0, _BANDS).alias("w"))
    return w.select("trial", _C("w")[0].alias("power_0"), _C("w")[1].alias("power_1"), _C("w")[2].alias("ratio_0"), _C("w")[3].alias("ratio_1"))


def _signal_sql(final: str = "") -> str:
    fps = 10.0
    epoch = lambda n, lo, hi: f"{n} AS (SELECT trial, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS top, arg_max(t, v) - {lo} AS at, (sum(v) - (arg_min(v, t) + arg_max(v, t)) / 2) / count(*) AS auc, count(*) AS n FROM samples WHERE t >= {lo} AND t < {hi} GROUP BY trial)"
    bands = lambda v: f"{v}s AS (SELECT trial, {', '.join(f'coalesce(sum(p) FILTER (WHERE f >= {a} AND f < {b}), 0) AS {n}' for n, a, b in FE.BANDS)} FROM {v} GROUP BY trial)"
    names = [n for n, _, _ in FE.BANDS]
    e = FE.EPS
    cols = {
        "mean_shift_z": f"(d.mean - b.mean) / (b.std + {e})",
        "std_ratio": f"d.std / (b.std + {e})",
        "peak_z": f"(d.top - b.mean) / (b.std + {e})",
        "auc_ratio": f"d.auc / (b.auc + {e})",
        **{f"power_ratio_{n}": f"pds.{n} / (pbs.{n} + {e})" for n in names},
        "total_power_ratio": f"({' + '.join(f'pds.{n}' for n in names)}) / ({' + '.join(f'pbs.{n}' for n in names)} + {e})",
        "frac_above_baseline": "(SELECT avg(CAST(s.v > b.mean + 2 * b.std AS INTEGER)) FROM samples s WHERE s.trial = d.trial AND s.t >= 20 AND s.t < 40)",
        "persistence": f"(a.mean - b.mean) / (d.mean - b.mean + {e})",
        "time_to_peak_frac": "d.at / d.n",
    }
    views = with_(SAMPLES, epoch("b", 0, 20), epoch("d", 20, 40), epoch("a", 40, 64), _dft("pb", 0, 20, fps), _dft("pd", 20, 20, fps), bands("pb"), bands("pd"))
    big = lambda v: f"CASE WHEN abs({v}) < 1e6 THEN {v} END"
    return views + f"SELECT d.trial, {', '.join(R(big(v), n) for n, v in cols.items())} FROM d JOIN b USING (trial) JOIN a USING (trial) JOIN pbs USING (trial) JOIN pds USING (trial)"


def _tame(df):
    """Figures beyond a million, where a baseline band is empty, as null."""
    return df.select("trial", *[F.when(F.abs(c) < 1e6, _C(c)).alias(c) for c in df.columns if c != "trial"])


@query(_signal_sql())
def g06_signal_features(spark, sf):
    return _tame(FE.signal_features(X.traces(spark, sf), ["trial"], "trace", 20, 40, 10.0))


@query()
def g07_feature_matrix(spark, sf):
    df = _tame(FE.signal_features(X.traces(spark, sf), ["trial"], "trace", 20, 40, 10.0))
    return FE.impute_medians(df, [c for c in df.columns if c != "trial"])


@query()
def g08_measurements(spark, sf):
    return _tame(FE.signal_features(X.traces(spark, sf), ["trial"], "trace", 20, 40, 10.0, measurements=True))


@query()
def g09_preprocess(spark, sf):
    return _summed(FE.preprocess(X.traces(spark, sf), "trace", 20), "trace")


@query()
def g10_feature_table(spark, sf):
    rows = M.written(FE.preprocess(X.traces(spark, sf), "trace", 20), "preprocessed")
    table = M.written(FE.feature_table(rows, "trial", "trace", 20, 40.0, bands=_BANDS), "features")
    return table.join(FE.component_features(rows, "trial", "trace", 20, 40.0, table, 16, split=0.4), "trial", "left")


@query(
    with_(TRACES)
    + f"SELECT vec_id AS trial, {R('(embedding[1] - avg(embedding[1]) OVER ()) / stddev_pop(embedding[1]) OVER ()', 'x')}, {R('(embedding[2] - min(embedding[2]) OVER ()) / (max(embedding[2]) OVER () - min(embedding[2]) OVER ())', 'y')} FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)"
)
def ml01_normalize(spark, sf):
    p = X.traces(spark, sf).select("trial", _C("trace")[0].alias("x"), _C("trace")[1].alias("y"))
    return M.normalize(M.normalize(p, ["x"], "zscore"), ["y"], "minmax")


def _scores(spark, sf, k: int):
    """(trial, given, pcs): scores of k components of whole traces."""
    return M.fit_components(X.traces(spark, sf), "trace", k)[1].select("trial", F.col("cluster").alias("given"), "pcs")


def _points(spark, sf, n: int):
    return _scores(spark, sf, n).select("trial", *[_C("pcs")[i].alias(f"v{i}") for i in range(n)])


@query()
def ml02_preprocessor(spark, sf):
    names = [f"v{i}" for i in range(64)]
    p = X.traces(spark, sf).select("trial", *[_C("trace")[i].alias(c) for i, c in enumerate(names)])
    p = p.withColumns({"v7": F.when(_C("trial") % 5 != 0, _C("v7")), "scalar": F.when(_C("trial") % 3 != 0, _C("trial") % 11)})
    out = M.fit_preprocessor(p, names, ["scalar"], 3).transform(p)
    return out.select("trial", *[_C("features")[i].alias(n) for i, n in enumerate(("pc1", "pc2", "pc3", "scaled"))])


@query()
def ml03_lag_components(spark, sf):
    out = M.lag_components(X.traces(spark, sf), "trace", 16, 3)
    return out.groupBy("trial").agg(F.count("*").alias("windows"), F.avg(_C("pcs")[0]).alias("pc1_mean"), F.stddev_pop(_C("pcs")[0]).alias("pc1_std"))


@query()
def ml04_components(spark, sf):
    model, scored = M.fit_components(X.traces(spark, sf), "trace", 32)
    return cumulative_variance(M.explained(model, spark))[0]


@query()
def ml05_time_importance(spark, sf):
    model, _ = M.fit_components(X.traces(spark, sf), "trace", 5)
    return M.time_importance(model, spark, 5)


@query(
    with_(TRACES)
    + f", d AS (SELECT trial, trace, coalesce(n_chars, (SELECT avg(n_chars) FROM documents JOIN traces ON doc_id = trial)) AS m FROM traces LEFT JOIN documents ON doc_id = trial) SELECT trial, CAST(65 AS BIGINT) AS n, {R('0.5 * (m - avg(m) OVER ()) / stddev_pop(m) OVER ()', 'last')} FROM d"
)
def ml06_measurement_columns(spark, sf):
    t = X.traces(spark, sf).join(X.table(spark, sf, "documents").select(_C("doc_id").alias("trial"), "n_chars"), "trial", "left")
    out = M.with_measurements(t, "trace", ["n_chars"], 0.5)
    return out.select("trial", F.size("trace").cast("long").alias("n"), F.element_at("trace", -1).alias("last"))


def _vectors(spark, sf):
    return M.written(_scores(spark, sf, 6), "scores").select("trial", "given", array_to_vector("pcs").alias("features"))


@query()
def ml07_kmeans(spark, sf):
    return M.best_kmeans(_vectors(spark, sf), 2, 4).select("trial", "given", "cluster")


@query()
def ml08_mixture_grid(spark, sf):
    return M.mixture_grid(_vectors(spark, sf), [2, 3], dim=6)


@query()
def ml08_diagonal_mixture(spark, sf):
    out, ll = M.diagonal_mixture(_points(spark, sf, 3), ["v0", "v1", "v2"], 3)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.lit(ll).alias("log_likelihood"))


@query()
def ml08_best_mixture(spark, sf):
    return M.best_mixture(_vectors(spark, sf), [2, 3], dim=6)[0].select("trial", "cluster")


@query()
def ml09_density_clusters(spark, sf):
    return M.density_clusters(_points(spark, sf, 2), "trial", ["v0", "v1"], 0.05, 4)


@query()
def ml10_subclusters(spark, sf):
    return M.membership(M.subclusters(X.traces(spark, sf), 2))


@query()
def ml11_reaction_profiles(spark, sf):
    from ..functions.scalars import segment_statistics

    stats = X.traces(spark, sf).select("trial", *[c.alias(n) for n, c in segment_statistics(_C("trace"), 20, 40).items()])
    cols = [c for c in stats.columns if c not in ("trial", "odor_duration", "post_duration")]
    vec = VectorAssembler(inputCols=cols, outputCol="features").transform(M.normalize(stats, cols, "zscore"))
    return M.best_kmeans(vec, 2, 3).select("trial", "cluster")


def _binned(spark, sf):
    """(trial, x): means of bins of 8 samples, in order."""
    bins = time_bins(X.samples(spark, sf), ["trial"], "t", "v", 0, 64, 8)
    return bins.groupBy("trial").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "mean"))), lambda b: b["mean"]).alias("x"))  # 8 bins a trial


@query()
def ml12_motifs(spark, sf):
    rows = M.written(_binned(spark, sf), "binned")
    motifs = M.fit_motifs(rows, "x", 3)
    w = M.motif_weights(_C("x"), motifs)
    return rows.withColumn("w", w).select("trial", *[_C("w")[i].alias(f"motif{i}") for i in range(3)], F.lit(motifs.explained).alias("explained"))


@query()
def ml13_projection_matrix(spark, sf):
    flat = M.projection_matrix(M.lag_components(X.traces(spark, sf), "trace", 16, 2), 20)
    return flat.select("trial", F.posexplode("flat").alias("place", "score"))


@query()
def ml14_silhouette(spark, sf):
    v = _vectors(spark, sf).withColumn("cluster", F.when(_C("trial") % 50 == 0, -1).otherwise(_C("given")))
    return v.agg(F.count("*").alias("n")).withColumns({"silhouette": F.lit(M.silhouette(v, squared=False)), "squared": F.lit(M.silhouette(v))})


@query(
    f"""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS bo, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS l,
 (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS r, (SELECT sum(n) FROM c) AS t) SELECT {R('(bo - l * r / (t * (t - 1) / 2)) / ((l + r) / 2 - l * r / (t * (t - 1) / 2))', 'ari')} FROM s"""
)
def ml15_adjusted_rand(spark, sf):
    return M.adjusted_rand(X.table(spark, sf, "labels"), "quality", "toxic")


@query(
    with_(SAMPLES)
    + f""", c AS (SELECT cluster, t, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM samples GROUP BY ALL), g AS (SELECT t, avg(v) AS g FROM samples GROUP BY t)
SELECT {R('(sum(n * (m - g) ** 2) / (count(DISTINCT cluster) - 1)) / (sum(n * s) / ((SELECT count(*) FROM traces) - count(DISTINCT cluster)))', 'score')} FROM c JOIN g USING (t)"""
)
def ml16_calinski_harabasz(spark, sf):
    return M.calinski_harabasz(X.samples(spark, sf))


_LEARNED = ["value_mean", "value_std", "value_min", "value_max", "frame_count"]


def _learnable(spark, sf):
    """A feature row a trial with label, weight, split and intensity."""
    agg = A.aggregate_trials(X.frames(spark, sf), X.KEYS, ["value"], ["mean", "std", "min", "max"]).na.fill(0.0)
    rows = agg.join(X.predictions(spark, sf).select(*X.KEYS, "label", "weight", "split", "intensity"), X.KEYS)
    cols = _LEARNED
    rows = VectorAssembler(inputCols=cols, outputCol="features").transform(M.normalize(rows, cols, "zscore", rows.filter("split = 'train'")))
    return M.written(rows.select(*X.KEYS, F.col("label").cast("double").alias("label"), "weight", "split", "intensity", "features", *cols), "learnable")


def _arrays(spark, sf):
    return _learnable(spark, sf).withColumn("features", M.vector_to_array("features"))


@query()
def ml17_linear_probe(spark, sf):
    rows = O.stratified_folds(_arrays(spark, sf), 5, "label", X.KEYS)
    return O.fold_metrics(O.out_of_fold(rows, "features", "label", X.KEYS), ["fold"]).select("fold", "n", "accuracy")


@query()
def ml18_leave_subjects_out(spark, sf):
    scored = O.leave_subjects_out(_arrays(spark, sf), "features", "label", X.KEYS)
    sizes = scored.agg(F.count("*").alias("n"), F.count_distinct("fold").alias("folds"), F.first("folds_by").alias("folds_by"))
    return sizes.join(M.auroc(scored, "label", "prob"), F.lit(True)).join(M.average_precision(scored, "label", "prob"), F.lit(True))


_AUC = """asc_ AS (SELECT prob, sum(label) AS pos, count(*) - sum(label) AS neg, count(*) AS n FROM preds GROUP BY prob), aw AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
 sum(pos) OVER (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING) AS al FROM asc_)"""


@query(with_(FRAMES, PREDICTIONS, _AUC) + f"SELECT {R('sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg))', 'auroc')}, {R('sum(pos * tp / al) / sum(pos)', 'ap')} FROM aw")
def ml18_ranking_metrics(spark, sf):
    p = X.predictions(spark, sf)
    return M.auroc(p, "label", "prob").join(M.average_precision(p, "label", "prob"), F.lit(True))


@query()
def ml19_discriminant(spark, sf):
    rows = _learnable(spark, sf)
    cols = ["value_mean", "value_std", "frame_count"]
    w, cut = M.fit_discriminant(rows.filter("split = 'train'"), cols)
    return M.discriminant_scores(rows, cols, w, cut).select(*X.KEYS, "score", "predicted")


def _trained(name: str):
    def run(spark, sf):
        _, preds = M.train_models(_learnable(spark, sf), [name], X.KEYS, inputs=5)
        return A.binary_metrics(preds, ["model", "split"])

    return run


for _n, _m in (("ml20_logistic", "logreg"), ("ml21_forest", "rf"), ("ml23_boosting", "gbt")):
    _f = _trained(_m)
    _f.__name__ = _n
    query()(_f)


@query()
def ml21_importances(spark, sf):
    rows = _learnable(spark, sf)
    return M.forest_importances(rows.filter("split = 'train'"), _LEARNED)


def _network(spark, sf, hidden, class_weights=None):
    rows = O.example_table(_arrays(spark, sf), "features", "label", "weight", [*X.KEYS, "split"])
    net, _ = O.fit_network(rows.filter("split = 'train'"), hidden, 2, reg=1.0, class_weights=class_weights, tol=1e-2)
    out = O.network_scores(rows, net, [*X.KEYS, "split"]).select(*X.KEYS, "split", _C("y").cast("int").alias("label"), "predicted")
    return A.binary_metrics(out, ["split"])


@query()
def ml22_network(spark, sf):
    return _network(spark, sf, [8])


@query()
def ml22_two_layers(spark, sf):
    return _network(spark, sf, [8, 4], [1.0, 3.0])


@query()
def ml23_ordinal(spark, sf):
    rows = _learnable(spark, sf).withColumn("label", _C("intensity").cast("double"))
    model = M.one_versus_rest().fit(rows.filter("split = 'train'"))
    return model.transform(rows).select(*X.KEYS, "intensity", _C("prediction").cast("int").alias("predicted"))


@query(with_(FRAMES, PREDICTIONS) + f"SELECT {_K}, CAST(i AS INTEGER) AS copy FROM preds, range(1, 6) r(i) WHERE i <= greatest(1, CAST(round_even(weight, 0) AS INTEGER))")
def ml24_expand_by_weight(spark, sf):
    return M.expand_by_weight(X.predictions(spark, sf), "weight").select(*X.KEYS, "copy")


_SPLIT = """rt AS (SELECT subject, avg(label) AS rate FROM preds GROUP BY subject), r1 AS (SELECT *, row_number() OVER (ORDER BY rate, subject) - 1 AS n FROM rt), r2 AS (SELECT subject, rate, CASE WHEN n % 6 = 0 THEN 'test' ELSE 'train' END AS s FROM r1),
r3 AS (SELECT subject, CASE WHEN (row_number() OVER (ORDER BY rate, subject) - 1) % 5 = 0 THEN 'validation' ELSE 'train' END AS s FROM r2 WHERE s = 'train'), sp AS (SELECT subject, s FROM r2 WHERE s = 'test' UNION ALL SELECT subject, s FROM r3)"""


@query(with_(FRAMES, PREDICTIONS, _SPLIT) + f"SELECT {_K}, s AS split FROM preds JOIN sp USING (subject)")
def ml25_balanced_split(spark, sf):
    return M.balanced_split(X.predictions(spark, sf).drop("split"), 0.15, validation_size=0.2).select(*X.KEYS, "split")


@query(with_(FRAMES, PREDICTIONS) + "SELECT subject, count(DISTINCT CASE WHEN trial = 6 THEN 'test' ELSE split END) AS splits FROM preds GROUP BY subject HAVING splits > 1")
def ml25_leaking_subjects(spark, sf):
    return M.leaking_subjects(X.predictions(spark, sf).withColumn("split", F.when(_C("trial") == 6, "test").otherwise(_C("split"))))


@query(
    with_(FRAMES, PREDICTIONS)
    + f", o AS (SELECT {_K}, (row_number() OVER (PARTITION BY label ORDER BY md5('67|' || dataset || '|' || subject || '|' || trial)) - 1) / count(*) OVER (PARTITION BY label) AS place FROM preds) SELECT {_K}, CASE WHEN place < 0.7 THEN 'train' WHEN place < 0.85 THEN 'validation' ELSE 'test' END AS split FROM o"
)
def ml26_stratified_split(spark, sf):
    return M.stratified_split(X.predictions(spark, sf).drop("split"), "label", X.KEYS).select(*X.KEYS, "split")


@query(
    with_(FRAMES, PREDICTIONS)
    + f", s AS (SELECT subject, row_number() OVER (ORDER BY count(*) DESC, subject) - 1 AS i FROM preds GROUP BY subject) SELECT {_K}, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INTEGER) AS fold FROM preds JOIN s USING (subject)"
)
def ml27_group_folds(spark, sf):
    return M.group_folds(X.predictions(spark, sf), 5).select(*X.KEYS, "fold")


@query()
def ml27_cross_validation(spark, sf):
    rows = M.group_folds(_learnable(spark, sf), 3)
    return A.confusion(M.cross_validate(rows, "logreg", 3, weight="weight"))


@query()
def ml28_train_models(spark, sf):
    _, preds = M.train_models(_learnable(spark, sf), ["logreg", "rf"], X.KEYS, inputs=5)
    return A.binary_metrics(preds, ["model", "split"])


@query()
def ml29_predict(spark, sf):
    rows = _learnable(spark, sf)
    model = Pipeline(stages=[M.estimator("logreg", "weight")]).fit(rows.filter("split = 'train'"))
    return M.predict(model, rows, 0.4).select(*X.KEYS, "prob", "predicted")


@query()
def ml30_sweep(spark, sf):
    return M.sweep(_learnable(spark, sf), [1e-3, 1e-1], [0.5, 1.0])


@query()
def ml30_random_search(spark, sf):
    return O.random_search(M.group_folds(_arrays(spark, sf), 5), O.drawn(8), "features", "label", "weight")


@query()
def ml31_seeds(spark, sf):
    rows = _arrays(spark, sf).drop("split")
    return O.seeded_comparison(rows, "features", "label", X.KEYS, seeds=(1, 2, 3))


@query()
def ml31_split_strategies(spark, sf):
    rows = _learnable(spark, sf).drop("split")
    splits = {"group": M.balanced_split(rows, 0.2), "stratified": M.stratified_split(rows, "label", X.KEYS), "random": rows.withColumn("split", F.when(F.pmod(F.xxhash64(*X.KEYS), F.lit(5)) == 0, "test").otherwise("train"))}
    parts = []
    for name, s in splits.items():
        _, preds = M.train_models(s, ["logreg"], X.KEYS, inputs=5)
        parts.append(A.binary_metrics(preds.filter("split = 'test'")).select(F.lit(name).alias("strategy"), "accuracy", "f1"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query()
def ml32_gated_scores(spark, sf):
    return M.gated_scores(_learnable(spark, sf)).select(*X.KEYS, "intensity", "p_react", "score")


_Q = [0.27, 0.53, 0.73, 0.87]


@query(
    with_(FRAMES, PREDICTIONS)
    + f", z AS (SELECT quantile_cont(prob, 0.42) AS z FROM preds), q AS (SELECT {', '.join(f'quantile_cont(prob, {c}) AS q{i}' for i, c in enumerate(_Q))} FROM preds, z WHERE prob > z) SELECT {_K}, CAST(CASE WHEN prob <= z THEN 0 ELSE 1 + {' + '.join(f'CAST(prob > q{i} AS INTEGER)' for i in range(4))} END AS INTEGER) AS pseudo FROM preds, z, q"
)
def ml32_pseudo_labels(spark, sf):
    return M.pseudo_labels(X.predictions(spark, sf), "prob").select(*X.KEYS, "pseudo")


def _views(spark, sf) -> None:
    G.register(spark)
    X.traces(spark, sf).createOrReplaceTempView("chronolith_traces")


@query(f"SELECT vec_id AS trial, CAST(57 AS BIGINT) AS windows, {R('list_sum(list_transform(range(1, 58), lambda i: CAST(embedding[i] AS DOUBLE)))', 'firsts')} FROM embeddings")
def ud2_hankel(spark, sf):
    _views(spark, sf)
    return spark.sql("SELECT trial, count(*) AS windows, sum(h.window[0]) AS firsts FROM chronolith_traces, LATERAL hankel(trace, 8) h GROUP BY trial")


@query(_savgol_sql())
def ud1_kernels(spark, sf):
    _views(spark, sf)
    s = spark.sql("SELECT trial, savgol(trace) AS s, lowpass(trace) AS l, hilbert_envelope(trace) AS h, welch_bands(trace) AS w FROM chronolith_traces")
    return _summed(s.filter("size(l) = 64 and size(h) = 64 and size(w) = 4"), "s")


_SEGMENTS = "SELECT vec_id AS trial, 'baseline' AS segment, 0 AS first, least(1000 + label, 1200) AS last FROM embeddings UNION ALL SELECT vec_id, 'odor', least(1000 + label, 1280), least(1000 + label, 2560) FROM embeddings UNION ALL SELECT vec_id, 'post', least(1000 + label, 2560), 1000 + label FROM embeddings"


@query(_SEGMENTS)
def ud2_segments(spark, sf):
    _views(spark, sf)
    return spark.sql("SELECT trial, s.* FROM chronolith_traces, LATERAL segments(40.0D, 2.0D, 1000 + cluster) s")


@query(f"""WITH z AS (SELECT vec_id AS trial, CAST(embedding[1] AS DOUBLE) * 9 AS a, CAST(embedding[2] AS DOUBLE) * 9 AS b, CAST(embedding[3] AS DOUBLE) * 9 AS c FROM embeddings)
SELECT trial, {R(_nsf('a'), 'normal')}, {R('2 * (' + _nsf('abs(b)') + ')', 'chi2')}, {R(_t2('c', '10'), 't')} FROM z""")
def ud4_tails(spark, sf):
    _views(spark, sf)
    return spark.sql("SELECT trial, normal_sf(trace[0] * 9) AS normal, chi2_1_sf(pow(trace[1] * 9, 2)) AS chi2, t_two_sided(trace[2] * 9, 10D) AS t FROM chronolith_traces")
