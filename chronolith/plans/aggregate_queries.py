"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import frames as P
from ..operators.joins import duplicate_keys
from . import fixtures as X
from .fixtures import FRAMES, PREDICTIONS, SAMPLES, with_
from .join_queries import _CMP, _REV, revisions
from .registry import R, query

_K = "dataset, subject, trial"
_FLAGS = "flagged AS (SELECT *, frame < on_idx AS b, frame BETWEEN on_idx AND off_idx AS d, frame > off_idx AS a FROM frames)"


def flagged(spark, sf):
    return P.epoch_flags(X.frames(spark, sf))


@query(
    with_(FRAMES)
    + f"""SELECT {_K}, count(*) AS frame_count, min(frame) AS frame_start, max(frame) AS frame_end, {R('avg(value)', 'value_mean')}, {R('stddev_samp(value)', 'value_std')},
  {R('min(value)', 'value_min')}, {R('max(value)', 'value_max')}, {R('sum(value)', 'value_sum')}, {R('arg_min(value, frame)', 'value_first')}, {R('arg_max(value, frame)', 'value_last')} FROM frames GROUP BY ALL"""
)
def a01_trial_aggregates(spark, sf):
    return A.aggregate_trials(X.frames(spark, sf), X.KEYS, ["value"])


RESPONDER = f"""SELECT {_K}, {R('bm', 'before_mean')}, {R('bs', 'before_std')}, {R('dm', 'during_mean')}, {R('dst', 'during_std')}, {R('dm - bm', 'during_minus_before')}, {R('c', 'direction_cos')},
  {R('s', 'direction_sin')}, {R('sqrt(c * c + s * s)', 'direction_consistency')}, {R('hi / nullif(nd, 0)', 'high_fraction')}, {R('fs - bm', 'rise_speed')} FROM
 (SELECT {_K}, avg(value) FILTER (WHERE b) AS bm, stddev_samp(value) FILTER (WHERE b) AS bs, avg(value) FILTER (WHERE d) AS dm, stddev_samp(value) FILTER (WHERE d) AS dst,
  avg((prob_x - eye_x) / len) FILTER (WHERE d AND len > 0) AS c, avg((prob_y - eye_y) / len) FILTER (WHERE d AND len > 0) AS s,
  CAST(count(*) FILTER (WHERE d AND value >= 75) AS DOUBLE) AS hi, count(*) FILTER (WHERE d) AS nd, avg(value) FILTER (WHERE d AND frame >= on_idx AND frame < least(on_idx + 2, off_idx + 1)) AS fs
  FROM (SELECT *, sqrt((prob_x - eye_x) ** 2 + (prob_y - eye_y) ** 2) AS len FROM flagged) GROUP BY ALL)"""


@query(with_(FRAMES, _FLAGS) + RESPONDER)
def a02_responder_aggregates(spark, sf):
    return A.responder_aggregates(flagged(spark, sf), X.KEYS, fps=X.FPS)


@query(with_(FRAMES) + f"SELECT {_K}, CAST(count(*) AS BIGINT) AS n, {R('sum(value * (frame + 1))', 'moment')}, true AS contiguous FROM frames GROUP BY ALL")
def a03_traces(spark, sf):
    t = A.assemble_traces(X.frames(spark, sf), X.KEYS)
    moment = F.aggregate(F.transform("trace", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return t.select(*X.KEYS, F.size("trace").cast("long").alias("n"), moment.alias("moment"), "contiguous")


GROUPS = "grouped AS (SELECT *, CASE WHEN trial IN (2, 4, 5) THEN 'A' ELSE 'B' END AS grp FROM frames)"
MEANS = "gmeans AS (SELECT subject, grp, frame, avg(value) AS mean_value, count(*) AS n FROM grouped GROUP BY ALL)"
DIFFS = "diffs AS (SELECT a.subject, a.frame, a.mean_value AS a, b.mean_value AS b, a.mean_value - b.mean_value AS diff FROM gmeans a JOIN gmeans b ON a.subject = b.subject AND a.frame = b.frame AND a.grp = 'A' AND b.grp = 'B')"


def means(spark, sf):
    return A.mean_traces(A.with_group(X.frames(spark, sf)), order=["trial"])


def diffs(spark, sf):
    return A.difference_matrix(means(spark, sf))


@query(with_(FRAMES, GROUPS, MEANS) + f"SELECT subject, grp, frame, {R('mean_value', 'mean_value')}, n FROM gmeans")
def a04_mean_traces(spark, sf):
    return means(spark, sf)


@query(with_(FRAMES, GROUPS, MEANS, DIFFS) + f"SELECT subject, frame, {R('a', 'a')}, {R('b', 'b')}, {R('diff', 'diff')} FROM diffs")
def a05_difference_matrix(spark, sf):
    return diffs(spark, sf)


@query(with_(FRAMES, GROUPS, MEANS, DIFFS) + f"SELECT frame, {R('avg(diff)', 'effect_mean')}, {R('quantile_cont(diff, 0.5)', 'effect_median')}, count(*) AS n FROM diffs GROUP BY frame")
def a06_effects(spark, sf):
    return A.effects(diffs(spark, sf))


_HITS = "hits AS (SELECT subject, coalesce(bool_or(value > 100) FILTER (WHERE trial IN (2, 4)), false) AS trained, coalesce(bool_or(value > 100) FILTER (WHERE trial IN (1, 3)), false) AS untrained FROM frames GROUP BY subject)"


def responses(spark, sf):
    return A.subject_responses(X.frames(spark, sf).withColumn("hit", F.col("value") > 100), [2, 4], [1, 3])


@query(with_(FRAMES, _HITS) + "SELECT count(*) FILTER (WHERE trained AND untrained) AS a, count(*) FILTER (WHERE trained AND NOT untrained) AS b, count(*) FILTER (WHERE NOT trained AND untrained) AS c, count(*) FILTER (WHERE NOT trained AND NOT untrained) AS d, count(*) AS total FROM hits")
def a07_contingency_counts(spark, sf):
    return A.contingency_counts(responses(spark, sf))


@query(with_(FRAMES, _HITS) + "SELECT coalesce(CAST(trained AS VARCHAR), 'all') AS trained, coalesce(CAST(untrained AS VARCHAR), 'all') AS untrained, count(*) AS n FROM hits GROUP BY CUBE (trained, untrained)")
def a08_contingency_table(spark, sf):
    return A.contingency_table(responses(spark, sf))


@query(with_(FRAMES, PREDICTIONS) + f"SELECT intensity, count(*) AS n, {R('min(weight)', 'weight_min')}, {R('avg(weight)', 'weight_mean')}, {R('max(weight)', 'weight_max')}, {R('count(*) / (SELECT count(*) FROM preds)', 'fraction')} FROM preds GROUP BY intensity")
def a09_class_balance(spark, sf):
    return A.class_balance(X.predictions(spark, sf), "intensity", "weight")


@query(with_(FRAMES) + f"SELECT count(*) AS n_rows, count(DISTINCT ({_K})) AS n_blocks, min(frame) AS frame_min, max(frame) AS frame_max FROM frames")
def a10_block_stats(spark, sf):
    return A.block_stats(X.frames(spark, sf), X.KEYS)


@query(f"SELECT event_type, count(*) AS n, {R('avg(value)', 'mean')}, {R('quantile_cont(value, 0.5)', 'median')}, {R('max(value)', 'max')} FROM events GROUP BY event_type")
def a11_cluster_summary(spark, sf):
    return A.cluster_summary(X.table(spark, sf, "events"), "event_type", "value")


@query(with_(FRAMES, PREDICTIONS) + f"SELECT split, label, predicted, count(*) AS n, {R('sum(weight)', 'weight')}, {R('sum(weight) / sum(sum(weight)) OVER (PARTITION BY split, label)', 'row_share')} FROM preds GROUP BY split, label, predicted")
def a12_confusion(spark, sf):
    return A.confusion(X.predictions(spark, sf), weight="weight", by=["split"])


def _metrics_sql(w: str) -> str:
    sums = ", ".join(f"coalesce(sum({w}) FILTER (WHERE label = {y} AND predicted = {p}), 0) AS {n}" for n, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))
    div = lambda a, b, n: R(f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)", n)
    return f"""SELECT split, {R('tp', 'tp')}, {R('fp', 'fp')}, {R('fn', 'fn')}, {R('tn', 'tn')}, {div('tp + tn', 'tp + fp + fn + tn', 'accuracy')}, {div('tp', 'tp + fp', 'precision')}, {div('tp', 'tp + fn', 'recall')},
 {div('2 * tp', '2 * tp + fp + fn', 'f1')}, {div('fp', 'fp + tn', 'fpr')}, {div('tn', 'fp + tn', 'tnr')}, {div('fn', 'tp + fn', 'fnr')} FROM (SELECT split, {sums} FROM preds GROUP BY split)"""


@query(with_(FRAMES, PREDICTIONS) + _metrics_sql("1.0"))
def a13_binary_metrics(spark, sf):
    return A.binary_metrics(X.predictions(spark, sf), ["split"])


@query(with_(FRAMES, PREDICTIONS) + _metrics_sql("weight"))
def a13_weighted_metrics(spark, sf):
    return A.binary_metrics(X.predictions(spark, sf), ["split"], weight="weight")


@query(
    with_(FRAMES, PREDICTIONS)
    + f""", g AS (SELECT intensity AS y, CAST(floor(prob * 6) AS INTEGER) AS p FROM preds), c AS (SELECT y AS c FROM g UNION SELECT p FROM g),
per AS (SELECT c, (SELECT count(*) FROM g WHERE y = c) AS support, (SELECT count(*) FROM g WHERE p = c) AS named, (SELECT count(*) FROM g WHERE p = c AND y = c) AS tp FROM c),
f AS (SELECT *, coalesce(tp / nullif(named, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r, coalesce(2 * tp / nullif(named + support, 0), 0) AS f FROM per)
SELECT {R('sum(tp) / sum(support)', 'accuracy')}, {R('avg(p)', 'precision_macro')}, {R('avg(r)', 'recall_macro')}, {R('avg(f)', 'f1_macro')}, {R('sum(p * support) / sum(support)', 'precision_weighted')},
 {R('sum(r * support) / sum(support)', 'recall_weighted')}, {R('sum(f * support) / sum(support)', 'f1_weighted')} FROM f"""
)
def a13_multiclass_metrics(spark, sf):
    return A.multiclass_metrics(X.predictions(spark, sf).withColumn("guess", F.floor(F.col("prob") * 6).cast("int")), "intensity", "guess")


@query(with_(FRAMES, PREDICTIONS) + f"SELECT subject, count(*) AS n, {R('avg(label)', 'rate')} FROM preds GROUP BY subject")
def a14_subject_rates(spark, sf):
    return A.subject_rates(X.predictions(spark, sf))


@query("SELECT user_id, event_type, count(*) AS copies FROM events GROUP BY ALL HAVING count(*) > 1")
def a15_duplicate_keys(spark, sf):
    return duplicate_keys(X.table(spark, sf, "events"), ["user_id", "event_type"])


@query(
    with_(FRAMES, PREDICTIONS)
    + f""", s AS (SELECT split, CAST(count(*) FILTER (WHERE label = 1 AND predicted = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label = 0 AND predicted = 1) AS DOUBLE) AS fp,
  CAST(count(*) FILTER (WHERE label = 1 AND predicted = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE label = 0 AND predicted = 0) AS DOUBLE) AS tn,
  """
    + ", ".join(f"{f} FILTER (WHERE label = {y} AND predicted = {1 - y}) AS {k}_{n}" for k, y in (("fp", 0), ("fn", 1)) for n, f in (("mean", "avg(prob)"), ("min", "min(prob)"), ("max", "max(prob)"), ("median", "quantile_cont(prob, 0.5)")))
    + f""" FROM preds GROUP BY split)
SELECT split, tp, fp, fn, tn, {R('coalesce(tp / nullif(tp + fp, 0), 0)', 'precision')}, {R('coalesce(tp / nullif(tp + fn, 0), 0)', 'recall')}, {R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)', 'f1')}, """
    + ", ".join(R(f"{k}_{n}", f"{k}_{n}") for k in ("fp", "fn") for n in ("mean", "min", "max", "median"))
    + " FROM s"
)
def a16_error_profile(spark, sf):
    return A.error_profile(X.predictions(spark, sf))


@query(with_(FRAMES, PREDICTIONS) + "SELECT split, string_agg(intensity || ':' || n, ',' ORDER BY intensity) AS missed FROM (SELECT split, intensity, count(*) AS n FROM preds WHERE label = 1 AND predicted = 0 GROUP BY ALL) GROUP BY split")
def a16_missed_by_intensity(spark, sf):
    return A.missed_by_intensity(X.predictions(spark, sf))


@query(
    with_(FRAMES, PREDICTIONS)
    + f"""SELECT subject, count(*) AS n, count(*) FILTER (WHERE label <> predicted) AS errors, {R('avg(CAST(label <> predicted AS INTEGER))', 'error_rate')}, count(*) FILTER (WHERE prob > 0.3 AND prob < 0.7) AS uncertain,
  count(*) FILTER (WHERE label <> predicted AND (prob <= 0.3 OR prob >= 0.7)) AS confident_wrong, {R('avg(prob) FILTER (WHERE label = predicted)', 'mean_prob_correct')}, {R('avg(prob) FILTER (WHERE label <> predicted)', 'mean_prob_error')} FROM preds GROUP BY subject"""
)
def a17_misclassified(spark, sf):
    return A.misclassified(X.predictions(spark, sf))


@query(
    with_(_REV, f"cmp AS ({_CMP})")
    + f"""SELECT count(*) FILTER (WHERE old = 0 AND new = 1) AS up, count(*) FILTER (WHERE old = 1 AND new = 0) AS down, count(*) FILTER (WHERE status = 'same') AS same, count(*) FILTER (WHERE status = 'added') AS added,
  count(*) FILTER (WHERE status = 'removed') AS removed, {R("coalesce(count(*) FILTER (WHERE status = 'changed') / nullif(count(*) FILTER (WHERE status IN ('same', 'changed')), 0), 0)", 'change_rate')} FROM cmp"""
)
def a18_label_changes(spark, sf):
    return A.label_changes(revisions(spark, sf))


_THRESHOLDS = [i / 100 for i in range(10, 90)]


def _sweep_sql(truth: str, score: str, grid: str) -> str:
    counts = f"""cnt AS (SELECT threshold, count(*) FILTER (WHERE {truth} AND {score} >= threshold) AS tp, count(*) FILTER (WHERE NOT ({truth}) AND {score} >= threshold) AS fp,
  count(*) FILTER (WHERE {truth} AND {score} < threshold) AS fn, count(*) FILTER (WHERE NOT ({truth}) AND {score} < threshold) AS tn FROM preds, {grid} GROUP BY threshold)"""
    div = lambda a, b: f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"
    return f"""{counts}, sweep AS (SELECT *, {div('tp', 'tp + fp')} AS precision, {div('tp', 'tp + fn')} AS recall, {div('tn', 'tn + fp')} AS specificity, {div('2 * tp', '2 * tp + fp + fn')} AS f1,
  {div('tp', 'tp + fn')} + {div('tn', 'tn + fp')} - 1 AS youden FROM cnt)"""


_GRID = "(SELECT i / 100.0 AS threshold FROM range(10, 90) r(i)) g"
_SHOW = f"SELECT {R('threshold', 'threshold')}, tp, fp, fn, tn, {R('precision', 'precision')}, {R('recall', 'recall')}, {R('specificity', 'specificity')}, {R('f1', 'f1')}, {R('youden', 'youden')} FROM sweep"


@query(with_(FRAMES, PREDICTIONS, _sweep_sql("label = 1", "prob", _GRID)) + _SHOW)
def a19_threshold_sweep(spark, sf):
    return A.threshold_sweep(X.predictions(spark, sf), _THRESHOLDS, F.col("label") == 1)


@query(
    with_(FRAMES, PREDICTIONS, _sweep_sql("label = 1", "prob", _GRID))
    + " UNION ALL ".join(
        f"SELECT '{n}' AS strategy, (SELECT {R('threshold')} FROM sweep WHERE {w} ORDER BY {o} DESC, threshold LIMIT 1) AS threshold"
        for n, w, o in (("f1", "true", "f1"), ("recall_at_precision", "precision >= 0.85", "recall"), ("precision_at_recall", "recall >= 0.85", "precision"), ("youden", "true", "youden"))
    )
)
def a19_best_threshold(spark, sf):
    return A.best_threshold(A.threshold_sweep(X.predictions(spark, sf), _THRESHOLDS, F.col("label") == 1))


@query(with_(FRAMES, PREDICTIONS, _sweep_sql("intensity >= 2", "floor(prob * 6)", "(SELECT unnest([1.0, 2.0, 3.0, 4.0, 5.0]) AS threshold) g")) + _SHOW)
def a20_integer_thresholds(spark, sf):
    p = X.predictions(spark, sf).withColumn("guess", F.floor(F.col("prob") * 6))
    return A.threshold_sweep(p, [1, 2, 3, 4, 5], F.col("intensity") >= 2, "guess")


@query(
    with_(FRAMES, PREDICTIONS)
    + f""", q AS (SELECT *, CASE WHEN trial = 6 THEN 'test' ELSE split END AS s FROM preds), many AS (SELECT subject, count(DISTINCT s) > 1 AS leaks FROM q GROUP BY subject)
SELECT s AS split, count(*) AS n, count(DISTINCT q.subject) AS subjects, {R('avg(label)', 'rate')}, {R('avg(label) - (SELECT avg(label) FROM q)', 'gap')}, count(DISTINCT CASE WHEN leaks THEN q.subject END) AS leaking FROM q JOIN many USING (subject) GROUP BY s"""
)
def a21_split_report(spark, sf):
    return A.split_report(X.predictions(spark, sf).withColumn("split", F.when(F.col("trial") == 6, "test").otherwise(F.col("split"))))


_LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {R(f'corr({a}, {b})', 'r')} FROM lineitem" for i, a in enumerate(_LI) for b in _LI[i + 1 :]))
def a22_correlations(spark, sf):
    return A.correlations(X.table(spark, sf, "lineitem"), _LI)


_RUNS = "runs AS (SELECT 'run' || trial AS run, 'mean' AS metric, avg(value) AS value FROM frames GROUP BY trial UNION ALL SELECT 'run' || trial, 'peak', max(value) FROM frames GROUP BY trial)"


def _runs(spark, sf):
    t = X.frames(spark, sf).groupBy(F.concat(F.lit("run"), F.col("trial").cast("string")).alias("run")).agg(F.avg("value").alias("mean"), F.max("value").alias("peak"))
    return t.unpivot("run", ["mean", "peak"], "metric", "value")


@query(with_(FRAMES, _RUNS) + f"SELECT metric, {R('a.value', 'old')}, {R('b.value', 'new')}, {R('b.value - a.value', 'delta')} FROM runs a JOIN runs b USING (metric) WHERE a.run = 'run1' AND b.run = 'run3'")
def a23_compare_runs(spark, sf):
    return A.compare_runs(_runs(spark, sf), "run1", "run3")


@query(with_(FRAMES, _RUNS) + f"SELECT metric, arg_max(run, value) AS best_run, {R('max(value)', 'best_value')} FROM runs GROUP BY metric")
def a23_best_runs(spark, sf):
    return A.best_runs(_runs(spark, sf))


@query(
    with_(FRAMES, PREDICTIONS)
    + f"""SELECT {R('(m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2))', 'd')}, n1, n0 FROM (SELECT avg(prob) FILTER (WHERE label = 1) AS m1, avg(prob) FILTER (WHERE label = 0) AS m0,
  var_samp(prob) FILTER (WHERE label = 1) AS v1, var_samp(prob) FILTER (WHERE label = 0) AS v0, count(*) FILTER (WHERE label = 1) AS n1, count(*) FILTER (WHERE label = 0) AS n0 FROM preds)"""
)
def a24_cohens_d(spark, sf):
    return A.cohens_d(X.predictions(spark, sf), "label", "prob")


@query(
    with_(FRAMES)
    + " UNION ALL ".join(
        [f"SELECT 'percentile:{q}' AS name, {R(f'quantile_cont(value, {q / 100})', 'threshold')} FROM frames" for q in (50, 90, 99)]
        + [f"SELECT 'sigma:{k}', {R(f'avg(value) FILTER (WHERE frame < 2) + {k} * stddev_pop(value) FILTER (WHERE frame < 2)')} FROM frames" for k in (1, 4)]
    )
)
def a25_thresholds(spark, sf):
    return A.resolve_thresholds(X.frames(spark, sf), "value", [50, 90, 99], F.col("frame") < X.ON, [1, 4])


@query("SELECT user_id, event_type, max(value) AS score FROM events WHERE NOT (user_id % 7 = 0) GROUP BY ALL")
def a26_score_cleanup(spark, sf):
    from ..operators.joins import keep_last

    e = X.table(spark, sf, "events").select("user_id", "event_type", F.col("value").alias("score"), "event_id")
    best = keep_last(e, ["user_id", "event_type"], [F.desc("score"), F.desc("event_id")]).drop("event_id")
    return best.join(e.filter("user_id % 7 = 0").select("user_id").distinct(), "user_id", "left_anti")


@query(with_(SAMPLES) + f"SELECT cluster, CAST(t AS INTEGER) AS t, {R('avg(v)', 'mean')} FROM samples GROUP BY cluster, t")
def a27_cluster_traces(spark, sf):
    return X.samples(spark, sf).groupBy("cluster", "t").agg(F.avg("v").alias("mean"))


@query(
    with_(FRAMES)
    + f""", s AS (SELECT {_K}, avg(CAST(value > 75 AS INTEGER)) AS fraction, sum(greatest(value - 75, 0)) AS auc, min(frame) FILTER (WHERE value > 75) AS latency, count(*) FILTER (WHERE event_type = 'click') AS stars FROM frames GROUP BY ALL),
c AS (SELECT *, round(5 * (fraction + auc / max(auc) OVER () + CASE WHEN latency IS NULL THEN 0.0 ELSE 1 - latency / max(latency) OVER () END) / 3, 0) AS score FROM s)
SELECT {_K}, {R('score', 'data_score')}, {R('(3.0 * stars + score) / 4', 'final_score')} FROM c"""
)
def a28_composite_scores(spark, sf):
    s = X.frames(spark, sf).groupBy(*X.KEYS).agg(
        F.avg((F.col("value") > 75).cast("int")).alias("fraction"), F.sum(F.greatest(F.col("value") - 75, F.lit(0.0))).alias("auc"), F.min(F.when(F.col("value") > 75, F.col("frame"))).alias("latency"), F.count_if(F.col("event_type") == "click").alias("stars")
    )
    return A.composite_scores(s, "fraction", "auc", "latency", user="stars").select(*X.KEYS, "data_score", "final_score")


def _scalars_sql() -> str:
    e = {"before": "b", "during": "d", "after": "a"}
    inner = ", ".join(
        [f"coalesce(sum(value) FILTER (WHERE {f}) / 2.0, 0) AS auc_{n}" for n, f in e.items()]
        + [f"(min(frame) FILTER (WHERE {f} AND value = m{f}) - min(frame) FILTER (WHERE {f})) / 2.0 AS time_to_peak_{n}" for n, f in e.items() if n != "before"]
        + [f"{g}(value) FILTER (WHERE {f}) AS {k}_{n}" for k, g in (("peak", "max"), ("low", "min")) for n, f in e.items()]
        + ["max(value) AS global_max", "min(value) AS global_min", "quantile_cont(value, 0.99) AS trimmed_max", "quantile_cont(value, 0.01) AS trimmed_min"]
    )
    names = [f"auc_{n}" for n in e] + ["time_to_peak_during", "time_to_peak_after"] + [f"{k}_{n}" for k in ("peak", "low") for n in e] + ["global_max", "global_min", "trimmed_max", "trimmed_min"]
    ratios = {"auc_ratio_during": "auc_during / nullif(auc_before, 0)", "auc_ratio_after": "auc_after / nullif(auc_before, 0)", "peak_ratio_during": "peak_during / nullif(peak_before, 0)", "peak_ratio_after": "peak_after / nullif(peak_before, 0)", "max_ratio": "global_max / nullif(trimmed_max, 0)", "extent": "global_max - global_min"}
    peaks = f"peaks AS (SELECT *, max(value) FILTER (WHERE d) OVER w AS md, max(value) FILTER (WHERE a) OVER w AS ma FROM flagged WINDOW w AS (PARTITION BY {_K}))"
    return with_(FRAMES, _FLAGS, peaks) + f"SELECT {_K}, " + ", ".join([R(n, n) for n in names] + [R(v, n) for n, v in ratios.items()]) + f" FROM (SELECT {_K}, {inner} FROM peaks GROUP BY ALL)"


@query(_scalars_sql())
def a29_engineered_scalars(spark, sf):
    return A.engineered_scalars(flagged(spark, sf), X.KEYS, fps=float(X.FPS))
