"""Queries of the scalar, array, map and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.frames import clean_text
from . import fixtures as X
from .fixtures import FRAMES, LABELS, SAMPLES, with_
from .registry import R, query

_K = "dataset, subject, trial"


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS clean FROM events")
def f01_clean_text(spark, sf):
    e = X.table(spark, sf, "events")
    text = F.when(F.col("user_id") % 3 == 0, F.when(F.col("event_id") % 2 == 0, " nan ").otherwise("None")).otherwise(F.concat(F.lit("\t "), F.col("event_type"), F.lit("  ")))
    return e.select("event_id", clean_text(F.trim(F.regexp_replace(text, "\t", " "))).alias("clean"))


@query("SELECT event_id, user_id AS subject, event_id AS trial FROM events")
def f02_path_digits(spark, sf):
    path = F.format_string("/data/rec/subject_%s/trial-%s.csv", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    subject, trial = S.subject_and_trial(path)
    return X.table(spark, sf, "events").select("event_id", subject.alias("subject"), trial.alias("trial"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'testing_' || user_id END AS core FROM events")
def f03_core_label(spark, sf):
    text = F.concat(F.when(F.col("event_id") % 2 == 0, "testing_").otherwise("training_"), F.col("user_id").cast("string"), F.lit("_subject_2"))
    return X.table(spark, sf, "events").select("event_id", S.core_label(text).alias("core"))


@query("SELECT event_id, CAST(month(ts) AS VARCHAR) || '-' || day(ts) || '-rec' AS plain FROM events")
def f04_plain_dates(spark, sf):
    text = F.concat(F.date_format("ts", "MM-dd"), F.lit("-rec_rig_2"))
    return X.table(spark, sf, "events").select("event_id", S.plain_dates(text).alias("plain"))


@query("SELECT o_orderkey, regexp_replace(lower(o_orderpriority), '[^a-z0-9]', '', 'g') AS k FROM orders")
def f05_column_key(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", S.column_key(F.col("o_orderpriority")).alias("k"))


@query("SELECT event_id, user_id || '_' || event_type AS id FROM events")
def f06_template_id(spark, sf):
    return X.table(spark, sf, "events").select("event_id", S.template_id("%s_%s", F.col("user_id"), F.col("event_type")).alias("id"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'testing_' || user_id END AS code FROM events")
def f07_testing_code(spark, sf):
    n = F.col("user_id").cast("string")
    a, b = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x Testing_"), n)).otherwise("none"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("TEST "), n))
    return X.table(spark, sf, "events").select("event_id", S.testing_code(a, b).alias("code"))


@query("SELECT event_id, user_id || CASE WHEN event_type = 'view' THEN '' ELSE ' | ' || event_type END AS text FROM events")
def f08_descriptor(spark, sf):
    kind = F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type"))
    return X.table(spark, sf, "events").select("event_id", S.descriptor(F.col("user_id"), kind, F.lit(None)).alias("text"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN quality = 1 WHEN 1 THEN quality = 1 ELSE false END AS flag FROM labels")
def f10_to_bool(spark, sf):
    words = F.when(F.col("quality") == 1, " Yes").otherwise("n")
    text = F.when(F.col("doc_id") % 3 == 0, words).when(F.col("doc_id") % 3 == 1, F.col("quality").cast("string"))
    return X.table(spark, sf, "labels").select("doc_id", S.to_bool(text).alias("flag"))


@query(f"SELECT event_id, {R('CASE WHEN event_id % 4 <> 0 THEN value END', 'number')} FROM events")
def f11_to_number(spark, sf):
    text = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(" "), F.col("value").cast("string"))).otherwise("n/a")
    return X.table(spark, sf, "events").select("event_id", S.to_number(text).alias("number"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS label FROM lineitem")
def f12_valid_label(spark, sf):
    text = F.when(F.col("l_linenumber") % 3 == 0, F.when(F.col("l_linenumber") == 3, "-1").otherwise("2.5")).otherwise(F.col("l_quantity").cast("string"))
    return X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.valid_label(text).alias("label"))


@query(with_(FRAMES, LABELS) + f"SELECT {_K}, CAST(intensity >= 1 AS INTEGER) AS binary_class, intensity AS multi_class, CAST(intensity >= 2 AS INTEGER) AS above_1, CAST(intensity >= 3 AS INTEGER) AS above_2 FROM labels5")
def f13_class_of(spark, sf):
    i = F.col("intensity")
    return X.labels(spark, sf).select(*X.KEYS, S.class_of(i, "binary").alias("binary_class"), S.class_of(i, "multiclass").alias("multi_class"), S.class_of(i, "threshold-1").alias("above_1"), S.class_of(i, "threshold-2").alias("above_2"))


@query(
    with_(FRAMES, LABELS)
    + f""", w AS (SELECT intensity, (SELECT count(*) FROM labels5) / ((SELECT count(DISTINCT intensity) FROM labels5) * CAST(count(*) AS DOUBLE)) AS class_weight FROM labels5 GROUP BY intensity)
SELECT {_K}, {R('greatest(1, intensity)', 'weight')}, {R('greatest(1, intensity) * CASE WHEN intensity = 5 THEN 5 ELSE 1 END', 'boosted')}, {R('greatest(1, intensity) * class_weight', 'combined')} FROM labels5 JOIN w USING (intensity)"""
)
def f14_weights(spark, sf):
    labels = X.labels(spark, sf)
    i = F.col("intensity")
    j = labels.join(S.class_weights(labels, "intensity"), "intensity")
    return j.select(*X.KEYS, S.sample_weight(i).alias("weight"), S.sample_weight(i, 5.0).alias("boosted"), (S.sample_weight(i) * F.col("class_weight")).alias("combined"))


@query(f"SELECT event_id, {R('value / nullif(event_id % 5, 0)', 'ratio')}, {R('least(100, greatest(10, value))', 'clipped')}, {R('sqrt(value)', 'root')}, {R('ln(value)', 'log')}, {R('round_even(value, 0)', 'even')} FROM events")
def f15_arithmetic(spark, sf):
    v = F.col("value")
    clip = F.least(F.lit(100.0), F.greatest(F.lit(10.0), v))
    return X.table(spark, sf, "events").select("event_id", S.safe_ratio(v, F.col("event_id") % 5).alias("ratio"), clip.alias("clipped"), F.sqrt(v).alias("root"), S.natural_log(v).alias("log"), F.bround(v, 0).alias("even"))


@query("SELECT event_id, CAST(event_id % 7 - 1 AS BIGINT) AS score, CAST(event_id % 7 - 1 >= 2 AS INTEGER) AS reacted FROM events")
def f16_ordinal(spark, sf):
    score = S.class_score(F.col("event_id") % 7)
    return X.table(spark, sf, "events").select("event_id", score.alias("score"), S.ordinal_binary(score).alias("reacted"))


@query("SELECT doc_id, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' END AS quality_name, CAST(toxic AS VARCHAR) AS toxic_name FROM labels")
def f17_decode(spark, sf):
    codes = F.lit('{"0": "low", "1": "high"}')
    return X.table(spark, sf, "labels").select("doc_id", S.decode(F.col("quality"), codes).alias("quality_name"), S.decode(F.col("toxic"), F.lit('{"7": "x"}')).alias("toxic_name"))


@query("SELECT doc_id, CASE quality WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE CAST(quality AS VARCHAR) END AS quality_name, CASE toxic WHEN 0 THEN 'clean' ELSE 'toxic' END AS toxic_name, CAST(toxic AS VARCHAR) AS toxic_code FROM labels")
def f17_code_maps(spark, sf):
    """The layouts of code maps by turns, and texts through the inverse of one."""
    layouts = ('{"index_to_value": {"0": "low", "1": "high"}}', '{"values": ["high", "low"], "keys": [1, 0]}', '{"labels": ["low", "high"]}', '["low", "high"]')
    codes = F.element_at(F.array(*[F.lit(x) for x in layouts]), (F.col("doc_id") % 4 + 1).cast("int"))
    name = S.decode(F.col("toxic").cast("double"), F.lit('{"0": "clean", "1": "toxic"}'))
    d = X.table(spark, sf, "labels").select("doc_id", S.decode(F.col("quality"), codes).alias("quality_name"), name.alias("toxic_name"))
    return d.withColumn("toxic_code", S.decode(F.col("toxic_name"), F.lit('{"0": "clean", "1": "toxic"}')))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def f18_json(spark, sf):
    return X.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(with_(SAMPLES) + f"SELECT trial, CAST(t AS INTEGER) AS t, {R('(v - avg(v) OVER w) / CASE WHEN stddev_pop(v) OVER w = 0 THEN 1 ELSE stddev_pop(v) OVER w END', 'z')} FROM samples WINDOW w AS (PARTITION BY trial)")
def f19_zscore(spark, sf):
    return X.traces(spark, sf).select("trial", F.posexplode(S.zscore(F.col("trace"))).alias("t", "z"))


@query(
    with_(SAMPLES)
    + f", b AS (SELECT trial, avg(v) AS m, stddev_pop(v) AS s FROM samples WHERE t < 20 GROUP BY trial) SELECT trial, CAST(t AS INTEGER) AS t, {R('(v - m) / CASE WHEN s = 0 THEN 1 ELSE s END', 'z')} FROM samples JOIN b USING (trial)"
)
def f20_baseline_zscore(spark, sf):
    return X.traces(spark, sf).select("trial", F.posexplode(S.zscore(F.col("trace"), F.slice("trace", 1, 20))).alias("t", "z"))


def _segment_sql() -> str:
    one = lambda n, lo, hi: (
        f"{n} AS (SELECT trial, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS lo, max(v) AS hi, count(*) AS n, sum(v) - (arg_min(v, t) + arg_max(v, t)) / 2 AS auc, arg_max(t, v) - {lo} AS peak FROM samples WHERE t >= {lo} AND t < {hi} GROUP BY trial)"
    )
    cols = [R(f"{a}.{c}", f"{n}_{name}") for n, a in (("odor", "o"), ("post", "p")) for c, name in (("mean", "mean"), ("std", "std"), ("lo", "min"), ("hi", "max"), ("auc", "auc"), ("n", "duration"))]
    more = [R("o.peak / o.n", "odor_peak_latency"), R("p.mean - o.mean", "post_vs_odor_mean"), R("p.auc - o.auc", "post_auc_delta")]
    return with_(SAMPLES, one("o", 20, 40), one("p", 40, 64)) + f"SELECT trial, {', '.join(cols + more)} FROM o JOIN p USING (trial)"


@query(_segment_sql())
def f21_segment_statistics(spark, sf):
    return X.traces(spark, sf).select("trial", *[c.alias(n) for n, c in S.segment_statistics(F.col("trace"), 20, 40).items()])


@query(
    with_(FRAMES)
    + f", d AS (SELECT subject, trial, frame, lead(event_id) OVER w - event_id AS ahead, event_id - lag(event_id) OVER w AS back FROM frames WINDOW w AS (PARTITION BY subject, trial ORDER BY frame)) SELECT subject, trial, {R('sum(CASE WHEN coalesce(ahead, back, 1) > 0 THEN coalesce(ahead, back, 1) ELSE 1 END)', 'total')} FROM d GROUP BY ALL"
)
def f22_frame_durations(spark, sf):
    t = X.frames(spark, sf).groupBy("subject", "trial").agg(F.array_sort(F.collect_list(F.struct("frame", "event_id"))).alias("p"))
    times = F.transform("p", lambda x: x["event_id"].cast("double"))
    return t.select("subject", "trial", S.array_sum(S.frame_durations(times)).alias("total"))


@query(
    with_(FRAMES)
    + f"""SELECT {_K}, {R('avg(value) FILTER (WHERE frame < 2)', 'baseline_mean')}, {R('stddev_pop(value) FILTER (WHERE frame < 2)', 'baseline_std')}, {R('regr_slope(value, frame) FILTER (WHERE frame < 2)', 'baseline_slope')},
 {R('max(value) FILTER (WHERE frame >= 2)', 'peak')}, {R('avg(CAST(value > 75 AS INTEGER)) FILTER (WHERE frame >= 2)', 'duty_cycle')}, {R('sqrt(avg(value * value) FILTER (WHERE frame >= 2)) / nullif(stddev_pop(value) FILTER (WHERE frame < 2), 0)', 'snr')} FROM frames GROUP BY ALL"""
)
def f23_feature_row(spark, sf):
    v, before = F.col("value"), F.col("frame") < X.ON
    b, d = F.when(before, v), F.when(~before, v)
    t = F.when(before, F.col("frame").cast("double"))
    return X.frames(spark, sf).groupBy(*X.KEYS).agg(
        F.avg(b).alias("baseline_mean"), F.stddev_pop(b).alias("baseline_std"), F.regr_slope(b, t).alias("baseline_slope"), F.max(d).alias("peak"), F.avg((d > 75).cast("double")).alias("duty_cycle"), S.safe_ratio(F.sqrt(F.avg(d * d)), F.stddev_pop(b)).alias("snr")
    )


def _windows_sql() -> str:
    late = S.LATENCY_S["manual"]
    return f"""WITH n AS (SELECT l_suppkey AS id, count(*) * 3 AS frames, 40.0 AS fps FROM lineitem GROUP BY l_suppkey), a AS (SELECT *, greatest(0, least(frames, round_even(fps * 30, 0))) AS base, greatest(0, least(frames, round_even(fps * (30 + {late}), 0))) AS s0 FROM n),
b AS (SELECT *, greatest(base, s0) AS s FROM a), c AS (SELECT *, greatest(0, least(frames, s + round_even(fps * (30 + {late}), 0))) AS e FROM b)
SELECT id, CAST(base AS INTEGER) AS baseline_end, CAST(s AS INTEGER) AS odor_start, CAST(e AS INTEGER) AS odor_end, CAST(greatest(0, least(frames, e + round_even(fps * 30, 0))) AS INTEGER) AS post_end FROM c"""


@query(_windows_sql())
def f24_segment_windows(spark, sf):
    n = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg((F.count("*") * 3).alias("frames"))
    w = S.segment_windows(F.lit(40.0), S.LATENCY_S["manual"], F.col("frames"))
    return n.select("id", w["baseline"][1].alias("baseline_end"), w["odor"][0].cast("int").alias("odor_start"), w["odor"][1].alias("odor_end"), w["post"][1].alias("post_end"))


@query(
    with_(FRAMES)
    + f""", x AS (SELECT *, min(frame) FILTER (WHERE value > 75) OVER (PARTITION BY {_K}) AS x0 FROM frames), m AS (SELECT *, max(value) FILTER (WHERE frame >= x0) OVER (PARTITION BY {_K}) AS pk FROM x),
p AS (SELECT *, min(frame) FILTER (WHERE frame >= x0 AND value = pk) OVER (PARTITION BY {_K}) AS p0 FROM m),
g AS (SELECT {_K}, avg(CAST(value > 75 AS INTEGER)) AS tf, sum(greatest(value - 75, 0)) / 2.0 AS auc, count(*) / 2.0 AS du, bool_or(value > 75) AS cr, max(x0) / 2.0 AS tt, (max(p0) - max(x0)) / 2.0 AS tp, max(pk) AS pk,
 max(value) FILTER (WHERE frame = x0) AS c0, max(value) FILTER (WHERE frame = x0 + 1) AS c1, max(value) FILTER (WHERE frame = p0 - 1) AS pb FROM p GROUP BY ALL)
SELECT {_K}, {R('tf', 'time_fraction')}, {R('auc', 'auc')}, {R('du', 'duration')}, cr AS crossed_threshold, {R('tt', 'time_to_threshold')}, {R('tp', 'time_to_peak')}, {R('pk', 'peak_value')},
 {R('CASE WHEN tp > 0 THEN (pk - c0) / tp WHEN cr THEN 0 END', 'rise_speed')}, {R('CASE WHEN tp > 0 THEN ((pk - pb) * 2 - (c1 - c0) * 2) / tp WHEN cr THEN 0 END', 'rise_acceleration')} FROM g"""
)
def f25_segment_metrics(spark, sf):
    return S.segment_metrics(X.frames(spark, sf), X.KEYS, "value", 75.0, 2.0)


@query(with_(FRAMES) + f"SELECT {_K}, {R('avg(value) FILTER (WHERE frame < 2) + 4 * stddev_pop(value) FILTER (WHERE frame < 2)', 'threshold')} FROM frames GROUP BY ALL")
def f26_sigma_threshold(spark, sf):
    return S.sigma_threshold(X.frames(spark, sf), X.KEYS, "value", F.col("frame") < X.ON)


@query(with_(FRAMES) + f"SELECT {_K}, {R('quantile_cont(value, 0.5) + 3 * 1.4826 * mad(value)', 'threshold')} FROM frames GROUP BY ALL")
def f26_robust_threshold(spark, sf):
    return S.robust_threshold(X.frames(spark, sf), X.KEYS, "value")


@query(
    with_(SAMPLES)
    + f""", b AS (SELECT trial, avg(v) FILTER (WHERE t < 20) AS m, stddev_pop(v) FILTER (WHERE t < 20) AS s FROM samples GROUP BY trial)
SELECT trial, {R('max(m)', 'baseline_mean')}, {R('max(s)', 'baseline_std')}, {R('max(m + 4 * s)', 'threshold')}, {R('sum(greatest(v - (m + 4 * s), 0))', 'auc')}, {R('sum(greatest(v - (m + 4 * s), 0)) / greatest(abs(max(m + 4 * s) * count(*)), 1e-8)', 'auc_ratio')}
FROM samples JOIN b USING (trial) WHERE t BETWEEN 20 AND 40 GROUP BY trial"""
)
def f27_odor_response(spark, sf):
    return S.odor_response(X.samples(spark, sf), "trial", "t", "v", 20, 40)
