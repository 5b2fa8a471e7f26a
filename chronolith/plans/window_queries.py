"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W_
from . import fixtures as X
from .fixtures import FRAMES, SAMPLES, TRACES, with_
from .registry import R, query

_K = "dataset, subject, trial"
_PREV = f"prev AS (SELECT *, lag(frame) OVER w AS pt, lag(value) OVER w AS pv, max(value) OVER v AS peak FROM frames WINDOW w AS (PARTITION BY {_K} ORDER BY frame), v AS (PARTITION BY {_K}))"


def _cross(threshold: str, cond: str = "true") -> str:
    at = f"CASE WHEN pv IS NULL OR pv = value THEN CAST(frame AS DOUBLE) ELSE pt + least(1.0, greatest(0.0, ({threshold} - pv) / (value - pv))) * (frame - pt) END"
    return f"arg_min({at}, frame) FILTER (WHERE {cond} AND value >= {threshold})"


@query(with_(FRAMES) + f", x AS (SELECT {_K}, frame, lag(frame) OVER (PARTITION BY {_K} ORDER BY frame) AS previous FROM frames WHERE event_id % 11 <> 0) SELECT {_K}, frame, previous FROM x WHERE frame - previous <> 1")
def w01_contiguity_breaks(spark, sf):
    return W_.contiguity_breaks(X.frames(spark, sf).filter("event_id % 11 <> 0"), X.KEYS)


@query(with_(FRAMES) + f"SELECT {_K}, frame, {R(f'avg(value) OVER (PARTITION BY {_K} ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)', 'smooth')} FROM frames")
def w02_rolling_mean(spark, sf):
    return X.frames(spark, sf).select(*X.KEYS, "frame", W_.rolling_mean("value", X.KEYS, "frame", 4).alias("smooth"))


@query(with_(FRAMES) + f"SELECT {_K}, frame, {R('coalesce((lead(value) OVER w - lag(value) OVER w) / 1.0, (lead(value) OVER w - value) / 0.5, (value - lag(value) OVER w) / 0.5)', 'velocity')} FROM frames WINDOW w AS (PARTITION BY {_K} ORDER BY frame)")
def w03_velocity(spark, sf):
    return X.frames(spark, sf).select(*X.KEYS, "frame", W_.velocity("value", X.KEYS, "frame", 1 / X.FPS).alias("velocity"))


@query(with_(FRAMES, _PREV) + f"SELECT {_K}, {R(_cross('75.0'), 'crossing')} FROM prev GROUP BY ALL")
def w04_first_crossing(spark, sf):
    return W_.crossings(X.frames(spark, sf), X.KEYS, "frame", "value", 75.0)


@query(with_(FRAMES) + f"SELECT {_K}, coalesce(hit, last) AS latency, coalesce(hit < last, false) AS event FROM (SELECT {_K}, min(frame) FILTER (WHERE value >= 75) AS hit, max(frame) AS last FROM frames GROUP BY ALL)")
def w05_latency(spark, sf):
    return W_.latency(X.frames(spark, sf), X.KEYS, "frame", "value", 75.0)


_RUNS = f"runs AS (SELECT {_K}, min(frame) AS \"start\", max(frame) AS \"end\", count(*) AS length FROM (SELECT *, frame - row_number() OVER (PARTITION BY {_K} ORDER BY frame) AS island FROM frames WHERE value >= 40) GROUP BY {_K}, island)"


@query(with_(FRAMES, _RUNS) + "SELECT * FROM runs")
def w06_runs(spark, sf):
    return W_.runs(X.frames(spark, sf), X.KEYS, "frame", F.col("value") >= 40)


@query(with_(FRAMES, _RUNS) + f'SELECT {_K}, count(*) AS "count", {R("avg(gap)", "interval_mean")}, {R("stddev_pop(gap)", "interval_std")} FROM (SELECT *, ("start" - lag("start") OVER (PARTITION BY {_K} ORDER BY "start")) * 0.5 AS gap FROM runs) GROUP BY {_K}')
def w07_excursions(spark, sf):
    return W_.excursions(X.frames(spark, sf), X.KEYS, "frame", "value", 40.0, 0.5)


@query(with_(FRAMES, _PREV) + f"SELECT {_K}, {R('sum((frame - pt) * (value + pv) / 2)', 'area')} FROM prev GROUP BY ALL")
def w08_area(spark, sf):
    return W_.areas(X.frames(spark, sf), X.KEYS, "frame", "value")


@query(
    with_(FRAMES, _PREV, f"peaked AS (SELECT *, min(frame) FILTER (WHERE value = peak) OVER (PARTITION BY {_K}) AS pk_at FROM prev)")
    + f"""SELECT {_K}, {R('max(peak)', 'peak')}, CAST(max(pk_at) AS INTEGER) AS peak_time, {R(f"CASE WHEN max(peak) > 10 THEN {_cross('(10.0 + 0.9 * (peak - 10.0))')} - {_cross('(10.0 + 0.1 * (peak - 10.0))')} END", 'rise_time')},
 min(frame) FILTER (WHERE frame >= pk_at AND value <= 10.0 + 0.5 * (peak - 10.0)) - max(pk_at) AS half_life FROM peaked GROUP BY ALL"""
)
def w09_rise_and_decay(spark, sf):
    return W_.rise_and_decay(X.frames(spark, sf), X.KEYS, "frame", "value", 10.0)


@query(with_(TRACES) + f"SELECT trial, CAST(i AS INTEGER) AS start, {R('list_sum(trace[i + 1 : i + 8])', 'total')} FROM traces, range(0, 57) r(i)")
def w10_lag_embedding(spark, sf):
    e = X.traces(spark, sf).select("trial", F.posexplode(W_.lag_embedding("trace", 8)).alias("start", "w"))
    return e.select("trial", "start", F.aggregate("w", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(with_(FRAMES) + f", s AS (SELECT dataset || '/' || subject || '/' || trial AS id, sum(value) AS total FROM frames GROUP BY {_K}) SELECT id, {R('total', 'total')}, row_number() OVER (ORDER BY total DESC, id) AS rank FROM s")
def w11_rank_trials(spark, sf):
    s = W_.ordered_sums(X.frames(spark, sf), X.KEYS, "frame", "value", "total")
    s = s.select(F.concat("dataset", F.lit("/"), F.col("subject").cast("string"), F.lit("/"), F.col("trial").cast("string")).alias("id"), "total")
    return W_.rank_by(s, "total", "id")


@query(with_(FRAMES) + f"SELECT {_K}, CAST(row_number() OVER (PARTITION BY dataset, subject ORDER BY trial) AS INTEGER) AS trial_number FROM (SELECT DISTINCT {_K} FROM frames)")
def w12_trial_numbers(spark, sf):
    return W_.numbered(X.frames(spark, sf).select(*X.KEYS).distinct(), ["dataset", "subject"], ["trial"], "trial_number")


_PV = "pv AS (SELECT l_suppkey AS id, CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE round(1 / (1 + sum(l_quantity) / 2000), 9) END AS p FROM lineitem GROUP BY l_suppkey)"


def p_values(spark, sf):
    s = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("q"))
    return s.select("id", F.when(F.col("id") % 9 != 0, F.round(1 / (1 + F.col("q") / 2000), 9)).alias("p"))


@query(
    with_(_PV)
    + f", r AS (SELECT *, p * count(p) OVER () / row_number() OVER (ORDER BY p, id) AS raw FROM pv WHERE p IS NOT NULL), q AS (SELECT id, p, least(1, min(raw) OVER (ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r) SELECT id, {R('p', 'p')}, {R('q', 'q')} FROM (SELECT * FROM q UNION ALL SELECT id, NULL, NULL FROM pv WHERE p IS NULL)"
)
def w13_benjamini_hochberg(spark, sf):
    return W_.benjamini_hochberg(p_values(spark, sf), "p", "id")


@query(with_(FRAMES) + ", s AS (SELECT frame, avg(value) AS m FROM frames GROUP BY frame) SELECT min(frame) FILTER (WHERE m / 100 < 0.5) AS onset FROM s")
def w14_earliest_onset(spark, sf):
    s = X.frames(spark, sf).groupBy("frame").agg((F.avg("value") / 100).alias("q"))
    return W_.earliest_onset(s, "q", "frame", 0.5)


LATENCIES = f"lat AS (SELECT {_K}, CASE WHEN trial IN (2, 4, 5) THEN 'A' ELSE 'B' END AS grp, coalesce(hit, last) AS latency, coalesce(hit < last, false) AS event FROM (SELECT {_K}, min(frame) FILTER (WHERE value >= 75) AS hit, max(frame) AS last FROM frames GROUP BY ALL))"
KM = """km0 AS (SELECT grp, latency AS "time", count(*) AS n, count(*) FILTER (WHERE event) AS events FROM lat GROUP BY ALL),
km1 AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY "time" ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS at_risk FROM km0),
km AS (SELECT grp, "time", CAST(at_risk AS BIGINT) AS at_risk, events, product(1 - events / at_risk) OVER (PARTITION BY grp ORDER BY "time" ROWS UNBOUNDED PRECEDING) AS survival FROM km1)"""


def latencies(spark, sf, threshold: float = 75.0):
    lat = W_.latency(X.frames(spark, sf), X.KEYS, "frame", "value", threshold)
    return lat.withColumn("grp", F.when(F.col("trial").isin(2, 4, 5), "A").otherwise("B"))


@query(with_(FRAMES, LATENCIES, KM) + f'SELECT grp, "time", at_risk, events, {R("survival", "survival")} FROM km')
def w15_kaplan_meier(spark, sf):
    return W_.kaplan_meier(latencies(spark, sf), ["grp"])


@query(with_(FRAMES, LATENCIES, KM) + 'SELECT grp, min("time") FILTER (WHERE survival <= 0.5) AS median FROM km GROUP BY grp')
def w15_median_survival(spark, sf):
    return W_.median_survival(W_.kaplan_meier(latencies(spark, sf), ["grp"]), ["grp"])


@query(
    with_(FRAMES)
    + f""", g AS (SELECT {_K}, frame, CASE WHEN event_id % 3 = 0 THEN value END AS v, CASE WHEN event_id % 3 = 0 THEN frame END AS i FROM frames),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(i IGNORE NULLS) OVER b AS i0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(i IGNORE NULLS) OVER a AS i1 FROM g
  WINDOW b AS (PARTITION BY {_K} ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY {_K} ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT {_K}, frame, {R('coalesce(v, CASE WHEN i1 > i0 THEN v0 + (v1 - v0) * (frame - i0) / (i1 - i0) END, v0, v1, 0)', 'filled')} FROM f"""
)
def w16_interpolate(spark, sf):
    f = X.frames(spark, sf).withColumn("v", F.when(F.col("event_id") % 3 == 0, F.col("value")))
    return W_.interpolate(f, X.KEYS, "frame", "v", "filled").select(*X.KEYS, "frame", "filled")


@query(with_(SAMPLES) + f"SELECT trial, CAST((t - 20) // 6 AS INTEGER) AS bin, {R('avg(v)', 'mean')}, {R('(20 + ((t - 20) // 6) * 6 + least(26 + ((t - 20) // 6) * 6, 40) - 1) / 2.0', 'centre')} FROM samples WHERE t >= 20 AND t < 40 GROUP BY trial, (t - 20) // 6")
def w17_time_bins(spark, sf):
    return W_.time_bins(X.samples(spark, sf), ["trial"], "t", "v", 20, 40, 6)


_VAR = "vars AS (SELECT t AS component, var_pop(v) AS variance FROM samples GROUP BY t), cum AS (SELECT component, variance / sum(variance) OVER () AS share, sum(variance) OVER (ORDER BY component ROWS UNBOUNDED PRECEDING) / sum(variance) OVER () AS cumulative FROM vars)"


def _variances(spark, sf):
    return X.samples(spark, sf).groupBy(F.col("t").alias("component")).agg(F.var_pop("v").alias("variance"))


@query(with_(SAMPLES, _VAR) + f"SELECT CAST(component AS INTEGER) AS component, {R('share', 'share')}, {R('cumulative', 'cumulative')} FROM cum")
def w18_cumulative_variance(spark, sf):
    return W_.cumulative_variance(_variances(spark, sf))[0].drop("variance")


@query(with_(SAMPLES, _VAR) + "SELECT CAST(min(component) FILTER (WHERE cumulative >= 0.8) AS INTEGER) AS n_80, CAST(min(component) FILTER (WHERE cumulative >= 0.9) AS INTEGER) AS n_90 FROM cum")
def w18_component_counts(spark, sf):
    return W_.cumulative_variance(_variances(spark, sf))[1]
