"""Queries of the statistical tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as H
from . import fixtures as X
from .aggregate_queries import DIFFS, GROUPS, MEANS, diffs
from .fixtures import FRAMES, with_
from .registry import R, query
from .window_queries import KM, LATENCIES, latencies

_D = (FRAMES, GROUPS, MEANS, DIFFS)
_N = H.SIMPSON


def _t2(t: str, df: str) -> str:
    """Two-sided p of t by Simpson's rule, with the gamma function that DuckDB has."""
    theta = f"atan(abs({t}) / sqrt({df}))"
    total = f"list_sum(list_transform(range(0, {_N + 1}), lambda i: CASE WHEN i IN (0, {_N}) THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END * pow(cos({theta} * i / {_N}), {df} - 1)))"
    return f"least(1.0, greatest(0.0, 1 - {total} * {theta} / {3 * _N} * 2 / sqrt(pi()) * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0))))"


def _sf(t: str, df: str) -> str:
    return f"CASE WHEN {t} >= 0 THEN {_t2(t, df)} / 2 ELSE 1 - {_t2(t, df)} / 2 END"


def _nsf(z: str) -> str:
    k = f"(1 / (1 + 0.2316419 * abs({z})))"
    a, b, c, d, e = H.NORMAL
    p = f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {k} * ({a} + {k} * ({b} + {k} * ({c} + {k} * ({d} + {k} * {e})))))"
    return f"CASE WHEN {z} >= 0 THEN {p} ELSE 1 - {p} END"


_MOM = "mom AS (SELECT frame, count(diff) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd FROM diffs GROUP BY frame)"
_TT = "tt AS (SELECT *, CASE WHEN n > 1 AND sd > 0 THEN mean / (sd / sqrt(n)) END AS t FROM mom)"


@query(with_(*_D, _MOM, _TT) + f"SELECT frame, n, {R('mean', 'mean')}, {R('t', 't')}, {R('CASE WHEN t IS NOT NULL THEN ' + _t2('t', '(n - 1)') + ' END', 'p')} FROM tt")
def h01_paired_t(spark, sf):
    return H.paired_t(diffs(spark, sf))


_RANKS = "rd AS (SELECT frame, round(diff, 9) AS diff FROM diffs), rk AS (SELECT *, rank() OVER (PARTITION BY frame ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY frame, abs(diff)) - 1) / 2.0 AS r FROM rd)"
_WX = """wx AS (SELECT frame, count(*) AS n, count(*) FILTER (WHERE diff = 0) AS zeros, coalesce(sum(r) FILTER (WHERE diff > 0), 0) AS wp, coalesce(sum(r) FILTER (WHERE diff < 0), 0) AS wm, sum(r * r) FILTER (WHERE diff <> 0) AS sq FROM rk GROUP BY frame),
wz AS (SELECT *, CASE WHEN sq > 0 THEN ((wp - wm) / 2 - 0.5 * sign(wp - wm)) / (sqrt(sq) / 2) END AS z FROM wx)"""


@query(with_(*_D, _RANKS, _WX) + f"SELECT frame, n, zeros, {R('wp', 'w_plus')}, {R('z', 'z')}, {R('least(1.0, 2 * (' + _nsf('abs(z)') + '))', 'p')} FROM wz")
def h02_wilcoxon(spark, sf):
    return H.wilcoxon(diffs(spark, sf))


@query()
def h02_wilcoxon_exact(spark, sf):
    return H.wilcoxon_exact(H.wilcoxon(diffs(spark, sf)))


_WELCH = """wl AS (SELECT frame, count(value) FILTER (WHERE grp = 'A') AS n_a, count(value) FILTER (WHERE grp = 'B') AS n_b, avg(value) FILTER (WHERE grp = 'A') - avg(value) FILTER (WHERE grp = 'B') AS d,
  var_samp(value) FILTER (WHERE grp = 'A') / count(value) FILTER (WHERE grp = 'A') AS va, var_samp(value) FILTER (WHERE grp = 'B') / count(value) FILTER (WHERE grp = 'B') AS vb FROM grouped WHERE frame < 12 GROUP BY frame),
wt AS (SELECT *, d / sqrt(va + vb) AS t, (va + vb) ** 2 / (va ** 2 / (n_a - 1) + vb ** 2 / (n_b - 1)) AS df FROM wl)"""


def _grouped(spark, sf):
    from ..operators.aggregate import with_group

    return with_group(X.frames(spark, sf)).filter("frame < 12")


@query(with_(FRAMES, GROUPS, _WELCH) + f"SELECT frame, n_a, n_b, {R('t', 't')}, {R('df', 'df')}, {R(_t2('t', 'df'), 'p')} FROM wt")
def h03_welch_t(spark, sf):
    return H.welch_t(_grouped(spark, sf), ["frame"], "grp", "value")


_MW = """mr AS (SELECT *, rank() OVER (PARTITION BY frame ORDER BY value) + (count(*) OVER (PARTITION BY frame, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY frame, value) AS c FROM grouped WHERE frame < 12),
mu AS (SELECT frame, sum(r) FILTER (WHERE grp = 'A') AS ra, CAST(count(*) FILTER (WHERE grp = 'A') AS DOUBLE) AS na, CAST(count(*) FILTER (WHERE grp = 'B') AS DOUBLE) AS nb, sum(c * c - 1) AS tied FROM mr GROUP BY frame),
mz AS (SELECT frame, ra - na * (na + 1) / 2 AS u, (abs(ra - na * (na + 1) / 2 - na * nb / 2) - 0.5) / sqrt(na * nb / 12 * (na + nb + 1 - tied / ((na + nb) * (na + nb - 1)))) AS z FROM mu)"""


@query(with_(FRAMES, GROUPS, _MW) + f"SELECT frame, {R('u', 'u')}, {R('z', 'z')}, {R('least(1.0, 2 * (' + _nsf('z') + '))', 'p')} FROM mz")
def h03_mann_whitney(spark, sf):
    return H.mann_whitney(_grouped(spark, sf), ["frame"], "grp", "value")


@query(
    with_(*_D)
    + f""", s AS (SELECT frame, count(*) FILTER (WHERE diff > 0) AS up, count(*) FILTER (WHERE diff < 0) AS down FROM diffs GROUP BY frame)
SELECT frame, up, down, {R("CASE WHEN up + down > 0 THEN least(1.0, 2 * list_sum(list_transform(range(0, least(up, down) + 1), lambda i: exp(lgamma(up + down + 1) - lgamma(i + 1) - lgamma(up + down - i + 1) - (up + down) * ln(2))))) END", 'p')} FROM s"""
)
def h04_sign_test(spark, sf):
    return H.sign_test(diffs(spark, sf))


_PERMS = 100
_FLIP = f"flip AS (SELECT subject, frame, perm, diff * CASE WHEN perm = 0 OR substr(md5('67|' || perm || '|' || subject), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS diff FROM diffs, range(0, {_PERMS + 1}) r(perm))"


@query(
    with_(*_D, _FLIP)
    + f""", m AS (SELECT perm, frame, avg(diff) AS m FROM flip GROUP BY ALL), o AS (SELECT frame, m AS effect FROM m WHERE perm = 0),
p AS (SELECT frame, max(effect) AS effect, (1 + count(*) FILTER (WHERE abs(m) >= abs(effect) - 1e-12)) / CAST({_PERMS + 1} AS DOUBLE) AS p FROM m JOIN o USING (frame) WHERE perm > 0 GROUP BY frame),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, frame) AS raw FROM p)
SELECT frame, {R('effect', 'effect')}, {R('p', 'p')}, {R('least(1.0, min(raw) OVER (ORDER BY p DESC, frame DESC ROWS UNBOUNDED PRECEDING))', 'q')} FROM r"""
)
def h05_randomization(spark, sf):
    return H.randomization_test(diffs(spark, sf), _PERMS)


@query(
    with_(*_D, _FLIP)
    + f""", m AS (SELECT perm, frame, quantile_cont(diff, 0.5) AS m FROM flip GROUP BY ALL), o AS (SELECT frame, m AS effect FROM m WHERE perm = 0),
p AS (SELECT frame, max(effect) AS effect, (1 + count(*) FILTER (WHERE abs(m) >= abs(effect) - 1e-12)) / CAST({_PERMS + 1} AS DOUBLE) AS p FROM m JOIN o USING (frame) WHERE perm > 0 GROUP BY frame),
r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, frame) AS raw FROM p)
SELECT frame, {R('effect', 'effect')}, {R('p', 'p')}, {R('least(1.0, min(raw) OVER (ORDER BY p DESC, frame DESC ROWS UNBOUNDED PRECEDING))', 'q')} FROM r"""
)
def h05_median_randomization(spark, sf):
    return H.randomization_test(diffs(spark, sf), _PERMS, statistic="median")


@query(
    with_(*_D, _FLIP)
    + f""", t AS (SELECT perm, frame, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM flip GROUP BY ALL HAVING count(*) > 1 AND stddev_samp(diff) > 0),
i AS (SELECT *, sign(t) AS side, frame - row_number() OVER (PARTITION BY perm, sign(t) ORDER BY frame) AS island FROM t WHERE abs(t) > 1.0),
c AS (SELECT perm, min(frame) AS "start", max(frame) AS "end", count(*) AS length, sum(t) AS mass FROM i GROUP BY perm, side, island), x AS (SELECT perm, max(abs(mass)) AS top FROM c WHERE perm > 0 GROUP BY perm)
SELECT "start", "end", length, {R('mass', 'mass')}, {R(f'(1 + (SELECT count(*) FROM x WHERE top >= abs(mass) - 1e-12)) / CAST({_PERMS + 1} AS DOUBLE)', 'p')} FROM c WHERE perm = 0"""
)
def h06_cluster_permutation(spark, sf):
    return H.cluster_permutation(diffs(spark, sf), _PERMS, threshold=1.0)


_CUT = 0.2
_CLUSTERS = f""", t0 AS (SELECT perm, frame, count(*) AS n, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM flip GROUP BY ALL HAVING count(*) > 1 AND stddev_samp(diff) > 1e-12),
t1 AS (SELECT *, 2 * ({_sf('abs(t)', '(n - 1)')}) AS p FROM t0), i AS (SELECT *, sign(t) AS side, frame - row_number() OVER (PARTITION BY perm, sign(t) ORDER BY frame) AS island FROM t1 WHERE p < {_CUT}),
c AS (SELECT perm, min(frame) AS "start", max(frame) AS "end", count(*) AS length, CAST(side AS INTEGER) AS sign, sum(abs(t)) AS mass FROM i GROUP BY perm, side, island), x AS (SELECT perm, max(mass) AS top FROM c WHERE perm > 0 GROUP BY perm),
cl AS (SELECT CAST(row_number() OVER (ORDER BY "start") AS INTEGER) AS cluster_id, "start", "end", length, sign, mass, (1 + (SELECT count(*) FROM x WHERE top >= mass - 1e-9)) / CAST({_PERMS + 1} AS DOUBLE) AS p_cluster FROM c WHERE perm = 0)"""


@query(with_(*_D, _FLIP) + _CLUSTERS + f' SELECT cluster_id, "start", "end", length, sign, {R("mass", "mass")}, {R("p_cluster", "p_cluster")} FROM cl')
def h06_clusters(spark, sf):
    return H.cluster_test(diffs(spark, sf), _PERMS, alpha=_CUT)[0]


@query(with_(*_D, _FLIP) + _CLUSTERS + f' SELECT frame, {R("t", "statistic")}, {R("p", "p")}, coalesce(cluster_id, 0) AS cluster_id, {R("p_cluster", "p_cluster")} FROM t1 LEFT JOIN cl ON frame BETWEEN "start" AND "end" WHERE perm = 0')
def h06_cluster_times(spark, sf):
    return H.cluster_test(diffs(spark, sf), _PERMS, alpha=_CUT)[1]


@query()
def h06_wilcoxon_clusters(spark, sf):
    return H.cluster_test(diffs(spark, sf), _PERMS, alpha=_CUT, method="wilcoxon")[1]


@query()
def h13_sections(spark, sf):
    frames = X.frames(spark, sf)
    sweep = [50, 75, 100]
    return H.summary_rows(H.cluster_test(diffs(spark, sf), _PERMS, alpha=_CUT)[0], H.survival_sweep(frames, X.KEYS, sweep), H.hazard_sweep(frames, X.KEYS, sweep), _spline(spark, sf), alpha=0.5)


@query(
    with_(*_D, _MOM)
    + f""", e AS (SELECT *, (mean + 0.5 * sd) / (sd / sqrt(n)) AS tl, (0.5 * sd - mean) / (sd / sqrt(n)) AS th FROM mom WHERE n > 1 AND sd > 0), p AS (SELECT *, {_sf('tl', '(n - 1)')} AS pl, {_sf('th', '(n - 1)')} AS ph FROM e)
SELECT frame, n, {R('mean', 'mean')}, {R('0.5 * sd', 'margin')}, {R('pl', 'p_low')}, {R('ph', 'p_high')}, {R('greatest(pl, ph)', 'p')} FROM p"""
)
def h07_equivalence(spark, sf):
    return H.equivalence(diffs(spark, sf))


@query(
    with_(*_D)
    + f""", o AS (SELECT *, count(*) OVER (PARTITION BY frame) AS n, row_number() OVER (PARTITION BY frame ORDER BY diff, subject) AS r FROM diffs), k AS (SELECT *, floor(0.2 * n) AS g, r > floor(0.2 * n) AND r <= n - floor(0.2 * n) AS kept FROM o),
l AS (SELECT *, min(diff) FILTER (WHERE kept) OVER (PARTITION BY frame) AS lo, max(diff) FILTER (WHERE kept) OVER (PARTITION BY frame) AS hi FROM k),
s AS (SELECT frame, count(*) AS n, count(*) - 2 * max(g) AS h, avg(diff) FILTER (WHERE kept) AS m, var_samp(least(hi, greatest(lo, diff))) AS v FROM l GROUP BY frame), y AS (SELECT *, CASE WHEN h > 1 AND v > 0 THEN m / sqrt((n - 1) * v / (h * (h - 1))) END AS t FROM s)
SELECT frame, n, {R('m', 'trimmed_mean')}, {R('t', 't')}, {R('h - 1', 'df')}, {R('CASE WHEN t IS NOT NULL THEN ' + _t2('t', '(h - 1)') + ' END', 'p')} FROM y"""
)
def h08_yuen(spark, sf):
    return H.yuen(diffs(spark, sf))


def _logrank(by: str) -> str:
    over = f"(PARTITION BY {by} ORDER BY latency ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)" if by else "(ORDER BY latency ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    k = f"{by}, " if by else ""
    return f"""r0 AS (SELECT {k}latency, count(*) AS c, count(*) FILTER (WHERE grp = 'A') AS c1, count(*) FILTER (WHERE event) AS d, count(*) FILTER (WHERE event AND grp = 'A') AS d1 FROM lat GROUP BY ALL),
r1 AS (SELECT {k}d, d1, CAST(sum(c) OVER {over} AS DOUBLE) AS n, CAST(sum(c1) OVER {over} AS DOUBLE) AS n1 FROM r0),
lr AS (SELECT {k}sum(d1) AS o, sum(d * n1 / n) AS e, sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v FROM r1 WHERE d > 0{' GROUP BY ' + by if by else ''})"""


@query(with_(FRAMES, LATENCIES, _logrank("")) + f"SELECT {R('o', 'observed')}, {R('e', 'expected')}, {R('v', 'variance')}, {R('(o - e) ** 2 / v', 'chi2')}, {R('2 * (' + _nsf('sqrt((o - e) ** 2 / v)') + ')', 'p')} FROM lr")
def h09_log_rank(spark, sf):
    return H.log_rank(latencies(spark, sf))


@query()
def h10_cox(spark, sf):
    return H.cox_binary(latencies(spark, sf))


_LATS = "lat AS (SELECT threshold, subject, trial, CASE WHEN trial IN (2, 4, 5) THEN 'A' ELSE 'B' END AS grp, coalesce(hit, last) AS latency, coalesce(hit < last, false) AS event FROM (SELECT threshold, dataset, subject, trial, min(frame) FILTER (WHERE value >= threshold) AS hit, max(frame) AS last FROM frames, (SELECT unnest([50.0, 75.0, 100.0]) AS threshold) GROUP BY ALL))"
_KMS = KM.replace("grp", "threshold, grp")


@query(
    with_(FRAMES, _LATS, _logrank("threshold"), _KMS, 'md AS (SELECT threshold, grp, min("time") FILTER (WHERE survival <= 0.5) AS m FROM km GROUP BY threshold, grp)')
    + f"SELECT {R('threshold', 'threshold')}, {R('(o - e) ** 2 / v', 'chi2')}, {R('2 * (' + _nsf('sqrt((o - e) ** 2 / v)') + ')', 'p')}, max(m) FILTER (WHERE grp = 'A') AS median_a, max(m) FILTER (WHERE grp = 'B') AS median_b FROM lr JOIN md USING (threshold) GROUP BY threshold, o, e, v"
)
def h11_survival_sweep(spark, sf):
    return H.survival_sweep(X.frames(spark, sf), X.KEYS, [50, 75, 100])


@query()
def h11_hazard_ratios(spark, sf):
    return H.hazard_sweep(X.frames(spark, sf), X.KEYS, [50, 75, 100])


def _spline(spark, sf):
    """Of all frames; the longest trial gives the length."""
    frames = _grouped(spark, sf)
    return H.mixed_spline(frames, (frames.agg(F.max("frame")).first()[0] or 0) + 1)


@query()
def h12_mixed_spline(spark, sf):
    return _spline(spark, sf)


@query(
    with_(*_D)
    + f""", s AS (SELECT frame, avg(diff) AS effect, 1 / (1 + abs(avg(diff))) AS q FROM diffs GROUP BY frame), i AS (SELECT frame - row_number() OVER (ORDER BY frame) AS island FROM s WHERE q < 0.2)
SELECT 'paired' AS test, min(frame) FILTER (WHERE q < 0.2) AS onset, (SELECT count(DISTINCT island) FROM i) AS windows, count(*) FILTER (WHERE q < 0.2) AS significant, {R('avg(effect) FILTER (WHERE q < 0.2)', 'mean_effect')},
 CASE WHEN avg(effect) FILTER (WHERE q < 0.2) > 0 THEN 'A>B' WHEN avg(effect) FILTER (WHERE q < 0.2) < 0 THEN 'A<B' ELSE 'none' END AS direction FROM s"""
)
def h13_summary(spark, sf):
    s = diffs(spark, sf).groupBy("frame").agg(F.avg("diff").alias("effect"), (1 / (1 + F.abs(F.avg("diff")))).alias("q"))
    return H.summarize_timewise(s, "paired", 0.2)
