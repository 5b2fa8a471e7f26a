"""Queries of the projections, filters and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as P
from . import fixtures as X
from .fixtures import FRAMES, LABELS, TRACES, with_
from .registry import R, query

_K = "dataset, subject, trial"


@query("SELECT event_id, trim(event_type) AS event_type, CASE WHEN user_id % 5 = 0 THEN NULL ELSE user_id END AS subject FROM events")
def p01_normalize_keys(spark, sf):
    e = X.table(spark, sf, "events")
    padded = e.select("event_id", F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("event_type"), F.when(F.col("user_id") % 5 == 0, "nan").otherwise(F.concat("user_id", F.lit(".0"))).alias("subject"))
    padded = padded.withColumn("subject", F.when(F.col("subject") != "nan", F.col("subject")))
    return P.normalize_keys(padded, ["event_type"], ["subject"])


@query("SELECT user_id AS subject, event_type AS kind, event_id FROM events")
def p02_rename(spark, sf):
    return P.rename(X.table(spark, sf, "events").select("user_id", "event_type", "event_id"), {"user_id": "subject"}, {"event_type": "kind", "absent": "x"})


@query("SELECT user_id AS animal, CAST(NULL AS VARCHAR) AS rig, event_id FROM events")
def p03_legacy_identifier(spark, sf):
    df = P.legacy_identifier(X.table(spark, sf, "events").select("user_id", "event_id"), "animal", "user_id")
    return P.legacy_identifier(df, "rig", "old_rig")


@query(with_(FRAMES) + f"SELECT {_K}, frame, value, event_id FROM frames")
def p04_order_columns(spark, sf):
    return P.order_columns(X.frames(spark, sf).select("value", "frame", "event_id", *X.KEYS), [*X.KEYS, "frame"], ["event_id"])


@query(
    with_(FRAMES) + f"SELECT {_K}, frame, CAST(frame < on_idx AS INTEGER) AS is_before, CAST(frame BETWEEN on_idx AND off_idx AS INTEGER) AS is_during, CAST(frame > off_idx AS INTEGER) AS is_after FROM frames"
)
def p05_epoch_flags(spark, sf):
    return P.epoch_flags(X.frames(spark, sf)).select(*X.KEYS, "frame", "is_before", "is_during", "is_after")


@query(with_(FRAMES) + f"SELECT {_K}, frame FROM frames WHERE dataset IN ('ds0', 'ds2')")
def p06_select_datasets(spark, sf):
    return P.select_values(X.frames(spark, sf), "dataset", ["ds0", "ds2"]).select(*X.KEYS, "frame")


@query(with_(FRAMES) + f"SELECT {_K}, frame FROM frames WHERE event_type = 'purchase' AND dataset IN ('ds1')")
def p07_trial_type(spark, sf):
    f = X.frames(spark, sf).withColumn("trial_type", F.concat(F.lit(" "), F.upper("event_type")))
    return P.trial_type_is(f, "Purchase", datasets=["ds1"]).select(*X.KEYS, "frame")


@query(with_(FRAMES) + f"SELECT {_K}, frame, event_id FROM frames WHERE subject = 1 AND trial = 1 AND frame = 0")
def p08_select_one(spark, sf):
    return P.select_one(X.frames(spark, sf), {"subject": 1, "trial": 1, "frame": 0}).select(*X.KEYS, "frame", "event_id")


@query(with_(FRAMES) + f"SELECT {_K}, frame - 1 AS frame, event_id FROM frames WHERE frame >= 1 AND frame < 7")
def p09_truncate_around(spark, sf):
    return P.truncate_around(X.frames(spark, sf), 1, 2).select(*X.KEYS, "frame", "event_id")


@query(with_(FRAMES) + f"SELECT {_K}, frame, {R('(frame - 2) / 2.0', 'rel_time')} FROM frames WHERE frame >= 0 AND frame < 6")
def p10_aligned_window(spark, sf):
    return P.aligned_window(X.frames(spark, sf), 1.0, 2.0, X.FPS).select(*X.KEYS, "frame", "rel_time")


@query(with_(TRACES) + f"SELECT trial, CAST(len(trace[1:40]) AS BIGINT) AS n, {R('list_sum(trace[1:40])', 'total')} FROM traces")
def p11_cap_trace(spark, sf):
    t = X.traces(spark, sf).withColumn("trace", P.cap_trace(F.col("trace"), 40))
    return t.select("trial", F.size("trace").cast("long").alias("n"), F.aggregate("trace", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(with_(FRAMES) + f"SELECT {_K}, frame, {R('value', 'value')}, {R('eye_x', 'eye_x')} FROM frames")
def p12_select_features(spark, sf):
    return P.select_features(X.frames(spark, sf), ["eye_x", "value"], [*X.KEYS, "frame"])


@query("SELECT unnest(['l_discount', 'l_extendedprice', 'l_quantity', 'l_tax']) AS feature, (SELECT count(*) FROM lineitem) AS n")
def p13_numeric_columns(spark, sf):
    df = X.table(spark, sf, "lineitem")
    wanted = [c for c in P.numeric_columns(df.drop("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))]
    counts = df.agg(*[F.count("*").alias(c) for c in wanted])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in wanted])).alias("x")).select("x.*")


@query(f"SELECT vec_id AS trial, {R('embedding[1]', 'pc1')}, {R('embedding[2]', 'pc2')}, {R('embedding[10]', 'pc10')} FROM embeddings")
def p14_component_columns(spark, sf):
    t = X.traces(spark, sf).select("trial", F.col("trace")[9].alias("pc10"), F.col("trace")[1].alias("pc2"), F.col("trace")[0].alias("pc1"))
    return t.select("trial", *P.component_columns(t))


@query(f"SELECT l_orderkey, l_linenumber, {R('l_quantity', 'l_quantity')} FROM lineitem")
def p15_low_variance(spark, sf):
    df = X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(1.0).alias("flat"))
    return P.drop_low_variance(df, ["l_quantity", "l_tax", "flat"], 0.01)


@query(with_(FRAMES) + f"SELECT {_K}, frame FROM frames WHERE subject NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING avg(value) <= 50)")
def p16_exclude_flagged(spark, sf):
    flags = X.table(spark, sf, "events").groupBy(F.col("user_id").alias("subject")).agg((F.avg("value") - 50).alias("score"))
    return P.exclude_flagged(X.frames(spark, sf), flags, ["subject"], "score").select(*X.KEYS, "frame")


@query("SELECT event_id, event_type FROM events WHERE regexp_matches(event_type, 'i') AND NOT regexp_matches(event_type, '^v')")
def p17_label_matches(spark, sf):
    return P.label_matches(X.table(spark, sf, "events"), "event_type", "i", "^v").select("event_id", "event_type")


@query(with_(TRACES) + "SELECT trial, CAST(60 AS BIGINT) AS n FROM traces")
def p18_trim_tail(spark, sf):
    t = X.traces(spark, sf).withColumn("trace", F.concat(F.slice("trace", 1, 59), F.array(F.lit(1.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(float("nan")))))
    return t.select("trial", F.size(P.trim_tail(F.col("trace"))).cast("long").alias("n"))


@query(with_(FRAMES) + f"SELECT {_K}, frame, {R('sqrt((prob_x - eye_x) ** 2 + (prob_y - eye_y) ** 2)', 'dir_val')} FROM frames")
def p19_direction_magnitude(spark, sf):
    return P.direction_magnitude(X.frames(spark, sf)).select(*X.KEYS, "frame", "dir_val")


@query(with_(FRAMES, LABELS) + f"SELECT {_K}, CAST(intensity = 0 AS INTEGER) AS non_reactive FROM labels5")
def p20_non_reactive(spark, sf):
    return X.labels(spark, sf).select(*X.KEYS, P.non_reactive(F.col("intensity")).alias("non_reactive"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'first' WHEN o_orderpriority LIKE '%SPECIFIED' THEN 'none' ELSE trim(o_orderpriority) END AS priority FROM orders")
def p21_canonical_dataset(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", P.canonical_dataset(F.col("o_orderpriority"), [("1 urgent", "first"), ("specified not", "none")]).alias("priority"))


@query(f"SELECT event_id, {R('value', 'signal')} FROM events")
def p22_choose_signal(spark, sf):
    e = X.table(spark, sf, "events")
    return e.select("event_id", F.col(P.choose_signal(e, ["envelope", "value", "event_id"])).alias("signal"))


@query(with_(FRAMES) + f"SELECT {_K}, frame, {R('CASE WHEN event_id % 2 = 0 THEN event_id / 10.0 ELSE frame / 2.0 END', 'time_s')} FROM frames")
def p23_time_axis(spark, sf):
    f = X.frames(spark, sf).withColumn("time", F.when(F.col("event_id") % 2 == 0, F.col("event_id") / 10.0))
    return P.time_axis(f, X.FPS).select(*X.KEYS, "frame", "time_s")


@query(
    with_(FRAMES)
    + """, t AS (SELECT dataset, subject, trial, count(*) AS n, 4 - trial AS fps FROM frames GROUP BY ALL)
SELECT dataset, subject, trial, 'fps must be positive' AS reason FROM t WHERE fps <= 0
UNION ALL SELECT dataset, subject, trial, 'stimulus starts outside the trial' FROM t WHERE n <= 2
UNION ALL SELECT dataset, subject, trial, 'stimulus ends after the trial' FROM t WHERE n < 5"""
)
def p24_trial_violations(spark, sf):
    t = X.frames(spark, sf).groupBy(*X.KEYS).agg(F.count("*").alias("n"))
    t = t.withColumns({"fps": 4 - F.col("trial"), "on_idx": F.lit(X.ON), "off_idx": F.lit(X.OFF), "steps_down": F.lit(0)})
    return P.trial_violations(t).select(*X.KEYS, "reason")
