"""Queries of the joins, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from . import fixtures as X
from .fixtures import FRAMES, LABELS, PREDICTIONS, with_
from .registry import R, query

_K = "dataset, subject, trial"


def _means(spark, sf):
    return X.frames(spark, sf).groupBy(*X.KEYS).agg(F.avg("value").alias("mean_value"), F.count("*").alias("n"))


_M = f"m AS (SELECT {_K}, avg(value) AS mean_value, count(*) AS n FROM frames GROUP BY ALL)"


@query(with_(FRAMES, LABELS, _M) + f"SELECT {_K}, {R('mean_value', 'mean_value')}, n, intensity FROM m JOIN labels5 USING ({_K})")
def j01_one_to_one(spark, sf):
    return J.join_one_to_one(_means(spark, sf), X.labels(spark, sf), X.KEYS)


@query(with_(FRAMES, LABELS) + f"SELECT {_K}, frame, intensity FROM frames JOIN labels5 USING ({_K}) WHERE intensity > 0")
def j02_frame_labels(spark, sf):
    return J.join_labels(X.frames(spark, sf), X.labels(spark, sf).filter("intensity > 0"), X.KEYS).select(*X.KEYS, "frame", "intensity")


@query(with_(FRAMES, LABELS) + f"SELECT {_K}, frame FROM frames SEMI JOIN (SELECT * FROM labels5 WHERE intensity >= 3) USING ({_K})")
def j03_labelled_only(spark, sf):
    return J.labelled_only(X.frames(spark, sf), X.labels(spark, sf).filter("intensity >= 3"), X.KEYS).select(*X.KEYS, "frame")


@query(
    with_(FRAMES, _M)
    + f""", a AS (SELECT {_K}, CASE WHEN trial % 2 = 0 THEN mean_value END AS mean_value FROM m),
b AS (SELECT {_K}, mean_value + CASE WHEN trial = 4 THEN 1 ELSE 0 END AS other FROM m WHERE trial < 6)
SELECT {_K}, {R('coalesce(mean_value, other)', 'mean_value')}, CAST(CASE WHEN mean_value IS NULL AND other IS NULL THEN 0 WHEN mean_value IS NULL OR other IS NULL THEN 1
  ELSE CAST(abs(mean_value - other) > 0.001 + 0.001 * abs(other) AS INTEGER) END AS INTEGER) AS mean_value_mismatch FROM a LEFT JOIN b USING ({_K})"""
)
def j04_merge_summary(spark, sf):
    m = _means(spark, sf).select(*X.KEYS, "mean_value")
    a = m.withColumn("mean_value", F.when(F.col("trial") % 2 == 0, F.col("mean_value")))
    b = m.filter("trial < 6").withColumn("mean_value", F.col("mean_value") + F.when(F.col("trial") == 4, 1).otherwise(0))
    return J.merge_summary(a, b, X.KEYS, ["mean_value"])


@query(
    with_(FRAMES, LABELS)
    + f", a AS (SELECT {_K} FROM labels5 WHERE intensity < 4), b AS (SELECT {_K} FROM labels5 WHERE intensity > 1) SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"
)
def j05_unmatched_keys(spark, sf):
    labels = X.labels(spark, sf)
    return J.unmatched_keys(labels.filter("intensity < 4"), labels.filter("intensity > 1"), X.KEYS)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j06_exclude_listed(spark, sf):
    bad = X.table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return X.table(spark, sf, "documents").select("doc_id", "n_chars").join(bad, "doc_id", "left_anti")


_REV = "old AS (SELECT doc_id, quality AS v FROM labels WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, toxic AS v FROM labels WHERE doc_id % 5 <> 0)"
_CMP = (
    "SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, o.v AS old, n.v AS new, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' "
    "WHEN o.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.doc_id = n.doc_id"
)


def revisions(spark, sf):
    labels = X.table(spark, sf, "labels")
    old = labels.filter("doc_id % 3 <> 0").select("doc_id", F.col("quality").alias("v"))
    return J.compare_labels(old, labels.filter("doc_id % 5 <> 0").select("doc_id", F.col("toxic").alias("v")), ["doc_id"], "v")


@query(with_(_REV) + _CMP)
def j07_compare_labels(spark, sf):
    return revisions(spark, sf)


@query(
    """WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE event_type = 'view')
SELECT user_id, event_id, round(value, 6) + 0.0 AS value FROM a JOIN b USING (user_id, n, c)"""
)
def j08_join_by_order(spark, sf):
    e = X.table(spark, sf, "events")
    clicks = e.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    views = e.filter("event_type = 'view'").select("user_id", "value", F.col("event_id").alias("view_id"))
    return J.join_by_order(clicks, views, ["user_id"], ["ts", "event_id"], ["view_id"]).select("user_id", "event_id", "value")


@query(
    with_(FRAMES, LABELS, _M)
    + f""", l AS (SELECT subject || '_testing_' || trial AS trial_id, intensity FROM labels5 WHERE trial < 5)
SELECT m.subject || '_testing_' || m.trial AS trial_id, n, intensity FROM m LEFT JOIN l ON l.trial_id = m.subject || '_testing_' || m.trial"""
)
def j09_join_by_template(spark, sf):
    trials = _means(spark, sf).select(F.format_string("%s_testing_%s", F.col("subject").cast("string"), F.col("trial").cast("string")).alias("trial_id"), "n")
    twice = X.labels(spark, sf).filter("trial < 5").drop("dataset")
    stale = twice.withColumn("intensity", F.lit(9))
    both = twice.withColumn("row", F.lit(2)).union(stale.withColumn("row", F.lit(1)))
    return J.join_by_template(trials, both, "%s_testing_%s", ["subject", "trial"], "trial_id", [F.desc("row")]).drop("row")


@query("SELECT vec_id, label, max(l_suppkey) AS cluster FROM embeddings JOIN lineitem ON vec_id = l_orderkey GROUP BY ALL")
def j10_rejoin_assignments(spark, sf):
    features = X.table(spark, sf, "embeddings").select("vec_id", "label")
    assigned = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("vec_id"), F.col("l_suppkey").alias("cluster"))
    return J.rejoin_assignments(features, assigned, "vec_id", [F.desc("cluster")])[0]


@query("SELECT DISTINCT l_orderkey AS vec_id FROM lineitem WHERE l_orderkey NOT IN (SELECT vec_id FROM embeddings)")
def j10_unmatched_assignments(spark, sf):
    features = X.table(spark, sf, "embeddings").select("vec_id", "label")
    assigned = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("vec_id"), F.col("l_suppkey").alias("cluster"))
    return J.rejoin_assignments(features, assigned, "vec_id", [F.desc("cluster")])[1].select("vec_id")


@query(with_(FRAMES, _M) + f"SELECT {_K}, frame, {R('value', 'value')}, {R('avg(value) OVER (PARTITION BY dataset, subject, trial)', 'mean_value')} FROM frames")
def j11_rejoin_aggregates(spark, sf):
    return X.frames(spark, sf).select(*X.KEYS, "frame", "value").join(_means(spark, sf).drop("n"), X.KEYS)


@query("SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' END AS label FROM orders")
def j12_map_scores(spark, sf):
    return J.map_scores(X.table(spark, sf, "orders"), "o_orderpriority", r"(\d+)", {"1": "urgent", "2": "high", "3": "medium"}).select("o_orderkey", "label")


@query(
    "WITH p AS (SELECT vec_id, embedding[1] AS x, embedding[2] AS y FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON a.vec_id <> b.vec_id "
    "AND (CAST(a.x AS DOUBLE) - b.x) ** 2 + (CAST(a.y AS DOUBLE) - b.y) ** 2 <= 0.0025"
)
def j13_range_pairs(spark, sf):
    points = X.traces(spark, sf).select("trial", F.col("trace")[0].alias("x"), F.col("trace")[1].alias("y"))
    return J.range_pairs(points, "trial", ["x", "y"], 0.05)


@query(with_(FRAMES) + f"SELECT {_K}, frame, CAST(row_number() OVER (ORDER BY {_K}, frame) AS BIGINT) AS place FROM frames QUALIFY place <= 1000")
def t01_sorted_head(spark, sf):
    """Rows in order of keys and frame; their place from a range-partitioned sort."""
    from ..operators.windows import global_rank

    return global_rank(X.frames(spark, sf).select(*X.KEYS, "frame"), [*X.KEYS, "frame"], "place").filter("place <= 1000")


@query(with_(FRAMES, _M) + f"SELECT {_K}, n FROM m ORDER BY {_K}")
def t02_sorted_trials(spark, sf):
    return _means(spark, sf).select(*X.KEYS, "n").orderBy(*X.KEYS)


@query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 10")
def t03_top_k(spark, sf):
    counts = X.table(spark, sf, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "user_id").limit(10)


@query(with_(FRAMES, _M) + f"SELECT {_K}, CAST(row_number() OVER (ORDER BY md5('67|' || dataset || '|' || subject || '|' || trial)) AS BIGINT) AS place FROM m")
def t04_seeded_shuffle(spark, sf):
    from ..operators.windows import seeded_order

    return seeded_order(_means(spark, sf).select(*X.KEYS), X.KEYS, 67)


@query("SELECT event_type, arg_max(user_id, m) AS best FROM (SELECT event_type, user_id, sum(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def t05_best_row(spark, sf):
    sums = X.table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("m"))
    return sums.groupBy("event_type").agg(F.max_by("user_id", "m").alias("best"))


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id DESC) = 1")
def t06_keep_best(spark, sf):
    e = X.table(spark, sf, "events")
    return J.keep_last(e, ["user_id", "event_type"], [F.desc("value"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, user_id, NULL::BIGINT AS extra FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, NULL, event_id * 2 FROM events WHERE event_type = 'view'")
def u01_union_by_name(spark, sf):
    e = X.table(spark, sf, "events")
    views = e.filter("event_type = 'view'").select("event_id", (F.col("event_id") * 2).alias("extra"))
    return e.filter("event_type = 'click'").select("event_id", "user_id").unionByName(views, allowMissingColumns=True)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 9 ELSE quality END AS quality FROM labels")
def u02_upsert(spark, sf):
    from ..operators.windows import upsert

    labels = X.table(spark, sf, "labels").select("doc_id", "quality")
    return upsert(labels, labels.filter("doc_id % 4 = 0").withColumn("quality", F.lit(9)), ["doc_id"])


@query("SELECT user_id FROM events WHERE event_type = 'click' AND value > 150 EXCEPT SELECT user_id FROM events WHERE event_type = 'view' AND value > 150")
def u03_key_difference(spark, sf):
    e = X.table(spark, sf, "events").filter("value > 150")
    return e.filter("event_type = 'click'").select("user_id").subtract(e.filter("event_type = 'view'").select("user_id"))


@query(with_(FRAMES, PREDICTIONS) + "SELECT subject FROM preds WHERE trial < 3 AND label = 1 INTERSECT SELECT subject FROM preds WHERE trial >= 3 AND label = 1")
def u04_shared_subjects(spark, sf):
    p = X.predictions(spark, sf).filter("label = 1")
    return p.filter("trial < 3").select("subject").intersect(p.filter("trial >= 3").select("subject"))


@query(with_(FRAMES) + f"SELECT DISTINCT {_K} FROM frames")
def u05_distinct_blocks(spark, sf):
    return X.frames(spark, sf).select(*X.KEYS).distinct()
