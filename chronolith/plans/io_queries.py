"""Queries of the sources, sinks and streams."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import frames as P
from ..operators.ml import estimator
from ..operators.store import scratch, written
from ..sources import io as S
from ..streaming import trials as ST
from . import fixtures as X
from .aggregate_queries import _FLAGS, RESPONDER
from .fixtures import FRAMES, LABELS, PREDICTIONS, TRACES, with_
from .registry import R, query

_K = "dataset, subject, trial"
_SUMS = f"SELECT trial, CAST(len(trace) AS BIGINT) AS n, {R('list_sum(trace)', 'total')} FROM traces"


def _sums(df, key: str = "trial"):
    return df.select(F.col(key).cast("long").alias("trial"), F.size("trace").cast("long").alias("n"), F.aggregate("trace", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query(f"SELECT event_id, user_id, {R('value', 'value')} FROM events")
def s01_csv_scan(spark, sf):
    e = X.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    path = S.write_table(e, scratch(spark, "frames-csv"), "csv")
    return S.read_frames(spark, path, "event_id bigint, user_id bigint, event_type string, value double", ["event_id", "user_id", "value"])


@query(f"SELECT event_id, {R('value', 'value')} FROM events WHERE value > 100")
def s02_parquet_scan(spark, sf):
    path = f"{sf}/events.parquet"
    return S.read_frames(spark, path, spark.read.parquet(path).schema, ["event_id", "value"], "parquet").filter("value > 100")


@query(with_(FRAMES) + f"SELECT {_K}, frame, {R('value', 'value')} FROM frames WHERE dataset = 'ds1'")
def s03_cache(spark, sf):
    path = scratch(spark, "frames-cache")
    S.cached(X.frames(spark, sf), path, ["dataset"])
    return S.cached(X.frames(spark, sf), path, ["dataset"]).filter("dataset = 'ds1'").select(*X.KEYS, "frame", "value")


def _wide(spark, sf, n: int = 64):
    return X.traces(spark, sf).select("trial", *[F.col("trace")[i].alias(f"dir_val_{i}") for i in range(n)])


@query(with_(TRACES) + _SUMS)
def s04_wide_trials(spark, sf):
    path = S.write_table(_wide(spark, sf), scratch(spark, "wide"), "csv")
    df = S.read_frames(spark, path, "trial bigint, " + ", ".join(f"dir_val_{i} double" for i in range(64)))
    return _sums(S.wide_trials(df, "dir_val_", {"trial": F.col("trial")}))


@query(with_(FRAMES) + f"SELECT subject AS trial, count(*) AS n, {R('sum(value)', 'total')}, any_value(dataset) AS dataset FROM frames GROUP BY subject")
def s05_stacked_trials(spark, sf):
    out = S.stacked_trials(X.frames(spark, sf), "subject", "event_id", "value", ["dataset", "trial"])
    return _sums(out, "subject").join(out.select(F.col("subject").alias("trial"), "dataset"), "trial")


@query(f"SELECT 'ds' || CAST(user_id % 3 AS VARCHAR) AS rig, count(*) AS n, {R('sum(value)', 'total')} FROM events GROUP BY rig")
def s06_manifest_folder(spark, sf):
    e = X.table(spark, sf, "events").select(F.concat(F.lit("ds"), (F.col("user_id") % 3).cast("string")).alias("rig"), "event_id", "value")
    folder = S.write_table(e, scratch(spark, "manifest"), "csv")
    rows = spark.read.schema("rig string, event_id bigint, value double").option("header", True).csv(folder)
    manifest = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).distinct().withColumn("listed", F.lit(True))
    return S.manifest_trials(spark, folder, "rig string, event_id bigint, value double", manifest).groupBy("rig").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(f"SELECT vec_id AS id, label, {R('embedding[1]', 'first')} FROM embeddings")
def s07_json_manifest(spark, sf):
    t = X.traces(spark, sf).select(F.struct(F.col("trial").alias("id"), F.col("cluster").alias("label"), F.col("trace")[0].alias("first")).alias("t"))
    listed = t.groupBy(F.expr("t.id div 100").alias("part")).agg(F.collect_list("t").alias("trials")).drop("part")
    path = S.write_table(listed.repartition(4), scratch(spark, "json"), "json")
    return spark.read.schema("trials array<struct<id:bigint,label:int,first:double>>").json(path).select(F.explode("trials").alias("t")).select("t.*")


@query(with_(TRACES) + _SUMS + " UNION ALL SELECT user_id, count(*), " + R("sum(value)") + " FROM events GROUP BY user_id")
def s08_load_trials(spark, sf):
    wide = _sums(S.load_trials(_wide(spark, sf), "dir_val_", "trial", "time", "v"))
    e = X.table(spark, sf, "events").select(F.col("user_id").alias("trial"), F.col("event_id").alias("time"), F.col("value").alias("v"))
    return wide.unionByName(_sums(S.load_trials(e, "dir_val_", "trial", "time", "v")))


@query(f"SELECT vec_id AS row, 's' || vec_id AS animal, label, {R('embedding[1]', 'first')} FROM embeddings")
def s09_matrix_metadata(spark, sf):
    e = X.table(spark, sf, "embeddings")
    entry = F.format_string('{"row_id": %s, "animal": "s%s", "label": %s}', F.col("vec_id").cast("string"), F.col("vec_id").cast("string"), F.col("label").cast("string"))
    texts = e.groupBy(F.expr("vec_id div 50").alias("part")).agg(F.concat(F.lit('{"rows": ['), F.array_join(F.collect_list(entry), ", "), F.lit("]}")).alias("meta"))
    meta = S.metadata_rows(texts, "meta", "row_id: bigint, animal: string, label: int").drop("row").withColumnRenamed("row_id", "row")
    matrix = X.traces(spark, sf).select(F.col("trial").alias("row"), F.col("trace")[0].alias("first"))
    return S.matrix_with_metadata(matrix, meta).select("row", "animal", "label", "first")


@query("SELECT CAST(vec_id % 3 AS INTEGER) AS layout, vec_id AS row_id, 's' || vec_id AS animal, label FROM embeddings")
def s09_metadata_layouts(spark, sf):
    """Metadata by row index, by column order, and as lists under rows."""
    e = X.table(spark, sf, "embeddings").select((F.col("vec_id") % 3).cast("int").alias("layout"), F.expr("vec_id div 90").alias("part"), F.col("vec_id").cast("string").alias("i"), F.col("label").cast("string").alias("of"))
    indexed = F.array_join(F.collect_list(F.format_string('"%s": {"row_id": %s, "animal": "s%s", "label": %s}', "i", "i", "i", "of")), ", ")
    listed = F.array_join(F.collect_list(F.format_string('["s%s", %s, %s]', "i", "of", "i")), ", ")
    texts = e.groupBy("layout", "part").agg(indexed.alias("x"), listed.alias("l"))
    names = '["animal", "label", "row_id"]'
    meta = (
        F.concat(F.lit('{"row_index_to_meta": {'), "x", F.lit("}}")),
        F.concat(F.lit(f'{{"column_order": {names}, "data": ['), "l", F.lit("]}")),
        F.concat(F.lit(f'{{"columns": {names}, "rows": ['), "l", F.lit("]}")),
    )
    texts = texts.select("layout", F.when(F.col("layout") == 0, meta[0]).when(F.col("layout") == 1, meta[1]).otherwise(meta[2]).alias("meta"))
    parts = [S.metadata_rows(texts.filter(F.col("layout") == n), "meta", "row_id: bigint, animal: string, label: int").drop("row").withColumn("layout", F.lit(n)) for n in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("layout", "row_id", "animal", "label")


@query(with_(TRACES) + f"SELECT trial, CAST(i AS INTEGER) AS t, {R('trace[i + 1]', 'c0')}, {R('trace[i + 33]', 'c1')} FROM traces, range(0, 32) r(i)")
def s10_matrix_channels(spark, sf):
    t = X.traces(spark, sf).select("trial", S.channels(F.array(F.slice("trace", 1, 32), F.slice("trace", 33, 32)), "trial_channel_time").alias("m"))
    return t.select("trial", F.posexplode("m").alias("t", "c")).select("trial", "t", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"))


@query("SELECT doc_id, CASE quality WHEN 0 THEN 'low' ELSE 'high' END AS quality, CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE toxic END AS INTEGER) AS trial_num FROM labels")
def s11_decode_columns(spark, sf):
    d = X.table(spark, sf, "labels").select("doc_id", "quality", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("trial_num"), F.concat(F.lit("testing_"), F.col("toxic").cast("string")).alias("trial_label"))
    return S.decode_columns(d, {"quality": {"0": "low", "1": "high"}}).drop("trial_label")


@query("SELECT 'doc' AS kind, doc_id, quality FROM labels")
def s12_read_labels(spark, sf):
    d = X.table(spark, sf, "labels").select(F.lit(" doc ").alias("kind"), "doc_id", F.concat(F.col("quality").cast("string"), F.lit(".0")).alias("quality"))
    return S.read_labels(d, ["kind"], ["doc_id"], "quality")


@query(f"SELECT o_orderkey, {R('o_totalprice', 'o_totalprice')}, CAST(NULL AS DOUBLE) AS o_orderpriority FROM orders")
def s13_read_summary(spark, sf):
    return S.read_summary(X.table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("string"), "o_orderpriority"), ["o_orderkey"])


_MEAN = f"SELECT {_K}, count(*) AS n, {R('avg(value)', 'm')} FROM frames GROUP BY ALL"


def _means(spark, sf):
    return X.frames(spark, sf).groupBy(*X.KEYS).agg(F.count("*").alias("n"), F.avg("value").alias("m"))


@query(with_(FRAMES) + _MEAN)
def s14_parquet_sink(spark, sf):
    return spark.read.parquet(S.write_table(_means(spark, sf), scratch(spark, "merged"))).select(*X.KEYS, "n", "m")


@query(with_(FRAMES) + _MEAN)
def s15_csv_sink(spark, sf):
    path = S.write_table(_means(spark, sf), scratch(spark, "aggregates"), "csv")
    return S.read_frames(spark, path, "dataset string, subject bigint, trial int, n bigint, m double")


@query(with_(FRAMES) + _MEAN)
def s16_ordered_sink(spark, sf):
    return spark.read.parquet(S.write_table(_means(spark, sf), scratch(spark, "ordered"), columns=["n", "m", *X.KEYS]))


@query(f"SELECT event_type, count(*) AS n, {R('avg(value)', 'mean')} FROM events GROUP BY event_type")
def s17_json_sink(spark, sf):
    m = X.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return spark.read.schema("event_type string, n bigint, mean double").json(S.write_table(m, scratch(spark, "metrics"), "json"))


@query(with_(FRAMES, PREDICTIONS) + f"SELECT {_K}, split, {R('prob', 'prob')} FROM preds WHERE split = 'test'")
def s18_prediction_sink(spark, sf):
    p = X.predictions(spark, sf).withColumn("model", F.lit("fixed"))
    path = S.write_table(p, scratch(spark, "predictions"), partition_by=["model", "split"])
    return spark.read.parquet(path).filter("split = 'test' and model = 'fixed'").select(*X.KEYS, "split", "prob")


@query("SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY label")
def s19_cluster_sink(spark, sf):
    c = X.table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return spark.read.parquet(S.write_table(c, scratch(spark, "clusters"), partition_by=["cluster"])).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def s20_fingerprints(spark, sf):
    return S.fingerprints(spark, f"{sf}/events.parquet")


def _streamed(spark, sf, df=None):
    """Frames as a stream of files; all of a trial are in one file."""
    f = X.frames(spark, sf) if df is None else df
    path = scratch(spark, "frames")
    f.repartition(6, *X.KEYS).sortWithinPartitions(*X.KEYS, "frame").write.parquet(path)
    return ST.frame_stream(spark, path)


@query(
    with_(FRAMES)
    + f"""SELECT {_K}, count(*) AS frame_count, min(frame) AS frame_start, max(frame) AS frame_end, {R('avg(value)', 'value_mean')}, {R('stddev_samp(value)', 'value_std')},
  {R('min(value)', 'value_min')}, {R('max(value)', 'value_max')}, {R('sum(value)', 'value_sum')}, {R('arg_min(value, frame)', 'value_first')}, {R('arg_max(value, frame)', 'value_last')} FROM frames GROUP BY ALL"""
)
def st1_trial_aggregates(spark, sf):
    return ST.run_to_end(ST.trial_aggregates(_streamed(spark, sf), X.KEYS, ["value"]), "complete", "aggregates")


def _by_days(spark, sf):
    """A stream of events in files that follow each other in time, one a batch."""
    path = scratch(spark, "days")
    events = X.table(spark, sf, "events")
    for low, high in ((1, 8), (8, 15), (15, 22), (22, 32)):
        events.filter((F.day("ts") >= low) & (F.day("ts") < high)).coalesce(1).write.mode("append").parquet(path)
    return ST.frame_stream(spark, path, 1)


@query(
    f"""SELECT user_id, event_type, count(*) AS frame_count, {R('avg(value)', 'value_mean')}, {R('stddev_samp(value)', 'value_std')}, {R('min(value)', 'value_min')}, {R('max(value)', 'value_max')}, {R('sum(value)', 'value_sum')},
 {R('arg_min(value, event_id)', 'value_first')}, {R('arg_max(value, event_id)', 'value_last')} FROM events GROUP BY user_id, event_type"""
)
def st1_windowed_aggregates(spark, sf):
    """State ends with each day's window; a day's late rows may come for two days."""
    sums = ST.trial_sums(_by_days(spark, sf), ["user_id", "event_type"], ["value"], "ts", "1 day", "2 days", "event_id")
    rows, _ = ST.run_updates(sums, ["window_start", "user_id", "event_type"], "sums")
    return ST.merged_aggregates(rows, ["user_id", "event_type"], ["value"])


@query(with_(FRAMES, _FLAGS) + RESPONDER)
def st2_responders(spark, sf):
    return ST.run_to_end(ST.responders(P.epoch_flags(_streamed(spark, sf)), X.KEYS, fps=X.FPS), "complete", "responders")


@query(with_(FRAMES) + f", x AS (SELECT {_K}, frame, lag(frame) OVER (PARTITION BY {_K} ORDER BY frame) AS previous FROM frames WHERE event_id % 11 <> 0) SELECT {_K}, CAST(frame AS BIGINT) AS frame, CAST(previous AS BIGINT) AS previous FROM x WHERE frame - previous <> 1")
def st3_contiguity(spark, sf):
    f = X.frames(spark, sf).filter("event_id % 11 <> 0")
    return ST.run_to_end(ST.contiguity_breaks(_streamed(spark, sf, f), X.KEYS), "append", "breaks")


@query(with_(FRAMES, LABELS) + f"SELECT {_K}, frame, intensity FROM frames JOIN labels5 USING ({_K}) WHERE intensity > 1")
def st4_labels(spark, sf):
    labels = written(X.labels(spark, sf).filter("intensity > 1"), "labels")
    return ST.run_to_end(ST.with_labels(_streamed(spark, sf), labels, X.KEYS).select(*X.KEYS, "frame", "intensity"), "append", "labelled")


@query(with_(FRAMES) + f"SELECT {_K}, frame, {R('value', 'value')} FROM frames")
def st5_write_through(spark, sf):
    return ST.run_to_end(_streamed(spark, sf).select(*X.KEYS, "frame", "value"), "append", "through")


@query(with_(FRAMES) + f"SELECT count(*) AS n_rows, count(DISTINCT ({_K})) AS n_blocks, min(frame) AS frame_min, max(frame) AS frame_max FROM frames")
def st6_batch_statistics(spark, sf):
    out = scratch(spark, "statistics")
    ST.finish(ST.batch_statistics(_streamed(spark, sf), X.KEYS, "frame", out))
    return spark.read.parquet(f"{out}/*").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_blocks").alias("n_blocks"), F.min("frame_min").alias("frame_min"), F.max("frame_max").alias("frame_max"))


@query()
def st7_scoring(spark, sf):
    t = _means(spark, sf).join(X.predictions(spark, sf).select(*X.KEYS, F.col("label").cast("double").alias("label")), X.KEYS)
    path = scratch(spark, "trials")
    t.repartition(4).write.parquet(path)
    model = Pipeline(stages=[VectorAssembler(inputCols=["n", "m"], outputCol="features"), estimator("logreg")]).fit(spark.read.parquet(path))
    scored = ST.score(ST.frame_stream(spark, path), model)
    return ST.run_to_end(scored.select(*X.KEYS, "prob", F.col("prediction").cast("int").alias("predicted")), "append", "scored")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS \"start\", event_type, count(*) AS n, " + R("sum(value)", "total") + " FROM events GROUP BY ALL")
def st8_windowed_counts(spark, sf):
    """Every event falls before the watermark's end, so that the last batch has all windows."""
    path = scratch(spark, "events")
    X.table(spark, sf, "events").repartitionByRange(4, "ts").write.parquet(path)
    w = ST.windowed_counts(ST.frame_stream(spark, path, 4), "ts", "event_type", "1 day", "40 days")
    return ST.run_to_end(w, "complete", "windows")
