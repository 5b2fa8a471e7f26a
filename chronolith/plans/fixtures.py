"""Trial recordings derived from the given tables: frames, labels, predictions, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["dataset", "subject", "trial"]
ON, OFF, FPS = 2, 5, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per frame of a trial: a user's events of five days."""
    e = table(spark, sf_dir, "events")
    block = F.floor((F.day("ts") - 1) / 5.0).cast("int")
    number = F.row_number().over(W.partitionBy("user_id", block).orderBy("ts", "event_id")) - 1
    return e.select(
        F.concat(F.lit("ds"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
        F.col("user_id").alias("subject"),
        (block + 1).alias("trial"),
        number.alias("frame"),
        "value",
        "event_type",
        "event_id",
        (F.col("event_id") % 13).cast("double").alias("eye_x"),
        (F.col("event_id") % 7).cast("double").alias("eye_y"),
        (F.col("event_id") % 17).cast("double").alias("prob_x"),
        (F.col("event_id") % 11).cast("double").alias("prob_y"),
        F.lit(ON).alias("on_idx"),
        F.lit(OFF).alias("off_idx"),
    )


FRAMES = f"""frames AS (SELECT 'ds' || CAST(user_id % 3 AS VARCHAR) AS dataset, user_id AS subject, CAST(floor((day(ts) - 1) / 5.0) AS INTEGER) + 1 AS trial,
  CAST(row_number() OVER (PARTITION BY user_id, CAST(floor((day(ts) - 1) / 5.0) AS INTEGER) ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, value, event_type, event_id,
  CAST(event_id % 13 AS DOUBLE) AS eye_x, CAST(event_id % 7 AS DOUBLE) AS eye_y, CAST(event_id % 17 AS DOUBLE) AS prob_x, CAST(event_id % 11 AS DOUBLE) AS prob_y,
  {ON} AS on_idx, {OFF} AS off_idx FROM events)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensity 0-5 of each trial: its purchases, at most five."""
    return frames(spark, sf_dir).groupBy(*KEYS).agg(F.least(F.lit(5), F.count_if(F.col("event_type") == "purchase")).cast("int").alias("intensity"))


LABELS = "labels5 AS (SELECT dataset, subject, trial, CAST(least(5, count(*) FILTER (WHERE event_type = 'purchase')) AS INTEGER) AS intensity FROM frames GROUP BY ALL)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored row per trial: label, probability from the mean value, decision, weight, split."""
    mean = frames(spark, sf_dir).groupBy(*KEYS).agg(F.avg("value").alias("m"), F.least(F.lit(5), F.count_if(F.col("event_type") == "purchase")).cast("int").alias("intensity"))
    p = F.round(1 / (1 + F.exp(-(F.col("m") - 50) / 20)), 9)
    return mean.select(
        *KEYS,
        "intensity",
        (F.col("intensity") > 1).cast("int").alias("label"),
        p.alias("prob"),
        (p >= 0.5).cast("int").alias("predicted"),
        F.greatest(F.lit(1), "intensity").cast("double").alias("weight"),
        F.when(F.col("subject") % 4 == 0, "test").when(F.col("subject") % 4 == 1, "validation").otherwise("train").alias("split"),
    )


PREDICTIONS = """means AS (SELECT dataset, subject, trial, avg(value) AS m, CAST(least(5, count(*) FILTER (WHERE event_type = 'purchase')) AS INTEGER) AS intensity FROM frames GROUP BY ALL),
scored AS (SELECT *, round(1 / (1 + exp(-(m - 50) / 20)), 9) AS prob FROM means),
preds AS (SELECT dataset, subject, trial, intensity, CAST(intensity > 1 AS INTEGER) AS label, prob, CAST(prob >= 0.5 AS INTEGER) AS predicted, CAST(greatest(1, intensity) AS DOUBLE) AS weight,
  CASE WHEN subject % 4 = 0 THEN 'test' WHEN subject % 4 = 1 THEN 'validation' ELSE 'train' END AS split FROM scored)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, cluster, trace): a trace of 64 samples as an array."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("trial"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("trace"))


TRACES = "traces AS (SELECT vec_id AS trial, label AS cluster, CAST(embedding AS DOUBLE[]) AS trace FROM embeddings)"
#: One row per sample of a trace, t from 0.
SAMPLES = TRACES + ", samples AS (SELECT trial, cluster, generate_subscripts(trace, 1) - 1 AS t, unnest(trace) AS v FROM traces)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces(spark, sf_dir).select("trial", "cluster", F.posexplode("trace").alias("t", "v"))


def with_(*views: str) -> str:
    return "WITH " + ", ".join(views) + " "
