"""Structured Streaming over frames: aggregates, contiguity, labels, write-through, statistics, scoring."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.aggregate import STATS, aggregate_trials, responder_aggregates
from ..operators.store import scratch


def frame_stream(spark: SparkSession, path: str, files: int = 2) -> DataFrame:
    """A stream of the Parquet files at path, a few for each batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def trial_aggregates(stream: DataFrame, keys: Sequence[str], values: Sequence[str], stats: Sequence[str] = STATS) -> DataFrame:
    """aggregate_trials on a stream: first and last are the least and greatest frame's, so batches may come in any order."""
    return aggregate_trials(stream, keys, values, stats)


def trial_sums(stream: DataFrame, keys: Sequence[str], values: Sequence[str], time: str, window: str, late: str, frame: str) -> DataFrame:
    """Sums of each trial and event-time window from which merged_aggregates makes its figures; for update or append mode.

    The state of a window is dropped once the watermark, `late` behind the newest row, has
    passed its end, so that state is as large as what is still open; rows for a window that
    is gone are dropped. Figures of a window: count, and of each value its number, mean, sum
    of squared deviations, least, greatest, and its first and last by frame. A time without
    a zone counts as UTC.
    """
    if dict(stream.dtypes)[time] == "timestamp_ntz":
        stream = stream.withColumn(time, F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(time)).cast("timestamp"))
    figures = [F.count("*").alias("frame_count")]
    for v in values:
        there = F.when(F.col(v).isNotNull(), F.struct(F.col(frame).alias("at"), F.col(v).alias("v")))
        spread = (F.var_pop(v) * F.count(v)).alias(f"{v}_m2")
        figures += [F.count(v).alias(f"{v}_n"), F.avg(v).alias(f"{v}_mean"), spread, F.min(v).alias(f"{v}_min"), F.max(v).alias(f"{v}_max"), F.min(there).alias(f"{v}_first"), F.max(there).alias(f"{v}_last")]
    sums = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(*figures)
    return sums.select(F.col("window.start").alias("window_start"), *keys, *[c for c in sums.columns if c not in ("window", *keys)])


def merged_aggregates(sums: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(keys, frame_count, and of each value mean, sample deviation, min, max, sum, first and last) of trials over all their windows."""
    means = sums
    for v in values:  # the trial's mean, for the squares between windows
        means = means.withColumns({f"__{v}": F.try_divide(F.sum(F.col(f"{v}_mean") * F.col(f"{v}_n")).over(W.partitionBy(*keys)), F.sum(f"{v}_n").over(W.partitionBy(*keys)))})
    out = [F.sum("frame_count").alias("frame_count")]
    for v in values:
        n, far = F.sum(f"{v}_n"), F.col(f"{v}_mean") - F.col(f"__{v}")
        squares = F.sum(F.col(f"{v}_m2") + F.col(f"{v}_n") * far * far)
        out += [F.max(f"__{v}").alias(f"{v}_mean"), F.when(n > 1, F.sqrt(squares / (n - 1))).alias(f"{v}_std"), F.min(f"{v}_min").alias(f"{v}_min"), F.max(f"{v}_max").alias(f"{v}_max"), F.sum(F.col(f"{v}_mean") * F.col(f"{v}_n")).alias(f"{v}_sum"), F.min(f"{v}_first")["v"].alias(f"{v}_first"), F.max(f"{v}_last")["v"].alias(f"{v}_last")]
    return means.groupBy(*keys).agg(*out)


def run_updates(result: DataFrame, keys: Sequence[str], name: str) -> tuple[DataFrame, list[dict]]:
    """(the last row of every key, progress of every batch) of a stream in update mode that is processed to its end.

    A batch overwrites a folder of its own number, so that one that is run again leaves no
    second copy; of the rows of a key that of the latest batch counts.
    """
    spark = result.sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    put = lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")
    query = result.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    finish(query)
    rows = spark.read.option("basePath", out).schema(T.StructType([*result.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in result.columns if c not in keys]), "batch").alias("x"))
    return latest.select(*keys, "x.*").select(*result.columns), [dict(p) if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]


def windowed_counts(stream: DataFrame, time: str, kind: str, window: str, late: str) -> DataFrame:
    """(start, kind, n, total) by event-time window; rows later than the watermark are dropped.

    A time without a zone counts as UTC, whatever the session's zone, and start has none either.
    """
    plain = dict(stream.dtypes)[time] == "timestamp_ntz"
    here, utc = F.current_timezone(), F.lit("UTC")
    if plain:
        stream = stream.withColumn(time, F.convert_timezone(utc, here, F.col(time)).cast("timestamp"))
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    start = F.col("window.start")
    return counts.select((F.convert_timezone(here, utc, start.cast("timestamp_ntz")) if plain else start).alias("start"), kind, "n", "total")


def responders(stream: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    return responder_aggregates(stream, keys, **options)


def contiguity_breaks(stream: DataFrame, keys: Sequence[str], frame: str = "frame", time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, frame, previous) of frames that don't follow their trial's last one; one number a trial is kept.

    With an event-time column the state of a trial is dropped once the watermark, `late`
    behind the newest row, has passed the trial's last row. Without one it is kept: for
    streams that end.
    """
    types = dict(stream.dtypes)
    out = ", ".join(f"{k} {types[k]}" for k in keys) + f", {frame} long, previous long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, newest = state.get if state.exists else (None, 0)
        numbers = []
        for f in frames:
            numbers += f[frame].tolist()
            if time:
                newest = max(newest, int(f[time].max().timestamp() * 1000))
        rows = []
        for n in sorted(numbers):
            if last is not None and n - last != 1:
                rows.append((*key, n, last))
            last = n if last is None else max(last, n)
        state.update((last, newest))
        if time:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[*keys, frame, "previous"])

    timeout = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    source = stream.withWatermark(time, late) if time else stream
    return source.groupBy(*keys).applyInPandasWithState(step, out, "last long, newest long", "append", timeout)


def with_labels(stream: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames with their static labels; unlabelled ones are dropped."""
    return stream.join(labels, list(keys))


def run_to_end(result: DataFrame, mode: str, name: str) -> DataFrame:
    """All that is there processed, and the outcome as a table.

    append: rows as they come, in Parquet files with a checkpoint. complete: the last
    batch's whole result.
    """
    spark = result.sparkSession
    out, checkpoint = scratch(spark, name), scratch(spark, f"{name}-checkpoint")
    writer = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start()
    finish(query)
    return spark.read.schema(result.schema).parquet(out)


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


def batch_statistics(stream: DataFrame, keys: Sequence[str], frame: str, out: str) -> StreamingQuery:
    """Writes (batch, n_rows, n_blocks, frame_min, frame_max) of every batch to out, once each."""

    def note(df: DataFrame, batch: int) -> None:
        stats = df.agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_blocks"), F.min(frame).alias("frame_min"), F.max(frame).alias("frame_max"))
        stats.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    checkpoint = scratch(stream.sparkSession, "statistics-checkpoint")
    return stream.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score(stream: DataFrame, model: PipelineModel) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(stream).withColumn("prob", vector_to_array("probability")[1])
