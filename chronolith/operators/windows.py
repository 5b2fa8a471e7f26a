"""Window operators: contiguity, smoothing, crossings, runs, areas, ranks and survival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def global_rank(df: DataFrame, order: Sequence[str | Column], out: str = "rank") -> DataFrame:
    """1, 2, ... over the whole table in order, without one task for all rows.

    Rows are range-partitioned and sorted, counted by partition, and numbered within
    it; only the counts (one per partition) meet in one task.
    """
    from .store import written

    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    part = written(part, "ranked")
    within = part.withColumn("__n", F.row_number().over(W.partitionBy("__part").orderBy(*order)))
    sizes = part.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", F.coalesce(F.sum("__size").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return within.join(F.broadcast(before), "__part").withColumn(out, (F.col("__n") + F.col("__before")).cast("long")).drop("__part", "__n", "__before")


def running_sums(df: DataFrame, order: str, columns: Sequence[str], descending: bool = False) -> DataFrame:
    """df with the sums of columns up to each row, `<column>_sum`, in order, without one task for all rows; as global_rank."""
    from .store import written

    by = F.desc(order) if descending else F.asc(order)
    part = written(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__part", F.spark_partition_id()), "ordered")
    within = W.partitionBy("__part").orderBy(by).rowsBetween(W.unboundedPreceding, 0)
    sizes = part.groupBy("__part").agg(*[F.sum(c).alias(c) for c in columns])
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("__part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"__{c}") for c in columns])
    summed = part.withColumns({f"{c}_sum": F.sum(c).over(within) for c in columns}).join(F.broadcast(before), "__part")
    return summed.withColumns({f"{c}_sum": F.col(f"{c}_sum") + F.col(f"__{c}") for c in columns}).drop("__part", *[f"__{c}" for c in columns])


def seeded_order(df: DataFrame, keys: Sequence[str], seed: int, out: str = "place") -> DataFrame:
    """Rows in an order that the seed and the keys decide, with their place."""
    mixed = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))
    return global_rank(df.withColumn("__order", mixed), ["__order"], out).drop("__order")


def upsert(df: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new in the place of df's rows of the same keys, and added."""
    return df.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new.select(*df.columns))


def contiguity_breaks(frames: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """(keys, frame, previous) where a frame isn't one more than the one before it, or is null."""
    previous = F.lag(frame).over(W.partitionBy(*keys).orderBy(frame))
    return frames.select(*keys, F.col(frame), previous.alias("previous")).filter(F.col(frame).isNull() | (F.col(frame) - F.col("previous") != 1))


def rolling_mean(c: str, keys: Sequence[str], order: str, window: int) -> Column:
    """Centred mean of `window` rows, fewer at the ends; an even window looks further back."""
    return F.avg(c).over(W.partitionBy(*keys).orderBy(order).rowsBetween(-(window // 2), (window - 1) // 2))


def velocity(c: str, keys: Sequence[str], order: str, dt: float) -> Column:
    """Central difference, one-sided at the ends."""
    w = W.partitionBy(*keys).orderBy(order)
    ahead, back, here = F.lead(c).over(w), F.lag(c).over(w), F.col(c)
    return F.coalesce((ahead - back) / (2 * dt), (ahead - here) / dt, (here - back) / dt)


def with_previous(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(time)
    return df.withColumns({"prev_t": F.lag(time).over(w), "prev_v": F.lag(value).over(w)})


def first_crossing(time: str, value: str, threshold: Column, among: Column | None = None) -> Column:
    """Aggregate over rows with prev_t, prev_v: first time at or above threshold, linearly interpolated."""
    t, v, pt, pv = F.col(time), F.col(value), F.col("prev_t"), F.col("prev_v")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (threshold - pv) / (v - pv)))
    at = F.when(pv.isNull() | (pv == v), t.cast("double")).otherwise(pt + share * (t - pt))
    reached = v >= threshold if among is None else among & (v >= threshold)
    return F.min_by(F.when(reached, at), F.when(reached, t))


def crossings(df: DataFrame, keys: Sequence[str], time: str, value: str, threshold: float) -> DataFrame:
    return with_previous(df, keys, time, value).groupBy(*keys).agg(first_crossing(time, value, F.lit(threshold)).alias("crossing"))


def latency(df: DataFrame, keys: Sequence[str], time: str, value: str, threshold: float) -> DataFrame:
    """(keys, latency, event): first time at threshold, else the last time, censored; so is a crossing on the last sample."""
    hit = F.min(F.when(F.col(value) >= threshold, F.col(time)))
    out = df.groupBy(*keys).agg(hit.alias("hit"), F.max(time).alias("last"))
    return out.select(*keys, F.coalesce("hit", "last").alias("latency"), F.coalesce(F.col("hit") < F.col("last"), F.lit(False)).alias("event"))


def runs(df: DataFrame, keys: Sequence[str], index: str, true: Column) -> DataFrame:
    """(keys, start, end, length) of the runs of consecutive indexes where `true` holds."""
    hit = df.filter(true)
    island = F.col(index) - F.row_number().over(W.partitionBy(*keys).orderBy(index))
    found = hit.withColumn("__island", island).groupBy(*keys, "__island")
    return found.agg(F.min(index).alias("start"), F.max(index).alias("end"), F.count("*").alias("length")).drop("__island")


def excursions(df: DataFrame, keys: Sequence[str], index: str, value: str, threshold: float, dt: float) -> DataFrame:
    """(keys, count, interval_mean, interval_std) of the runs at or above threshold, onset to onset."""
    islands = runs(df, keys, index, F.col(value) >= threshold)
    gap = (F.col("start") - F.lag("start").over(W.partitionBy(*keys).orderBy("start"))) * dt
    return islands.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").alias("count"), F.avg("gap").alias("interval_mean"), F.stddev_pop("gap").alias("interval_std"))


def trapezoid(time: str, value: str) -> Column:
    """Aggregate over rows with prev_t, prev_v: area by the trapezoid rule."""
    return F.sum((F.col(time) - F.col("prev_t")) * (F.col(value) + F.col("prev_v")) / 2)


def areas(df: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    return with_previous(df, keys, time, value).groupBy(*keys).agg(trapezoid(time, value).alias("area"))


def rise_and_decay(df: DataFrame, keys: Sequence[str], time: str, value: str, baseline: float) -> DataFrame:
    """(keys, peak, peak_time, rise_time, half_life): 10-90 % rise, and time from peak to half of it."""
    w = W.partitionBy(*keys)
    first_peak = F.struct((-F.col(value)).alias("v"), F.col(time).alias("t"))
    p = with_previous(df, keys, time, value).withColumns({"__peak": F.max(value).over(w), "__at": F.min(first_peak).over(w)["t"]})
    rise = F.col("__peak") - baseline
    at = lambda share: first_crossing(time, value, F.lit(baseline) + share * rise)
    falls = (F.col(time) >= F.col("__at")) & (F.col(value) <= baseline + 0.5 * rise)
    out = p.groupBy(*keys).agg(F.max("__peak").alias("peak"), F.max("__at").alias("peak_time"), at(0.1).alias("lo"), at(0.9).alias("hi"), F.min(F.when(falls, F.col(time))).alias("half"))
    up = F.col("peak") > baseline
    return out.select(*keys, "peak", "peak_time", F.when(up, F.col("hi") - F.col("lo")).alias("rise_time"), (F.col("half") - F.col("peak_time")).alias("half_life"))


def lag_embedding(trace: str, length: int) -> Column:
    """All windows of `length` consecutive samples of an array."""
    last = F.size(trace) - length
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(F.col(trace), i + 1, F.lit(length)))


def ordered_sums(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """(keys, out): sums of value, added up in order: equal rows have equal sums, to the last bit, wherever they lie."""
    so_far = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = df.select(*keys, F.sum(value).over(so_far).alias("__sum"), F.row_number().over(W.partitionBy(*keys).orderBy(order)).alias("__n"))
    return sums.groupBy(*keys).agg(F.max_by("__sum", "__n").alias(out))


def rank_by(df: DataFrame, value: str, tie: str, out: str = "rank") -> DataFrame:
    """df with ranks from the largest value, equal ones by tie; NaN come first and nulls last, as in SQL."""
    return global_rank(df, [F.col(value).desc_nulls_last(), F.col(tie).asc_nulls_last()], out)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*groups).orderBy(*order)))


def benjamini_hochberg(tests: DataFrame, p: str, key: str, out: str = "q") -> DataFrame:
    """tests with q values; null p values stay null and don't count. tests has one row per test."""
    every = W.partitionBy(F.col(p).isNull())
    rank = F.row_number().over(every.orderBy(p, key))
    raw = tests.withColumn("__raw", F.col(p) * F.count(p).over(every) / rank)
    from_top = every.orderBy(F.desc(p), F.desc(key)).rowsBetween(W.unboundedPreceding, 0)
    return raw.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(from_top)))).drop("__raw")


def earliest_onset(tests: DataFrame, q: str, time: str, alpha: float = 0.05) -> DataFrame:
    return tests.agg(F.min(F.when(F.col(q) < alpha, F.col(time))).alias("onset"))


def kaplan_meier(events: DataFrame, by: Sequence[str], time: str = "latency", event: str = "event") -> DataFrame:
    """(by, time, at_risk, events, survival) at each time; rows meet by time before any window."""
    t = events.groupBy(*by, F.col(time).alias("time")).agg(F.count("*").alias("n"), F.count_if(event).alias("events"))
    w = W.partitionBy(*by).orderBy("time")
    t = t.withColumn("at_risk", F.sum("n").over(w.rowsBetween(0, W.unboundedFollowing)))
    step = F.when(F.col("events") < F.col("at_risk"), F.log1p(-F.col("events") / F.col("at_risk")))
    dead = F.max((F.col("events") == F.col("at_risk")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    s = F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(F.coalesce(step, F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0))))
    return t.select(*by, "time", "at_risk", "events", s.alias("survival"))


def median_survival(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """First time at which survival is a half or less; null if never."""
    return curve.groupBy(*by).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("time"))).alias("median"))


def interpolate(df: DataFrame, keys: Sequence[str], index: str, value: str, out: str) -> DataFrame:
    """Nulls filled linearly between neighbours, with the nearest value at the ends, 0 where all are null."""
    w = W.partitionBy(*keys).orderBy(index)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(index))
    v0, v1 = F.last(value, True).over(back), F.first(value, True).over(ahead)
    i0, i1 = F.last(at, True).over(back), F.first(at, True).over(ahead)
    between = v0 + (v1 - v0) * (F.col(index) - i0) / F.when(i1 > i0, i1 - i0)
    return df.withColumn(out, F.coalesce(F.col(value), between, v0, v1, F.lit(0.0)))


def time_bins(df: DataFrame, keys: Sequence[str], index: str, value: str, start: int, end: int, size: int) -> DataFrame:
    """(keys, bin, mean, centre) of samples start <= index < end, `size` to a bin."""
    inside = df.filter((F.col(index) >= start) & (F.col(index) < end)).withColumn("bin", F.floor((F.col(index) - start) / size).cast("int"))
    lo = start + F.col("bin") * size
    return inside.groupBy(*keys, "bin").agg(F.avg(value).alias("mean")).withColumn("centre", (lo + F.least(lo + size, F.lit(end)) - 1) / 2)


def cumulative_variance(components: DataFrame, index: str = "component", variance: str = "variance", shares: Sequence[float] = (0.8, 0.9)) -> tuple[DataFrame, DataFrame]:
    """(components with share and cumulative share, one row of how many components reach each share)."""
    every = W.partitionBy()
    c = components.withColumn("share", F.col(variance) / F.sum(variance).over(every))
    c = c.withColumn("cumulative", F.sum("share").over(W.orderBy(index).rowsBetween(W.unboundedPreceding, 0)))
    return c, c.agg(*[F.min(F.when(F.col("cumulative") >= s, F.col(index))).alias(f"n_{round(100 * s)}") for s in shares])
