"""Scalar, array, map and JSON functions of trial tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def subject_and_trial(path: Column) -> tuple[Column, Column]:
    """Subject and trial numbers from a file path: its last two runs of digits."""
    digits = F.regexp_extract_all(path, F.lit(r"(\d+)"), 1)
    last = lambda n: F.try_element_at(digits, F.lit(-n)).cast("long")
    return last(2), last(1)


def core_label(label: Column) -> Column:
    """testing_N at the start of a label, or null."""
    found = F.regexp_extract(label, r"^(testing_\d+)", 1)
    return F.when(found != "", found)


def plain_dates(name: Column) -> Column:
    """Leading zeros of the parts of a name's dates gone, and a rig's suffix."""
    return F.regexp_replace(F.regexp_replace(name, r"(^|[_-])0+(\d)", "$1$2"), r"_rig_?\d+$", "")


def column_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def template_id(template: str, *parts: Column) -> Column:
    return F.format_string(template, *[p.cast("string") for p in parts])


def testing_code(*texts: Column) -> Column:
    """The first testN or testing_N in any of the columns, as testing_N."""
    code = lambda t: F.regexp_extract(F.lower(t), r"test(?:ing)?[ _-]?(\d+)", 1)
    return F.coalesce(*[F.when(code(t) != "", F.concat(F.lit("testing_"), code(t))) for t in texts])


def descriptor(*parts: Column) -> Column:
    return F.concat_ws(" | ", *[F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts])


def to_bool(c: Column) -> Column:
    """true, 1, t, yes, y and nonzero numbers; false, 0, f, no, n, empty and null; else an error."""
    t = F.lower(F.trim(c.cast("string")))
    n = t.try_cast("double")
    known = F.when(t.isNull() | t.isin("", "nan", "false", "f", "no", "n"), False).when(t.isin("true", "t", "yes", "y"), True).when(n.isNotNull(), n != 0)
    return F.coalesce(known, F.raise_error(F.concat(F.lit("not a boolean: "), t)).cast("boolean"))


def to_number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def valid_label(c: Column) -> Column:
    """The label as an integer where it is one of 0 or more, else null."""
    n = to_number(c)
    return F.when((n >= 0) & (n == F.floor(n)), n.cast("int"))


def class_of(intensity: Column, mode: str) -> Column:
    if mode == "multiclass":
        return intensity.cast("int")
    least = {"binary": 1, "threshold-1": 2, "threshold-2": 3}[mode]
    return (intensity >= least).cast("int")


def sample_weight(intensity: Column, boost: float = 1.0, boosted: int = 5) -> Column:
    w = F.greatest(F.lit(1), intensity).cast("double")
    return F.when(intensity == boosted, w * boost).otherwise(w)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, class_weight): rows over classes times the class's rows."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes"))
    return counts.join(F.broadcast(total), F.lit(True)).select(label, (F.col("all") / (F.col("classes") * F.col("n"))).alias("class_weight"))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def natural_log(x: Column) -> Column:
    """Natural logarithm: minus infinity at 0, where Spark's is null; null below."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))


def ordinal_binary(score: Column, threshold: int = 2) -> Column:
    return (score >= threshold).cast("int")


def class_score(index: Column) -> Column:
    """Class indexes 0..6 as scores -1..5."""
    return index - 1


# Names under which a code map holds another one, a list of texts, and the codes of such a list.
NESTED = ("index_to_value", "index_to_label", "codes_to_values", "map", "mapping", "lookup")
LISTED, PAIRED = ("values", "labels"), ("keys", "codes", "indices")


def code_map(codes: Column) -> Column:
    """A JSON text as a map of code to text.

    A map, one nested under a known name, a list (codes are places from 0), or lists of
    texts and of their codes, which count from 0 where their numbers differ. Of a repeated
    code the first text counts, and a null one is none.
    """
    flat = "map<string,string>"
    m = F.from_json(codes, flat)
    of = lambda names, kind: F.coalesce(*[F.from_json(F.try_element_at(m, F.lit(n)), kind) for n in names])
    places = lambda a: F.when(F.size(a) > 0, F.transform(a, lambda _, i: i.cast("string"))).otherwise(F.array().cast("array<string>"))
    plain, texts, keys = F.from_json(codes, "array<string>"), of(LISTED, "array<string>"), of(PAIRED, "array<string>")
    first = F.filter(F.arrays_zip(keys.alias("k"), texts.alias("v")), lambda x, i: x["k"].isNotNull() & (F.array_position(keys, x["k"]) == i + 1))
    paired = F.when(F.size(keys) == F.size(texts), F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))).otherwise(F.map_from_arrays(places(texts), texts))
    listed = F.when(F.startswith(F.ltrim(codes), F.lit("[")), F.map_from_arrays(places(plain), plain))
    return F.coalesce(listed, of(NESTED, flat), F.when(texts.isNotNull(), paired), m)


def decode(c: Column, codes: Column) -> Column:
    """Codes through a JSON code map, then through its inverse; codes that both lack stay as they are."""
    m, text = code_map(codes), c.cast("string")
    whole = c.try_cast("double")
    number = F.when(whole == F.floor(whole), whole.cast("bigint").cast("string"))
    back = F.try_element_at(F.filter(F.map_entries(m), lambda e: e["value"] == text), F.lit(-1))["key"]
    return F.coalesce(F.try_element_at(m, text), F.try_element_at(m, number), back, text)


def invert_map(m: Column) -> Column:
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(e["value"], e["key"])))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, not at each of its uses inside a lambda."""
    return F.transform(F.array(value), use)[0]


def array_std(a: Column) -> Column:
    """Population standard deviation."""
    return let(array_mean(a), lambda m: F.sqrt(array_mean(F.transform(a, lambda x: (x - m) * (x - m)))))


def zscore(trace: Column, baseline: Column | None = None) -> Column:
    """A trace less its mean (or its baseline's) over the deviation; a deviation of 0 counts as 1."""
    b = trace if baseline is None else baseline
    fit = F.struct(array_mean(b).alias("m"), F.coalesce(F.nullif(array_std(b), F.lit(0.0)), F.lit(1.0)).alias("s"))
    return let(fit, lambda p: F.transform(trace, lambda x: (x - p["m"]) / p["s"]))


def array_area(a: Column) -> Column:
    """Trapezoid area at unit steps."""
    return array_sum(F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: (x + y) / 2))


def segment_statistics(trace: Column, on: int, off: int) -> dict[str, Column]:
    """Mean, deviation, extremes, area, length and place of the peak in the stimulus and after it."""
    a, b = F.slice(trace, on + 1, off - on), F.slice(trace, off + 1, F.size(trace) - off)
    out: dict[str, Column] = {}
    for n, x in (("odor", a), ("post", b)):
        out |= {f"{n}_mean": array_mean(x), f"{n}_std": array_std(x), f"{n}_min": F.array_min(x), f"{n}_max": F.array_max(x), f"{n}_auc": array_area(x), f"{n}_duration": F.size(x).cast("double")}
    out["odor_peak_latency"] = (F.array_position(a, F.array_max(a)) - 1) / F.size(a)
    return out | {"post_vs_odor_mean": out["post_mean"] - out["odor_mean"], "post_auc_delta": out["post_auc"] - out["odor_auc"]}


def frame_durations(times: Column) -> Column:
    """Steps to the next time, the last repeated; 1 where a step isn't positive."""
    n = F.size(times)
    steps = F.zip_with(F.slice(times, 1, n - 1), F.slice(times, 2, n - 1), lambda a, b: b - a)
    whole = F.when(n > 1, F.concat(steps, F.slice(steps, -1, 1))).otherwise(F.array(F.lit(1.0)))
    return F.transform(whole, lambda d: F.when(d > 0, d).otherwise(1.0))


# Seconds of the segments, and latencies of the two presets.
BASELINE_S, ODOR_S, POST_S = 30.0, 30.0, 30.0
LATENCY_S = {"opto": 2.15321342434201, "manual": 3.01241129416006}


def segment_windows(fps: Column, latency_s: float, frames: Column) -> dict[str, tuple[Column, Column]]:
    """(start, end) frames of baseline, odor and post, end-exclusive, within the trial."""
    late = max(latency_s, 0.0)
    clamp = lambda c: F.greatest(F.lit(0), F.least(frames, c)).cast("int")
    f = F.when(fps > 0, fps).otherwise(0.0)
    baseline = clamp(F.bround(f * BASELINE_S))
    start = F.greatest(baseline, clamp(F.bround(f * (BASELINE_S + late))))
    end = clamp(start + F.bround(f * (ODOR_S + late)))
    return {"baseline": (F.lit(0), baseline), "odor": (start, end), "post": (end, clamp(end + F.bround(f * POST_S)))}


def segment_metrics(frames: DataFrame, keys: Sequence[str], value: str, threshold: float, fps: float, frame: str = "frame") -> DataFrame:
    """keys and nine reaction figures: share and area above threshold, latency, peak, speed and acceleration of the rise."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    v, f = F.col(value), F.col(frame)
    above = v > threshold
    x = frames.withColumns({"__0": F.min(f).over(w), "__x": F.min(F.when(above, f)).over(w)})
    after = f >= F.col("__x")
    best = F.min_by(f, F.when(after, F.struct((-v).alias("v"), f.alias("f"))))
    x = x.withColumn("__p", F.min(F.when(after, F.struct((-v).alias("v"), f.alias("f")))).over(w)["f"])
    at = lambda c: F.max(F.when(f == c, v))
    g = x.groupBy(*keys).agg(
        F.avg(above.cast("double")).alias("time_fraction"),
        (F.sum(F.when(above, v - threshold).otherwise(0.0)) / fps).alias("auc"),
        (F.count("*") / F.lit(fps)).alias("duration"),
        F.bool_or(above).alias("crossed_threshold"),
        ((F.max("__x") - F.max("__0")) / fps).alias("time_to_threshold"),
        ((best - F.max("__x")) / fps).alias("time_to_peak"),
        F.max(F.when(after, v)).alias("peak_value"),
        at(F.col("__x")).alias("cross_v"),
        at(F.col("__x") + 1).alias("cross_next"),
        at(F.col("__p") - 1).alias("peak_before"),
    )
    rises = F.col("time_to_peak") > 0
    speed = F.when(rises, (F.col("peak_value") - F.col("cross_v")) / F.col("time_to_peak")).when(F.col("crossed_threshold"), 0.0)
    slopes = (F.col("peak_value") - F.col("peak_before")) * fps - (F.col("cross_next") - F.col("cross_v")) * fps
    return g.select(*keys, "time_fraction", "auc", "duration", "crossed_threshold", "time_to_threshold", "time_to_peak", "peak_value", speed.alias("rise_speed"), F.when(rises, slopes / F.col("time_to_peak")).when(F.col("crossed_threshold"), 0.0).alias("rise_acceleration"))


def sigma_threshold(frames: DataFrame, keys: Sequence[str], value: str, baseline: Column, k: float = 4.0) -> DataFrame:
    b = F.when(baseline, F.col(value))
    return frames.groupBy(*keys).agg((F.avg(b) + k * F.stddev_pop(b)).alias("threshold"))


def robust_threshold(frames: DataFrame, keys: Sequence[str], value: str, k: float = 3.0) -> DataFrame:
    """Median + k * 1.4826 * median absolute deviation."""
    m = frames.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    far = frames.join(m, list(keys)).groupBy(*keys).agg(F.first("median").alias("median"), F.percentile(F.abs(F.col(value) - F.col("median")), 0.5).alias("mad"))
    return far.select(*keys, (F.col("median") + k * 1.4826 * F.col("mad")).alias("threshold"))


def odor_response(samples: DataFrame, key: str, time: str, value: str, on: float, off: float) -> DataFrame:
    """(key, baseline_mean, baseline_std, threshold, auc, auc_ratio): area above mean + 4 deviations of the baseline."""
    from pyspark.sql import Window as W

    t, v = F.col(time), F.col(value)
    base = F.when(t < on, v)
    inside = samples.filter((t >= on) & (t <= off))
    w = W.partitionBy(key).orderBy(time)
    step = F.coalesce(F.lead(t).over(w) - t, t - F.lag(t).over(w), F.lit(1.0)).cast("double")
    odor = inside.withColumn("__d", F.when(step > 0, step).otherwise(1.0))
    b = samples.groupBy(key).agg(F.avg(base).alias("baseline_mean"), F.stddev_pop(base).alias("baseline_std")).withColumn("threshold", F.col("baseline_mean") + 4 * F.col("baseline_std"))
    j = odor.join(b, key).groupBy(key).agg(*[F.first(c).alias(c) for c in ("baseline_mean", "baseline_std", "threshold")], F.sum(F.greatest(v - F.col("threshold"), F.lit(0.0)) * F.col("__d")).alias("auc"), F.sum("__d").alias("__all"))
    return j.withColumn("auc_ratio", F.col("auc") / F.greatest(F.abs(F.col("threshold") * F.col("__all")), F.lit(1e-8))).drop("__all")

