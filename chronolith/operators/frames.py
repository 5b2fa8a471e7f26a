"""Projections, filters and checks of frame tables and traces."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
_ID_LIKE = re.compile(r"(^|_)(id|index|number|num|label|trial|subject|cluster)($|_)", re.I)


class DataError(ValueError):
    """A table that breaks an operator's contract."""


def require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataError(f"missing columns: {', '.join(missing)}")


def clean_text(c: Column) -> Column:
    """Trimmed text; empty, "nan" and "None" are null."""
    t = F.trim(c.cast("string"))
    return F.when(~t.isin("", "nan", "None"), t)


def normalize_keys(df: DataFrame, text_keys: Sequence[str], int_keys: Sequence[str] = ()) -> DataFrame:
    """Text keys trimmed and null tokens null; integer keys as longs, an error if not integral."""
    require(df, [*text_keys, *int_keys])
    out = df.withColumns({c: clean_text(F.col(c)) for c in text_keys})

    def whole(c: str) -> Column:
        t = clean_text(F.col(c))
        number = F.expr(f"try_cast(`{c}` AS double)")
        bad = t.isNotNull() & (number.isNull() | (number != F.floor(number)))
        return F.when(bad, F.raise_error(F.concat(F.lit(f"{c}: not an integer: "), t)).cast("long")).otherwise(number.cast("long"))

    return out.withColumns({c: whole(c) for c in int_keys})


def rename(df: DataFrame, required: Mapping[str, str], optional: Mapping[str, str] | None = None) -> DataFrame:
    require(df, list(required))
    return df.withColumnsRenamed({**required, **{a: b for a, b in (optional or {}).items() if a in df.columns}})


def legacy_identifier(df: DataFrame, name: str, legacy: str) -> DataFrame:
    """Column `name` from its legacy column, or null where neither is there."""
    if name in df.columns:
        return df
    return df.withColumnRenamed(legacy, name) if legacy in df.columns else df.withColumn(name, F.lit(None).cast("string"))


def order_columns(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    first = [c for c in first if c in df.columns]
    last = [c for c in last if c in df.columns and c not in first]
    return df.select(*first, *[c for c in df.columns if c not in first and c not in last], *last)


def epoch_flags(df: DataFrame, frame: str = "frame", on: str = "on_idx", off: str = "off_idx") -> DataFrame:
    """is_before, is_during (both ends in), is_after; 0 without timing."""
    f, a, b = F.col(frame), F.col(on), F.col(off)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    return df.withColumns({"is_before": flag(f < a), "is_during": flag((f >= a) & (f <= b)), "is_after": flag(f > b)})


def select_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    if not values:
        raise DataError("no values to select")
    return df.filter(F.col(column).cast("string").isin(*map(str, values)))


def trial_type_is(df: DataFrame, wanted: str, column: str = "trial_type", datasets: Sequence[str] = (), dataset: str = "dataset") -> DataFrame:
    out = df.filter(F.lower(F.trim(F.col(column))) == wanted.strip().lower())
    return select_values(out, dataset, datasets) if datasets else out


def select_one(df: DataFrame, where: Mapping[str, object]) -> DataFrame:
    """The single row that matches; an error in the row itself if more do."""
    found = reduce(lambda d, kv: d.filter(F.col(kv[0]) == F.lit(kv[1])), where.items(), df)
    if found.limit(2).count() != 1:
        raise DataError(f"{dict(where)} selects no row, or several")
    return found


def truncate_around(df: DataFrame, before: int, after: int, frame: str = "frame", on: str = "on_idx", off: str = "off_idx") -> DataFrame:
    """Frames from `before` ahead of the stimulus to `after` behind it, numbered from 0."""
    start = F.greatest(F.lit(0), F.col(on) - before)
    kept = df.filter((F.col(frame) >= start) & (F.col(frame) < F.col(off) + after))
    return kept.withColumn(frame, F.col(frame) - start)


def aligned_window(df: DataFrame, pre_s: float, post_s: float, fps: float, frame: str = "frame", on: str = "on_idx") -> DataFrame:
    """Frames in [on - pre, on + post) with time in seconds from the stimulus."""
    start, end = F.col(on) - int(pre_s * fps), F.col(on) + int(post_s * fps)
    return df.filter((F.col(frame) >= start) & (F.col(frame) < end)).withColumn("rel_time", (F.col(frame) - F.col(on)) / F.lit(float(fps)))


def cap_trace(c: Column, most: int = 3601) -> Column:
    return F.slice(c, 1, most)


def select_features(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted features in the table's own order; an error if none or one is missing."""
    require(df, wanted)
    return df.select(*keep, *[c for c in df.columns if c in set(wanted)])


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose name doesn't look like an identifier's."""
    return [c for c, t in df.dtypes if t.split("(")[0] in _NUMERIC and not _ID_LIKE.search(c)]


def component_columns(df: DataFrame, prefix: str = "pc") -> list[str]:
    found = [(int(m[1]), c) for c in df.columns if (m := re.fullmatch(rf"{prefix}_?(\d+)", c, re.I))]
    return [c for _, c in sorted(found)]


def drop_low_variance(df: DataFrame, columns: Sequence[str], least: float) -> DataFrame:
    """df without those of columns whose population variance is below `least`."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if row[c] is None or row[c] < least])


def exclude_flagged(df: DataFrame, flags: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """df without the subjects that flags scores 0 or less."""
    return df.join(flags.filter(F.col(score) <= 0).select(*keys).distinct(), list(keys), "left_anti")


def label_matches(df: DataFrame, column: str, like: str, unlike: str) -> DataFrame:
    return df.filter(F.col(column).rlike(like) & ~F.col(column).rlike(unlike))


def trim_tail(c: Column) -> Column:
    """A trace without trailing zeros, nulls and NaN."""
    dead = lambda x: x.isNull() | F.isnan(x) | (x == 0)
    last = F.coalesce(F.array_max(F.transform(c, lambda x, i: F.when(~dead(x), i + 1))), F.lit(0))
    return F.slice(c, F.lit(1), last)


def direction_magnitude(df: DataFrame, out: str = "dir_val") -> DataFrame:
    return df.withColumn(out, F.hypot(F.col("prob_x") - F.col("eye_x"), F.col("prob_y") - F.col("eye_y")))


def non_reactive(label: Column) -> Column:
    return (label == 0).cast("int")


def canonical_dataset(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The name of the first rule whose tokens are all in the text; else the text, trimmed."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " ")
    out = F.trim(c)
    for need, name in reversed(rules):
        has = reduce(lambda a, b: a & b, [F.array_contains(tokens, t) for t in need.split()])
        out = F.when(has, F.lit(name)).otherwise(out)
    return out


def choose_signal(df: DataFrame, preferred: Sequence[str]) -> str:
    for c in preferred:
        if c in df.columns:
            return c
    raise DataError("no signal column")


def time_axis(df: DataFrame, fps: float | None, time: str = "time", frame: str = "frame") -> DataFrame:
    """time_s: the time column, else frame / fps, else the frame."""
    by_frame = F.col(frame) / F.lit(float(fps)) if fps and fps > 0 else F.col(frame).cast("double")
    return df.withColumn("time_s", F.coalesce(F.col(time).cast("double"), by_frame) if time in df.columns else by_frame)


def trial_violations(trials: DataFrame) -> DataFrame:
    """(trial columns, reason) of trials(fps, on_idx, off_idx, n, steps_down) that aren't well formed."""
    rules = {
        "fps must be positive": F.col("fps") <= 0,
        "stimulus starts outside the trial": (F.col("on_idx") < 0) | (F.col("on_idx") >= F.col("n")),
        "stimulus ends before it starts": F.col("off_idx") <= F.col("on_idx"),
        "stimulus ends after the trial": F.col("off_idx") > F.col("n"),
        "time goes back": F.col("steps_down") > 0,
    }
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for t, c in rules.items()]), lambda x: x.isNotNull())
    return trials.withColumn("reason", F.explode(reasons))
