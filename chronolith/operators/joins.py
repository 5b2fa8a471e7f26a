"""Joins of frames, labels, summaries and scores, with their contracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import DataError


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, copies) of the keys that several rows have."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    if not duplicate_keys(df, keys).isEmpty():
        raise DataError(f"{what}: several rows of one key ({', '.join(keys)})")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return assert_unique(left, keys, "left").join(assert_unique(right, keys, "right"), list(keys), how)


def join_labels(frames: DataFrame, labels: DataFrame, keys: Sequence[str], drop_missing: bool = True) -> DataFrame:
    """Frames with the labels of their trial; without a label dropped, or an error as the row is read."""
    labels = assert_unique(labels, keys, "labels")
    if drop_missing:
        return frames.join(labels, list(keys))
    joined = frames.join(labels.withColumn("__labelled", F.lit(True)), list(keys), "left")
    return joined.filter(F.coalesce("__labelled", F.raise_error(F.lit("a frame without a label")).cast("boolean"))).drop("__labelled")


def labelled_only(frames: DataFrame, labels: DataFrame, keys: Sequence[str]) -> DataFrame:
    return frames.join(labels.select(*keys), list(keys), "left_semi")


def _mismatch(a: Column, b: Column, tolerance: float) -> Column:
    far = F.abs(a - b) > tolerance + tolerance * F.abs(b)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull() | b.isNull(), 1).otherwise(far.cast("int"))


def merge_summary(aggregates: DataFrame, summary: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-3) -> DataFrame:
    """Aggregates with their nulls filled from summary, and <value>_mismatch: 1 where the two disagree."""
    s = assert_unique(summary, keys, "summary").select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
    joined = assert_unique(aggregates, keys, "aggregates").join(s, list(keys), "left")
    merged = {v: F.coalesce(F.col(v), F.col(f"__{v}")) for v in values}
    flags = {f"{v}_mismatch": _mismatch(F.col(v), F.col(f"__{v}"), tolerance) for v in values}
    rest = [c for c in aggregates.columns if c not in values]
    return joined.select(*rest, *[c.alias(v) for v, c in merged.items()], *[c.alias(v) for v, c in flags.items()])


def unmatched_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(side, keys) of the keys that only one side has."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    sides = [x.join(y, list(keys), "left_anti").select(F.lit(n).alias("side"), *keys) for n, x, y in (("left", a, b), ("right", b, a))]
    return reduce(DataFrame.unionByName, sides)


def compare_labels(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, old, new, status): same, changed, added or removed."""
    a = old.select(*keys, F.col(value).alias("old"), F.lit(True).alias("__a"))
    b = new.select(*keys, F.col(value).alias("new"), F.lit(True).alias("__b"))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, "old", "new", status.alias("status"))


def join_by_order(rows: DataFrame, labels: DataFrame, groups: Sequence[str], row_order: Sequence[str], label_order: Sequence[str]) -> DataFrame:
    """The n-th row of a group with the n-th label; groups whose counts differ are dropped."""
    number = lambda df, order: df.withColumn("__n", F.row_number().over(W.partitionBy(*groups).orderBy(*order)))
    count = lambda df: df.withColumn("__count", F.count("*").over(W.partitionBy(*groups)))
    return count(number(rows, row_order)).join(count(number(labels, label_order)), [*groups, "__n", "__count"]).drop("__n", "__count")


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Of each key the row that comes first in order."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def join_by_template(trials: DataFrame, labels: DataFrame, template: str, parts: Sequence[str], id_col: str, order: Sequence[Column]) -> DataFrame:
    """Trials with the labels whose formatted parts are the trial's id; of several the last."""
    keyed = labels.withColumn(id_col, F.format_string(template, *[F.col(p).cast("string") for p in parts])).drop(*parts)
    return trials.join(keep_last(keyed, [id_col], order), id_col, "left")


def rejoin_assignments(features: DataFrame, assigned: DataFrame, key: str, order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """Features with their last assignment, and the assignments that match none."""
    last = keep_last(assigned, [key], order)
    return features.join(last, key), last.join(features.select(key), key, "left_anti")


def map_scores(scores: DataFrame, text: str, pattern: str, mapping: Mapping[str, str], out: str = "label") -> DataFrame:
    """Scores with the label that the number in their text maps to; null where none does."""
    number = F.regexp_extract(F.col(text), pattern, 1)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return scores.withColumn(out, F.try_element_at(F.create_map(*pairs), number))


def range_pairs(points: DataFrame, id_col: str, coords: Sequence[str], eps: float) -> DataFrame:
    """(a, b) of different points within Euclidean distance eps, both ways.

    Points meet in grid cells of side eps: a point goes to its own cell and the cells
    beside it, and is joined by cell with the points whose own cell it is.
    """
    own = points.select(F.col(id_col).alias("a"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(coords)], *[F.floor(F.col(c) / eps).alias(f"g{i}") for i, c in enumerate(coords)])
    near = points.select(F.col(id_col).alias("b"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(coords)])
    for i in range(len(coords)):
        cell = F.floor(F.col(f"y{i}") / eps)
        near = near.withColumn(f"g{i}", F.explode(F.sequence(cell - 1, cell + 1)))
    apart = reduce(lambda p, q: p + q, [(F.col(f"x{i}") - F.col(f"y{i}")) ** 2 for i in range(len(coords))])
    return own.join(near, [f"g{i}" for i in range(len(coords))]).filter((F.col("a") != F.col("b")) & (apart <= eps * eps)).select("a", "b")
