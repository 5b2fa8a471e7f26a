"""Exact percentiles of whole tables or of large groups, without all values of a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import written

#: Cells into which a round cuts what is left of a group.
CELLS = 256
#: Brackets that are broadcast, a few numbers each; more are shuffled.
BROADCAST_ROWS = 200_000


def _in_brackets(values: DataFrame, brackets: DataFrame, how: str = "inner") -> DataFrame:
    small = brackets.select("__key").limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    b = brackets.withColumnsRenamed({"__key": "__of"})
    met = (F.col("__key") == F.col("__of")) & (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    out = values.join(F.broadcast(b) if small else b, met, how)
    return out.drop("__of") if how == "inner" else out


def exact_percentiles(df: DataFrame, value: str | Column, shares: Sequence[float], by: Sequence[str] = (), keep: bool = True, cells: int = CELLS) -> DataFrame:
    """(by, share, percentile): linear interpolation between the two values whose ranks are nearest.

    The value of a rank is bracketed by the least and largest value of its group; a round
    counts the bracket's values by cells of equal width and goes on with the least and
    largest value of the cell that has the rank, until they are one. A round is one
    aggregation, of which a row a cell is shuffled. Nulls and NaN don't count; a group
    without values has no row. keep=False reads df anew in each round instead of writing
    its values.
    """
    v = F.col(value).cast("double") if isinstance(value, str) else value.cast("double")
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    values = df.select(key.alias("__key"), v.alias("__v")).filter("__v is not null and not isnan(__v)")
    values = written(values, "values") if keep else values
    ends = values.groupBy("__key").agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    at = lambda s: (F.col("__n") - 1) * F.lit(float(s))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(s)), F.ceil(at(s))) for s in shares])))
    open_ = written(ends.withColumn("__rank", F.explode(ranks)).withColumn("__below", F.lit(0).cast("long")), "brackets")
    sizes = open_.select("__key", "__n").distinct()
    done = None
    while True:
        closed = open_.filter("__lo = __hi").select("__key", "__rank", F.col("__lo").alias("__at"))
        done = closed if done is None else done.unionByName(closed)
        left = open_.filter("__lo < __hi").drop("__n")
        if left.isEmpty():
            break
        hits = _in_brackets(values, left)
        # Halves, as the difference of two doubles may be none.
        cell = F.least(F.floor((F.col("__v") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2) * cells), F.lit(cells - 1))
        counts = hits.groupBy("__key", "__rank", "__below", cell.alias("__cell")).agg(F.count("*").alias("__c"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        before = F.col("__below") + F.coalesce(F.sum("__c").over(W.partitionBy("__key", "__rank").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        found = counts.withColumn("__below", before).filter((F.col("__below") <= F.col("__rank")) & (F.col("__rank") < F.col("__below") + F.col("__c")))
        open_ = written(found.select("__key", "__lo", "__hi", "__rank", "__below", F.lit(0).cast("long").alias("__n")), "brackets")
        if keep:
            values = written(_in_brackets(values, open_.filter("__lo < __hi").select("__key", "__lo", "__hi"), "left_semi"), "values")
    found = done.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__at"))).alias("__values")).join(sizes, "__key")  # two entries a share

    def one(s: float) -> Column:
        low, high = F.element_at("__values", F.floor(at(s))), F.element_at("__values", F.ceil(at(s)))
        part = at(s) - F.floor(at(s))
        return F.struct(F.lit(float(s)).alias("share"), (low * (1 - part) + high * part).alias("percentile"))

    rows = found.select("__key", F.explode(F.array(*[one(s) for s in shares])).alias("__x"))
    return rows.select(*[F.col("__key")[c].alias(c) for c in by], "__x.share", "__x.percentile")


def percentile_columns(df: DataFrame, value: str | Column, named: dict[str, float], by: Sequence[str] = (), keep: bool = True) -> DataFrame:
    """(by, a column for each name): exact_percentiles, a row a group."""
    long = exact_percentiles(df, value, list(named.values()), by, keep)
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("share") == float(s), F.col("percentile"))).alias(n) for n, s in named.items()])


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Median of each column; all columns share each round."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")).select("x.*")
    got = {r["name"]: r["percentile"] for r in exact_percentiles(long, "v", [0.5], ["name"]).collect()}
    return {c: got.get(c) for c in columns}
