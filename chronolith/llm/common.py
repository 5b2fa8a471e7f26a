"""Helpers that the operators share: bounded broadcasts, bounded samples, text folding."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.store import scratch, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Largest table, in rows of a few numbers each, that an operator broadcasts.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; the fast path is for text of ASCII alone."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint on df if it has at most so many rows, else df as it is.

    df is a written table or cheap to count; beyond the bound Spark shuffles it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def small_or_none(df: DataFrame, rows: int | None = None) -> DataFrame | None:
    """small(df) if it is broadcast, else None."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, share: int = 10_000) -> DataFrame:
    """left join right (one row a key, with the key's number of rows in left) where one key may hold most rows.

    Fewer than `share` keys can hold more than 1 / share of all rows each: those are
    broadcast, and of the rest no key brings more than that to one task. Both are
    written tables or cheap to read twice; left has no column named `count`.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    heavy = F.col(count) * share > total
    hot = F.broadcast(right.filter(heavy))
    rest = left.join(hot.select(key), key, "left_anti").join(right.filter(~heavy), key)
    return left.join(hot, key).unionByName(rest)


def of_keys(left: DataFrame, keys: DataFrame, key: str, count: str) -> DataFrame:
    """Rows of left with a key of keys(key, count), a written table of different keys that says how many rows of left have each."""
    hint = small_or_none(keys.select(key))
    return left.join(hint, key, "left_semi") if hint is not None else join_counted(left, keys, key, count).drop(count)


def first_of_each(df: DataFrame, keys: Sequence[str], k: int, id_col: str = "id") -> DataFrame:
    """Of each key the k rows whose id's hash comes first; there are few keys.

    Hashes are even, so that the first k lie below a threshold that the key's size sets,
    but for one chance in billions: then the key's rows are ordered all. df is cheap to read.
    """
    place = F.pmod(F.xxhash64(F.lit("place"), id_col), F.lit(1 << 40)) / float(1 << 40)
    hashed = df.withColumn("__place", place)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__all"))
    same = reduce(lambda a, b: a & b, [hashed[c].eqNullSafe(sizes[c]) for c in keys])
    enough = (k + 8 * k**0.5 + 16) / F.col("__all")
    near = hashed.join(F.broadcast(sizes), same).filter(F.col("__place") <= enough).select(*[hashed[c] for c in hashed.columns], "__all")
    found = near.groupBy(*keys, "__all").agg(F.count("*").alias("__n"))
    short = found.filter(F.col("__n") < F.least(F.col("__all"), F.lit(k)))
    rows = near.drop("__all") if short.isEmpty() else hashed
    order = W.partitionBy(*keys).orderBy("__place", id_col)
    return rows.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k).drop("__n", "__place")


_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-case code point of a letter or digit, or 32 for all else."""
    global _FOLD
    if _FOLD is None:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalnum():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _FOLD = t
    return _FOLD


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fold(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with single spaces between words, and where each one was in text."""
    x = fold_table()[code_points(text)]
    space = x == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    return x[at], at
