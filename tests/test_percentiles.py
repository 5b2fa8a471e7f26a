"""Exact percentiles against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.operators import percentiles as P

SHARES = [0.0, 0.01, 0.27, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("keep", [True, False])
@pytest.mark.parametrize("cells", [16, 256])
def test_percentiles_of_groups_equal_numpy(spark, keep, cells):
    rng = np.random.default_rng(2)
    groups = {
        "normal": rng.normal(size=501),
        "ties": rng.integers(0, 4, 300).astype(float),
        "tails": np.concatenate([rng.normal(size=50) * 10.0 ** rng.integers(-20, 20, 50), [-1e9, 1e9]]),
        "one": np.array([3.25]),
        "same": np.full(40, -0.5),
        "two": np.array([1.0, 2.0]),
        None: rng.random(9),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("empty", None), ("empty", float("nan")), ("two", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r["g"], r["share"]): r["percentile"] for r in P.exact_percentiles(df, "v", SHARES, ["g"], keep, cells).collect()}
    assert set(got) == {(g, s) for g in groups for s in SHARES}
    for g, x in groups.items():
        at = np.sort(x)
        for s in SHARES:
            pos = (len(x) - 1) * s
            low, high = at[int(np.floor(pos))], at[int(np.ceil(pos))]
            part = pos - np.floor(pos)
            assert np.isclose(got[g, s], low * (1 - part) + high * part, rtol=1e-12)


def test_whole_tables_and_columns(spark):
    df = spark.range(1001).select((F.col("id") * 8 % 1001).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("b"), F.lit(None).cast("double").alias("c"))
    assert P.percentile_columns(df, "a", {"low": 0.25, "high": 0.999}).first().asDict() == {"low": 250.0, "high": 999.0}
    assert P.column_medians(df, ["a", "b", "c"]) == {"a": 500.0, "b": 500.0, "c": None}
    assert P.exact_percentiles(df.filter("false"), "a", [0.5]).count() == 0


def test_no_list_of_a_groups_values_in_the_plan(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    plan = P.exact_percentiles(df, "v", [0.5], ["g"])._jdf.queryExecution().toString().lower()
    assert "percentile(" not in plan and "collect_list(v" not in plan
