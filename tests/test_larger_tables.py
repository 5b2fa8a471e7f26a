"""Queries against their SQL on events that the smallest tables lack: zeros, and values whose sums depend on the order."""

import datetime
import hashlib
import os
import random
import statistics

import duckdb
import pytest
from oracle import DATA, TABLES, assert_same
from pyspark.sql import functions as F

from chronolith.operators.stats import randomization_test
from chronolith.plans import queries as plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture
def given(spark, tmp_path):
    """Folder of the given tables with events (user_id, day, value) of its own, in time's order."""

    def build(rows, files=1):
        start = datetime.datetime(2024, 1, 1)
        full = [(i, start + datetime.timedelta(days=day - 1, seconds=i), user, "view", value, "{}") for i, (user, day, value) in enumerate(sorted(rows, key=lambda r: r[1]))]
        for t in TABLES:
            if t != "events":
                os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
        spark.createDataFrame(full, EVENTS).repartitionByRange(files, "event_id").sortWithinPartitions("event_id").write.parquet(str(tmp_path / "events.parquet"))
        return str(tmp_path)

    return build


def wanted(sf_dir, name):
    con = duckdb.connect(config={"threads": 1})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet{'/*.parquet' if t == 'events' else ''}'")
    return con.execute(SQL[name]).df()


def test_logarithms_of_zeros(spark, given):
    sf_dir = given([(1, 1, v) for v in (0.0, -0.0, 1.0, 12.5, 1e-300, None, float("inf"))])
    got = QUERIES["f15_arithmetic"](spark, sf_dir).toPandas()
    assert (got["log"] == float("-inf")).sum() == 2
    assert_same(got, wanted(sf_dir, "f15_arithmetic"))


def test_means_are_added_up_in_the_order_of_trials(spark, given):
    draw, rows, up, down = random.Random(4), [], 0, 0
    for user in range(400):
        a = [draw.randrange(1, 9999) / 100 for _ in range(3)]
        b = draw.sample(a, 3)
        rows += [(user, day, v) for day, v in zip((6, 16, 21, 1, 11, 26), a + b, strict=True)]
        a, b = ((x[0] + x[1] + x[2]) / 3 for x in (a, b))
        up, down = up + (a > b), down + (a < b)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else a table as small as this comes in order
    try:
        got = QUERIES["h04_sign_test"](spark, given(rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert up > 20 and down > 20 and [(r["up"], r["down"]) for r in got] == [(up, down)]


def test_trials_of_equal_rows_rank_by_their_names(spark, given):
    draw = random.Random(5)
    values = [draw.randrange(1, 9999) / 100 for _ in range(60)]
    rows = [(user, 1 + i // 13, v) for user in range(90) for i, v in enumerate(values)]
    rows += [(200, 3, None), (201, 3, float("nan")), (202, 3, -1.0), (203, 3, 0.0), (204, 3, -0.0)]
    sf_dir = given(rows, files=4)
    assert_same(QUERIES["w11_rank_trials"](spark, sf_dir).toPandas(), wanted(sf_dir, "w11_rank_trials"))


def test_medians_hold_when_differences_come_out_anew_in_their_last_bits(spark):
    draw, perms = random.Random(6), 20
    values = {(s, f): draw.randrange(-900, 1100) / 600 for s in range(41) for f in range(12)}
    anew = F.udf(lambda x: x + int.from_bytes(os.urandom(2)) * 1e-18, "double").asNondeterministic()
    diffs = spark.createDataFrame([(s, f, v) for (s, f), v in values.items()], "subject long, frame int, diff double").withColumn("diff", anew("diff"))
    got = {r["frame"]: (round(r["effect"], 9), round(r["p"], 9)) for r in randomization_test(diffs, perms, statistic="median").collect()}
    up = {(p, s): p == 0 or hashlib.md5(f"67|{p}|{s}".encode()).hexdigest()[0] < "8" for p in range(perms + 1) for s in range(41)}
    want = {}
    for f in range(12):
        effect, *flips = (statistics.median(v if up[p, s] else -v for (s, g), v in values.items() if g == f) for p in range(perms + 1))
        want[f] = (round(effect, 9), round((1 + sum(abs(m) >= abs(effect) - 1e-12 for m in flips)) / (perms + 1), 9))
    assert got == want
