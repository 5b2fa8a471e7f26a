"""Aggregates on streams whose state ends."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from chronolith.streaming import trials as ST


def test_state_ends_late_rows_are_dropped_and_the_rest_equals_the_batch_form(spark, tmp_path):
    rng = np.random.default_rng(8)
    path, day0 = f"{tmp_path}/in", dt.datetime(2024, 3, 1)
    rows, at = [], 0
    for batch in range(6):  # two days a batch; a trial crosses midnights and batches
        part = [(i % 3, at + i, day0 + dt.timedelta(days=2 * batch, minutes=40 * i), float(rng.normal()) + 1e4 if i % 7 else None) for i in range(60)]
        late = [(9, 10**6, day0, 5.0)] if batch == 4 else []  # its window is gone
        spark.createDataFrame([*part, *late], "trial long, frame long, ts timestamp_ntz, v double").coalesce(1).write.mode("append").parquet(path)
        rows += part
        at += 60
    stream = ST.frame_stream(spark, path, 1)
    sums, progress = ST.run_updates(ST.trial_sums(stream, ["trial"], ["v"], "ts", "1 day", "36 hours", "frame"), ["window_start", "trial"], "sums")
    got = {r["trial"]: r for r in ST.merged_aggregates(sums, ["trial"], ["v"]).collect()}
    assert set(got) == {0, 1, 2}
    for k, r in got.items():
        own = [x for x in rows if x[0] == k]
        v = np.array([x[3] for x in own if x[3] is not None])
        assert r["frame_count"] == len(own)
        assert np.allclose([r["v_mean"], r["v_std"], r["v_min"], r["v_max"], r["v_sum"], r["v_first"], r["v_last"]], [v.mean(), v.std(ddof=1), v.min(), v.max(), v.sum(), v[0], v[-1]])
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(held) < sums.count() and sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in progress if p["stateOperators"]) == 1


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path):
    path = f"{tmp_path}/in"
    spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1), 2.0)], "trial long, frame long, ts timestamp_ntz, v double").write.parquet(path)
    sums = ST.trial_sums(ST.frame_stream(spark, path, 1), ["trial"], ["v"], "ts", "1 day", "1 day", "frame")
    rows, _ = ST.run_updates(sums, ["window_start", "trial"], "again")
    assert rows.count() == 1
    one = ST.merged_aggregates(rows, ["trial"], ["v"]).first()
    assert one["v_std"] is None and one["v_mean"] == 2.0
    assert ST.merged_aggregates(rows.filter(F.lit(False)), ["trial"], ["v"]).count() == 0
