"""Counters cut into slices of time against one event after the other."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from atalaya.streaming import counters as C

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, fail boolean"


def replayed(rows, span):
    want, state = {}, {}
    for i, ts, user, fail in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[0])):
        n, first = state.get(user, (0, ts))
        if n and ts >= first + timedelta(seconds=span):
            n = 0
        if fail and n == 0:
            first = ts
        n = n + 1 if fail else 0
        state[user] = (n, first)
        want[i] = n
    return want


@pytest.mark.parametrize("slice_spans", [1, 3, 64])
@pytest.mark.parametrize("success", [0.0, 0.01, 0.3])
def test_slices_equal_replay(spark, slice_spans, success):
    """One user with most events, which with few successes are one stretch over hundreds of counters."""
    rnd = random.Random(slice_spans)
    at, rows = datetime(1969, 12, 31, 22), []
    for i in range(3000):
        at += timedelta(seconds=rnd.choice([0, 0, 1, 7, 20, 59, 61]) if rnd.random() < 0.995 else 400)
        rows.append((i, at, rnd.choice([0, 0, 0, 0, 1, 2, None]), rnd.random() >= success))
    rnd.shuffle(rows)
    rows.append((9000, None, 0, True))
    got = C.count_failures(spark.createDataFrame(rows, SCHEMA), "user_id", F.col("fail"), 3, 60, slice_spans=slice_spans)
    found = {r.event_id: r.fallos for r in got.collect()}
    assert found == replayed(rows, 60)


def test_empty_log(spark):
    assert C.count_failures(spark.createDataFrame([], SCHEMA), "user_id", F.col("fail"), 3, 60).count() == 0
