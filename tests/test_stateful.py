"""State that outlives a run: counters with expiry and a feed, over batches with a restart between them."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from atalaya.streaming import jobs as J, stateful as S

EVENTS = "event_id bigint, ts timestamp, user_id bigint, fail boolean"
ITEMS = "region string, url string, titulo string, fuente string, ts timestamp"


def arrive(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def replayed(rows, span):
    """The counter of every user, one event after the other."""
    want, state = {}, {}
    for i, ts, user, fail in rows:
        n, first = state.get(user, (0, ts))
        if n and ts >= first + timedelta(seconds=span):
            n = 0
        if fail:
            first = ts if n == 0 else first
        n = n + 1 if fail else 0
        state[user] = (n, first)
        want[i] = (n, n >= 3)
    return want


def test_counter_goes_on_after_restarts(spark, tmp_path):
    rnd = random.Random(5)
    at, rows = datetime(2024, 1, 1), []
    for i in range(240):
        at += timedelta(seconds=rnd.randint(1, 40))
        rows.append((i, at, rnd.choice([0, 0, 1, 2, 3]), rnd.random() < 0.8))  # one user has much of it
    base, folder = str(tmp_path / "job"), tmp_path / "in"
    sizes = []
    for part in (rows[:80], rows[80:160], rows[160:]):
        arrive(spark, folder, part[::-1], EVENTS)
        counted = S.failure_counter(spark.readStream.schema(EVENTS).parquet(str(folder)), "user_id", F.col("fail"), 3, 300, "0 seconds")
        with S.rocksdb_state(spark):
            query = J.drain(counted, base, "append")
        sizes.append(S.state_rows(query))
        assert S.late_rows(query) == 0
    got = {r.event_id: (r.fallos, r.bloqueado) for r in J.drained(counted, base).collect()}
    assert got == replayed(rows, 300)
    # Long after all of them only the newest user has a counter; a late row is dropped and counted.
    arrive(spark, folder, [(900, at + timedelta(days=1), 9, True)], EVENTS)
    with S.rocksdb_state(spark):
        assert S.state_rows(J.drain(counted, base, "append")) < max(sizes)
    arrive(spark, folder, [(901, at, 9, True)], EVENTS)
    with S.rocksdb_state(spark):
        assert S.late_rows(J.drain(counted, base, "append")) == 1
    got = {r.event_id: r.fallos for r in J.drained(counted, base).collect()}
    assert got[900] == 1 and 901 not in got


def test_counter_without_rows_and_with_nulls(spark, tmp_path):
    arrive(spark, tmp_path / "in", [(1, None, 1, True), (2, datetime(2024, 1, 1), None, True), (3, datetime(2024, 1, 1), 1, None),
                                    (4, datetime(2024, 1, 1), 1, True), (5, datetime(2024, 1, 1), 1, True)], EVENTS)
    spark.createDataFrame([], EVENTS).write.parquet(str(tmp_path / "none"))
    for name, want in (("in", {3: 0, 4: 1, 5: 2}), ("none", {})):
        counted = S.failure_counter(spark.readStream.schema(EVENTS).parquet(str(tmp_path / name)), "user_id", F.col("fail"), 3, 300, "1 hour")
        with S.rocksdb_state(spark):
            got = J.run_available(counted, "append")
        assert {r.event_id: r.fallos for r in got.collect()} == want


def test_feed_merges_batches(spark, tmp_path):
    rnd = random.Random(2)
    start = datetime(2024, 1, 10)
    rows = [(rnd.choice("rs"), f"u{rnd.randint(0, 40)}", f"t{rnd.randint(0, 3)}", "f", start + timedelta(minutes=rnd.randint(0, 5000)))
            for _ in range(200)]
    rows += rows[:50]  # repeated items
    base, folder = str(tmp_path / "job"), tmp_path / "in"
    now = F.lit(start + timedelta(days=6))
    source = lambda: J.recent_feed(spark.readStream.schema(ITEMS).parquet(str(folder)), now)
    arrive(spark, folder, [], ITEMS)
    assert S.feed(spark, base, source()).count() == 0
    for i in range(3):
        arrive(spark, folder, rows[i::3], ITEMS)
        S.keep_feed(source(), base, 5, "7 days")
        seen = [r for j in range(i + 1) for r in rows[j::3]]
        want = J.top_feed(J.recent_feed(spark.createDataFrame(seen, ITEMS), now), 5)
        assert {tuple(r) for r in S.feed(spark, base, source(), 5).collect()} == {tuple(r) for r in want.collect()}
    assert spark.read.parquet(f"{base}/feed/{S.finished(spark, base)}").count() <= 2 * 5
