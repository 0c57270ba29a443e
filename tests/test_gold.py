"""Daily totals merged batch by batch: restarts, replays, late rows and untouched months."""

import shutil
from collections import Counter
from datetime import datetime, timedelta

from atalaya.streaming import gold as G

SCHEMA = "k string, ts timestamp"


def test_batches_replays_and_late_rows(spark, tmp_path):
    base, folder = str(tmp_path / "job"), tmp_path / "in"
    folder.mkdir()
    source = lambda: spark.readStream.schema(SCHEMA).parquet(str(folder))
    assert G.gold(source(), base, ["k"]).count() == 0
    start = datetime(2024, 1, 30)
    parts = [[("ab"[h % 2], start + timedelta(hours=h)) for h in range(60)],
             [(None, start + timedelta(hours=50 + h)) for h in range(30)] + [("a", start)],  # the last one is two days late
             [("a", datetime(2024, 3, 5)), ("b", None)]]
    want = Counter()
    for number, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        G.upsert_days(source(), base, ["k"], late="1 day")
        want += Counter((k, t.date()) for k, t in part if t and (k, t) != ("a", start) or number == 0)
        got = {(r.k, r.dia): r.cantidad for r in G.gold(source(), base, ["k"]).collect()}
        assert got == want
    last = G.marks(spark, base).orderBy("lote").collect()
    assert [(r.filas, r.tardias, r.sin_fecha) for r in last] == [(60, 0, 0), (90, 1, 0), (91, 1, 1)]
    # The second batch wrote February only, the third March only.
    assert G.months_written(spark, base, 9) == {"2024-01-01": 0, "2024-02-01": 1, "2024-03-01": 2}
    # A driver lost after writing but before its commit replays the batch: nothing changes.
    for name in ("2", ".2.crc"):
        (tmp_path / "job" / "state" / "commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "job" / "marks" / "2")
    G.upsert_days(source(), base, ["k"], late="1 day")
    assert {(r.k, r.dia): r.cantidad for r in G.gold(source(), base, ["k"]).collect()} == want
    assert [tuple(r) for r in G.marks(spark, base).orderBy("lote").collect()] == [tuple(r) for r in last]
