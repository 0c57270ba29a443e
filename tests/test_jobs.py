"""Streams against brute force, sinks, and registered queries against their SQL."""

import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from atalaya.bindings import load_all
from atalaya.sources import readers as R, sinks as S
from atalaya.streaming import counters as C, jobs as J

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def stream(spark, tmp_path, rows, schema, files=3):
    """Write rows as several files, in order, and stream them one file at a time."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_group_count_stream(spark, tmp_path):
    rows = [(g,) for g in "aabbaca"]
    log = J.run_available(J.stream_group_count(stream(spark, tmp_path, rows, "g string"), ["g"]))
    got = {r.g: r.n for r in J.latest_rows(log, ["g"]).collect()}
    assert got == {"a": 4, "b": 2, "c": 1}
    counts = R.group_count(spark.createDataFrame(rows, "g string"), ["g"])
    assert R.ingest_reconcile(counts, spark.createDataFrame(rows, "g string")).first().diferencia == 0


def test_lockout_across_batches(spark, tmp_path):
    rnd = random.Random(3)
    start, rows = datetime(2024, 1, 1), []
    for i in range(300):
        start += timedelta(seconds=rnd.randint(1, 40))
        rows.append((i, start, rnd.randint(0, 5), rnd.random() < 0.8))
    schema = "event_id bigint, ts timestamp, user_id bigint, fail boolean"
    s = stream(spark, tmp_path, rows[::-1], schema, 4)  # newest first
    got = {r.event_id: (r.fallos, r.bloqueado) for r in
           C.count_failures(J.run_available(s, "append"), "user_id", F.col("fail"), 3, 300).collect()}
    want, state = {}, {}
    for i, ts, user, fail in rows:
        n, first = state.get(user, (0, ts))
        if n and ts >= first + timedelta(seconds=300):
            n = 0
        if fail:
            first = ts if n == 0 else first
            n += 1
        else:
            n = 0
        state[user] = (n, first)
        want[i] = (n, n >= 3)
    assert got == want


def test_lockout_of_one_long_stretch(spark):
    """A key that never succeeds: its counter expires again and again within one stretch."""
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=40 * i), 1, True) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, fail boolean")
    got = {r.event_id: r.fallos for r in C.count_failures(df, "user_id", F.col("fail"), 3, 300).collect()}
    assert got == {i: i % 8 + 1 for i in range(200)}


def test_drains_lose_nothing(spark, tmp_path):
    """Three files, newest first, as a folder named like the table; a table without rows is fine too."""
    rows = [(datetime(2024, 1, 1) + timedelta(hours=h), "ab"[h % 2]) for h in range(3000)]
    schema = "ts timestamp, k string"
    for i, part in enumerate((rows[2000:], rows[1000:2000], rows[:1000])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "t.parquet"))
    source = lambda: J.stream_parquet(spark, str(tmp_path), "t", schema, 1)
    limited = J.latest_rows(J.run_available(J.window_limit(source(), ["k"], 30, size="1 day")), ["k", "inicio"])
    assert limited.agg(F.sum("n")).first()[0] == 3000
    daily = J.latest_rows(J.run_available(J.incremental_series(source(), ["k"])), ["k", "dia"])
    batch = J.incremental_series(spark.createDataFrame(rows, schema), ["k"])
    assert {tuple(r) for r in daily.collect()} == {tuple(r) for r in batch.collect()}
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none.parquet"))
    empty = J.run_available(J.window_limit(J.stream_parquet(spark, str(tmp_path), "none", schema), ["k"], 3))
    assert J.latest_rows(empty, ["k", "inicio"]).count() == 0


def test_window_limit_same_for_batch_and_stream(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, 0, 0, s % 60) + timedelta(minutes=s // 60), "a" if s % 3 else "b") for s in range(200)]
    batch = {tuple(r) for r in J.window_limit(spark.createDataFrame(rows, "ts timestamp, k string"), ["k"], 30).collect()}
    log = J.run_available(J.window_limit(stream(spark, tmp_path, rows, "ts timestamp, k string"), ["k"], 30))
    assert {tuple(r) for r in J.latest_rows(log, ["k", "inicio"]).collect()} == batch


def test_feed_drops_blank_and_repeated(spark):
    rows = [("r", f"u{i}", f"t{i}", "f", datetime(2024, 1, 10, i % 24)) for i in range(20)]
    rows += [("r", "u1", "t1", "f", datetime(2024, 1, 10, 1)), ("r", "", "t", "f", datetime(2024, 1, 10)), ("r", "z", None, "f", datetime(2024, 1, 10)),
             ("r", "old", "t", "f", datetime(2023, 1, 1))]
    df = spark.createDataFrame(rows, "region string, url string, titulo string, fuente string, ts timestamp")
    out = J.top_feed(J.recent_feed(df, F.lit(datetime(2024, 1, 11)))).orderBy("orden").collect()
    assert len(out) == 12 and out[0].url == "u19" and len({r.url for r in out}) == 12


def test_layers_and_stale_output(spark, tmp_path):
    path = str(tmp_path / "layer")
    S.write_layer(None, path, spark)
    df = spark.createDataFrame([(1, "a")], "a int, b string")
    S.write_layer(df, path)
    assert spark.read.parquet(path).count() == 1
    S.write_layer(None, path, spark)
    assert spark.read.parquet(path).count() == 0


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'di "x", y', None), (2, "z", "w")], "a int, b string, c string")
    S.export_csv(df.coalesce(1), str(tmp_path / "csv"), {"a": "A", "b": "B", "c": "C"})
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.splitlines() == ["A,B,C", '1,"di ""x"", y",', "2,z,w"]


def test_checksums(spark, tmp_path):
    import hashlib
    (tmp_path / "f.bin").write_bytes(b"abc")
    want = spark.createDataFrame([("f.bin", hashlib.sha256(b"abc").hexdigest(), 3), ("g.bin", "x", 1)], "fichero string, sha256 string, bytes bigint")
    got = {r.fichero: r.coincide for r in R.verify_files(spark, str(tmp_path / "*.bin"), want).collect()}
    assert got == {"f.bin": True, "g.bin": False}


CHECKED = ["monthly_series", "territory_summary", "normalize_events", "join_population_clip", "national_kpis", "feature_panel",
           "z_alerts", "join_event_window_category", "paged_alerts", "quantile_classes", "funnel_discards", "cards_funnel",
           "metrics_by_volume", "psi", "health_report", "scenario_projection", "chunk_text", "vector_topk", "resolve_entities",
           "join_fuzzy_levenshtein", "golden_questions", "answer_report", "failure_lockout", "latest_feed", "column_profile"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(row):
    return tuple(x if x is None else repr(round(float(x), 9)) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", CHECKED if not os.environ.get("ALL_QUERIES") else sorted(
    n for n, e in load_all().items() if e.oracle))
def test_query_equals_sql(spark, duck, name):
    entry = load_all()[name]
    df = entry.run(spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(entry.oracle)
    assert cols == sorted(rel.columns)
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({entry.oracle})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(plain, df.select(*cols).collect()), key=key) == sorted(map(plain, want), key=key)
