"""Structured Streaming jobs drained over the event and page tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from atalaya.bindings.registry import query
from atalaya.session import scratch_path
from atalaya.sources.readers import load
from atalaya.streaming import counters as C, gold as G, jobs as J, stateful as S


def event_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return J.stream_parquet(spark, sf, "events", schema).withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_group_count", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    keys = ["event_type", "user_id"]
    log = J.run_available(J.stream_group_count(event_stream(spark, sf), keys))
    return J.latest_rows(log, keys)


LIMIT_SQL = """
    SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS inicio, count(*) AS n, count(*) > 2 AS excedido
    FROM events GROUP BY ALL"""


@query("fixed_window_limit", LIMIT_SQL)
def _(spark, sf):
    keys = ["event_type"]
    log = J.run_available(J.window_limit(event_stream(spark, sf), keys, 2, size="10 minutes"))
    return J.latest_rows(log, [*keys, "inicio"])


@query("fixed_window_limit_batch", LIMIT_SQL)
def _(spark, sf):
    """The same body over the table instead of the stream."""
    events = load(spark, sf, "events", ["ts", "event_type"]).withColumn("ts", F.col("ts").cast("timestamp"))
    return J.window_limit(events, ["event_type"], 2, size="10 minutes")


def drained_events(spark, sf):
    return J.run_available(event_stream(spark, sf).select("event_id", "user_id", "event_type", "ts"), "append")


def counter_sql(fails: str, seconds: int, locked: str) -> str:
    """The counter replayed one event per user and recursion step."""
    return f"""
    WITH RECURSIVE e AS (SELECT user_id, event_id, ts, {fails} AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    s AS (
      SELECT user_id, k, event_id, ts, CASE WHEN f THEN 1 ELSE 0 END AS fallos, ts AS inicio FROM e WHERE k = 1
      UNION ALL
      SELECT e.user_id, e.k, e.event_id, e.ts,
        CASE WHEN NOT f THEN 0 WHEN s.fallos = 0 OR e.ts >= s.inicio + INTERVAL {seconds} SECOND THEN 1 ELSE s.fallos + 1 END,
        CASE WHEN s.fallos = 0 OR e.ts >= s.inicio + INTERVAL {seconds} SECOND THEN e.ts ELSE s.inicio END
      FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT user_id, event_id, CAST(fallos AS INTEGER) AS fallos, {locked} AS bloqueado FROM s"""


@query("failure_lockout", counter_sql("event_type <> 'signup'", 86400, "fallos >= 3"))
def _(spark, sf):
    return C.count_failures(drained_events(spark, sf), "user_id", F.col("event_type") != "signup", 3, 86400)


@query("failure_lockout_stream", counter_sql("event_type <> 'signup'", 86400, "fallos >= 3"))
def _(spark, sf):
    """The lockout with its counters as state of the stream."""
    events = event_stream(spark, sf).select("event_id", "user_id", "event_type", "ts")
    with S.rocksdb_state(spark):
        return J.run_available(
            S.failure_counter(events, "user_id", F.col("event_type") != "signup", 3, 86400, "1 day"), "append").drop("_batch", "b")


@query("first_hit_limit", counter_sql("true", 43200, "fallos > 1"))
def _(spark, sf):
    """Rate limit whose window opens at the first hit of a client."""
    return C.count_failures(drained_events(spark, sf), "user_id", F.lit(True), 1, 43200, strict=True)


FEED_SQL = r"""
    SELECT region, CAST(r AS INTEGER) AS orden, titulo, url, fuente, fecha FROM (
      SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts DESC, url) AS r FROM (
        SELECT DISTINCT ON (region, url) region, url, titulo, fuente, strftime(ts, '%Y-%m-%d') AS fecha, ts FROM (
          SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS region, url, regexp_extract(html, '<title>(.*?)</title>', 1) AS titulo,
            regexp_extract(url, '//([^/]+)', 1) AS fuente, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id % 20000 AS BIGINT)) AS ts FROM pages)
        WHERE titulo <> '' AND url <> '' AND ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 14 DAY AND ts <= TIMESTAMP '2024-01-15 00:00:00'
        ORDER BY region, url, ts DESC, titulo DESC)) WHERE r <= 12"""


def page_items(pages):
    """Press items seen in the page table: title, address, source and a publication time."""
    return pages.select(
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("region"), "url",
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("titulo"),
        F.regexp_extract("url", "//([^/]+)", 1).alias("fuente"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("page_id") % 20000).cast("int"))).alias("ts"))


@query("latest_feed", FEED_SQL)
def _(spark, sf):
    pages = J.stream_parquet(spark, sf, "pages", load(spark, sf, "pages").schema)
    now = F.lit("2024-01-15").cast("timestamp")
    # Items of the window lie within 14 days of each other, so the watermark drops none.
    items = J.recent_feed(page_items(pages), now, 14)
    base = scratch_path(spark, "feed")
    S.keep_feed(items, base, late="14 days")
    return S.feed(spark, base, items)


@query("incremental_series", """
    SELECT event_type, user_id, CAST(date_trunc('month', ts) AS DATE) AS periodo, count(*) AS cantidad FROM events GROUP BY ALL""")
def _(spark, sf):
    keys = ["event_type", "user_id"]
    log = J.run_available(J.incremental_series(event_stream(spark, sf), keys))
    return J.months_of(J.latest_rows(log, [*keys, "dia"]), keys)




@query("incremental_series_upsert", """
    SELECT event_type, user_id, CAST(ts AS DATE) AS dia, count(*) AS cantidad FROM events GROUP BY ALL""")
def _(spark, sf):
    """Daily totals kept in a gold table that every batch merges its own days into."""
    keys = ["event_type", "user_id"]
    events, base = event_stream(spark, sf).select("event_type", "user_id", "ts"), scratch_path(spark, "gold")
    G.upsert_days(events, base, keys)
    return G.gold(events, base, keys).drop("periodo")
