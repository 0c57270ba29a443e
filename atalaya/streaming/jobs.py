"""Structured Streaming jobs. The same bodies accept a batch table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType

from atalaya.functions import month_start
from atalaya.session import file_system, path_exists, scratch_path


def stream_parquet(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 1_000_000) -> DataFrame:
    """File stream over one table of a folder, whether that is one file or a folder of part files."""
    table = f"{folder}/{name}.parquet"
    found, files = file_system(spark, table)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if files.getFileStatus(found).isDirectory():
        return reader.parquet(table)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream_group_count(df: DataFrame, cols: list[str], count_as: str = "n") -> DataFrame:
    """Mergeable counts per key; on a stream they stay up to date as rows arrive."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count_as))


def window_limit(df: DataFrame, keys: list[str], limit: int, ts: str = "ts",
                 size: str = "1 minute", late: str | None = None) -> DataFrame:
    """Requests per key and epoch-aligned window, flagged above the limit.

    Counts combine before the shuffle, so one hot client costs one row per task and window. A
    finite table is drained without `late`, so no event is lost in whatever order its files come;
    an endless stream names the lateness after which windows close and their state goes.
    """
    if df.isStreaming and late:
        df = df.withWatermark(ts, late)
    counts = df.groupBy(F.window(ts, size), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*keys, F.col("window.start").alias("inicio"), "n",
                         (F.col("n") > limit).alias("excedido"))


def incremental_series(df: DataFrame, keys: list[str], ts: str = "ts", qty: str | None = None,
                       late: str | None = None) -> DataFrame:
    """Daily totals per series that grow as events arrive; only a named lateness closes old days."""
    if df.isStreaming and late:
        df = df.withWatermark(ts, late)
    amount = F.count(F.lit(1)) if qty is None else F.sum(qty)
    # A 1-day event-time window gives the state an expiry; days then roll up to months.
    daily = df.groupBy(*keys, F.window(ts, "1 day").alias("_w")).agg(amount.alias("cantidad"))
    return daily.select(*keys, F.to_date("_w.start").alias("dia"), "cantidad")


def months_of(daily: DataFrame, keys: list[str]) -> DataFrame:
    return daily.groupBy(*keys, month_start(F.col("dia")).alias("periodo")).agg(
        F.sum("cantidad").alias("cantidad"))


def recent_feed(df: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Items of the last days with title and url; `top_feed` keeps the newest of each url."""
    rows = df.where((F.coalesce("titulo", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != ""))
    rows = rows.where((F.col("ts") > now - F.expr(f"interval {days} days")) & (F.col("ts") <= now))
    return rows.withColumn("fecha", F.date_format("ts", "yyyy-MM-dd"))


def top_items(items: DataFrame, n: int = 12) -> DataFrame:
    """Newest n items per region. One item per url is kept first, then Spark prunes to n rows
    per region inside each task before the shuffle."""
    once = items.groupBy("region", "url").agg(
        F.max_by(F.struct("titulo", "fuente", "fecha", "ts"), F.struct("ts", "titulo", "fuente")).alias("i"))
    return numbered(once.select("region", "url", "i.*"), n).drop("orden")


def numbered(rows: DataFrame, n: int) -> DataFrame:
    newest = Window.partitionBy("region").orderBy(F.desc("ts"), "url")
    return rows.withColumn("orden", F.row_number().over(newest)).where(F.col("orden") <= n)


def ranked(rows: DataFrame, n: int = 12) -> DataFrame:
    """Items that `top_items` kept, with their place in the region."""
    return numbered(rows, n).select("region", "orden", "titulo", "url", "fuente", "fecha")


def top_feed(items: DataFrame, n: int = 12) -> DataFrame:
    """The feed of a whole table of items."""
    return ranked(top_items(items, n), n)


def drain(df: DataFrame, base: str, mode: str = "update") -> StreamingQuery:
    """Run a stream over what has arrived and stop. The same `base` goes on where the last run ended.

    Every micro-batch appends its rows with its number. A batch that is replayed after a failure
    overwrites its own folder, so the log holds each batch once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/log/b={number}")

    query = (df.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def drained(df: DataFrame, base: str) -> DataFrame:
    """What the runs of `drain` over `df` wrote; a table without rows leaves an empty log."""
    spark = df.sparkSession
    schema = df.withColumn("_batch", F.lit(0)).schema
    if not path_exists(spark, f"{base}/log"):
        return spark.createDataFrame([], schema.add("b", IntegerType()))
    return spark.read.schema(schema).parquet(f"{base}/log")


def run_available(df: DataFrame, mode: str = "update") -> DataFrame:
    """Drain a stream once and return what it wrote, from the shared checkpoint folder."""
    base = scratch_path(df.sparkSession, "stream")
    drain(df, base, mode)
    return drained(df, base)


def latest_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """Current row of every key in a change log written in update mode."""
    rest = [c for c in log.columns if c not in keys and c not in ("_batch", "b")]
    best = F.max_by(F.struct(*rest), "_batch")
    return log.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[f"_r.{c}" for c in rest])
