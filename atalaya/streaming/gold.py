"""Daily totals of a stream, merged into a gold table of which a batch rewrites only the months it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from atalaya.functions import month_start
from atalaya.session import cut_lineage, file_system, path_exists

MARK = "lote bigint, filas bigint, tardias bigint, sin_fecha bigint, ultimo timestamp"


def months_written(spark: SparkSession, base: str, upto: int) -> dict[str, int]:
    """The batch that holds the current rows of each month, from folder names alone."""
    found, files = file_system(spark, f"{base}/gold/b=*/periodo=*")
    newest: dict[str, int] = {}
    for status in files.globStatus(found) or []:
        path = status.getPath()
        number = int(path.getParent().getName().removeprefix("b="))
        month = path.getName().removeprefix("periodo=")
        if number <= upto:
            newest[month] = max(number, newest.get(month, -1))
    return newest


def current(spark: SparkSession, base: str, schema: StructType, upto: int, months: set[str] | None = None) -> DataFrame:
    """Rows of the gold table after batch `upto`, of all months or some."""
    newest = months_written(spark, base, upto)
    paths = [f"{base}/gold/b={b}/periodo={m}" for m, b in sorted(newest.items()) if months is None or m in months]
    if not paths:
        return spark.createDataFrame([], schema)
    full = StructType([*schema.fields]).add("b", IntegerType())
    return spark.read.schema(full).option("basePath", f"{base}/gold").parquet(*paths).select(*schema.names)


def mark_of(spark: SparkSession, base: str, number: int):
    """What a finished batch left: rows taken and dropped so far, and the newest time seen."""
    path = f"{base}/marks/{number}"
    return spark.read.schema(MARK).parquet(path).first() if number >= 0 and path_exists(spark, path) else None


def marks(spark: SparkSession, base: str) -> DataFrame:
    """One row per finished batch with running totals of rows taken, late rows and rows without a time."""
    if not path_exists(spark, f"{base}/marks"):
        return spark.createDataFrame([], MARK)
    return spark.read.schema(MARK).parquet(f"{base}/marks/*")


def upsert_days(df: DataFrame, base: str, keys: list[str], ts: str = "ts", late: str | None = None) -> StreamingQuery:
    """Drain a stream into daily totals per series; `gold` reads them and `marks` tells what was dropped.

    A batch counts its own rows by day, adds them to the current rows of the months they fall in
    and writes those months whole under its own number; other months are neither read nor written.
    It reads only what earlier batches wrote, so a replayed batch writes the same again, and it is
    valid once its mark stands. With `late`, rows older than the newest time of all earlier batches
    by more than that are dropped and counted; rows without a time always are. Null keys are keys.
    """
    schema = df.select(*keys, F.to_date(ts).alias("dia"), F.lit(0).cast("bigint").alias("cantidad"),
                       F.to_date(ts).alias("periodo")).schema

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = mark_of(spark, base, number - 1)
        newest = before["ultimo"] if before else None
        is_late = F.lit(False)
        if late and newest is not None:
            is_late = F.coalesce(F.col(ts) < F.lit(newest) - F.expr(f"interval {late}"), F.lit(False))
        days = cut_lineage(batch.groupBy(*keys, F.to_date(ts).alias("dia"), is_late.alias("tarde")).agg(
            F.count(F.lit(1)).alias("cantidad"), F.max(ts).cast("timestamp").alias("ultimo")))
        taken = F.col("dia").isNotNull() & ~F.col("tarde")
        seen = days.agg(*[F.coalesce(F.sum(F.when(c, F.col("cantidad"))), F.lit(0)).alias(n) for n, c in (
            ("filas", taken), ("tardias", F.col("tarde")), ("sin_fecha", F.col("dia").isNull()))], F.max("ultimo").alias("ultimo")).first()
        fresh = days.where(taken).select(*keys, "dia", "cantidad", month_start(F.col("dia")).alias("periodo"))
        months = {str(r[0]) for r in fresh.select("periodo").distinct().collect()}
        merged = fresh.unionByName(current(spark, base, schema, number - 1, months)).groupBy(*keys, "dia", "periodo").agg(
            F.sum("cantidad").alias("cantidad"))
        merged.write.mode("overwrite").partitionBy("periodo").parquet(f"{base}/gold/b={number}")
        totals = [seen[c] + (before[c] if before else 0) for c in ("filas", "tardias", "sin_fecha")]
        times = [t for t in (newest, seen["ultimo"]) if t is not None]
        spark.createDataFrame([(number, *totals, max(times, default=None))], MARK).coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/{number}")

    query = (df.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def gold(df: DataFrame, base: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """The daily totals that the finished batches of `upsert_days` left."""
    spark = df.sparkSession
    schema = df.select(*keys, F.to_date(ts).alias("dia"), F.lit(0).cast("bigint").alias("cantidad"), F.to_date(ts).alias("periodo")).schema
    last = marks(spark, base).agg(F.max("lote")).first()[0]
    return current(spark, base, schema, -1 if last is None else last)
