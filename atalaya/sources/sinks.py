"""Layer tables, relational loads, JSON reports and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atalaya.session import file_system, path_exists


def write_layer(df: DataFrame | None, path: str, spark: SparkSession | None = None) -> None:
    """Overwrite a layer table; `None` empties an optional output whose input is gone."""
    if df is not None:
        df.write.mode("overwrite").parquet(path)
        return
    session = spark or SparkSession.active()
    if not path_exists(session, path):  # the optional output was never written
        return
    schema = session.read.parquet(path).schema
    session.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, table: str, cols: list[str]) -> None:
    """Load the selected columns into a catalog table; one that exists is emptied and keeps its definition."""
    rows = df.select(*cols)
    if df.sparkSession.catalog.tableExists(table):
        rows.write.mode("overwrite").insertInto(table, overwrite=True)
    else:
        rows.write.saveAsTable(table)


def load_table(df: DataFrame, table: str, cols: list[str], base: str) -> str:
    """Load a catalog table whole or not at all: a new version is written beside the old one, then the table points to it.

    Until the last statement the table has its old rows, whatever is lost before it; the version
    replaced stays for its readers until the next load. A table that exists keeps its columns and
    types; no rows empty it. One load of a table at a time. Returns the folder of the version.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    rows = df.select(*cols)
    if exists:
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in spark.table(table).schema])
    found, files = file_system(spark, f"{base}/v*")
    versions = sorted(status.getPath().toString() for status in files.globStatus(found) or [])
    new = f"{base}/v{int(versions[-1].rsplit('/v', 1)[1]) + 1 if versions else 1:09d}"
    rows.write.parquet(new)
    if not exists:
        spark.catalog.createTable(table, new, "parquet", rows.schema)
        return new
    old = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"]
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{new}'")
    spark.catalog.refreshTable(table)
    for path in versions:  # versions before the one replaced, and what broken loads left
        if path.rsplit("/", 1)[1] != old.rsplit("/", 1)[1]:
            files.delete(file_system(spark, path)[0], True)
    return new


def write_jdbc(df: DataFrame, url: str, table: str, cols: list[str],
               properties: dict[str, str] | None = None, partitions: int = 8) -> None:
    """Truncate and load over a bounded number of connections."""
    (df.select(*cols).repartition(partitions).write.mode("overwrite").option("truncate", True)
     .jdbc(url, table, properties=properties or {}))


def report_json(df: DataFrame) -> DataFrame:
    """One JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_report(df: DataFrame, path: str) -> None:
    report_json(df).write.mode("overwrite").text(path)


def export_csv(df: DataFrame, path: str, labels: dict[str, str]) -> None:
    """CSV with header labels, doubled quotes and empty nulls."""
    renamed = df.select(*[F.col(c).alias(label) for c, label in labels.items()])
    (renamed.write.mode("overwrite").option("header", True).option("quote", '"')
     .option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path))


def csv_lines(df: DataFrame) -> DataFrame:
    """The same rows as CSV text, for a download."""
    options = {"quote": '"', "escape": '"', "nullValue": "", "emptyValue": ""}
    return df.select(F.to_csv(F.struct(*df.columns), options).alias("linea"))
