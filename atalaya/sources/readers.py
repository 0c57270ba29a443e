"""Layer tables, commented CSV, headerless sheets, reference dimensions, lineage and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from atalaya.functions import number, parse_coord, strip_marks
from atalaya.functions.territory import pad_code

HEADER_SEARCH_ROWS = 30


def load(spark: SparkSession, folder: str, name: str, cols: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df if cols is None else df.select(*cols)


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """Documented events: comment lines skipped, codes kept as text."""
    schema = ("cod_municipio string, periodo string, categoria string, descripcion string, "
              "fuente string")
    return spark.read.schema(schema).option("header", True).option("comment", "#").csv(path)


def parse_population(cells: DataFrame) -> DataFrame:
    """Population rows of a sheet given as (row_id, cells): header found by cell names.

    The header is one row, read as a scalar subquery, so the sheet itself is only scanned.
    """
    names = F.transform("cells", lambda c: F.trim(strip_marks(c, lower=False)))
    sheet = cells.withColumn("_names", names)
    is_header = (F.array_contains("_names", "MPIO")
                 & F.exists("_names", lambda c: c.startswith("POBLACI"))
                 & (F.col("row_id") < HEADER_SEARCH_ROWS))
    header = sheet.where(is_header).agg(
        F.min_by(F.struct("row_id", "_names"), "row_id")).scalar()
    sheet = sheet.withColumn("_header", header)
    titles = F.col("_header._names")

    def cell(test) -> Column:
        positions = F.filter(F.sequence(F.lit(1), F.size(titles)),
                             lambda i: test(F.element_at(titles, i)))
        return F.get(F.col("cells"), F.element_at(positions, 1) - 1)

    body = sheet.where(F.col("row_id") > F.col("_header.row_id")).select(
        cell(lambda t: t == "MPIO").alias("code"), cell(lambda t: t == "ANO").alias("year"),
        cell(lambda t: t.contains("AREA")).alias("area"),
        cell(lambda t: t.startswith("POBLACI")).alias("people"))
    body = body.where(F.trim(strip_marks(F.col("area"), lower=False)) == "TOTAL")
    out = body.select(
        pad_code(F.regexp_replace("code", r"\D", ""), 5).alias("cod_municipio"),
        number(F.col("year")).try_cast("bigint").alias("anio"),
        number(F.col("people")).try_cast("bigint").alias("poblacion"))
    return out.where("cod_municipio IS NOT NULL AND anio IS NOT NULL AND poblacion > 0 "
                     "AND NOT startswith(cod_municipio, '00')")


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key; the latest in `order` wins. `max_by` combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[f"_b.{c}" for c in rest])


def dedupe_prefer(df: DataFrame, key: str, preferred: Column, order: list[str]) -> DataFrame:
    """One row per key, preferring rows that meet a condition, then the first in `order`."""
    rest = [c for c in df.columns if c != key]
    rank = F.struct((~F.coalesce(preferred, F.lit(False))).cast("int").alias("r"), *order)
    best = F.min_by(F.struct(*rest), rank)
    return df.groupBy(key).agg(best.alias("_b")).select(key, *[f"_b.{c}" for c in rest])


def territory_reference(raw: DataFrame) -> DataFrame:
    """Official names and coordinates, one row per territory, the head town (CM) preferred."""
    def digits(name: str, width: int) -> Column:
        return pad_code(F.regexp_replace(name, r"\D", ""), width)

    rows = raw.select(
        digits("codigo_municipio", 5).alias("cod_municipio"),
        digits("codigo_departamento", 2).alias("cod_departamento"),
        F.trim("nombre_municipio").alias("municipio"),
        F.trim("nombre_departamento").alias("departamento"),
        parse_coord(F.col("latitud")).alias("lat"), parse_coord(F.col("longitud")).alias("lon"),
        F.col("tipo_centro_poblado").alias("_tipo"))
    order = ["municipio", "departamento", "lat", "lon"]
    return dedupe_prefer(rows, "cod_municipio", F.col("_tipo") == "CM", order).drop("_tipo")


def cap_rows(df: DataFrame, order: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """First `cap` rows in order, and whether the source may have been cut."""
    kept = df.orderBy(*order).limit(cap)
    flag = kept.agg(F.count(F.lit(1)).alias("rows")).withColumns(
        {"row_cap": F.lit(cap), "capped": F.col("rows") >= cap})
    return kept, flag


def lineage(df: DataFrame, source_id: str, cap: int | None = None) -> DataFrame:
    """Rows, columns, cap and a fingerprint that ignores row order but counts repeats.

    Row hashes are summed, not xor-ed: a pair of equal rows would cancel under xor.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns])
    digest = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("content_hash"),
    ).select(
        F.lit(source_id).alias("fuente"), "rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("columns"), F.lit(cap).cast("int").alias("row_cap"),
        (F.lit(cap).isNotNull() & (F.col("rows") >= F.coalesce(F.lit(cap), F.lit(0)))).alias("capped"),
        "content_hash")


def verify_files(spark: SparkSession, path: str, expected: DataFrame, name: Column | None = None) -> DataFrame:
    """SHA-256 and size of raw files next to the published values (fichero, sha256, bytes).

    `name` is an expression over `path`; the last part of the path is the default. A file is one
    row, so files of 2 GiB and more are beyond it.
    """
    name = F.regexp_extract("path", "[^/]+$", 0) if name is None else name
    files = spark.read.format("binaryFile").load(path).select(
        name.alias("fichero"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    other = expected.select("fichero", F.col("sha256").alias("sha256_publicado"),
                            F.col("bytes").alias("bytes_publicados"))
    return files.join(other, "fichero", "full_outer").withColumn(
        "coincide", F.coalesce((F.col("sha256") == F.col("sha256_publicado"))
                               & (F.col("bytes") == F.col("bytes_publicados")), F.lit(False)))


def group_count(df: DataFrame, cols: list[str], count_as: str = "n") -> DataFrame:
    """Counts per group of a huge source: only the group columns are read, partial counts merge."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(count_as))


def ingest_reconcile(counts: DataFrame, source: DataFrame, count_as: str = "n") -> DataFrame:
    """Sum of the group counts against an independent row count."""
    read = source.agg(F.count(F.lit(1)).alias("c")).scalar()
    return counts.agg(F.sum(count_as).alias("source_rows")).withColumn("source_count", read).withColumn(
        "diferencia", F.col("source_rows") - F.col("source_count"))


