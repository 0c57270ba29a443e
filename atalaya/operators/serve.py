"""Dashboard queries: rankings, pages, searches, class breaks and spliced histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from atalaya.functions import period_str, unaccent_lower
from atalaya.operators.quantiles import exact_quantiles, step_class
from atalaya.session import cut_lineage

# Columns a caller may sort alerts by.
# The largest page and offset that are served.
MAX_PAGE, MAX_OFFSET = 200, 1_000_000
SORT_COLUMNS = ["periodo", "municipio", "departamento", "categoria", "cantidad", "score_z",
                "severidad"]
SEARCH_COLUMNS = ["municipio", "departamento", "categoria"]


def top_territories(summary: DataFrame, n: int = 20) -> DataFrame:
    """Largest territories by crimes; n is clamped to 1..5000."""
    crimes = F.coalesce(F.col("total_delitos"), F.col("total_hechos"))
    out = summary.withColumns({
        "total_delitos": crimes, "total_respuestas": F.coalesce("total_respuestas", F.lit(0))})
    return out.orderBy(F.desc("total_delitos"), "cod_municipio").limit(max(1, min(int(n), 5000)))


def territory_names(summary: DataFrame) -> DataFrame:
    return summary.select("cod_municipio", "municipio", "departamento").orderBy(
        "municipio", "cod_municipio")


def time_series(panel: DataFrame, code: str, category: str) -> DataFrame:
    return (
        panel.where((F.col("cod_municipio") == code) & (F.col("categoria") == category))
        .select(period_str(F.col("periodo")).alias("periodo"), "cantidad").orderBy("periodo")
    )


def search(df: DataFrame, q: str = "", severity: str = "",
           columns: list[str] = SEARCH_COLUMNS) -> DataFrame:
    """Accent-insensitive substring search over several columns, plus a severity filter."""
    if severity in ("ALTA", "MEDIA"):
        df = df.where(F.col("severidad") == severity)
    text = q.strip()
    if text:
        needle = unaccent_lower(F.lit(text))
        df = df.where(reduce(lambda a, b: a | b,
                             [F.contains(unaccent_lower(F.col(c)), needle) for c in columns]))
    return df


def alerts(anomalies: DataFrame, severity: str = "", q: str = "", sort: str = "periodo",
           direction: str = "desc", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One stable page of alerts and the total behind it."""
    found = search(anomalies, q, severity)
    column = sort if sort in SORT_COLUMNS else "periodo"
    first = F.col(column).asc() if direction.lower() == "asc" else F.col(column).desc()
    ordered = found.orderBy(first, F.desc("periodo"), "cod_municipio", "categoria")
    page_rows = ordered.offset(max(0, min(int(offset), MAX_OFFSET))).limit(max(1, min(int(limit), MAX_PAGE)))
    shown = page_rows.select("cod_municipio", "municipio", "departamento", "categoria",
                             period_str(F.col("periodo")).alias("periodo"), "cantidad", "score_z",
                             "severidad")
    return shown, found.agg(F.count(F.lit(1)).alias("total"))


def client_page(df: DataFrame, order: list, page: int, size: int) -> DataFrame:
    """Page rows with from/to/total; a page past the end becomes the last page."""
    # Rows carry their position, so a deep page is a filter and not a long list for one task.
    rows = global_rank(df, order, "_pos")
    total = rows.count()
    pages = max(1, -(-total // size))
    page = max(1, min(page, pages))
    start = (page - 1) * size
    return rows.where(F.col("_pos").between(start + 1, start + size)).orderBy("_pos").drop("_pos").withColumns({
        "pagina": F.lit(page), "desde": F.lit(min(start + 1, total)),
        "hasta": F.lit(min(start + size, total)), "total": F.lit(total)})


def global_rank(df: DataFrame, order: list, out: str = "puesto") -> DataFrame:
    """1-based position in a total order, without an unpartitioned window.

    The range-sorted table is checkpointed, so partition ids are fixed; each partition is numbered
    on its own and shifted by the size of the partitions before it. Only one count per partition
    is ordered globally.
    """
    rows = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    shard = F.shiftright("_id", 33)
    sizes = rows.groupBy(shard.alias("_shard")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_shard")) - F.col("_n")
    offsets = sizes.select("_shard", before.alias("_before"))
    local = F.col("_id").bitwiseAND((1 << 33) - 1)
    return (
        rows.withColumn("_shard", shard).join(offsets, "_shard")
        .withColumn(out, F.col("_before") + local + 1).drop("_shard", "_before", "_id")
    )


def national_rank(summary: DataFrame) -> DataFrame:
    return global_rank(summary, [F.desc("total_delitos"), "cod_municipio"]).select(
        "cod_municipio", "municipio", "total_delitos", "puesto")


def category_ranking(totals: DataFrame, n: int = 15) -> DataFrame:
    """Top territories per category with the national total.

    `totals` holds one row per (territory, category), so a window partition is bounded by the
    number of territories and Spark keeps only n rows per task before the shuffle.
    """
    per_place = totals.groupBy("categoria", "municipio", "departamento").agg(
        F.sum("total").alias("total"))
    order = Window.partitionBy("categoria").orderBy(F.desc("total"), "municipio", "departamento")
    top = per_place.withColumn("puesto", F.row_number().over(order)).where(F.col("puesto") <= n)
    national = totals.groupBy("categoria").agg(F.sum("total").alias("total_nacional"))
    return top.join(national, "categoria")


def category_leader(totals: DataFrame) -> DataFrame:
    """Arg-max territory per category, ties to the smaller name."""
    per_name = totals.groupBy("categoria", "municipio").agg(F.sum("total").alias("total"))
    best = F.min_by(F.struct("municipio", "total"),
                    F.struct((-F.col("total")).alias("t"), "municipio"))
    return per_name.groupBy("categoria").agg(best.alias("b")).select("categoria", "b.municipio", "b.total")


def top_category_reference(cat_year: DataFrame, n: int = 3) -> DataFrame:
    """The n largest categories and their count two years before the last one."""
    ref_year = cat_year.agg(F.max("anio") - 2).scalar()
    return (
        cat_year.groupBy("categoria").agg(
            F.sum("cantidad").alias("total"),
            F.sum(F.when(F.col("anio") == ref_year, F.col("cantidad"))).alias("cantidad"))
        .withColumn("anio", ref_year)
        .orderBy(F.desc("total"), "categoria").limit(n)
    )


def quantile_classes(df: DataFrame, col: str, n: int = 7) -> DataFrame:
    """Class of every row by equal-count breaks, with the rounded bounds of its class."""
    breaks = exact_quantiles(df, F.col(col), [i / n for i in range(1, n)])
    if breaks[0] is None:
        breaks = []
    table = F.array(*[F.lit(float(b)) for b in breaks]) if breaks else F.array().cast("array<double>")
    out = df.withColumn("clase", step_class(F.col(col), breaks))
    lower = F.when(F.col("clase") == 0, F.lit(0)).otherwise(
        F.round(F.get(table, F.col("clase") - 1)).cast("bigint") + 1)
    upper = F.round(F.get(table, F.col("clase"))).cast("bigint")
    return out.withColumns({"desde": lower.cast("bigint"), "hasta": upper})


def splice(panel: DataFrame, forecasts: DataFrame, tail: int = 24,
           keys: list[str] | None = None) -> DataFrame:
    """Last observed months followed by the forecast, joined at the last observed month."""
    keys = keys or ["cod_municipio", "categoria"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("periodo"))
    observed = panel.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= tail)
    # A series only gets the splice point when it has a forecast to attach.
    known = forecasts.select(*keys).distinct().withColumn("_has", F.lit(True))
    observed = observed.join(known, keys, "left").select(
        *keys, "periodo", F.col("cantidad").cast("double").alias("historico"),
        F.when((F.col("_r") == 1) & F.col("_has"), F.col("cantidad").cast("double")).alias("pronostico"),
        F.lit(None).cast("double").alias("limite_inferior"),
        F.lit(None).cast("double").alias("limite_superior"))
    ahead = forecasts.select(
        *keys, "periodo", F.lit(None).cast("double").alias("historico"),
        F.col("prediccion").alias("pronostico"), "limite_inferior", "limite_superior")
    return observed.unionByName(ahead)
