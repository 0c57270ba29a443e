"""Monthly panels and rollups built from the unified event table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window, functions as F

from atalaya.constants import CRIME, PANEL_KEY, SERIES_KEY
from atalaya.functions import month_start, nature, period_str, region


def monthly_counts(events: DataFrame, keys: list[str] = PANEL_KEY, ts: str = "fecha",
                   qty: str = "cantidad") -> DataFrame:
    """Observed cells only. Partial aggregation collapses a hot key before the shuffle."""
    return (
        events.groupBy(*keys, month_start(F.col(ts)).alias("periodo"))
        .agg(F.sum(qty).alias("cantidad"))
    )


def fill_months(cells: DataFrame, keys: list[str], month: str = "periodo",
                qty: str = "cantidad") -> DataFrame:
    """Insert zero months between observed months of each series, never outside its own range.

    Every observed month also emits the empty months up to the next observed one, so the fill is
    one window and one explode, with no self-join, and null keys survive.
    """
    following = F.lead(month).over(Window.partitionBy(*keys).orderBy(month))
    # A null month stays a single row, as there is no range to fill.
    last = F.coalesce(F.add_months(following, -1), F.col(month))
    spread = cells.withColumn("_last", last).select(
        *keys, F.col(qty).alias("_qty"),
        F.posexplode_outer(F.sequence(F.col(month), F.col("_last"), F.expr("interval 1 month"))),
    )
    return spread.select(
        *keys, F.col("col").alias(month),
        F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("_qty")).otherwise(F.lit(0))
        .cast("bigint").alias(qty),
    )


def monthly_series(events: DataFrame, response: Iterable[str], keys: list[str] = PANEL_KEY,
                   ts: str = "fecha", qty: str = "cantidad", category: str = "categoria") -> DataFrame:
    """Gap-filled series per territory and category, with calendar parts and nature."""
    cells = monthly_counts(events, keys, ts, qty)
    if set(SERIES_KEY) <= set(keys):
        # Clustered by series here, the fill and every later series window need no further shuffle.
        cells = cells.repartition(*SERIES_KEY)
    filled = fill_months(cells, keys)
    return (
        filled.withColumn("anio", F.year("periodo").cast("bigint"))
        .withColumn("mes", F.month("periodo").cast("bigint"))
        .withColumn("naturaleza", nature(F.col(category), response))
    )


def attach_population(panel: DataFrame, population: DataFrame, code: str = "cod_municipio",
                      year: str = "anio") -> DataFrame:
    """Left join on (code, nearest year that the denominator covers).

    Spark broadcasts a denominator that its size statistics show to be small; otherwise it sort-merges.
    """
    span = population.agg(F.struct(F.min(year).alias("lo"), F.max(year).alias("hi")))
    lookup = population.select(
        F.col(code).alias("_code"), F.col(year).alias("_year"),
        F.col("poblacion").cast("double").alias("poblacion"),
    )
    limits = span.scalar()
    return (
        panel.withColumn("_clip", F.least(F.greatest(F.col(year), limits.getField("lo")),
                                          limits.getField("hi")))
        .join(lookup, (F.col(code) == F.col("_code")) & (F.col("_clip") == F.col("_year")), "left")
        .drop("_clip", "_code", "_year")
    )


def canonical_name(events: DataFrame, code: str = "cod_municipio") -> DataFrame:
    """Most frequent (name, region) per code, ties to the smaller name."""
    counted = events.groupBy(code, "municipio", "departamento").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(
        F.struct("municipio", "departamento"),
        F.struct((-F.col("n")).alias("n"), "municipio", "departamento"),
    )
    return counted.groupBy(code).agg(best.alias("_best")).select(
        code, F.col("_best.municipio").alias("municipio"),
        F.col("_best.departamento").alias("departamento"),
    )


def territory_summary(events: DataFrame, response: Iterable[str]) -> DataFrame:
    """Totals by nature, distinct crime categories, year range and canonical name per territory.

    One scan and no join: events shrink to (territory, name, category), then to (territory, name)
    with the set of its crime categories, then to the territory. The sets hold category names only.
    """
    is_response = F.col("categoria").isin(*response)
    cube = events.groupBy("cod_municipio", "municipio", "departamento", "categoria").agg(
        F.sum("cantidad").alias("q"), F.count(F.lit(1)).alias("n"),
        F.min("anio").alias("lo"), F.max("anio").alias("hi"),
    )
    named = cube.groupBy("cod_municipio", "municipio", "departamento").agg(
        F.sum("q").alias("q"), F.sum(F.when(is_response, 0).otherwise(F.col("q"))).alias("crimes"),
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.collect_set(F.when(~is_response, F.col("categoria"))).alias("kinds"),
    )
    best = F.min_by(F.struct("municipio", "departamento"),
                    F.struct((-F.col("n")).alias("n"), "municipio", "departamento"))
    return named.groupBy("cod_municipio").agg(
        F.sum("q").alias("total_hechos"), F.sum("crimes").alias("total_delitos"),
        F.sum(F.col("q") - F.col("crimes")).alias("total_respuestas"),
        F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).cast("bigint").alias("categorias"),
        F.min("lo").alias("primer_anio"), F.max("hi").alias("ultimo_anio"), best.alias("_best"),
    ).select("cod_municipio", "total_hechos", "total_delitos", "total_respuestas", "categorias",
             "primer_anio", "ultimo_anio", "_best.municipio", "_best.departamento")


def attach_coords(summary: DataFrame, reference: DataFrame) -> DataFrame:
    return summary.join(reference.select("cod_municipio", "lat", "lon"), "cod_municipio", "left")


def category_year(events: DataFrame, response: Iterable[str]) -> DataFrame:
    return (
        events.groupBy("categoria", "anio").agg(F.sum("cantidad").alias("cantidad"))
        .withColumn("naturaleza", nature(F.col("categoria"), response))
    )


def nature_share(events: DataFrame, response: Iterable[str]) -> DataFrame:
    """Total and percentage by nature; the grand total is a scalar over the two-row result."""
    totals = events.groupBy(nature(F.col("categoria"), response).alias("naturaleza")).agg(
        F.sum("cantidad").alias("hechos"))
    grand = F.sum("hechos").over(Window.partitionBy(F.lit(1)))
    return totals.withColumn("participacion_pct", F.round(100 * F.col("hechos") / grand, 2))


def national_kpis(summary: DataFrame, panel: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row of dashboard totals. Three one-row aggregates are read as scalar subqueries."""
    panel_row = panel.agg(F.struct(
        F.count_distinct(F.when(F.col("naturaleza") == CRIME, F.col("categoria"))).alias("c"),
        F.min("periodo").alias("lo"), F.max("periodo").alias("hi"),
    ))
    alert_row = anomalies.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severidad") == "ALTA").alias("alta"),
        F.count_if(F.col("severidad") == "MEDIA").alias("media"),
    ))
    crimes = F.coalesce(F.col("total_delitos"), F.col("total_hechos"))
    base = summary.agg(
        F.count(F.lit(1)).alias("municipios"),
        F.count_distinct(region(F.col("cod_municipio"))).alias("departamentos"),
        F.coalesce(F.sum("total_hechos"), F.lit(0)).alias("total_hechos"),
        F.coalesce(F.sum(crimes), F.lit(0)).alias("total_delitos"),
        F.coalesce(F.sum(F.coalesce(F.col("total_respuestas"), F.lit(0))), F.lit(0))
        .alias("total_respuestas"),
    )
    base = base.withColumn("_p", panel_row.scalar()).withColumn("_a", alert_row.scalar())
    return base.select(
        "municipios", "departamentos", F.col("_p.c").alias("categorias"),
        "total_hechos", "total_delitos", "total_respuestas",
        F.col("_a.n").alias("anomalias"), F.col("_a.alta").alias("anomalias_alta"),
        F.col("_a.media").alias("anomalias_media"),
        F.coalesce(period_str(F.col("_p.lo")), F.lit("")).alias("periodo_min"),
        F.coalesce(period_str(F.col("_p.hi")), F.lit("")).alias("periodo_max"),
    )


def region_rollup(summary: DataFrame) -> DataFrame:
    crimes = F.coalesce(F.col("total_delitos"), F.col("total_hechos"))
    return (
        summary.where("cod_municipio IS NOT NULL")
        .groupBy(region(F.col("cod_municipio")).alias("cod_departamento"))
        .agg(F.min("departamento").alias("departamento"), F.sum(crimes).alias("total_delitos"),
             F.count(F.lit(1)).alias("municipios"))
    )


def category_list(panel: DataFrame, code: str | None = None) -> DataFrame:
    rows = panel if code is None else panel.where(F.col("cod_municipio") == code)
    return rows.select("categoria").distinct().orderBy("categoria")


def territory_detail(panel: DataFrame, code: str, top: int | None = None) -> DataFrame:
    """Breakdown of one territory; with `top`, only the largest crime categories."""
    rows = panel.where(F.col("cod_municipio") == code)
    if top is not None:
        rows = rows.where(F.col("naturaleza") == CRIME)
    out = rows.groupBy("categoria", "naturaleza").agg(F.sum("cantidad").alias("total"))
    out = out.orderBy(F.desc("total"), "categoria")
    return out if top is None else out.limit(top)


def series_totals(panel: DataFrame) -> DataFrame:
    """(territory, category) totals that rankings and cards share."""
    return panel.groupBy("cod_municipio", "municipio", "departamento", "categoria", "naturaleza").agg(
        F.sum("cantidad").alias("total"))


