"""Stage funnel over pre-counted processes: cleaning, rates, rankings and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from atalaya.constants import (
    ADVANCED, FUNNEL_YEARS, MIN_KNOWN_TERRITORY, MIN_KNOWN_TITLE, NO_TITLE, UNKNOWN_STAGE,
)
from atalaya.functions import blank_to, number, region, stage_class, stage_order, territory_code

CUBE_KEYS = ["cod_municipio", "anio", "etapa", "clase_etapa"]


def typed_cube(raw: DataFrame) -> DataFrame:
    """Parse the all-text group counts; a missing title column is allowed."""
    cols = {
        "cod_municipio": territory_code(F.col("cod_dane_hecho"), "A"),
        "anio": number(F.col("a_o_hecho")),
        "etapa": F.trim("etapa"),
        "n_procesos": F.coalesce(number(F.col("n_procesos")).try_cast("bigint"), F.lit(0)),
    }
    if "titulo_delito" in raw.columns:
        cols["titulo_delito"] = blank_to(F.col("titulo_delito"), NO_TITLE)
    return raw.select(*[c.alias(n) for n, c in cols.items()]).withColumn("causa", _discard_cause())


def _discard_cause() -> Column:
    """First cause that applies, or null for a row that is kept."""
    return (
        F.when(F.col("cod_municipio").isNull(), F.lit("sin_municipio_valido"))
        .when(~F.coalesce(F.col("anio").between(*FUNNEL_YEARS), F.lit(False)),
              F.lit("anio_invalido_o_fuera_de_rango"))
        .when(F.col("n_procesos") <= 0, F.lit("conteo_no_positivo"))
    )


def funnel_cube(raw: DataFrame) -> DataFrame:
    """Valid rows with their stage class."""
    return (
        typed_cube(raw).where("causa IS NULL").drop("causa")
        .withColumn("anio", F.col("anio").cast("bigint"))
        .withColumn("clase_etapa", stage_class(F.coalesce("etapa", F.lit(""))))
    )


def funnel_annual(cube: DataFrame) -> DataFrame:
    return cube.groupBy(*CUBE_KEYS).agg(F.sum("n_procesos").alias("n_procesos"))


def rate_columns(df: DataFrame) -> dict[str, Column]:
    advanced = F.when(F.col("clase_etapa") == ADVANCED, F.col("n_procesos")).otherwise(0)
    known = F.when(F.col("clase_etapa") != UNKNOWN_STAGE, F.col("n_procesos")).otherwise(0)
    return {"total_procesos": F.sum("n_procesos"), "n_judicializados": F.sum(advanced),
            "procesos_etapa_conocida": F.sum(known)}


def rate_pct(advanced: str = "n_judicializados", known: str = "procesos_etapa_conocida") -> Column:
    return F.round(100 * F.col(advanced) / F.greatest(F.col(known), F.lit(1)), 2)


def funnel_rate(cube: DataFrame, by: str) -> DataFrame:
    """Totals and rate over the known-stage denominator, by territory, title or cohort year."""
    key = {"territory": "cod_municipio", "title": "titulo_delito", "year": "anio"}[by]
    out = cube.groupBy(key).agg(*[c.alias(n) for n, c in rate_columns(cube).items()])
    out = out.withColumn("tasa_judicializacion_pct", rate_pct())
    return out.where(F.col("procesos_etapa_conocida") > 0) if by == "year" else out


def funnel_stage(cube: DataFrame) -> DataFrame:
    """National funnel per raw stage in chain order."""
    return (
        cube.groupBy("etapa", "clase_etapa").agg(F.sum("n_procesos").alias("n_procesos"))
        .withColumn("orden", stage_order(F.coalesce("etapa", F.lit(""))))
        .orderBy("orden", F.desc("n_procesos"), "etapa")
    )


def funnel_class(cube: DataFrame) -> DataFrame:
    """One national row: totals per class and the rate."""
    def of(label: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("clase_etapa") == label, F.col("n_procesos"))), F.lit(0))

    return cube.agg(
        F.sum("n_procesos").alias("total_procesos"), of("indagacion").alias("indagacion"),
        of(ADVANCED).alias("judicializado"), of(UNKNOWN_STAGE).alias("desconocido"),
    ).withColumn(
        "tasa_judicializacion_pct",
        F.round(100 * F.col("judicializado")
                / F.greatest(F.col("indagacion") + F.col("judicializado"), F.lit(1)), 2))


def with_names(rates: DataFrame, reference: DataFrame) -> DataFrame:
    """Official names where the code is known; unmatched codes keep null names."""
    names = reference.select("cod_municipio", "municipio", "departamento")
    return rates.join(names, "cod_municipio", "left")


def serving_labels(rates: DataFrame) -> DataFrame:
    """Replace missing names by the code and a dash, as the ranking shows them."""
    return rates.withColumns({
        "municipio": F.coalesce("municipio", "cod_municipio"),
        "departamento": F.coalesce("departamento", F.lit("—")),
    })


def unmatched(fact: DataFrame, reference: DataFrame, key: str = "cod_municipio") -> DataFrame:
    """Codes without a reference row. The fact is reduced to its distinct codes first."""
    codes = fact.select(key).where(F.col(key).isNotNull()).distinct()
    return codes.join(reference.select(key).distinct(), key, "left_anti").withColumn(
        "municipio", F.col(key))


def funnel_region(rates: DataFrame) -> DataFrame:
    """Region rate from summed numerators and denominators."""
    out = rates.where("cod_municipio IS NOT NULL").groupBy(
        region(F.col("cod_municipio")).alias("cod_departamento")).agg(
        F.coalesce(F.min("departamento"), F.lit("—")).alias("departamento"),
        F.sum("total_procesos").alias("total_procesos"),
        F.sum("n_judicializados").alias("n_judicializados"),
        F.sum("procesos_etapa_conocida").alias("procesos_etapa_conocida"),
        F.count(F.lit(1)).alias("municipios"),
    )
    rate = F.coalesce(F.try_divide(100 * F.col("n_judicializados"), F.col("procesos_etapa_conocida")),
                      F.lit(0.0))
    return out.withColumn("tasa_judicializacion_pct", F.round(rate, 6))


def funnel_coverage(cube: DataFrame) -> DataFrame:
    return cube.agg(F.count_distinct("cod_municipio").alias("municipios"),
                    F.min("anio").alias("anio_min"), F.max("anio").alias("anio_max"))


def funnel_discards(raw: DataFrame) -> DataFrame:
    """Raw-to-kept reconciliation with one column per exclusive cause."""
    def lost(cause: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("causa") == cause, F.col("n_procesos"))), F.lit(0))

    causes = ["sin_municipio_valido", "anio_invalido_o_fuera_de_rango", "conteo_no_positivo"]
    out = typed_cube(raw).agg(
        F.count(F.lit(1)).alias("filas_agregadas"),
        F.coalesce(F.sum("n_procesos"), F.lit(0)).alias("procesos_bronze"),
        *[lost(c).alias(c) for c in causes],
    )
    dropped = F.col(causes[0]) + F.col(causes[1]) + F.col(causes[2])
    return out.withColumns({
        "procesos_gold": F.col("procesos_bronze") - dropped,
        "descartados_pct": F.round(100 * dropped / F.greatest("procesos_bronze", F.lit(1)), 2),
    })


def eligible_titles(titles: DataFrame, min_known: int = MIN_KNOWN_TITLE) -> DataFrame:
    return titles.where((F.col("procesos_etapa_conocida") >= min_known)
                        & (F.col("titulo_delito") != NO_TITLE))


def extremes(df: DataFrame, label: str, rate: str, n: int) -> DataFrame:
    """The n highest and n lowest rates, each a bounded top-n."""
    high = df.orderBy(F.desc(rate), label).limit(n).withColumn("tipo", F.lit("mayor_tasa"))
    low = df.orderBy(F.asc(rate), label).limit(n).withColumn("tipo", F.lit("menor_tasa"))
    return high.unionByName(low)


def title_ranking(titles: DataFrame, min_known: int = MIN_KNOWN_TITLE, n: int = 5) -> DataFrame:
    cols = ["titulo_delito", "total_procesos", "n_judicializados", "tasa_judicializacion_pct"]
    return extremes(eligible_titles(titles, min_known).select(*cols), "titulo_delito",
                    "tasa_judicializacion_pct", n)


def rate_extremes(rates: DataFrame, min_known: int = MIN_KNOWN_TERRITORY, n: int = 15,
                  label: str = "cod_municipio", volume: str = "procesos_etapa_conocida") -> DataFrame:
    return extremes(rates.where(F.col(volume) >= min_known), label, "tasa_judicializacion_pct", n)


def top_by_volume(rates: DataFrame, n: int | None = 10) -> DataFrame:
    out = rates.orderBy(F.desc("total_procesos"), "cod_municipio")
    return out if n is None else out.limit(n)


def drilldown(annual: DataFrame, code: str) -> DataFrame:
    return (annual.where(F.col("cod_municipio") == code)
            .select("anio", "etapa", "clase_etapa", "n_procesos").orderBy("anio", "etapa"))


def funnel_lookup(rates: DataFrame, code: str | None = None, titles: DataFrame | None = None,
                  min_known: int = MIN_KNOWN_TITLE, n: int = 3) -> DataFrame:
    """National row, or the row of one territory, always over the known-stage denominator.

    With `titles` the national row also lists the `n` titles of lowest and of highest rate.
    """
    if code is not None:
        return rates.where(F.col("cod_municipio") == code).select(
            "cod_municipio", "municipio", "total_procesos", "n_judicializados",
            "tasa_judicializacion_pct")
    national = rates.agg(
        F.sum("total_procesos").alias("total_procesos"),
        F.sum("n_judicializados").alias("n_judicializados"),
        F.sum("procesos_etapa_conocida").alias("procesos_etapa_conocida"),
    ).withColumn("tasa_judicializacion_pct", rate_pct())
    if titles is None:
        return national
    fit = eligible_titles(titles, min_known)
    rate = F.col("tasa_judicializacion_pct")
    piece = F.format_string("%s: %.2f", "titulo_delito", "tasa_judicializacion_pct")
    for name, order, sign in (("menor_tasa", rate.asc(), 1), ("mayor_tasa", rate.desc(), -1)):
        ends = F.array_sort(F.collect_list(F.struct((rate * sign).alias("k"), "titulo_delito", piece.alias("t"))))
        ends = fit.orderBy(order, "titulo_delito").limit(n).agg(F.array_join(F.transform(ends, lambda s: s["t"]), "; "))
        national = national.withColumn(name, F.nullif(ends.scalar(), F.lit("")))
    return national
