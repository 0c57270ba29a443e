"""Data and model health signals with a traffic light each."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from atalaya.constants import (
    GREEN, LAG_BAD, LAG_STALE, LAG_WARN, MIN_POPULATION_COVERAGE, PSI_EPS, PSI_MODERATE,
    PSI_SIGNIFICANT, RED, YELLOW,
)
from atalaya.functions import month_diff, period_str
from atalaya.operators.quantiles import exact_quantiles
from atalaya.plans import metrics as m
from atalaya.session import cut_lineage


def psi_light(value: Column) -> Column:
    return (F.when(value >= PSI_SIGNIFICANT, F.lit(RED)).when(value >= PSI_MODERATE, F.lit(YELLOW))
            .otherwise(F.lit(GREEN)))


def psi(values: DataFrame, is_reference: Column, value: Column, bins: int = 10) -> DataFrame:
    """Population stability index between two parts of one table.

    Bin edges are the distinct quantiles of log1p(reference) with open ends; a bin includes its
    left edge. After the edges, one pass counts both parts per bin, at most `bins` rows.
    """
    table = values.select(is_reference.alias("ref"), F.log1p(value.cast("double")).alias("x")).where(
        "x IS NOT NULL")
    edges = exact_quantiles(table.where("ref"), F.col("x"), [i / bins for i in range(bins + 1)])
    inner = [] if edges[0] is None else sorted(set(edges))[1:-1]
    usable = edges[0] is not None and len(set(edges)) > 1
    bucket = reduce(lambda a, e: a + F.when(F.col("x") >= e, 1).otherwise(0), inner, F.lit(0))
    counts = table.groupBy(bucket.alias("b")).agg(F.count_if("ref").alias("r"),
                                                  F.count_if(~F.col("ref")).alias("c"))
    totals = table.agg(F.struct(F.count_if("ref").alias("r"), F.count_if(~F.col("ref")).alias("c")))
    shares = counts.withColumn("t", totals.scalar())
    ref = F.greatest(F.try_divide("r", "t.r"), F.lit(PSI_EPS))
    cur = F.greatest(F.try_divide("c", "t.c"), F.lit(PSI_EPS))
    term = (cur - ref) * F.ln(cur / ref)
    value_or_zero = F.when(F.lit(usable) & (F.max("t.c") > 0), F.sum(term)).otherwise(F.lit(0.0))
    return shares.agg(F.round(F.coalesce(value_or_zero, F.lit(0.0)), 4).alias("psi"))


def data_drift(panel: DataFrame, response: Iterable[str], recent: int = 6, reference: int = 18) -> DataFrame:
    """Stability of the last months against the ones just before, and the change in volume.

    Only the list of calendar months is read by the driver; the panel is stored for the passes.
    """
    crimes = cut_lineage(panel.where(~F.col("categoria").isin(*response)).select("periodo", "cantidad"))
    months = [r[0] for r in crimes.select("periodo").distinct().orderBy("periodo").collect()]
    if len(months) <= recent + 1:
        return panel.sparkSession.range(1).select(
            F.lit(0.0).alias("psi"), F.lit(GREEN).alias("estado"),
            F.lit(None).cast("double").alias("volumen_mensual_referencia"),
            F.lit(None).cast("double").alias("volumen_mensual_reciente"),
            F.lit(None).cast("double").alias("cambio_volumen_pct"))
    cutoff = F.lit(months[-recent])
    start = F.lit(months[max(0, len(months) - recent - reference)])
    used = crimes.where(F.col("periodo") >= start)
    is_ref = F.col("periodo") < cutoff
    volume = used.groupBy("periodo").agg(F.sum("cantidad").alias("q")).agg(
        F.avg(F.when(is_ref, F.col("q"))).alias("r"), F.avg(F.when(~is_ref, F.col("q"))).alias("c"))
    out = psi(used, is_ref, F.col("cantidad")).withColumn(
        "_v", volume.select(F.struct("r", "c")).scalar())
    return out.select(
        "psi", psi_light(F.col("psi")).alias("estado"),
        F.round("_v.r", 1).alias("volumen_mensual_referencia"),
        F.round("_v.c", 1).alias("volumen_mensual_reciente"),
        F.when(F.col("_v.r") != 0, F.round(100 * (F.col("_v.c") - F.col("_v.r")) / F.col("_v.r"), 1))
        .alias("cambio_volumen_pct"))


def stale_categories(panel: DataFrame, limit: int = LAG_STALE) -> DataFrame:
    """Categories that end more than `limit` months before the panel."""
    last = panel.groupBy("categoria").agg(F.max("periodo").alias("m"))
    overall = panel.agg(F.max("periodo")).scalar()
    behind = month_diff(overall, F.col("m"))
    return last.withColumn("meses_detras_del_panel", behind).where(behind > limit).select(
        "categoria", period_str(F.col("m")).alias("periodo_max"), "meses_detras_del_panel")


def freshness(panel: DataFrame, now: Column) -> DataFrame:
    """Months since the last observed month; stale categories turn green into yellow."""
    stale = stale_categories(panel)
    piece = F.concat_ws(":", "categoria", "periodo_max", "meses_detras_del_panel")
    summary = stale.agg(F.struct(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("meses_detras_del_panel")).alias("k"),
                                                 "categoria", piece.alias("t")))),
            lambda s: s.getField("t")), ", ").alias("lista")))
    row = panel.agg(F.max("periodo").alias("m")).withColumn("_s", summary.scalar())
    lag = month_diff(now, F.col("m"))
    light = (F.when(F.col("m").isNull(), F.lit(RED)).when(lag > LAG_BAD, F.lit(RED))
             .when(lag > LAG_WARN, F.lit(YELLOW)).when(F.col("_s.n") > 0, F.lit(YELLOW))
             .otherwise(F.lit(GREEN)))
    return row.select(period_str(F.col("m")).alias("periodo_max"), lag.alias("lag_meses"),
                      F.col("_s.lista").alias("fuentes_estancadas"), light.alias("estado"))


def population_coverage(panel: DataFrame) -> DataFrame:
    if "poblacion" not in panel.columns:
        panel = panel.withColumn("poblacion", F.lit(None).cast("double"))
    share = F.coalesce(F.avg(F.col("poblacion").isNotNull().cast("int")), F.lit(0.0))
    pct = F.round(100 * share, 1)
    return panel.agg(
        (F.count("poblacion") > 0).alias("disponible"), pct.alias("cobertura_pct")
    ).withColumn("estado", F.when(F.col("disponible") & (F.col("cobertura_pct") >= MIN_POPULATION_COVERAGE),
                                  F.lit(GREEN)).otherwise(F.lit(YELLOW)))


def backtest_light(bt: DataFrame) -> DataFrame:
    """Long-horizon errors and whether the forecast still beats persistence."""
    wins = F.col("mae") < F.col("baseline_mae")
    return m.metrics(bt).select(
        "n", "mae", "smape", "baseline_mae", "baseline_smape", wins.alias("supera_baseline_mae"),
        F.when(wins, F.lit(GREEN)).otherwise(F.lit(YELLOW)).alias("estado"))


def health_report(signals: dict[str, DataFrame]) -> DataFrame:
    """One row per signal plus the worst of all; every signal frame carries `estado`."""
    parts = [df.select(F.lit(name).alias("senal"), "estado") for name, df in signals.items()]
    rows = reduce(DataFrame.unionByName, parts)
    order = F.array_position(F.array(F.lit(GREEN), F.lit(YELLOW), F.lit(RED)), F.col("estado"))
    worst = rows.agg(F.max_by("estado", order).alias("estado")).select(
        F.lit("global").alias("senal"), "estado")
    return rows.unionByName(worst)
