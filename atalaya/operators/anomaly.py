"""Upward-anomaly detection by consensus of a robust z score and an isolation score."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from atalaya.constants import (
    CONTAMINATION, FALLBACK_SIGMA_FLOOR, HIGH, MAD_TO_SIGMA, MEANAD_TO_SIGMA, MEDIUM, MIN_HISTORY,
    SERIES_KEY, Z_HIGH, Z_THRESHOLD,
)
from atalaya.functions import month_start, period_str
from atalaya.operators.features import min_history
from atalaya.operators.isolation import isolation_score

ALERT_COLUMNS = ["cod_municipio", "municipio", "departamento", "categoria", "periodo", "cantidad",
                 "score_z", "severidad"]


def rolling_median(panel: DataFrame, size: int = 12, min_obs: int = 6, keys: list[str] = SERIES_KEY,
                   y: str = "cantidad", out: str = "mediana_movil") -> DataFrame:
    """Median of the current and previous values; short heads use the median of the series.

    A series holds one row per month, so a window partition is bounded by the calendar.
    """
    frame = Window.partitionBy(*keys).orderBy("periodo").rowsBetween(-(size - 1), 0)
    rolling = F.when(F.count(y).over(frame) >= min_obs, F.percentile(y, F.lit(0.5)).over(frame))
    whole = F.percentile(y, F.lit(0.5)).over(Window.partitionBy(*keys))
    return panel.withColumn(out, F.coalesce(rolling, whole))


def robust_z(df: DataFrame, col: str, out: str, keys: list[str] = SERIES_KEY) -> DataFrame:
    """(x - median) / sigma per series, sigma from the MAD or, when that is 0, from the mean
    absolute deviation with a floor."""
    group = Window.partitionBy(*keys)
    df = df.withColumn("_dev", F.col(col) - F.percentile(col, F.lit(0.5)).over(group))
    df = df.withColumns({
        "_mad": F.percentile(F.abs("_dev"), F.lit(0.5)).over(group),
        "_mean_ad": F.avg(F.abs("_dev")).over(group),
    })
    fallback = F.greatest(F.col("_mean_ad") / MEANAD_TO_SIGMA, F.lit(FALLBACK_SIGMA_FLOOR))
    sigma = F.when(F.col("_mad") > 0, F.col("_mad") / MAD_TO_SIGMA).otherwise(fallback)
    return df.withColumn(out, F.coalesce(F.col("_dev") / sigma, F.lit(0.0))).drop(
        "_dev", "_mad", "_mean_ad")


def z_scores(panel: DataFrame, response: Iterable[str], history: int = MIN_HISTORY,
             keys: list[str] = SERIES_KEY) -> DataFrame:
    """Crime series with enough history, their rolling median and the z of the residual."""
    rows = panel.where(~F.col("categoria").isin(*response))
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    rows = rolling_median(min_history(rows, history, keys), keys=keys)
    rows = rows.withColumn("residuo", F.col("cantidad").cast("double") - F.col("mediana_movil"))
    return robust_z(rows, "residuo", "z_residuo", keys)


def _alerts(rows: DataFrame, flag: Column) -> DataFrame:
    return rows.where(flag & (F.col("cantidad") > F.col("mediana_movil"))).select(
        "cod_municipio", "municipio", "departamento", "categoria", "periodo", "cantidad",
        F.round("z_residuo", 2).alias("score_z"),
        F.when(F.abs("z_residuo") > Z_HIGH, F.lit(HIGH)).otherwise(F.lit(MEDIUM)).alias("severidad"),
    )


def z_alerts(panel: DataFrame, response: Iterable[str], history: int = MIN_HISTORY,
             threshold: float = Z_THRESHOLD) -> DataFrame:
    """Alerts of the z signal alone."""
    rows = z_scores(panel, response, history)
    return _alerts(rows, F.abs("z_residuo") > threshold)


def detect(panel: DataFrame, response: Iterable[str], history: int = MIN_HISTORY,
           contamination: float = CONTAMINATION, threshold: float = Z_THRESHOLD,
           seed: int = 42, isolated: Column | None = None) -> DataFrame:
    """Alerts both signals agree on, newest first.

    The second signal is the isolation forest, or an expression over the scored rows.
    """
    rows = z_scores(panel, response, history)
    rows = rows.withColumn("_y", F.col("cantidad").cast("double"))
    rows = robust_z(rows, "_y", "z_nivel").drop("_y")
    if isolated is None:
        rows = isolation_score(rows, ["z_residuo", "z_nivel"], SERIES_KEY + ["periodo"],
                               contamination, seed)
        isolated = F.col("aislado")
    flagged = _alerts(rows, (F.abs("z_residuo") > threshold) & isolated)
    return flagged.orderBy(F.desc("periodo"), "cod_municipio", "categoria")


def corroboration(anomalies: DataFrame) -> DataFrame:
    """Share of alerts whose territory-month has at least two alerted categories.

    Counted bottom-up: alerts per (territory, month, category), then per (territory, month).
    """
    cells = anomalies.groupBy("cod_municipio", month_start(F.col("periodo")).alias("m"),
                              "categoria").agg(F.count(F.lit(1)).alias("n"))
    months = cells.groupBy("cod_municipio", "m").agg(
        F.sum("n").alias("n"), F.count("categoria").alias("k"))
    many = F.col("k") >= 2
    return months.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_anomalias"),
        F.coalesce(F.sum(F.when(many, F.col("n"))), F.lit(0)).alias("n_corroboradas"),
        F.count_if(many).alias("n_clusters_multidelito"),
    ).withColumn(
        "fraccion_corroborada",
        F.coalesce(F.round(F.try_divide("n_corroboradas", "n_anomalias"), 3), F.lit(0.0)))


def match_events(anomalies: DataFrame, events: DataFrame, window: int = 1,
                 by_category: bool = False) -> DataFrame:
    """Flag each documented event that has an alert in its territory within +-window months.

    The range condition becomes an equi-join: each event is expanded to its few candidate months
    and looked up in the distinct alerted cells, so a hot territory never pairs its alerts with
    all of its events.
    """
    events = events.withColumn("_e", F.xxhash64(F.struct(*events.columns)))
    target = F.to_date(F.concat_ws("-", F.substring("periodo", 1, 7), F.lit("01")))
    has_category = by_category and "categoria" in events.columns
    alert_keys = ["cod_municipio", month_start(F.col("periodo")).alias("_m")]
    cells = anomalies.select(*alert_keys).distinct()
    months = F.sequence(F.add_months("_t", -window), F.add_months("_t", window),
                        F.expr("interval 1 month"))
    base = events.withColumn("_t", target).withColumn("_row", F.monotonically_increasing_id())
    probe = base.withColumn("_m", F.explode_outer(months))
    if has_category:
        named = anomalies.select(*alert_keys, F.col("categoria").alias("_c")).distinct()
        general = probe.where("categoria IS NULL").join(
            cells.withColumn("_hit", F.lit(True)), ["cod_municipio", "_m"], "left")
        specific = probe.where("categoria IS NOT NULL").join(
            named.withColumn("_hit", F.lit(True)),
            (probe["cod_municipio"] == named["cod_municipio"]) & (probe["_m"] == named["_m"])
            & (F.col("categoria") == F.col("_c")), "left",
        ).select(*[probe[c] for c in probe.columns], "_hit")
        joined = general.unionByName(specific)
    else:
        joined = probe.join(cells.withColumn("_hit", F.lit(True)), ["cod_municipio", "_m"], "left")
    keep = [c for c in events.columns if c != "_e"]
    return (
        joined.groupBy("_e", "_row", "_t", *keep)
        .agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("detectado"))
        .withColumn("periodo", period_str(F.col("_t"))).drop("_e", "_row", "_t")
    )


def event_recall(anomalies: DataFrame, events: DataFrame, window: int = 1,
                 by_category: bool = False) -> DataFrame:
    hits = match_events(anomalies, events, window, by_category)
    return hits.agg(
        F.count(F.lit(1)).alias("n_eventos"), F.count_if("detectado").alias("n_detectados"),
        F.coalesce(F.round(F.try_divide(F.count_if("detectado"), F.count(F.lit(1))), 3), F.lit(0.0))
        .alias("recall"),
        F.lit(window).alias("window_months"), F.lit(by_category).alias("by_categoria"),
    )


def anomaly_stats(anomalies: DataFrame, panel: DataFrame, response: Iterable[str],
                  history: int = MIN_HISTORY) -> DataFrame:
    """Alert totals and their rate over the months and series the detector evaluates."""
    crimes = panel.where(~F.col("categoria").isin(*response)
                         & F.col("cod_municipio").isNotNull() & F.col("categoria").isNotNull())
    universe = (
        crimes.groupBy(*SERIES_KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= history)
        .agg(F.struct(F.coalesce(F.sum("n"), F.lit(0)).alias("meses"),
                      F.count(F.lit(1)).alias("series")))
    )
    totals = anomalies.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("severidad") == HIGH).alias("alta"),
        F.count_if(F.col("severidad") == MEDIUM).alias("media"),
        F.count_distinct(F.struct(*SERIES_KEY)).alias("series_con_alerta"),
    ).withColumn("_u", universe.scalar())
    return totals.select(
        "total", "alta", "media", F.col("_u.meses").alias("universo_meses_serie"),
        F.round(100 * F.try_divide("total", "_u.meses"), 3).alias("tasa_alertas_pct"),
        F.col("_u.series").alias("series_evaluadas"), "series_con_alerta",
        F.round(F.try_divide("total", "_u.series"), 2).alias("alertas_por_serie"),
    )


def confusion(detected: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """True/false positives and misses of a detected set against a known set."""
    found = detected.select(*keys).distinct().withColumn("_d", F.lit(True))
    known = truth.select(*keys).distinct().withColumn("_t", F.lit(True))
    both = found.join(known, keys, "full_outer")
    hit, miss = F.col("_d").isNotNull(), F.col("_d").isNull()
    counts = both.agg(
        F.count_if(hit & F.col("_t").isNotNull()).alias("tp"),
        F.count_if(hit & F.col("_t").isNull()).alias("fp"), F.count_if(miss).alias("fn"),
    )
    return counts.withColumns({
        "precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4),
        "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4),
    })


def latest_anomalies(anomalies: DataFrame, n: int = 20) -> DataFrame:
    """Per territory: how many alerts it has, and its newest ones."""
    territory = Window.partitionBy("cod_municipio")
    newest = territory.orderBy(F.desc("periodo"), "categoria")
    return (
        anomalies.withColumn("n_anomalias", F.count(F.lit(1)).over(territory))
        .withColumn("orden", F.row_number().over(newest)).where(F.col("orden") <= n)
        .select("cod_municipio", "orden", "n_anomalias", "categoria",
                period_str(F.col("periodo")).alias("periodo"), "cantidad", "severidad",
                F.round("score_z", 2).alias("score_z"))
    )


