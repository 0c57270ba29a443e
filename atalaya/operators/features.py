"""Window features of a series panel. All share one partitioning, so one shuffle and one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from atalaya.constants import HIST_WINDOW, LAGS, MIN_HISTORY, MIN_NONZERO, ROLL_WINDOWS, SERIES_KEY
from atalaya.functions import month_index, period_str


def _ordered(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("periodo")


def with_lags(panel: DataFrame, lags: list[int] = LAGS, keys: list[str] = SERIES_KEY,
              y: str = "cantidad") -> DataFrame:
    w = _ordered(keys)
    return panel.withColumns({f"lag_{n}": F.lag(y, n).over(w) for n in lags})


def with_rolling(panel: DataFrame, windows: list[int] = ROLL_WINDOWS, keys: list[str] = SERIES_KEY,
                 y: str = "cantidad") -> DataFrame:
    """Mean and sample deviation of the previous values; null until the window is full."""
    out: dict[str, Column] = {}
    for size in windows:
        w = _ordered(keys).rowsBetween(-size, -1)
        full = F.count(y).over(w) == size
        out[f"roll_mean_{size}"] = F.when(full, F.avg(y).over(w))
        out[f"roll_std_{size}"] = F.when(full, F.stddev_samp(y).over(w))
    return panel.withColumns(out)


def with_hist_mean(panel: DataFrame, size: int = HIST_WINDOW, keys: list[str] = SERIES_KEY,
                   y: str = "cantidad") -> DataFrame:
    return panel.withColumn("media_hist", F.avg(y).over(_ordered(keys).rowsBetween(-size, -1)))


def with_months_active(panel: DataFrame, keys: list[str] = SERIES_KEY) -> DataFrame:
    return panel.withColumn("meses_activos", (F.row_number().over(_ordered(keys)) - 1).cast("double"))


def with_exog(panel: DataFrame) -> DataFrame:
    population = F.col("poblacion").cast("double")
    known = F.when(population > 0, population)
    return panel.withColumns({
        "log_poblacion": F.log1p(population),
        "tasa_hist": F.col("media_hist") / known * 1e5,
    })


def calendar_columns(month: Column, origin_year: Column) -> dict[str, Column]:
    """Calendar inputs of a month; the trend counts from the first year of the whole panel."""
    number = F.month(month)
    return {
        "mes": number.cast("double"),
        "trimestre": F.quarter(month).cast("double"),
        "mes_sin": F.sin(2 * math.pi * number / 12),
        "mes_cos": F.cos(2 * math.pi * number / 12),
        "trend": ((F.year(month) - origin_year) * 12 + number).cast("double"),
    }


def calendar_features(panel: DataFrame) -> DataFrame:
    first = panel.agg(F.min(F.year("periodo"))).scalar()
    return panel.withColumns(calendar_columns(F.col("periodo"), first))


def make_features(panel: DataFrame, keys: list[str] = SERIES_KEY, y: str = "cantidad") -> DataFrame:
    """Every model input for each (series, month), using only values before that month."""
    out = with_lags(panel, keys=keys, y=y)
    out = with_rolling(out, keys=keys, y=y)
    out = with_months_active(with_hist_mean(out, keys=keys, y=y), keys=keys)
    if "poblacion" in panel.columns:
        out = with_exog(out)
    return calendar_features(out)


def feature_names(with_population: bool, rate_mode: bool) -> list[str]:
    names = [f"lag_{n}" for n in LAGS]
    names += [f"roll_{kind}_{n}" for n in ROLL_WINDOWS for kind in ("mean", "std")]
    names += ["media_hist", "meses_activos", "mes", "trimestre", "mes_sin", "mes_cos", "trend"]
    if with_population:
        names.append("log_poblacion")
        if not rate_mode:
            names.append("tasa_hist")
    return names


def min_history(panel: DataFrame, n: int = MIN_HISTORY, keys: list[str] = SERIES_KEY) -> DataFrame:
    rows = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return panel.withColumn("_n", rows).where(F.col("_n") >= n).drop("_n")


def active_series(panel: DataFrame, n: int = MIN_NONZERO, keys: list[str] = SERIES_KEY,
                  y: str = "cantidad") -> DataFrame:
    busy = F.count_if(F.col(y) > 0).over(Window.partitionBy(*keys))
    return panel.withColumn("_busy", busy).where(F.col("_busy") >= n).drop("_busy")


def naive_scale(panel: DataFrame, origin: Column | None = None, keys: list[str] = SERIES_KEY,
                y: str = "cantidad") -> DataFrame:
    """Mean absolute one-step change per series before the origin (the MASE denominator)."""
    rows = panel if origin is None else panel.where(F.col("periodo") < origin)
    change = F.abs(F.col(y) - F.lag(y).over(_ordered(keys)))
    return rows.withColumn("_d", change).groupBy(*keys).agg(F.avg("_d").alias("escala"))


def last_value(panel: DataFrame, origin: Column | None = None, keys: list[str] = SERIES_KEY,
               y: str = "cantidad") -> DataFrame:
    """Persistence forecast and mean volume per series before the origin."""
    rows = panel if origin is None else panel.where(F.col("periodo") < origin)
    return rows.groupBy(*keys).agg(F.max_by(y, "periodo").alias("ultimo"),
                                   F.avg(y).alias("volumen_medio"))


def latest_n(panel: DataFrame, code: str, category: str, n: int = 12) -> DataFrame:
    """Last months of one series (1..60) with their total."""
    n = max(1, min(int(n), 60))
    rows = panel.where((F.col("cod_municipio") == code) & (F.col("categoria") == category))
    tail = rows.orderBy(F.desc("periodo")).limit(n)
    total = F.sum("cantidad").over(Window.partitionBy("cod_municipio", "categoria"))
    return tail.select("cod_municipio", "categoria", period_str(F.col("periodo")).alias("periodo"),
                       "cantidad", total.alias("total_periodo"))


def seasonal_value(y: str = "cantidad", keys: list[str] = SERIES_KEY, months: int = 12) -> Column:
    """Value of the same calendar month `months` earlier, by date and not by row offset."""
    by_month = Window.partitionBy(*keys).orderBy(month_index(F.col("periodo")))
    return F.max(y).over(by_month.rangeBetween(-months, -months))


def seasonal_naive(panel: DataFrame, origin: Column, months: int = 12,
                   keys: list[str] = SERIES_KEY, y: str = "cantidad") -> DataFrame:
    """Forecast rows at or after the origin with last year's value; unknown or too late gives 0."""
    season = seasonal_value(y, keys, months)
    known = F.add_months("periodo", -months) < origin
    return (
        panel.withColumn("estacional", F.coalesce(F.when(known, season), F.lit(0)))
        .where(F.col("periodo") >= origin)
        .select(*keys, "periodo", F.col(y).alias("y"), "estacional")
    )
