"""Rolling-origin evaluation: origins, actuals and the two baselines in one window pass."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from atalaya.constants import LAGS, SERIES_KEY
from atalaya.operators.features import seasonal_value
from atalaya.session import cut_lineage

MIN_TRAIN_ROWS = 50


@dataclass(frozen=True)
class Origins:
    """Calendar of a panel and the positions of the evaluated origins in it."""

    periods: list[date]
    horizon: int
    positions: list[int]

    def targets(self, position: int) -> list[date]:
        return self.periods[position:position + self.horizon]


def find_origins(panel: DataFrame, horizon: int, n_splits: int,
                 min_train: int = MIN_TRAIN_ROWS) -> Origins:
    """Last `n_splits` origins with enough training rows.

    Only calendar months and one count per month reach the driver.
    """
    nth = F.row_number().over(Window.partitionBy(*SERIES_KEY).orderBy("periodo"))
    trainable = panel.select("periodo", nth.alias("k")).groupBy("periodo").agg(
        F.count_if(F.col("k") > max(LAGS)).alias("n")).orderBy("periodo").collect()
    periods = [r["periodo"] for r in trainable]
    horizon = max(1, min(int(horizon), len(periods) - 2))
    last = len(periods) - horizon
    if last < 1:
        return Origins(periods, horizon, [])
    wanted = range(max(1, last - n_splits + 1), last + 1)
    enough = [i for i in wanted if sum(r["n"] for r in trainable[:i]) >= min_train]
    return Origins(periods, horizon, enough)


def baseline_backtest(panel: DataFrame, horizon: int = 6, n_splits: int = 3,
                      origins: Origins | None = None) -> DataFrame:
    """Actuals with persistence, seasonal value, scale and volume for every origin and step.

    All of it is one window partitioning by series: the statistics before each origin are
    conditional aggregates of the series, so neither origins nor baselines add joins.
    """
    if origins is None:
        # Stored, so that finding the origins and evaluating them read the panel once.
        panel = cut_lineage(panel.select(*SERIES_KEY, "periodo", "cantidad"))
        origins = find_origins(panel, horizon, n_splits)
    series = Window.partitionBy(*SERIES_KEY)
    y, month = F.col("cantidad").cast("double"), F.col("periodo")
    step_change = F.abs(y - F.lag(y).over(series.orderBy("periodo")))
    rows = panel.select(*SERIES_KEY, "periodo", y.alias("y"), step_change.alias("_d"),
                        seasonal_value().cast("double").alias("_season"))
    picks: list[Column] = []
    for position in origins.positions:
        origin = F.lit(origins.periods[position])
        before = month < origin
        steps = F.array_position(F.array(*[F.lit(d) for d in origins.targets(position)]), month)
        picks.append(F.struct(
            origin.alias("origen"), steps.cast("int").alias("paso"),
            F.max_by(F.when(before, F.col("y")), F.when(before, month)).over(series).alias("persistencia"),
            F.when(F.add_months(month, -12) < origin, F.col("_season")).alias("estacional"),
            F.avg(F.when(before, F.col("_d"))).over(series).alias("escala"),
            F.avg(F.when(before, F.col("y"))).over(series).alias("volumen"),
        ))
    if not picks:
        raise ValueError("the panel is too short for the requested horizon")
    rows = rows.withColumn("_all", F.array(*picks)).withColumn("_p", F.explode("_all"))
    return rows.where("_p.paso > 0 AND _p.volumen IS NOT NULL").select(
        "_p.origen", "_p.paso", *SERIES_KEY, "periodo", "y",
        F.coalesce("_p.persistencia", F.lit(0.0)).alias("persistencia"),
        F.coalesce("_p.estacional", F.lit(0.0)).alias("estacional"),
        "_p.escala", "_p.volumen")


def join_actuals(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecast next to the observed count at the same series and month."""
    seen = panel.select(*SERIES_KEY, "periodo", F.col("cantidad").cast("double").alias("y"))
    return forecasts.join(seen, SERIES_KEY + ["periodo"])
