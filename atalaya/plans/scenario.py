"""What-if levers applied to a table of forecasts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F


@dataclass(frozen=True)
class Scenario:
    """Assumed change of incidence in percent, reached linearly over `ramp` months."""

    name: str
    change_pct: float = 0.0
    ramp: int = 0


def ramp_weight(step: Column, ramp: Column) -> Column:
    return F.when(ramp <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), step / ramp))


def scenario_projection(forecasts: DataFrame, scenarios: list[Scenario],
                        keys: tuple[str, ...] = ("cod_municipio", "categoria")) -> DataFrame:
    """Every forecast under every scenario, with avoided counts and their running total.

    The scenario list is written into each row as a small array, so no join takes place; the
    running total is a window over the few steps of one series and scenario.
    """
    table = F.array(*[F.struct(F.lit(s.name).alias("n"), F.lit(float(s.change_pct)).alias("c"),
                               F.lit(int(s.ramp)).alias("r")) for s in scenarios])
    rows = forecasts.withColumn("_s", F.explode(table))
    factor = 1.0 + F.col("_s.c") / 100.0 * ramp_weight(F.col("paso"), F.col("_s.r"))

    def moved(name: str) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.col(name) * factor), 2)

    rows = rows.select(
        *keys, "paso", "periodo", F.col("_s.n").alias("escenario"),
        F.col("prediccion").alias("base"), moved("prediccion").alias("prediccion"),
        moved("limite_inferior").alias("limite_inferior"),
        moved("limite_superior").alias("limite_superior"))
    rows = rows.withColumn("evitados", F.round(F.col("base") - F.col("prediccion"), 2))
    running = Window.partitionBy(*keys, "escenario").orderBy("paso")
    return rows.withColumn("evitados_acumulado", F.round(F.sum("evitados").over(running), 2))
