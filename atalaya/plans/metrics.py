"""Forecast accuracy, skill, dispersion and calibrated bands over a backtest table.

A backtest row is (origen, paso, cod_municipio, categoria, periodo, y, yhat, persistencia,
estacional, escala, volumen). Every metric is a partial aggregation of that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from atalaya.constants import BAND_LEVEL
from atalaya.operators.quantiles import exact_quantiles


def _mae(pred: str) -> Column:
    return F.round(F.avg(F.abs(F.col("y") - F.col(pred))), 4)


def _smape(pred: str) -> Column:
    """Points where truth and forecast are both zero are skipped; none left gives zero."""
    size = F.abs("y") + F.abs(pred)
    share = F.when(size > 0, 2 * F.abs(F.col(pred) - F.col("y")) / size)
    return F.round(F.coalesce(100 * F.avg(share), F.lit(0.0)), 2)


def _mase(pred: str) -> Column:
    """Points without a positive in-sample scale are skipped."""
    return F.round(F.avg(F.when(F.col("escala") > 0, F.abs(F.col(pred) - F.col("y")) / F.col("escala"))), 4)


def metric_columns() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"), _mae("yhat").alias("mae"), _smape("yhat").alias("smape"),
        _mae("persistencia").alias("baseline_mae"), _smape("persistencia").alias("baseline_smape"),
        _mae("estacional").alias("baseline_estacional_mae"),
        _smape("estacional").alias("baseline_estacional_smape"),
        _mase("yhat").alias("mase"), _mase("persistencia").alias("baseline_mase"),
    ]


def metrics(bt: DataFrame, group_cols: list[str] | None = None) -> DataFrame:
    return bt.groupBy(*(group_cols or [])).agg(*metric_columns())


def metrics_by_step(bt: DataFrame) -> DataFrame:
    return metrics(bt, ["paso"])


def metrics_by_volume(bt: DataFrame) -> DataFrame:
    """One-step accuracy by tercile of the mean volume of the series."""
    one = bt.where("paso = 1")
    q1, q2 = exact_quantiles(one, F.col("volumen"), [1 / 3, 2 / 3])
    if q1 is None:
        q1 = q2 = 0.0
    stratum = (F.when(F.col("volumen") <= q1, F.lit("bajo"))
               .when(F.col("volumen") <= q2, F.lit("medio")).otherwise(F.lit("alto")))
    label = (F.when(F.col("estrato") == "bajo", F.format_string("≤%.1f", F.lit(q1)))
             .when(F.col("estrato") == "medio", F.format_string("%.1f–%.1f", F.lit(q1), F.lit(q2)))
             .otherwise(F.format_string(">%.1f", F.lit(q2))))
    out = metrics(one.withColumn("estrato", stratum), ["estrato"])
    wins = (F.col("smape") < F.col("baseline_smape")) & (F.col("mae") <= F.col("baseline_mae"))
    return out.withColumn("rango_volumen_mensual", label).withColumn("gana_modelo", wins)


def skill(mae: Column, base: Column) -> Column:
    """Percent improvement over a baseline error; null without a baseline."""
    return F.when(base != 0, F.round(100.0 * (1.0 - mae / base), 1))


def skill_table(bt: DataFrame) -> DataFrame:
    one = metrics(bt.where("paso = 1")).select(F.lit("1_paso").alias("alcance"), "*")
    multi = metrics(bt).select(F.lit("multipaso").alias("alcance"), "*")
    return one.unionByName(multi).select(
        "alcance",
        skill(F.col("mae"), F.col("baseline_mae")).alias("skill_vs_persistencia_pct"),
        skill(F.col("mae"), F.col("baseline_estacional_mae")).alias("skill_vs_estacional_pct"))


def dispersion(bt: DataFrame) -> DataFrame:
    """Quasi-Poisson dispersion of the one-step residuals."""
    spread = (F.col("y") - F.col("yhat")) ** 2 / F.greatest(F.col("yhat"), F.lit(1.0))
    return bt.where("paso = 1").agg(F.coalesce(F.avg(spread), F.lit(0.0)).alias("dispersion"))


def band_half(yhat: Column, step: Column, phi: Column | float, scale: Column | float) -> Column:
    """Half-width that grows with the level and with the square root of the step."""
    as_col = [x if isinstance(x, Column) else F.lit(float(x)) for x in (phi, scale)]
    return as_col[1] * F.sqrt(as_col[0] * F.greatest(yhat, F.lit(1.0))) * F.sqrt(step)


def conformal(bt: DataFrame, level: float = BAND_LEVEL) -> DataFrame:
    """Band scale from the empirical quantile of standardised residuals, and its coverage."""
    phi = float(dispersion(bt).first()[0])
    unit = band_half(F.col("yhat"), F.col("paso"), phi, 1.0)
    standardised = F.abs(F.col("y") - F.col("yhat")) / F.greatest(unit, F.lit(1e-9))
    scale = exact_quantiles(bt, standardised, [level])[0]
    half = band_half(F.col("yhat"), F.col("paso"), phi, scale or 0.0)
    # Same comparison as the quantile itself, so that the boundary point counts as covered.
    inside = standardised <= F.lit(scale)
    return bt.agg(
        F.round(F.lit(phi), 4).alias("dispersion"), F.round(F.lit(scale), 4).alias("escala_banda"),
        F.round(100 * F.avg(inside.cast("int")), 1).alias("cobertura_pct"),
        F.round(F.avg(half), 4).alias("semiancho_medio"))


def blend_sweep(bt: DataFrame, weights: tuple[float, ...] = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)
                ) -> DataFrame:
    """Accuracy of several model/persistence mixes from one backtest of the raw model.

    Weights are exploded next to each row and aggregated at once, so the backtest is read once.
    """
    swept = bt.withColumn("peso_modelo", F.explode(F.array(*[F.lit(w) for w in weights])))
    swept = swept.withColumn("yhat", F.col("peso_modelo") * F.col("yhat")
                             + (1.0 - F.col("peso_modelo")) * F.col("persistencia"))
    both = swept.withColumn("alcance", F.explode(
        F.when(F.col("paso") == 1, F.array(F.lit("1_paso"), F.lit("multipaso")))
        .otherwise(F.array(F.lit("multipaso")))))
    return metrics(both, ["peso_modelo", "alcance"]).withColumn(
        "skill_vs_persistencia_pct", skill(F.col("mae"), F.col("baseline_mae")))


def model_verdict(bt: DataFrame) -> DataFrame:
    """Which baselines the forecast beats, at one step and over the whole horizon."""
    def flags(rows: DataFrame, suffix: str) -> DataFrame:
        return metrics(rows).select(
            (F.col("smape") < F.col("baseline_smape")).alias(f"supera_persistencia_smape{suffix}"),
            (F.col("mae") < F.col("baseline_mae")).alias(f"supera_persistencia_mae{suffix}"),
            (F.col("mae") < F.col("baseline_estacional_mae")).alias(f"supera_estacional_mae{suffix}"))

    multi = flags(bt, "_multipaso")
    row = multi.select(F.struct(*multi.columns).alias("m")).scalar()
    one = flags(bt.where("paso = 1"), "").withColumn("_m", row)
    return one.select("*", "_m.*").drop("_m")


def compare_scores(champion: DataFrame, challenger: DataFrame, margin: float = 0.01) -> DataFrame:
    """Verdict on two backtests by the relative multi-step error, within a tie margin."""
    def scores(bt: DataFrame, name: str) -> DataFrame:
        one = F.col("paso") == 1
        err = F.abs(F.col("y") - F.col("yhat"))
        return bt.agg(F.struct(
            F.round(F.avg(F.when(one, err)), 4).alias("uno"), F.round(F.avg(err), 4).alias("multi"),
        ).alias(name))

    out = scores(champion, "a").withColumn("b", scores(challenger, "b").scalar())
    gain = (F.col("a.multi") - F.col("b.multi")) / F.greatest(F.col("a.multi"), F.lit(1e-9))
    verdict = (F.when(gain > margin, F.lit("challenger")).when(gain < -margin, F.lit("champion"))
               .otherwise(F.lit("empate")))
    return out.select(
        F.col("a.uno").alias("champion_mae_1paso"), F.col("a.multi").alias("champion_mae_multipaso"),
        F.col("b.uno").alias("challenger_mae_1paso"), F.col("b.multi").alias("challenger_mae_multipaso"),
        F.round(gain, 4).alias("margen"), verdict.alias("veredicto"))
