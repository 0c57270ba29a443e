"""Forecast evaluation, monitoring, levers and the learned models."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from atalaya.bindings import frames as B
from atalaya.bindings.registry import query
from atalaya.bindings.sql_base import CTES, RESPONSE_SQL, sql
from atalaya.operators import anomaly, isolation
from atalaya.plans import forecast as FC, metrics as M, monitoring as MON
from atalaya.plans.linear import Ridge
from atalaya.plans.scenario import Scenario, scenario_projection
from atalaya.session import cut_lineage


def mae(p: str) -> str:
    return f"round(avg(abs(y - {p})), 4)"


def smape(p: str) -> str:
    return f"round(coalesce(100 * avg(CASE WHEN abs(y) + abs({p}) > 0 THEN 2 * abs({p} - y) / (abs(y) + abs({p})) END), 0.0), 2)"


def mase(p: str) -> str:
    return f"round(avg(CASE WHEN escala > 0 THEN abs({p} - y) / escala END), 4)"


METRICS_SQL = (f"count(*) AS n, {mae('yhat')} AS mae, {smape('yhat')} AS smape, {mae('persistencia')} AS baseline_mae, "
               f"{smape('persistencia')} AS baseline_smape, {mae('estacional')} AS baseline_estacional_mae, "
               f"{smape('estacional')} AS baseline_estacional_smape, {mase('yhat')} AS mase, {mase('persistencia')} AS baseline_mase")


@query("forecast_metrics", sql(f"SELECT origen, {METRICS_SQL} FROM btd GROUP BY origen"))
def _(spark, sf):
    return M.metrics(B.backtest(spark, sf), ["origen"])


@query("metrics_by_step", sql(f"SELECT paso, {METRICS_SQL} FROM btd GROUP BY paso"))
def _(spark, sf):
    return M.metrics_by_step(B.backtest(spark, sf))


@query("metrics_by_volume", sql(f"""
    WITH q AS (SELECT quantile_cont(volumen, 1/3) AS q1, quantile_cont(volumen, 2/3) AS q2 FROM btd WHERE paso = 1),
    s AS (SELECT b.*, q1, q2, CASE WHEN volumen <= q1 THEN 'bajo' WHEN volumen <= q2 THEN 'medio' ELSE 'alto' END AS estrato
      FROM btd b, q WHERE paso = 1)
    SELECT *, smape < baseline_smape AND mae <= baseline_mae AS gana_modelo FROM (SELECT estrato,
      CASE estrato WHEN 'bajo' THEN '≤' || format('{{:.1f}}', q1) WHEN 'medio' THEN format('{{:.1f}}', q1) || '–' || format('{{:.1f}}', q2)
        ELSE '>' || format('{{:.1f}}', q2) END AS rango_volumen_mensual, {METRICS_SQL} FROM s GROUP BY estrato, q1, q2)"""))
def _(spark, sf):
    return M.metrics_by_volume(B.backtest(spark, sf))


def skill_sql(base: str) -> str:
    return f"CASE WHEN {base} <> 0 THEN round(100.0 * (1.0 - mae / {base}), 1) END"


@query("skill_score", sql(f"""
    SELECT alcance, {skill_sql('baseline_mae')} AS skill_vs_persistencia_pct, {skill_sql('baseline_estacional_mae')} AS skill_vs_estacional_pct
    FROM (SELECT '1_paso' AS alcance, {METRICS_SQL} FROM btd WHERE paso = 1 UNION ALL SELECT 'multipaso', {METRICS_SQL} FROM btd)"""))
def _(spark, sf):
    return M.skill_table(cut_lineage(B.backtest(spark, sf)))


@query("dispersion", sql("SELECT round(avg((y - yhat) ** 2 / greatest(yhat, 1.0)), 6) AS dispersion FROM btd WHERE paso = 1"))
def _(spark, sf):
    return M.dispersion(B.backtest(spark, sf)).select(F.round("dispersion", 6).alias("dispersion"))


@query("conformal_band", sql("""
    WITH p AS (SELECT avg((y - yhat) ** 2 / greatest(yhat, 1.0)) AS phi FROM btd WHERE paso = 1),
    u AS (SELECT *, sqrt(phi * greatest(yhat, 1.0)) * sqrt(paso) AS unidad FROM btd, p),
    r AS (SELECT *, abs(y - yhat) / greatest(unidad, 1e-9) AS z FROM u),
    q AS (SELECT quantile_cont(z, 0.8) AS corte FROM r)
    SELECT round(any_value(phi), 4) AS dispersion, round(any_value(corte), 4) AS escala_banda,
      round(100 * avg(CASE WHEN z <= corte THEN 1 ELSE 0 END), 1) AS cobertura_pct, round(avg(corte * unidad), 4) AS semiancho_medio FROM r, q"""))
def _(spark, sf):
    return M.conformal(cut_lineage(B.backtest(spark, sf)))


@query("blend_sweep", sql(f"""
    WITH w AS (SELECT unnest([1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3]::DOUBLE[]) AS peso_modelo),
    s AS (SELECT b.* REPLACE (peso_modelo * estacional + (1.0 - peso_modelo) * persistencia AS yhat), peso_modelo FROM btd b, w)
    SELECT *, {skill_sql('baseline_mae')} AS skill_vs_persistencia_pct FROM (
      SELECT peso_modelo, '1_paso' AS alcance, {METRICS_SQL} FROM s WHERE paso = 1 GROUP BY peso_modelo
      UNION ALL SELECT peso_modelo, 'multipaso', {METRICS_SQL} FROM s GROUP BY peso_modelo)"""))
def _(spark, sf):
    raw = B.backtest(spark, sf).withColumn("yhat", F.col("estacional"))
    return M.blend_sweep(raw)


def flags_sql(suffix: str, where: str) -> str:
    return (f"SELECT smape < baseline_smape AS supera_persistencia_smape{suffix}, mae < baseline_mae AS supera_persistencia_mae{suffix}, "
            f"mae < baseline_estacional_mae AS supera_estacional_mae{suffix} FROM (SELECT {METRICS_SQL} FROM btd {where})")


@query("model_verdict", sql(f"SELECT * FROM ({flags_sql('', 'WHERE paso = 1')}), ({flags_sql('_multipaso', '')})"))
def _(spark, sf):
    return M.model_verdict(cut_lineage(B.backtest(spark, sf)))


@query("scenario_projection", sql("""
    WITH s AS (SELECT * FROM (VALUES ('base', 0.0::DOUBLE, 0), ('programa', -13.37::DOUBLE, 3), ('repunte', 20.0::DOUBLE, 0)) v(escenario, c, r)),
    p AS (SELECT cod_municipio, categoria, paso, periodo, escenario, prediccion AS base, prediccion, limite_inferior, limite_superior,
      1.0 + c / 100.0 * CASE WHEN r <= 0 THEN 1.0 ELSE least(1.0, CAST(paso AS DOUBLE) / r) END AS f FROM fc, s),
    o AS (SELECT cod_municipio, categoria, paso, periodo, escenario, base, round(greatest(0.0, prediccion * f), 2) AS prediccion,
      round(greatest(0.0, limite_inferior * f), 2) AS limite_inferior, round(greatest(0.0, limite_superior * f), 2) AS limite_superior FROM p)
    SELECT *, round(base - prediccion, 2) AS evitados, round(sum(round(base - prediccion, 2)) OVER (
      PARTITION BY cod_municipio, categoria, escenario ORDER BY paso), 2) AS evitados_acumulado FROM o"""))
def _(spark, sf):
    return scenario_projection(B.forecasts(spark, sf), [
        Scenario("base"), Scenario("programa", -13.37, 3), Scenario("repunte", 20.0, 0)])


# ---------------------------------------------------------------- monitoring
CTES["crime_months"] = f"""
    SELECT periodo, row_number() OVER (ORDER BY periodo DESC) AS r FROM (SELECT DISTINCT periodo FROM panel
      WHERE categoria NOT IN {RESPONSE_SQL})"""
CTES["drift"] = f"""
    SELECT p.*, r > 6 AS ref, ln(1 + CAST(cantidad AS DOUBLE)) AS x FROM panel p JOIN crime_months m ON p.periodo = m.periodo
    WHERE r <= 24 AND categoria NOT IN {RESPONSE_SQL}"""
CTES["psi_bins"] = """
    WITH e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS q FROM drift WHERE ref),
    b AS (SELECT ref, len(list_filter(q[2:len(q) - 1], lambda v: x >= v)) AS b FROM drift, e),
    t AS (SELECT count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM drift),
    s AS (SELECT greatest(count(*) FILTER (ref) / any_value(t.r), 1e-6) AS rp, greatest(count(*) FILTER (NOT ref) / any_value(t.c), 1e-6) AS cp
      FROM b, t GROUP BY b)
    SELECT round(sum((cp - rp) * ln(cp / rp)), 4) AS psi FROM s"""


@query("psi", sql("SELECT psi FROM psi_bins"))
def _(spark, sf):
    rows = B.panel(spark, sf).where(~F.col("categoria").isin(*B.RESPONSE))
    months = [r[0] for r in rows.select("periodo").distinct().orderBy(F.desc("periodo")).limit(24).collect()]
    used = rows.where(F.col("periodo") >= F.lit(months[-1]))
    return MON.psi(used, F.col("periodo") < F.lit(months[5]), F.col("cantidad"))


DRIFT_SQL = """
    SELECT psi, CASE WHEN psi >= 0.25 THEN 'rojo' WHEN psi >= 0.1 THEN 'amarillo' ELSE 'verde' END AS estado,
      round(vr, 1) AS volumen_mensual_referencia, round(vc, 1) AS volumen_mensual_reciente,
      round(100 * (vc - vr) / vr, 1) AS cambio_volumen_pct
    FROM psi_bins, (SELECT avg(q) FILTER (ref) AS vr, avg(q) FILTER (NOT ref) AS vc FROM (
      SELECT periodo, ref, CAST(sum(cantidad) AS DOUBLE) AS q FROM drift GROUP BY periodo, ref))"""


@query("data_drift", sql(DRIFT_SQL))
def _(spark, sf):
    return MON.data_drift(B.panel(spark, sf), B.RESPONSE)


# One category is cut off early, so that the stale branch is exercised.
CTES["stale_panel"] = "SELECT * FROM panel WHERE NOT (categoria = '3-MEDIUM' AND periodo > DATE '2000-08-01')"
FRESH_SQL = """
    SELECT strftime(m, '%Y-%m') AS periodo_max, CAST((2001 - year(m)) * 12 + 10 - month(m) AS INTEGER) AS lag_meses, coalesce(l, '') AS fuentes_estancadas,
      CASE WHEN (2001 - year(m)) * 12 + 10 - month(m) > 6 THEN 'rojo' WHEN (2001 - year(m)) * 12 + 10 - month(m) > 3 THEN 'amarillo'
        WHEN l IS NOT NULL THEN 'amarillo' ELSE 'verde' END AS estado
    FROM (SELECT max(periodo) AS m FROM stale_panel), (SELECT string_agg(categoria || ':' || strftime(c, '%Y-%m') || ':' || d, ', '
      ORDER BY d DESC, categoria) AS l FROM (SELECT categoria, max(periodo) AS c, (year((SELECT max(periodo) FROM stale_panel)) - year(max(periodo))) * 12
        + month((SELECT max(periodo) FROM stale_panel)) - month(max(periodo)) AS d FROM stale_panel GROUP BY categoria) WHERE d > 6)"""


def stale_panel(spark, sf):
    return B.panel(spark, sf).where(~((F.col("categoria") == "3-MEDIUM") & (F.col("periodo") > F.lit("2000-08-01").cast("date"))))



def now():
    return F.lit("2001-10-15").cast("date")


@query("freshness", sql(FRESH_SQL))
def _(spark, sf):
    return MON.freshness(stale_panel(spark, sf), now())


COVERAGE_SQL = """
    SELECT count(poblacion) > 0 AS disponible, round(100.0 * count(poblacion) / count(*), 1) AS cobertura_pct,
      CASE WHEN count(poblacion) > 0 AND round(100.0 * count(poblacion) / count(*), 1) >= 95 THEN 'verde' ELSE 'amarillo' END AS estado FROM panel_pop"""


@query("population_coverage", sql(COVERAGE_SQL))
def _(spark, sf):
    return MON.population_coverage(B.panel_pop(spark, sf))


LIGHT_SQL = f"""
    SELECT n, mae, smape, baseline_mae, baseline_smape, mae < baseline_mae AS supera_baseline_mae,
      CASE WHEN mae < baseline_mae THEN 'verde' ELSE 'amarillo' END AS estado FROM (SELECT {METRICS_SQL} FROM btd)"""


@query("health_report", sql(f"""
    WITH r AS (SELECT 'frescura' AS senal, estado FROM ({FRESH_SQL}) UNION ALL SELECT 'deriva', estado FROM ({DRIFT_SQL})
      UNION ALL SELECT 'poblacion', estado FROM ({COVERAGE_SQL}) UNION ALL SELECT 'backtest', estado FROM ({LIGHT_SQL}))
    SELECT * FROM r UNION ALL SELECT 'global', CASE WHEN count(*) FILTER (estado = 'rojo') > 0 THEN 'rojo'
      WHEN count(*) FILTER (estado = 'amarillo') > 0 THEN 'amarillo' ELSE 'verde' END FROM r"""))
def _(spark, sf):
    return MON.health_report({
        "frescura": MON.freshness(stale_panel(spark, sf), now()), "deriva": MON.data_drift(B.panel(spark, sf), B.RESPONSE),
        "poblacion": MON.population_coverage(B.panel_pop(spark, sf)), "backtest": MON.backtest_light(B.backtest(spark, sf))})


@query("modeling_target", sql("""
    SELECT cod_municipio, categoria, periodo, round(cantidad / greatest(coalesce(poblacion, 100000.0), 1.0) * 100000, 6) AS objetivo FROM panel_pop"""))
def _(spark, sf):
    out, _ = FC.modeling_target(B.panel_pop(spark, sf))
    return out.select("cod_municipio", "categoria", "periodo", F.round("objetivo", 6).alias("objetivo"))


# ---------------------------------------------------------------- learned linear models, which SQL can fit and repeat
MIX = Ridge(("lag_1", "lag_12"), 0.05)
SEASON = Ridge(("lag_12",))
NEWEST = Ridge(("lag_1",), 0.2)


def every_series(spark, sf):
    """All series of the panel, also those with few non-zero months."""
    return FC.prepare_panel(B.panel(spark, sf), 0)


def weights_sql(ridge: Ridge) -> str:
    """Weights of the newest value (a) and the one a year before (b) and the constant (c), from sums over known months."""
    own = 1 + ridge.strength
    if len(ridge.features) == 2:
        a, b = (f"({own} * {v} * {t} - {s} * {u}) / ({own} * {own} * vx * vz - s * s)" for v, t, s, u in (
            ("vz", "tx", "s", "tz"), ("vx", "tz", "s", "tx")))
    else:
        a, b = (f"{t} / ({own} * {v})" if f in ridge.features else "0.0::DOUBLE" for f, t, v in (("lag_1", "tx", "vx"), ("lag_12", "tz", "vz")))
    return f"SELECT origen, a, b, my - a * mx - b * mz AS c FROM (SELECT *, {a} AS a, {b} AS b FROM sums)"


def sums_sql(origins: str) -> str:
    return f"""
    SELECT origen, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, avg(x * x) - avg(x) * avg(x) AS vx, avg(z * z) - avg(z) * avg(z) AS vz,
      avg(x * z) - avg(x) * avg(z) AS s, avg(x * y) - avg(x) * avg(y) AS tx, avg(z * y) - avg(z) * avg(y) AS tz
    FROM {origins} JOIN lagged ON periodo < origen WHERE z IS NOT NULL GROUP BY origen"""


def model_sql(bt: str, origins: str, ridge: Ridge) -> str:
    """Backtest rows with the recursive forecast of the model fitted before each origin, and the served mix."""
    return f"""
    WITH sums AS ({sums_sql(origins)}), w AS ({weights_sql(ridge)})
    SELECT * EXCLUDE (a, b, c), 0.7 * yhat_modelo + (1 - 0.7) * persistencia AS yhat FROM (
      SELECT t.*, list_reduce([persistencia] || list(estacional) OVER (PARTITION BY t.origen, cod_municipio, categoria ORDER BY paso
        ROWS UNBOUNDED PRECEDING), lambda p, v: greatest(0.0::DOUBLE, c + a * p + b * v)) AS yhat_modelo, a, b, c FROM {bt} t JOIN w ON w.origen = t.origen)"""


CTES["lagged"] = """
    SELECT periodo, CAST(cantidad AS DOUBLE) AS y, CAST(lag(cantidad, 1) OVER s AS DOUBLE) AS x, CAST(lag(cantidad, 12) OVER s AS DOUBLE) AS z
    FROM panel WINDOW s AS (PARTITION BY cod_municipio, categoria ORDER BY periodo)"""
for cte, other in (("origins", "origins12"), ("before", "before12"), ("bt", "bt12")):
    CTES[other] = (CTES[cte].replace("greatest(1, n - 8) AND n - 6", "greatest(1, n - 13) AND n - 12").replace("FROM origins o", "FROM origins12 o")
                   .replace("FROM before b", "FROM before12 b").replace("b.idx + 5", "b.idx + 11"))
CTES["btm"] = model_sql("bt", "origins", MIX)
CTES["btm_season"] = model_sql("bt", "origins", SEASON)
CTES["btm_newest"] = model_sql("bt", "origins", NEWEST)
CTES["btm12"] = model_sql("bt12", "origins12", MIX)
CTES["whole"] = "SELECT CAST(max(periodo) + INTERVAL 1 MONTH AS DATE) AS origen FROM panel"
CTES["btm_band"] = """
    WITH p AS (SELECT avg((y - yhat) ** 2 / greatest(yhat, 1.0)) AS phi FROM btm WHERE paso = 1)
    SELECT any_value(phi) AS phi, quantile_cont(abs(y - yhat) / greatest(sqrt(phi * greatest(yhat, 1.0)) * sqrt(paso), 1e-9), 0.8) AS escala_z
    FROM btm, p"""


@query("train_forecaster", sql(f"""
    SELECT m.*, round(phi, 4) AS dispersion, round(escala_z, 4) AS escala_banda FROM (SELECT {METRICS_SQL} FROM btm) m, btm_band"""))
def _(spark, sf):
    """Backtest metrics of the model, its dispersion and band scale."""
    return trained(FC.train(B.panel(spark, sf), min_nonzero=0, make_estimator=MIX))


@query("forecast_recursive", sql("""
    WITH sums AS (""" + sums_sql("whole") + "), w AS (" + weights_sql(MIX) + """),
    ser AS (SELECT cod_municipio, categoria, list(CAST(cantidad AS DOUBLE) ORDER BY periodo) AS v, max(periodo) AS ultimo FROM panel GROUP BY ALL),
    st AS (SELECT *, len(v) AS n, unnest(range(1, 7)) AS k FROM ser),
    m AS (SELECT st.*, list_reduce([v[n]] || list_transform(range(1, k + 1), lambda j: CASE WHEN n - 12 + j >= 1 THEN v[n - 12 + j] ELSE 0.0 END),
      lambda p, x: greatest(0.0::DOUBLE, c + a * p + b * x)) AS modelo FROM st, w),
    f AS (SELECT *, 0.7 * modelo + (1 - 0.7) * v[n] AS u FROM m),
    h AS (SELECT f.*, escala_z * sqrt(phi * greatest(u, 1.0)) * sqrt(k) AS ancho FROM f, btm_band)
    SELECT cod_municipio, categoria, CAST(k AS INTEGER) AS paso, CAST(ultimo + to_months(CAST(k AS INTEGER)) AS DATE) AS periodo, round(u, 2) AS prediccion,
      round(greatest(0.0, u - ancho), 2) AS limite_inferior, round(u + ancho, 2) AS limite_superior FROM h"""))
def _(spark, sf):
    return FC.forecast(FC.train(B.panel(spark, sf), min_nonzero=0, make_estimator=MIX))


@query("walk_forward", sql("""
    SELECT origen, paso, cod_municipio, categoria, periodo, y, round(yhat, 4) AS yhat, persistencia, estacional, round(escala, 4) AS escala,
      round(volumen, 4) AS volumen FROM btm"""))
def _(spark, sf):
    return rounded_bt(FC.walk_forward(B.panel(spark, sf), make_estimator=MIX, prepared=every_series(spark, sf)))


@query("backtest_long", sql(LIGHT_SQL.replace("btd", "btm12")))
def _(spark, sf):
    rows = FC.walk_forward(B.panel(spark, sf), 12, 2, MIX, prepared=every_series(spark, sf))
    return MON.backtest_light(cut_lineage(rows))


def errors_sql(bt: str) -> str:
    return f"SELECT round(avg(abs(y - yhat)) FILTER (paso = 1), 4) AS uno, round(avg(abs(y - yhat)), 4) AS multi FROM {bt}"


@query("champion_challenger", sql(f"""
    SELECT a.uno AS champion_mae_1paso, a.multi AS champion_mae_multipaso, b.uno AS challenger_mae_1paso, b.multi AS challenger_mae_multipaso,
      round((a.multi - b.multi) / greatest(a.multi, 1e-9), 4) AS margen, CASE WHEN (a.multi - b.multi) / greatest(a.multi, 1e-9) > 0.01 THEN 'challenger'
        WHEN (a.multi - b.multi) / greatest(a.multi, 1e-9) < -0.01 THEN 'champion' ELSE 'empate' END AS veredicto
    FROM ({errors_sql('btm')}) a, ({errors_sql('btm_season')}) b"""))
def _(spark, sf):
    return FC.champion_challenger(B.panel(spark, sf), MIX, SEASON, min_nonzero=0)


@query("hpo_temporal", sql("\nUNION ALL\n".join(
    f"SELECT '{name}' AS candidato, round(avg(abs(y - yhat)), 4) AS mae_multipaso FROM {bt}"
    for name, bt in (("mezcla", "btm"), ("estacional", "btm_season"), ("ultimo", "btm_newest")))))
def _(spark, sf):
    grid = {"mezcla": MIX, "estacional": SEASON, "ultimo": NEWEST}
    return FC.hpo_temporal(B.panel(spark, sf), grid, min_nonzero=0)


# ---------------------------------------------------------------- learned models (no SQL equivalent)
def trees(depth: int = 5):
    """Boosted trees of twenty rounds; the operators take any estimator."""
    return FC.default_estimator(iterations=20, depth=depth, rate=0.2)


def linear():
    return LinearRegression(featuresCol="features", labelCol="objetivo", predictionCol="pred", regParam=0.1, solver="normal")


def trained(fitted):
    return M.metrics(fitted.backtest).withColumns({
        "dispersion": F.lit(round(fitted.dispersion, 4)), "escala_banda": F.lit(round(fitted.band_scale, 4))})


def rounded_bt(df):
    return df.select("origen", "paso", "cod_municipio", "categoria", "periodo", "y", F.round("yhat", 4).alias("yhat"),
                     "persistencia", "estacional", F.round("escala", 4).alias("escala"), F.round("volumen", 4).alias("volumen"))


@query("isolation_score")
def _(spark, sf):
    rows = anomaly.z_scores(B.panel(spark, sf), B.RESPONSE).withColumn("_y", F.col("cantidad").cast("double"))
    rows = cut_lineage(anomaly.robust_z(rows, "_y", "z_nivel"))
    out = isolation.isolation_score(rows, ["z_residuo", "z_nivel"], ["cod_municipio", "categoria", "periodo"])
    return out.select("cod_municipio", "categoria", "periodo", F.round("aislamiento", 6).alias("aislamiento"), "aislado")


@query("detect_anomalies", sql("""
    SELECT cod_municipio, municipio, departamento, categoria, periodo, cantidad, score_z, severidad FROM alerts WHERE month(periodo) % 2 = 0"""))
def _(spark, sf):
    """Both signals, the second one given: even months."""
    return anomaly.detect(B.panel(spark, sf), B.RESPONSE, threshold=B.ALERT_Z, isolated=F.month("periodo") % 2 == 0)


@query("detect_anomalies_forest")
def _(spark, sf):
    return anomaly.detect(B.panel(spark, sf), B.RESPONSE, threshold=B.ALERT_Z)


@query("train_forecaster_trees")
def _(spark, sf):
    return trained(FC.train(B.panel_pop(spark, sf), make_estimator=trees))


@query("forecast_recursive_trees")
def _(spark, sf):
    return FC.forecast(FC.train(B.panel_pop(spark, sf), make_estimator=trees))


@query("walk_forward_trees")
def _(spark, sf):
    return rounded_bt(FC.walk_forward(B.panel_pop(spark, sf), make_estimator=trees))


@query("backtest_long_trees")
def _(spark, sf):
    return MON.backtest_light(cut_lineage(FC.walk_forward(B.panel(spark, sf), 12, 2, trees)))


@query("champion_challenger_trees")
def _(spark, sf):
    return FC.champion_challenger(B.panel(spark, sf), trees, linear)


@query("hpo_temporal_trees")
def _(spark, sf):
    return FC.hpo_temporal(B.panel(spark, sf), {"profundidad_3": lambda: trees(3), "profundidad_5": trees, "lineal": linear})


@query("permutation_importance")
def _(spark, sf):
    return FC.permutation_importance(FC.train(B.panel_pop(spark, sf), make_estimator=trees))


@query("population_shock")
def _(spark, sf):
    return FC.shocked_forecast(FC.train(B.panel_pop(spark, sf), make_estimator=trees), "11000", 10.0)
