"""Panels, joins, aggregations, windows, rankings and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from atalaya import functions as A
from atalaya.bindings import frames as B
from atalaya.bindings.registry import query
from atalaya.bindings.sql_base import CTES, K2, K5, RESPONSE_SQL, sql
from atalaya.operators import anomaly, corpus, features as W, panel as P, quality, serve
from atalaya.plans.backtest import baseline_backtest, join_actuals

PANEL_COLUMNS = f"{K5}, periodo, cantidad, anio, mes, naturaleza"
SUMMARY_COLUMNS = ("cod_municipio, total_hechos, total_delitos, total_respuestas, categorias, primer_anio, ultimo_anio, "
                   "municipio, departamento")
ORIGIN = "2000-06-01"
CODE, CATEGORY = "11000", "1-URGENT"
ALERTS = "cod_municipio, municipio, departamento, categoria, periodo, cantidad, score_z, severidad"


@query("monthly_series", sql(f"SELECT {PANEL_COLUMNS} FROM panel"))
def _(spark, sf):
    return B.panel(spark, sf)


@query("territory_summary", sql(f"SELECT {SUMMARY_COLUMNS} FROM summary"))
def _(spark, sf):
    return B.summary(spark, sf)


@query("canonical_name", sql("SELECT cod_municipio, municipio, departamento FROM names"))
def _(spark, sf):
    return P.canonical_name(B.events_v(spark, sf))


@query("category_year", sql("SELECT categoria, anio, cantidad, naturaleza FROM cat_year"))
def _(spark, sf):
    return B.cat_year(spark, sf)


@query("nature_share", sql("""
    SELECT naturaleza, CAST(sum(cantidad) AS BIGINT) AS hechos,
      round(100.0 * sum(cantidad) / sum(sum(cantidad)) OVER (), 2) AS participacion_pct FROM cat_year GROUP BY naturaleza"""))
def _(spark, sf):
    return P.nature_share(B.events_u(spark, sf), B.RESPONSE)


@query("join_population_clip", sql(f"SELECT {PANEL_COLUMNS}, poblacion FROM panel_pop"))
def _(spark, sf):
    return B.panel_pop(spark, sf)


@query("join_coords", sql("SELECT s.cod_municipio, total_delitos, lat, lon FROM summary s LEFT JOIN reference r "
                          "ON s.cod_municipio = r.cod_municipio"))
def _(spark, sf):
    return P.attach_coords(B.summary(spark, sf).select("cod_municipio", "total_delitos"), B.reference(spark, sf))


KPI_SQL = sql("""
    SELECT r.*, a.*, c.*, p.* FROM (
      SELECT count(*) AS municipios, count(DISTINCT substr(cod_municipio, 1, 2)) AS departamentos,
        CAST(sum(total_hechos) AS BIGINT) AS total_hechos, CAST(sum(total_delitos) AS BIGINT) AS total_delitos,
        CAST(sum(total_respuestas) AS BIGINT) AS total_respuestas FROM summary) r,
      (SELECT count(*) AS anomalias, count(*) FILTER (severidad = 'ALTA') AS anomalias_alta,
        count(*) FILTER (severidad = 'MEDIA') AS anomalias_media FROM alerts) a,
      (SELECT count(DISTINCT categoria) AS categorias FROM panel WHERE naturaleza = 'delito') c,
      (SELECT strftime(min(periodo), '%Y-%m') AS periodo_min, strftime(max(periodo), '%Y-%m') AS periodo_max FROM panel) p""")


@query("national_kpis", KPI_SQL)
def _(spark, sf):
    return P.national_kpis(B.summary(spark, sf), B.panel(spark, sf), B.alerts(spark, sf))


@query("join_kpi_cross", sql("""
    SELECT (SELECT count(*) FROM summary) AS municipios, (SELECT count(DISTINCT categoria) FROM panel) AS categorias,
      (SELECT strftime(max(periodo), '%Y-%m') FROM panel) AS periodo_max"""))
def _(spark, sf):
    """One-row aggregates side by side, as scalar subqueries rather than a cross join."""
    panel = B.panel(spark, sf)
    row = panel.agg(F.struct(F.count_distinct("categoria").alias("c"), F.max("periodo").alias("hi"))).scalar()
    out = B.summary(spark, sf).agg(F.count(F.lit(1)).alias("municipios")).withColumn("_p", row)
    return out.select("municipios", F.col("_p.c").alias("categorias"), A.period_str(F.col("_p.hi")).alias("periodo_max"))


@query("region_rollup", sql("""
    SELECT substr(cod_municipio, 1, 2) AS cod_departamento, min(departamento) AS departamento,
      CAST(sum(total_delitos) AS BIGINT) AS total_delitos, count(*) AS municipios FROM summary GROUP BY 1"""))
def _(spark, sf):
    return P.region_rollup(B.summary(spark, sf))


@query("category_list", sql(f"SELECT DISTINCT categoria FROM panel WHERE cod_municipio = '{CODE}'"))
def _(spark, sf):
    return P.category_list(B.panel(spark, sf), CODE)


@query("territory_detail", sql(f"""
    SELECT categoria, naturaleza, CAST(sum(cantidad) AS BIGINT) AS total FROM panel
    WHERE cod_municipio = '{CODE}' GROUP BY ALL"""))
def _(spark, sf):
    return P.territory_detail(B.panel(spark, sf), CODE)


@query("territory_detail_top", sql(f"""
    SELECT categoria, naturaleza, CAST(sum(cantidad) AS BIGINT) AS total FROM panel
    WHERE cod_municipio = '{CODE}' AND naturaleza = 'delito' GROUP BY ALL ORDER BY total DESC, categoria LIMIT 2"""))
def _(spark, sf):
    return P.territory_detail(B.panel(spark, sf), CODE, 2)


@query("series_stats", sql("""
    SELECT count(*) FILTER (busy >= 12) AS series_modeladas,
      count(DISTINCT CASE WHEN busy >= 12 THEN cod_municipio END) AS municipios_modelados,
      count(DISTINCT CASE WHEN busy >= 12 THEN categoria END) AS categorias_modeladas,
      CAST(coalesce(sum(q) FILTER (busy >= 12), 0) AS BIGINT) AS hechos_modelados,
      strftime(min(lo) FILTER (busy >= 12), '%Y-%m') AS periodo_min,
      strftime(max(hi) FILTER (busy >= 12), '%Y-%m') AS periodo_max,
      round(100.0 * count(*) FILTER (busy >= 12) / count(*), 1) AS series_pct,
      round(100.0 * sum(q) FILTER (busy >= 12) / sum(q), 1) AS hechos_pct
    FROM (SELECT cod_municipio, categoria, count(*) FILTER (cantidad > 0) AS busy, sum(cantidad) AS q,
            min(periodo) AS lo, max(periodo) AS hi FROM panel GROUP BY ALL)"""))
def _(spark, sf):
    return quality.series_stats(B.panel(spark, sf))


# ---------------------------------------------------------------- windows
WIN = f"WINDOW w AS (PARTITION BY {K2} ORDER BY periodo)"
LAGS_SQL = ", ".join(f"lag(cantidad, {n}) OVER w AS lag_{n}" for n in (1, 2, 3, 6, 12))


def roll_sql(size: int, places: int = 6) -> str:
    frame = f"OVER (PARTITION BY {K2} ORDER BY periodo ROWS BETWEEN {size} PRECEDING AND 1 PRECEDING)"
    full = f"count(cantidad) {frame} = {size}"
    return (f"round(CASE WHEN {full} THEN avg(cantidad) {frame} END, {places}) AS roll_mean_{size}, "
            f"round(CASE WHEN {full} THEN stddev_samp(cantidad) {frame} END, {places}) AS roll_std_{size}")


ROLLS_SQL = ", ".join(roll_sql(n) for n in (3, 6, 12))
HIST_SQL = f"round(avg(cantidad) OVER (PARTITION BY {K2} ORDER BY periodo ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 6)"


def rounded(df, names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


ROLL_NAMES = [f"roll_{k}_{n}" for n in (3, 6, 12) for k in ("mean", "std")]


@query("lags", sql(f"SELECT {K2}, periodo, cantidad, {LAGS_SQL} FROM panel {WIN}"))
def _(spark, sf):
    return W.with_lags(B.panel(spark, sf).select("cod_municipio", "categoria", "periodo", "cantidad"))


@query("rolling_mean_std", sql(f"SELECT {K2}, periodo, {ROLLS_SQL} FROM panel"))
def _(spark, sf):
    out = W.with_rolling(B.panel(spark, sf).select("cod_municipio", "categoria", "periodo", "cantidad"))
    return rounded(out, ROLL_NAMES).drop("cantidad")


@query("hist_mean", sql(f"SELECT {K2}, periodo, {HIST_SQL} AS media_hist FROM panel"))
def _(spark, sf):
    out = W.with_hist_mean(B.panel(spark, sf)).select("cod_municipio", "categoria", "periodo", "media_hist")
    return rounded(out, ["media_hist"])


@query("months_active", sql(f"SELECT {K2}, periodo, CAST(row_number() OVER w - 1 AS DOUBLE) AS meses_activos FROM panel {WIN}"))
def _(spark, sf):
    return W.with_months_active(B.panel(spark, sf)).select("cod_municipio", "categoria", "periodo", "meses_activos")


EXOG_SQL = f"round(ln(1 + poblacion), 6) AS log_poblacion, round({HIST_SQL[6:-4]} / CASE WHEN poblacion > 0 THEN poblacion END * 100000, 6) AS tasa_hist"
CALENDAR_SQL = ("CAST(month(periodo) AS DOUBLE) AS mes, CAST(quarter(periodo) AS DOUBLE) AS trimestre, "
                "round(sin(2 * pi() * month(periodo) / 12), 6) + 0.0 AS mes_sin, round(cos(2 * pi() * month(periodo) / 12), 6) + 0.0 AS mes_cos, "
                "CAST((year(periodo) - (SELECT min(year(periodo)) FROM panel)) * 12 + month(periodo) AS DOUBLE) AS trend")


@query("exog_features", sql(f"SELECT {K2}, periodo, {EXOG_SQL} FROM panel_pop"))
def _(spark, sf):
    out = W.with_exog(W.with_hist_mean(B.panel_pop(spark, sf)))
    return rounded(out.select("cod_municipio", "categoria", "periodo", "log_poblacion", "tasa_hist"), ["log_poblacion", "tasa_hist"])


@query("calendar_features", sql(f"SELECT {K2}, periodo, {CALENDAR_SQL} FROM panel"))
def _(spark, sf):
    out = W.calendar_features(B.panel(spark, sf)).select(
        "cod_municipio", "categoria", "periodo", "mes", "trimestre", "mes_sin", "mes_cos", "trend")
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("mes_sin", "mes_cos")})


@query("feature_panel", sql(f"""
    SELECT {K2}, periodo, cantidad, {LAGS_SQL}, {ROLLS_SQL}, {HIST_SQL} AS media_hist,
      CAST(row_number() OVER w - 1 AS DOUBLE) AS meses_activos, {EXOG_SQL}, {CALENDAR_SQL} FROM panel_pop {WIN}"""))
def _(spark, sf):
    out = W.make_features(B.panel_pop(spark, sf)).drop("municipio", "departamento", "cod_departamento", "anio", "naturaleza", "poblacion")
    out = rounded(out, [*ROLL_NAMES, "media_hist", "log_poblacion", "tasa_hist"])
    return out.withColumns({c: F.round(c, 6) + 0.0 for c in ("mes_sin", "mes_cos")})


@query("rolling_median", sql(f"SELECT {K2}, periodo, mediana_movil FROM zbase"))
def _(spark, sf):
    rows = W.min_history(B.panel(spark, sf).where(~F.col("categoria").isin(*B.RESPONSE)))
    return anomaly.rolling_median(rows).select("cod_municipio", "categoria", "periodo", "mediana_movil")


@query("robust_z", sql(f"SELECT {K2}, periodo, round(z_residuo, 6) + 0.0 AS z_residuo FROM zscore"))
def _(spark, sf):
    out = anomaly.z_scores(B.panel(spark, sf), B.RESPONSE)
    return out.select("cod_municipio", "categoria", "periodo", (F.round("z_residuo", 6) + 0.0).alias("z_residuo"))


@query("history_filter", sql(f"""
    SELECT {K2}, periodo, cantidad FROM panel QUALIFY count(*) OVER (PARTITION BY {K2}) >= 79"""))
def _(spark, sf):
    return W.min_history(B.panel(spark, sf), 79).select("cod_municipio", "categoria", "periodo", "cantidad")


@query("active_series", sql(f"""
    SELECT {K2}, periodo, cantidad FROM panel QUALIFY count(*) FILTER (cantidad > 0) OVER (PARTITION BY {K2}) >= 62"""))
def _(spark, sf):
    return W.active_series(B.panel(spark, sf), 62).select("cod_municipio", "categoria", "periodo", "cantidad")


@query("naive_scale", sql(f"""
    SELECT {K2}, round(avg(d), 6) AS escala FROM (SELECT {K2}, abs(cantidad - lag(cantidad) OVER w) AS d FROM panel
      WHERE periodo < DATE '{ORIGIN}' {WIN}) GROUP BY ALL"""))
def _(spark, sf):
    return rounded(W.naive_scale(B.panel(spark, sf), F.lit(ORIGIN).cast("date")), ["escala"])


@query("last_value", sql(f"""
    SELECT {K2}, arg_max(cantidad, periodo) AS ultimo, round(avg(cantidad), 6) AS volumen_medio
    FROM panel WHERE periodo < DATE '{ORIGIN}' GROUP BY ALL"""))
def _(spark, sf):
    return rounded(W.last_value(B.panel(spark, sf), F.lit(ORIGIN).cast("date")), ["volumen_medio"])


@query("latest_n", sql(f"""
    SELECT {K2}, strftime(periodo, '%Y-%m') AS periodo, cantidad, CAST(sum(cantidad) OVER () AS BIGINT) AS total_periodo
    FROM (SELECT * FROM panel WHERE cod_municipio = '{CODE}' AND categoria = '{CATEGORY}' ORDER BY periodo DESC LIMIT 24)"""))
def _(spark, sf):
    return W.latest_n(B.panel(spark, sf), CODE, CATEGORY, 24)


@query("join_seasonal_naive", sql(f"""
    SELECT a.cod_municipio, a.categoria, a.periodo, a.cantidad AS y, coalesce(b.cantidad, 0) AS estacional
    FROM panel a LEFT JOIN panel b ON a.cod_municipio = b.cod_municipio AND a.categoria = b.categoria
      AND b.periodo = CAST(a.periodo - INTERVAL 12 MONTH AS DATE) AND b.periodo < DATE '{ORIGIN}'
    WHERE a.periodo >= DATE '{ORIGIN}'"""))
def _(spark, sf):
    return W.seasonal_naive(B.panel(spark, sf), F.lit(ORIGIN).cast("date"))


@query("join_actuals", sql(f"""
    SELECT f.cod_municipio, f.categoria, f.periodo, f.prediccion, CAST(p.cantidad AS DOUBLE) AS y
    FROM fc f JOIN panel p ON f.cod_municipio = p.cod_municipio AND f.categoria = p.categoria AND f.periodo = p.periodo"""))
def _(spark, sf):
    fc = B.forecasts(spark, sf).select("cod_municipio", "categoria", "periodo", "prediccion")
    return join_actuals(fc, B.panel(spark, sf))


# ---------------------------------------------------------------- anomalies
@query("z_alerts", sql(f"SELECT {ALERTS} FROM alerts"))
def _(spark, sf):
    return B.alerts(spark, sf)


@query("corroboration", sql("""
    SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_anomalias, CAST(coalesce(sum(n) FILTER (k >= 2), 0) AS BIGINT) AS n_corroboradas,
      count(*) FILTER (k >= 2) AS n_clusters_multidelito,
      coalesce(round(coalesce(sum(n) FILTER (k >= 2), 0) / sum(n), 3), 0.0) AS fraccion_corroborada
    FROM (SELECT cod_municipio, periodo, count(*) AS n, count(DISTINCT categoria) AS k FROM alerts GROUP BY ALL)"""))
def _(spark, sf):
    return anomaly.corroboration(B.alerts(spark, sf))


CTES["hits"] = """
    SELECT e.cod_municipio, e.periodo, e.categoria, coalesce(bool_or(a.cod_municipio IS NOT NULL), false) AS detectado
    FROM doc_events e LEFT JOIN alerts a ON a.cod_municipio = e.cod_municipio
      AND abs((year(a.periodo) - CAST(substr(e.periodo, 1, 4) AS INTEGER)) * 12 + month(a.periodo) - CAST(substr(e.periodo, 6, 2) AS INTEGER)) <= 1
    GROUP BY ALL"""
CTES["hits_cat"] = CTES["hits"].replace("<= 1", "<= 2 AND (e.categoria IS NULL OR e.categoria = a.categoria)")


@query("join_event_window", sql("SELECT cod_municipio, periodo, categoria, detectado FROM hits"))
def _(spark, sf):
    return anomaly.match_events(B.alerts(spark, sf), B.doc_events(spark, sf), 1, False)


@query("join_event_window_category", sql("SELECT cod_municipio, periodo, categoria, detectado FROM hits_cat"))
def _(spark, sf):
    return anomaly.match_events(B.alerts(spark, sf), B.doc_events(spark, sf), 2, True)


@query("event_recall", sql("""
    SELECT count(*) AS n_eventos, count(*) FILTER (detectado) AS n_detectados,
      round(count(*) FILTER (detectado) / count(*), 3) AS recall, CAST(2 AS INTEGER) AS window_months, true AS by_categoria FROM hits_cat"""))
def _(spark, sf):
    return anomaly.event_recall(B.alerts(spark, sf), B.doc_events(spark, sf), 2, True)


@query("anomaly_stats", sql(f"""
    SELECT total, alta, media, meses AS universo_meses_serie, round(100.0 * total / meses, 3) AS tasa_alertas_pct,
      series AS series_evaluadas, con AS series_con_alerta, round(total / series, 2) AS alertas_por_serie
    FROM (SELECT count(*) AS total, count(*) FILTER (severidad = 'ALTA') AS alta, count(*) FILTER (severidad = 'MEDIA') AS media,
            count(DISTINCT cod_municipio || '|' || categoria) AS con FROM alerts),
      (SELECT CAST(sum(n) AS BIGINT) AS meses, count(*) AS series FROM (SELECT count(*) AS n FROM panel
        WHERE categoria NOT IN {RESPONSE_SQL} GROUP BY {K2}) WHERE n >= 18)"""))
def _(spark, sf):
    return anomaly.anomaly_stats(B.alerts(spark, sf), B.panel(spark, sf), B.RESPONSE)


@query("detector_confusion", sql("""
    WITH d AS (SELECT DISTINCT cod_municipio, strftime(periodo, '%Y-%m') AS periodo FROM alerts),
    t AS (SELECT DISTINCT cod_municipio, periodo FROM doc_events),
    c AS (SELECT count(*) FILTER (d.periodo IS NOT NULL AND t.periodo IS NOT NULL) AS tp,
      count(*) FILTER (t.periodo IS NULL) AS fp, count(*) FILTER (d.periodo IS NULL) AS fn
      FROM d FULL JOIN t ON d.cod_municipio = t.cod_municipio AND d.periodo = t.periodo)
    SELECT tp, fp, fn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall FROM c"""))
def _(spark, sf):
    found = B.alerts(spark, sf).withColumn("periodo", A.period_str(F.col("periodo")))
    return anomaly.confusion(found, B.doc_events(spark, sf), ["cod_municipio", "periodo"])


@query("latest_anomalies", sql("""
    SELECT cod_municipio, CAST(r AS INTEGER) AS orden, n AS n_anomalias, categoria, strftime(periodo, '%Y-%m') AS periodo,
      cantidad, severidad, score_z FROM (SELECT *, count(*) OVER (PARTITION BY cod_municipio) AS n, row_number() OVER (
        PARTITION BY cod_municipio ORDER BY periodo DESC, categoria) AS r FROM alerts) WHERE r <= 5"""))
def _(spark, sf):
    return anomaly.latest_anomalies(B.alerts(spark, sf), 5)


# ---------------------------------------------------------------- rankings, pages, legends
@query("national_rank", sql("""
    SELECT cod_municipio, municipio, total_delitos, row_number() OVER (ORDER BY total_delitos DESC, cod_municipio) AS puesto
    FROM summary"""))
def _(spark, sf):
    return serve.national_rank(B.summary(spark, sf))


@query("top_territories", sql(f"SELECT {SUMMARY_COLUMNS} FROM summary ORDER BY total_delitos DESC, cod_municipio LIMIT 10"))
def _(spark, sf):
    return serve.top_territories(B.summary(spark, sf), 10)


@query("territory_names", sql("SELECT cod_municipio, municipio, departamento FROM summary"))
def _(spark, sf):
    return serve.territory_names(B.summary(spark, sf))


@query("time_series", sql(f"""
    SELECT strftime(periodo, '%Y-%m') AS periodo, cantidad FROM panel
    WHERE cod_municipio = '{CODE}' AND categoria = '{CATEGORY}'"""))
def _(spark, sf):
    return serve.time_series(B.panel(spark, sf), CODE, CATEGORY)


SEARCH_SQL = """(contains(translate(lower(municipio), 'áéíóúüñ', 'aeiouun'), 'urgent') OR
      contains(translate(lower(departamento), 'áéíóúüñ', 'aeiouun'), 'urgent') OR
      contains(translate(lower(categoria), 'áéíóúüñ', 'aeiouun'), 'urgent'))"""


@query("search_filter", sql(f"SELECT {ALERTS} FROM alerts WHERE severidad = 'MEDIA' AND {SEARCH_SQL}"))
def _(spark, sf):
    return serve.search(B.alerts(spark, sf), "Úrgént", "MEDIA")


@query("paged_alerts", sql(f"""
    SELECT cod_municipio, municipio, departamento, categoria, strftime(periodo, '%Y-%m') AS periodo, cantidad, score_z, severidad,
      (SELECT count(*) FROM alerts WHERE {SEARCH_SQL}) AS total
    FROM (SELECT * FROM alerts WHERE {SEARCH_SQL} ORDER BY score_z DESC, periodo DESC, cod_municipio, categoria LIMIT 20 OFFSET 10)"""))
def _(spark, sf):
    page, total = serve.alerts(B.alerts(spark, sf), q="urgent", sort="score_z", limit=20, offset=10)
    return page.withColumn("total", total.scalar())


@query("client_page", sql("""
    SELECT cod_municipio, total_delitos, CAST(2 AS INTEGER) AS pagina, CAST(11 AS INTEGER) AS desde,
      CAST(least(20, (SELECT count(*) FROM summary)) AS INTEGER) AS hasta, CAST((SELECT count(*) FROM summary) AS INTEGER) AS total
    FROM (SELECT * FROM summary ORDER BY total_delitos DESC, cod_municipio LIMIT 10 OFFSET 10)"""))
def _(spark, sf):
    rows = B.summary(spark, sf).select("cod_municipio", "total_delitos")
    return serve.client_page(rows, [F.desc("total_delitos"), "cod_municipio"], 2, 10)


@query("category_ranking", sql("""
    SELECT categoria, municipio, departamento, total, CAST(r AS INTEGER) AS puesto, total_nacional FROM (
      SELECT categoria, municipio, departamento, CAST(sum(total) AS BIGINT) AS total, row_number() OVER (
        PARTITION BY categoria ORDER BY sum(total) DESC, municipio, departamento) AS r,
        CAST(sum(sum(total)) OVER (PARTITION BY categoria) AS BIGINT) AS total_nacional
      FROM totals GROUP BY categoria, municipio, departamento) WHERE r <= 15"""))
def _(spark, sf):
    return serve.category_ranking(B.totals(spark, sf))


@query("category_leader", sql("""
    SELECT categoria, municipio, total FROM (SELECT categoria, municipio, CAST(sum(total) AS BIGINT) AS total, row_number() OVER (
      PARTITION BY categoria ORDER BY sum(total) DESC, municipio) AS r FROM totals GROUP BY categoria, municipio) WHERE r = 1"""))
def _(spark, sf):
    return serve.category_leader(B.totals(spark, sf))


@query("top_category_reference", sql("""
    SELECT categoria, CAST(sum(cantidad) AS BIGINT) AS total, (SELECT max(anio) - 2 FROM cat_year) AS anio,
      CAST(sum(cantidad) FILTER (anio = (SELECT max(anio) - 2 FROM cat_year)) AS BIGINT) AS cantidad
    FROM cat_year GROUP BY categoria ORDER BY total DESC, categoria LIMIT 3"""))
def _(spark, sf):
    return serve.top_category_reference(B.cat_year(spark, sf))


@query("quantile_classes", sql("""
    WITH b AS (SELECT quantile_cont(CAST(total_delitos AS DOUBLE), [1/7, 2/7, 3/7, 4/7, 5/7, 6/7]) AS q FROM summary),
    c AS (SELECT cod_municipio, total_delitos, q, CAST(len(list_filter(q, lambda x: x < total_delitos)) AS INTEGER) AS clase FROM summary, b)
    SELECT cod_municipio, total_delitos, clase,
      CAST(CASE WHEN clase = 0 THEN 0 ELSE CAST(round(q[clase]) AS BIGINT) + 1 END AS BIGINT) AS desde,
      CAST(round(q[clase + 1]) AS BIGINT) AS hasta FROM c"""))
def _(spark, sf):
    return serve.quantile_classes(B.summary(spark, sf).select("cod_municipio", "total_delitos"), "total_delitos")


@query("history_with_forecast", sql(f"""
    SELECT p.cod_municipio, p.categoria, p.periodo, CAST(p.cantidad AS DOUBLE) AS historico,
      CASE WHEN r = 1 AND f.cod_municipio IS NOT NULL THEN CAST(p.cantidad AS DOUBLE) END AS pronostico,
      CAST(NULL AS DOUBLE) AS limite_inferior, CAST(NULL AS DOUBLE) AS limite_superior
    FROM (SELECT *, row_number() OVER (PARTITION BY {K2} ORDER BY periodo DESC) AS r FROM panel) p
    LEFT JOIN (SELECT DISTINCT {K2} FROM fc) f ON p.cod_municipio = f.cod_municipio AND p.categoria = f.categoria WHERE r <= 24
    UNION ALL SELECT {K2}, periodo, NULL, prediccion, limite_inferior, limite_superior FROM fc"""))
def _(spark, sf):
    return serve.splice(B.panel(spark, sf), B.forecasts(spark, sf))


@query("top_categories_text", sql("""
    SELECT cod_municipio, string_agg(categoria || ' (' || total || ')', ', ' ORDER BY r) AS top_categorias FROM (
      SELECT cod_municipio, categoria, total, row_number() OVER (PARTITION BY cod_municipio ORDER BY total DESC, categoria) AS r
      FROM totals) WHERE r <= 3 GROUP BY cod_municipio"""))
def _(spark, sf):
    return corpus.top_categories(B.totals(spark, sf), 3)


@query("admin_breakdown", """
    SELECT dimension, CAST(r AS INTEGER) AS orden, valor, n, distintos FROM (
      SELECT dimension, valor, n, row_number() OVER (PARTITION BY dimension ORDER BY n DESC, valor) AS r,
        count(*) OVER (PARTITION BY dimension) AS distintos FROM (
          SELECT 'tipo' AS dimension, p_type AS valor, count(*) AS n FROM part GROUP BY p_type
          UNION ALL SELECT 'marca', p_brand, count(*) FROM part GROUP BY p_brand
          UNION ALL SELECT 'nombre', p_name, count(*) FROM part GROUP BY p_name)) WHERE r <= 5""")
def _(spark, sf):
    rows = B.load(spark, sf, "part", ["p_type", "p_brand", "p_name"])
    return corpus.admin_breakdown(rows, [("p_type", "tipo", 5), ("p_brand", "marca", 5), ("p_name", "nombre", 5), ("falta", "x", 3)])


BT_ROUND = "round(persistencia, 6) AS persistencia, round(estacional, 6) AS estacional, round(escala, 6) AS escala, round(volumen, 6) AS volumen"


@query("baseline_backtest", sql(f"SELECT origen, paso, {K2}, periodo, y, {BT_ROUND} FROM bt"))
def _(spark, sf):
    return rounded(baseline_backtest(B.panel(spark, sf), 6, 3), ["persistencia", "estacional", "escala", "volumen"])
