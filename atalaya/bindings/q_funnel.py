"""Stage funnel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atalaya.bindings import frames as B
from atalaya.bindings.registry import query
from atalaya.bindings.sql_base import CTES, sql
from atalaya.operators import corpus, funnel

MIN_TITLE, MIN_TERRITORY = 1000, 100


def rate_sql(key: str, source: str = "cube") -> str:
    return f"""
      SELECT {key}, CAST(sum(n_procesos) AS BIGINT) AS total_procesos,
        CAST(sum(CASE WHEN clase_etapa = 'judicializado' THEN n_procesos ELSE 0 END) AS BIGINT) AS n_judicializados,
        CAST(sum(CASE WHEN clase_etapa <> 'desconocido' THEN n_procesos ELSE 0 END) AS BIGINT) AS procesos_etapa_conocida,
        round(100.0 * sum(CASE WHEN clase_etapa = 'judicializado' THEN n_procesos ELSE 0 END)
          / greatest(sum(CASE WHEN clase_etapa <> 'desconocido' THEN n_procesos ELSE 0 END), 1), 2) AS tasa_judicializacion_pct
      FROM {source} GROUP BY {key}"""


CTES["rates"] = f"""
    SELECT t.*, r.municipio, r.departamento FROM ({rate_sql('cod_municipio')}) t
    LEFT JOIN reference r ON t.cod_municipio = r.cod_municipio"""
CTES["titles"] = rate_sql("titulo_delito")
RATES = ("cod_municipio, total_procesos, n_judicializados, procesos_etapa_conocida, tasa_judicializacion_pct, "
         "municipio, departamento")


@query("funnel_annual", sql("SELECT cod_municipio, anio, etapa, clase_etapa, n_procesos FROM annual"))
def _(spark, sf):
    return funnel.funnel_annual(B.cube(spark, sf))


@query("funnel_territory", sql(f"SELECT {RATES} FROM rates"))
def _(spark, sf):
    return B.rates(spark, sf)


@query("funnel_title", sql("SELECT * FROM titles"))
def _(spark, sf):
    return funnel.funnel_rate(B.cube(spark, sf), "title")


@query("funnel_stage", sql("""
    SELECT etapa, clase_etapa, CAST(sum(n_procesos) AS BIGINT) AS n_procesos, CAST(CASE etapa WHEN 'Indagación' THEN 0
      WHEN 'Investigación' THEN 1 WHEN 'Juicio' THEN 2 WHEN 'Ejecución De Penas' THEN 3 ELSE 4 END AS INTEGER) AS orden
    FROM cube GROUP BY etapa, clase_etapa"""))
def _(spark, sf):
    return funnel.funnel_stage(B.cube(spark, sf))


@query("funnel_class", sql("""
    SELECT t AS total_procesos, i AS indagacion, j AS judicializado, d AS desconocido,
      round(100.0 * j / greatest(i + j, 1), 2) AS tasa_judicializacion_pct FROM (
      SELECT CAST(sum(n_procesos) AS BIGINT) AS t, CAST(sum(n_procesos) FILTER (clase_etapa = 'indagacion') AS BIGINT) AS i,
        CAST(sum(n_procesos) FILTER (clase_etapa = 'judicializado') AS BIGINT) AS j,
        CAST(sum(n_procesos) FILTER (clase_etapa = 'desconocido') AS BIGINT) AS d FROM cube)"""))
def _(spark, sf):
    return funnel.funnel_class(B.cube(spark, sf))


@query("funnel_year_rate", sql(rate_sql("anio")))
def _(spark, sf):
    return funnel.funnel_rate(B.cube(spark, sf), "year")


@query("funnel_region", sql("""
    SELECT substr(cod_municipio, 1, 2) AS cod_departamento, coalesce(min(departamento), '—') AS departamento,
      CAST(sum(total_procesos) AS BIGINT) AS total_procesos, CAST(sum(n_judicializados) AS BIGINT) AS n_judicializados,
      CAST(sum(procesos_etapa_conocida) AS BIGINT) AS procesos_etapa_conocida, count(*) AS municipios,
      round(100.0 * sum(n_judicializados) / sum(procesos_etapa_conocida), 6) AS tasa_judicializacion_pct
    FROM rates GROUP BY 1"""))
def _(spark, sf):
    return funnel.funnel_region(B.rates(spark, sf))


@query("funnel_coverage", sql("SELECT count(DISTINCT cod_municipio) AS municipios, min(anio) AS anio_min, max(anio) AS anio_max FROM cube"))
def _(spark, sf):
    return funnel.funnel_coverage(B.cube(spark, sf))


@query("funnel_discards", sql("""
    SELECT *, procesos_bronze - sin_municipio_valido - anio_invalido_o_fuera_de_rango - conteo_no_positivo AS procesos_gold,
      round(100.0 * (sin_municipio_valido + anio_invalido_o_fuera_de_rango + conteo_no_positivo) / greatest(procesos_bronze, 1), 2) AS descartados_pct
    FROM (SELECT count(*) AS filas_agregadas, CAST(sum(n_procesos) AS BIGINT) AS procesos_bronze,
      CAST(coalesce(sum(n_procesos) FILTER (causa = 'sin_municipio_valido'), 0) AS BIGINT) AS sin_municipio_valido,
      CAST(coalesce(sum(n_procesos) FILTER (causa = 'anio_invalido_o_fuera_de_rango'), 0) AS BIGINT) AS anio_invalido_o_fuera_de_rango,
      CAST(coalesce(sum(n_procesos) FILTER (causa = 'conteo_no_positivo'), 0) AS BIGINT) AS conteo_no_positivo
      FROM funnel_typed)"""))
def _(spark, sf):
    return funnel.funnel_discards(B.funnel_raw(spark, sf))


TITLE_COLS = "titulo_delito, total_procesos, n_judicializados, tasa_judicializacion_pct"
ELIGIBLE = f"FROM titles WHERE procesos_etapa_conocida >= {MIN_TITLE} AND titulo_delito <> 'Sin información'"


@query("title_ranking", sql(f"""
    SELECT *, 'mayor_tasa' AS tipo FROM (SELECT {TITLE_COLS} {ELIGIBLE} ORDER BY tasa_judicializacion_pct DESC, titulo_delito LIMIT 2)
    UNION ALL SELECT *, 'menor_tasa' FROM (SELECT {TITLE_COLS} {ELIGIBLE} ORDER BY tasa_judicializacion_pct, titulo_delito LIMIT 2)"""))
def _(spark, sf):
    return funnel.title_ranking(funnel.funnel_rate(B.cube(spark, sf), "title"), MIN_TITLE, 2)


@query("rate_extremes", sql(f"""
    SELECT *, 'mayor_tasa' AS tipo FROM (SELECT {RATES} FROM rates WHERE procesos_etapa_conocida >= {MIN_TERRITORY}
      ORDER BY tasa_judicializacion_pct DESC, cod_municipio LIMIT 7)
    UNION ALL SELECT *, 'menor_tasa' FROM (SELECT {RATES} FROM rates WHERE procesos_etapa_conocida >= {MIN_TERRITORY}
      ORDER BY tasa_judicializacion_pct, cod_municipio LIMIT 7)"""))
def _(spark, sf):
    return funnel.rate_extremes(B.rates(spark, sf), MIN_TERRITORY, 7)


@query("top_by_volume", sql(f"""
    SELECT cod_municipio, coalesce(municipio, cod_municipio) AS municipio, coalesce(departamento, '—') AS departamento,
      total_procesos, n_judicializados, procesos_etapa_conocida, tasa_judicializacion_pct
    FROM rates ORDER BY total_procesos DESC, cod_municipio LIMIT 10"""))
def _(spark, sf):
    return funnel.top_by_volume(funnel.serving_labels(B.rates(spark, sf)))


@query("anti_unmatched", sql("""
    SELECT DISTINCT cod_municipio, cod_municipio AS municipio FROM cube
    WHERE cod_municipio NOT IN (SELECT cod_municipio FROM reference)"""))
def _(spark, sf):
    return funnel.unmatched(B.cube(spark, sf), B.reference(spark, sf))


@query("drilldown_year_stage", sql("SELECT anio, etapa, clase_etapa, n_procesos FROM annual WHERE cod_municipio = '11000'"))
def _(spark, sf):
    return funnel.drilldown(funnel.funnel_annual(B.cube(spark, sf)), "11000")


@query("funnel_lookup", sql("""
    SELECT CAST(sum(total_procesos) AS BIGINT) AS total_procesos, CAST(sum(n_judicializados) AS BIGINT) AS n_judicializados,
      CAST(sum(procesos_etapa_conocida) AS BIGINT) AS procesos_etapa_conocida,
      round(100.0 * sum(n_judicializados) / greatest(sum(procesos_etapa_conocida), 1), 2) AS tasa_judicializacion_pct,
      (SELECT string_agg(titulo_delito || ': ' || format('{:.2f}', r), '; ' ORDER BY r, titulo_delito) FROM (SELECT titulo_delito, tasa_judicializacion_pct AS r
        """ + ELIGIBLE + """ ORDER BY r, titulo_delito LIMIT 3)) AS menor_tasa,
      (SELECT string_agg(titulo_delito || ': ' || format('{:.2f}', r), '; ' ORDER BY r DESC, titulo_delito) FROM (SELECT titulo_delito, tasa_judicializacion_pct AS r
        """ + ELIGIBLE + """ ORDER BY r DESC, titulo_delito LIMIT 3)) AS mayor_tasa FROM rates"""))
def _(spark, sf):
    return funnel.funnel_lookup(B.rates(spark, sf), titles=funnel.funnel_rate(B.cube(spark, sf), "title"), min_known=MIN_TITLE)


@query("funnel_lookup_territory", sql("""
    SELECT cod_municipio, municipio, total_procesos, n_judicializados, tasa_judicializacion_pct FROM rates
    WHERE cod_municipio = '11000'"""))
def _(spark, sf):
    return funnel.funnel_lookup(B.rates(spark, sf), "11000")


def _two(x: str) -> str:
    return f"format('{{:.2f}}', {x})"


@query("cards_funnel", sql(f"""
    WITH s AS (SELECT cod_municipio, coalesce(municipio, cod_municipio) AS municipio, coalesce(departamento, '—') AS departamento,
      total_procesos, n_judicializados, procesos_etapa_conocida, tasa_judicializacion_pct AS t FROM rates),
    c AS (SELECT CAST(sum(n_procesos) AS BIGINT) AS t, CAST(sum(n_procesos) FILTER (clase_etapa = 'indagacion') AS BIGINT) AS i,
      CAST(sum(n_procesos) FILTER (clase_etapa = 'judicializado') AS BIGINT) AS j FROM cube),
    e AS (SELECT titulo_delito AS l, tasa_judicializacion_pct AS t {ELIGIBLE}),
    m AS (SELECT municipio AS l, t FROM s WHERE procesos_etapa_conocida >= {MIN_TERRITORY})
    SELECT * FROM (SELECT 'Justicia: de ' || t || ' procesos penales, la TASA DE JUDICIALIZACIÓN nacional es ' || {_two('round(100.0 * j / greatest(i + j, 1), 2)')}
      || '%. Embudo: indagación ' || i || ', judicializado ' || j || '.' AS content, 'nacional' AS alcance FROM c
    UNION ALL SELECT 'Título penal «' || titulo_delito || '»: ' || total_procesos || ' procesos, ' || n_judicializados
      || ' superaron la indagación (' || {_two('tasa_judicializacion_pct')} || '% de los de etapa conocida).', 'titulo' FROM titles
    UNION ALL SELECT 'Justicia en ' || municipio || ' (' || departamento || '), código DANE ' || cod_municipio || ': ' || total_procesos
      || ' procesos, ' || n_judicializados || ' judicializados (superaron la indagación). Tasa de judicialización: ' || {_two('t')} || '%.', 'municipio'
      FROM (SELECT * FROM s ORDER BY total_procesos DESC, cod_municipio LIMIT 200)
    UNION ALL SELECT 'Títulos por tasa de judicialización. Mayor tasa: '
      || (SELECT string_agg(l || ': ' || {_two('t')} || '%', ', ' ORDER BY t DESC, l) FROM (SELECT * FROM e ORDER BY t DESC, l LIMIT 3)) || '. Menor tasa: '
      || (SELECT string_agg(l || ': ' || {_two('t')} || '%', ', ' ORDER BY t, l) FROM (SELECT * FROM e ORDER BY t, l LIMIT 3)) || '.', 'ranking-titulo'
    UNION ALL SELECT 'Municipios por tasa de judicialización. Mayor tasa: '
      || (SELECT string_agg(l || ': ' || {_two('t')} || '%', ', ' ORDER BY t DESC, l) FROM (SELECT * FROM m ORDER BY t DESC, l LIMIT 15)) || '. Menor tasa: '
      || (SELECT string_agg(l || ': ' || {_two('t')} || '%', ', ' ORDER BY t, l) FROM (SELECT * FROM m ORDER BY t, l LIMIT 15)) || '.', 'ranking') WHERE content IS NOT NULL"""))
def _(spark, sf):
    cards = corpus.cards_funnel(B.cube(spark, sf), B.reference(spark, sf), min_title=MIN_TITLE, min_territory=MIN_TERRITORY)
    return cards.select("content", F.col("metadata")["alcance"].alias("alcance"))
