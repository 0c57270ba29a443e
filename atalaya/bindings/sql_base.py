"""Shared parts of the oracle SQL: the same derived tables, written independently for DuckDB."""

from __future__ import annotations

import re

RESPONSE_SQL = "('4-NOT SPECIFIED', '5-LOW')"
K5 = "cod_departamento, departamento, cod_municipio, municipio, categoria"
K2 = "cod_municipio, categoria"

_CODE = ("lpad(CAST(n_regionkey * 10 + 11 AS VARCHAR), 2, '0') || "
         "lpad(CAST(n_nationkey AS VARCHAR), 3, '0')")
_DEP = "lpad(CAST(n_regionkey * 10 + 11 AS VARCHAR), 2, '0')"
_FROM = ("FROM orders JOIN customer ON o_custkey = c_custkey "
         "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_WORD = "upper(translate(substr(md5(s_name), 1, 8), '0123456789', 'ghijklmnop'))"

CTES: dict[str, str] = {
    "events_u": f"""
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS fecha,
          CAST(year(o_orderdate) AS BIGINT) AS anio, CAST(month(o_orderdate) AS BIGINT) AS mes,
          {_DEP} AS cod_departamento, r_name AS departamento, {_CODE} AS cod_municipio,
          n_name AS municipio, o_orderpriority AS categoria, CAST(1 AS BIGINT) AS cantidad,
          'src_' || lower(o_orderstatus) AS fuente, c_mktsegment AS segmento, o_totalprice
        {_FROM}""",
    "events_v": """
        SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN municipio || ' CT' ELSE municipio END
                          AS municipio) FROM events_u""",
    "cells": f"""
        SELECT {K5}, CAST(date_trunc('month', fecha) AS DATE) AS periodo,
          CAST(sum(cantidad) AS BIGINT) AS cantidad FROM events_u GROUP BY ALL""",
    "bounds": f"SELECT {K5}, min(periodo) AS lo, max(periodo) AS hi FROM cells GROUP BY ALL",
    "cal": f"""
        SELECT {K5}, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP),
          INTERVAL 1 MONTH)) AS DATE) AS periodo FROM bounds""",
    "panel": f"""
        SELECT {K5}, periodo, coalesce(cantidad, 0) AS cantidad,
          CAST(year(periodo) AS BIGINT) AS anio, CAST(month(periodo) AS BIGINT) AS mes,
          CASE WHEN categoria IN {RESPONSE_SQL} THEN 'respuesta' ELSE 'delito' END AS naturaleza
        FROM cal LEFT JOIN cells USING ({K5}, periodo)""",
    "people": f"""
        SELECT {_CODE} AS cod_municipio, CAST(y AS BIGINT) AS anio,
          CAST(count(*) * 1000 + (y - 1997) * 50 AS BIGINT) AS poblacion
        FROM customer JOIN nation ON c_nationkey = n_nationkey,
          (SELECT unnest([1997, 1998, 1999, 2000]) AS y)
        WHERE n_nationkey <> 3 GROUP BY n_regionkey, n_nationkey, y""",
    "panel_pop": f"""
        SELECT p.*, CAST(d.poblacion AS DOUBLE) AS poblacion FROM panel p LEFT JOIN people d
        ON p.cod_municipio = d.cod_municipio AND d.anio =
          least(greatest(p.anio, (SELECT min(anio) FROM people)), (SELECT max(anio) FROM people))""",
    "reference": f"""
        SELECT {_CODE} AS cod_municipio, {_DEP} AS cod_departamento,
          'Villa ' || n_name AS municipio, r_name AS departamento,
          4.5 + n_nationkey / 8.0 AS lat, -(70.25 + n_nationkey / 4.0) AS lon
        FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name NOT IN ('NATION_5', 'NATION_11', 'NATION_17', 'NATION_23')""",
    "summary": f"""
        SELECT cod_municipio, CAST(sum(cantidad) AS BIGINT) AS total_hechos,
          CAST(sum(CASE WHEN categoria IN {RESPONSE_SQL} THEN 0 ELSE cantidad END) AS BIGINT) AS total_delitos,
          CAST(sum(CASE WHEN categoria IN {RESPONSE_SQL} THEN cantidad ELSE 0 END) AS BIGINT) AS total_respuestas,
          count(DISTINCT CASE WHEN categoria NOT IN {RESPONSE_SQL} THEN categoria END) AS categorias,
          min(anio) AS primer_anio, max(anio) AS ultimo_anio, n.municipio, n.departamento
        FROM events_v JOIN names n USING (cod_municipio)
        GROUP BY cod_municipio, n.municipio, n.departamento""",
    "names": """
        SELECT cod_municipio, municipio, departamento FROM (
          SELECT cod_municipio, municipio, departamento, row_number() OVER (
            PARTITION BY cod_municipio ORDER BY count(*) DESC, municipio, departamento) AS r
          FROM events_v GROUP BY cod_municipio, municipio, departamento) WHERE r = 1""",
    "totals": """
        SELECT cod_municipio, municipio, departamento, categoria, naturaleza,
          CAST(sum(cantidad) AS BIGINT) AS total FROM panel GROUP BY ALL""",
    "cat_year": f"""
        SELECT categoria, anio, CAST(sum(cantidad) AS BIGINT) AS cantidad,
          CASE WHEN categoria IN {RESPONSE_SQL} THEN 'respuesta' ELSE 'delito' END AS naturaleza
        FROM events_u GROUP BY categoria, anio""",
    # ---- anomalies (z signal) ----
    "zbase": f"""
        SELECT *, coalesce(CASE WHEN n12 >= 6 THEN m12 END, mall) AS mediana_movil FROM (
          SELECT *, count(*) OVER (PARTITION BY {K2}) AS n_hist,
            count(cantidad) OVER w AS n12, median(cantidad) OVER w AS m12,
            median(cantidad) OVER (PARTITION BY {K2}) AS mall
          FROM panel WHERE categoria NOT IN {RESPONSE_SQL}
          WINDOW w AS (PARTITION BY {K2} ORDER BY periodo ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
        WHERE n_hist >= 18""",
    "zdev": f"""
        SELECT *, CAST(cantidad AS DOUBLE) - mediana_movil - median(CAST(cantidad AS DOUBLE) - mediana_movil)
          OVER (PARTITION BY {K2}) AS dev FROM zbase""",
    "zscore": f"""
        SELECT *, coalesce(dev / CASE WHEN mad > 0 THEN mad / 0.6745
            ELSE greatest(mean_ad / 0.7979, 1.0) END, 0.0) AS z_residuo
        FROM (SELECT *, median(abs(dev)) OVER (PARTITION BY {K2}) AS mad,
                avg(abs(dev)) OVER (PARTITION BY {K2}) AS mean_ad FROM zdev)""",
    "alerts": """
        SELECT cod_municipio, municipio, departamento, categoria, periodo, cantidad,
          round(z_residuo, 2) AS score_z, CASE WHEN abs(z_residuo) > 5 THEN 'ALTA' ELSE 'MEDIA' END AS severidad
        FROM zscore WHERE abs(z_residuo) > 2.0 AND cantidad > mediana_movil""",
    "doc_events": """
        SELECT cod_municipio, strftime(fecha, '%Y-%m') AS periodo,
          CASE WHEN CAST(cod_municipio AS INTEGER) % 2 = 0 THEN NULL ELSE categoria END AS categoria
        FROM (SELECT *, row_number() OVER (PARTITION BY cod_municipio, anio
                ORDER BY o_totalprice DESC, o_orderkey) AS r FROM events_u) WHERE r = 1""",
    # ---- funnel ----
    "funnel_raw": f"""
        SELECT cod_dane_hecho, etapa, a_o_hecho, titulo_delito, CAST(count(*) AS VARCHAR) AS n_procesos
        FROM (SELECT
          CASE WHEN o_orderkey % 53 = 0 THEN '' WHEN o_orderkey % 59 = 0 THEN '00000' ELSE {_CODE} END AS cod_dane_hecho,
          CASE WHEN o_orderstatus = 'O' THEN 'Indagación'
               WHEN o_orderstatus = 'F' THEN CASE o_orderkey % 3 WHEN 0 THEN 'Juicio'
                 WHEN 1 THEN 'Ejecución De Penas' ELSE ' Investigación ' END
               WHEN o_orderkey % 5 = 0 THEN 'Sin Información' ELSE 'Indagación' END AS etapa,
          CASE WHEN o_orderkey % 61 = 0 THEN 'Sin Información' WHEN o_orderkey % 67 = 0 THEN '1999'
               ELSE CAST(year(o_orderdate) + 10 AS VARCHAR) END AS a_o_hecho,
          CASE WHEN o_orderkey % 31 = 0 THEN ' ' ELSE c_mktsegment END AS titulo_delito
          {_FROM}) GROUP BY ALL""",
    "funnel_typed": """
        SELECT cod_municipio, anio, etapa, n_procesos, titulo_delito,
          CASE WHEN cod_municipio IS NULL THEN 'sin_municipio_valido'
               WHEN anio IS NULL OR anio NOT BETWEEN 2003 AND 2026 THEN 'anio_invalido_o_fuera_de_rango'
               WHEN n_procesos <= 0 THEN 'conteo_no_positivo' END AS causa
        FROM (SELECT
          CASE WHEN length(cod_dane_hecho) BETWEEN 1 AND 5 AND substr(lpad(cod_dane_hecho, 5, '0'), 1, 2) <> '00'
               THEN lpad(cod_dane_hecho, 5, '0') END AS cod_municipio,
          TRY_CAST(a_o_hecho AS BIGINT) AS anio, trim(etapa) AS etapa,
          CAST(n_procesos AS BIGINT) AS n_procesos,
          CASE WHEN trim(titulo_delito) = '' THEN 'Sin información' ELSE trim(titulo_delito) END AS titulo_delito
          FROM funnel_raw)""",
    "cube": """
        SELECT cod_municipio, anio, etapa, n_procesos, titulo_delito,
          CASE WHEN etapa IN ('Investigación', 'Juicio', 'Ejecución De Penas') THEN 'judicializado'
               WHEN etapa = 'Indagación' THEN 'indagacion' ELSE 'desconocido' END AS clase_etapa
        FROM funnel_typed WHERE causa IS NULL""",
    "annual": """
        SELECT cod_municipio, anio, etapa, clase_etapa, CAST(sum(n_procesos) AS BIGINT) AS n_procesos
        FROM cube GROUP BY ALL""",
    # ---- backtest with a deterministic forecast ----
    "periods": """
        SELECT periodo, row_number() OVER (ORDER BY periodo) - 1 AS idx, count(*) OVER () AS n
        FROM (SELECT DISTINCT periodo FROM panel)""",
    "origins": """
        SELECT periodo AS origen, idx FROM periods WHERE idx BETWEEN greatest(1, n - 8) AND n - 6""",
    "before": f"""
        SELECT o.origen, o.idx, {K2}, arg_max(CAST(cantidad AS DOUBLE), periodo) AS persistencia,
          avg(d) AS escala, avg(CAST(cantidad AS DOUBLE)) AS volumen
        FROM origins o JOIN (SELECT *, CAST(abs(cantidad - lag(cantidad) OVER (
            PARTITION BY {K2} ORDER BY periodo)) AS DOUBLE) AS d FROM panel) p ON p.periodo < o.origen
        GROUP BY ALL""",
    "bt": """
        SELECT b.origen, CAST(q.idx - b.idx + 1 AS INTEGER) AS paso, a.cod_municipio, a.categoria, a.periodo,
          CAST(a.cantidad AS DOUBLE) AS y, b.persistencia,
          CAST(coalesce(s.cantidad, 0) AS DOUBLE) AS estacional, b.escala, b.volumen
        FROM before b JOIN periods q ON q.idx BETWEEN b.idx AND b.idx + 5
        JOIN panel a ON a.cod_municipio = b.cod_municipio AND a.categoria = b.categoria AND a.periodo = q.periodo
        LEFT JOIN panel s ON s.cod_municipio = a.cod_municipio AND s.categoria = a.categoria
          AND s.periodo = CAST(a.periodo - INTERVAL 12 MONTH AS DATE) AND s.periodo < b.origen""",
    "btd": "SELECT *, 0.7 * estacional + (1 - 0.7) * persistencia AS yhat FROM bt",
    # ---- forecasts from the seasonal baseline, for levers and splices ----
    "fc": """
        SELECT cod_municipio, categoria, paso, periodo, round(yhat, 2) AS prediccion,
          round(greatest(0.0, yhat - sqrt(greatest(yhat, 1.0)) * sqrt(paso)), 2) AS limite_inferior,
          round(yhat + sqrt(greatest(yhat, 1.0)) * sqrt(paso), 2) AS limite_superior
        FROM btd WHERE origen = (SELECT max(origen) FROM btd)""",
    # ---- questions and names ----
    "gazetteer": f"""
        SELECT CAST(s_suppkey + 10000 AS VARCHAR) AS cod_municipio,
          CASE s_suppkey % 3 WHEN 0 THEN 'SAN ' || {_WORD} WHEN 1 THEN 'SANTIAGO DE ' || {_WORD}
            ELSE {_WORD} END AS municipio, n_name AS departamento, {_WORD} AS palabra, s_suppkey
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "questions": """
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 THEN '¿Qué pasó con ' ELSE '¿Cuál es el pronóstico de ' END
          || CASE o_orderpriority WHEN '1-URGENT' THEN 'homicidios' WHEN '2-HIGH' THEN 'hurto a carros'
               WHEN '3-MEDIUM' THEN 'amenazas' WHEN '4-NOT SPECIFIED' THEN 'capturas' ELSE 'el clima' END
          || ' en ' || CASE WHEN o_orderkey % 4 = 0 THEN translate(lower(municipio), 'ao', 'áó')
               WHEN o_orderkey % 4 = 1 THEN lower(palabra)
               WHEN o_orderkey % 4 = 2 THEN substr(palabra, 1, 3) || substr(palabra, 5)
               WHEN o_orderkey % 8 = 3 THEN 'Santiago' ELSE 'el país' END || '?' AS texto
        FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS sk FROM lineitem GROUP BY l_orderkey)
          ON o_orderkey = l_orderkey JOIN gazetteer ON sk = s_suppkey""",
    "qwords": """
        SELECT id, texto, regexp_extract_all(upper(strip_accents(texto)), '[A-Z0-9]+') AS w FROM questions""",
    "qa": """
        SELECT CAST(o_orderkey AS VARCHAR) AS id, n_name,
          CASE WHEN o_orderkey % 6 IN (3, 4) THEN 'fuera_alcance' WHEN o_orderkey % 6 = 0 THEN 'municipio'
               WHEN o_orderkey % 6 = 1 THEN 'justicia' WHEN o_orderkey % 6 = 2 THEN 'ranking' ELSE 'fuzzy' END AS categoria,
          CAST(floor(o_totalprice) AS BIGINT) + CASE WHEN o_orderkey % 12 = 0 THEN 1 ELSE 0 END AS esperada,
          CASE o_orderkey % 6
            WHEN 0 THEN 'Se registraron ' || replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.')
                        || ' hechos en ' || CAST(year(o_orderdate) AS VARCHAR)
            WHEN 1 THEN CASE WHEN o_orderkey % 4 = 1 THEN 'La tasa es 8,51 %' ELSE 'La tasa es 851 %' END
            WHEN 2 THEN 'El municipio con más casos es ' || lower(n_name)
            WHEN 3 THEN 'No encontré información sobre eso; datos a 2026.'
            WHEN 4 THEN 'No puedo responder, pero hubo 4500 casos' END AS respuesta,
          o_orderkey % 6 AS clase, CAST(o_orderkey % 3 AS BIGINT) AS n_fuentes,
          CAST(o_orderkey % 50 AS DOUBLE) / 10 AS latencia_s
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
}


def sql(final: str) -> str:
    """Prepend the derived tables that a query names, directly or through each other."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(final)
    if not needed:
        return final
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    if final.lstrip().upper().startswith("WITH "):
        return f"WITH {parts},\n{final.lstrip()[5:]}"
    return f"WITH {parts}\n{final}"
