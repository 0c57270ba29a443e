"""Test tables seen as events, panels, funnels, questions and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from atalaya.operators import anomaly, funnel, panel as P
from atalaya.plans.backtest import baseline_backtest
from atalaya.sources.catalog import SourceSpec
from atalaya.sources.readers import load

RESPONSE = ["4-NOT SPECIFIED", "5-LOW"]
ALERT_Z = 2.0
# Nations without an official name, so that unmatched codes occur.
UNNAMED = ["NATION_5", "NATION_11", "NATION_17", "NATION_23"]

RAW_CATALOG = [
    SourceSpec("src_iso", "A", "HURTO_PERSONAS"),
    SourceSpec("src_dmy", "B", "HURTO_OTRAS_MODALIDADES", "dmy"),
    SourceSpec("src_cap", "B", "CAPTURAS", "dmy", "respuesta"),
    SourceSpec("src_none", "A", "SECUESTRO"),
]


def dep_code() -> Column:
    return F.lpad((F.col("n_regionkey") * 10 + 11).cast("string"), 2, "0")


def code() -> Column:
    return F.concat(dep_code(), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))


def order_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with customer, nation and region. Dimension sides are left to Spark to place."""
    orders = load(spark, sf, "orders")
    customer = load(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    )


def events_u(spark: SparkSession, sf: str) -> DataFrame:
    return order_facts(spark, sf).select(
        "o_orderkey", F.to_date("o_orderdate").alias("fecha"),
        F.year("o_orderdate").cast("bigint").alias("anio"),
        F.month("o_orderdate").cast("bigint").alias("mes"),
        dep_code().alias("cod_departamento"), F.col("r_name").alias("departamento"),
        code().alias("cod_municipio"), F.col("n_name").alias("municipio"),
        F.col("o_orderpriority").alias("categoria"), F.lit(1).cast("bigint").alias("cantidad"),
        F.concat(F.lit("src_"), F.lower("o_orderstatus")).alias("fuente"),
        F.col("c_mktsegment").alias("segmento"), "o_totalprice")


def events_v(spark: SparkSession, sf: str) -> DataFrame:
    """The same events with a spelling variant of the name in some rows."""
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat("municipio", F.lit(" CT"))).otherwise(F.col("municipio"))
    return events_u(spark, sf).withColumn("municipio", name)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return P.monthly_series(events_u(spark, sf), RESPONSE)


def people(spark: SparkSession, sf: str) -> DataFrame:
    customer, nation = load(spark, sf, "customer", ["c_nationkey"]), load(spark, sf, "nation")
    counts = customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).where("n_nationkey <> 3")
    years = F.explode(F.array(*[F.lit(y).cast("bigint") for y in (1997, 1998, 1999, 2000)]))
    return counts.select(code().alias("cod_municipio"), "n", years.alias("anio")).select(
        "cod_municipio", "anio", (F.col("n") * 1000 + (F.col("anio") - 1997) * 50).alias("poblacion"))


def panel_pop(spark: SparkSession, sf: str) -> DataFrame:
    return P.attach_population(panel(spark, sf), people(spark, sf))


def reference(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).where(~F.col("n_name").isin(*UNNAMED))
    return rows.select(
        code().alias("cod_municipio"), dep_code().alias("cod_departamento"),
        F.concat(F.lit("Villa "), "n_name").alias("municipio"), F.col("r_name").alias("departamento"),
        (4.5 + F.col("n_nationkey") / 8.0).alias("lat"), (-(70.25 + F.col("n_nationkey") / 4.0)).alias("lon"))


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.territory_summary(events_v(spark, sf), RESPONSE)


def totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals do not need the zero months, so they come straight from the observed cells."""
    cells = P.monthly_counts(events_u(spark, sf))
    return P.series_totals(cells.withColumn("naturaleza", P.nature(F.col("categoria"), RESPONSE)))


def cat_year(spark: SparkSession, sf: str) -> DataFrame:
    return P.category_year(events_u(spark, sf), RESPONSE)


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.z_alerts(panel(spark, sf), RESPONSE, threshold=ALERT_Z)


def doc_events(spark: SparkSession, sf: str) -> DataFrame:
    """The month of the largest order of each territory and year; half of them name a category."""
    best = F.max_by(F.struct("fecha", "categoria"), F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k")))
    rows = events_u(spark, sf).groupBy("cod_municipio", "anio").agg(best.alias("b"))
    return rows.select(
        "cod_municipio", F.date_format("b.fecha", "yyyy-MM").alias("periodo"),
        F.when(F.col("cod_municipio").cast("int") % 2 != 0, F.col("b.categoria")).alias("categoria"))


def funnel_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Ungrouped process rows as all-text columns."""
    key = F.col("o_orderkey")
    stage = (F.when(F.col("o_orderstatus") == "O", "Indagación")
             .when(F.col("o_orderstatus") == "F",
                   F.when(key % 3 == 0, "Juicio").when(key % 3 == 1, "Ejecución De Penas").otherwise(" Investigación "))
             .when(key % 5 == 0, "Sin Información").otherwise("Indagación"))
    year = (F.when(key % 61 == 0, "Sin Información").when(key % 67 == 0, "1999")
            .otherwise((F.year("o_orderdate") + 10).cast("string")))
    return order_facts(spark, sf).select(
        F.when(key % 53 == 0, "").when(key % 59 == 0, "00000").otherwise(code()).alias("cod_dane_hecho"),
        stage.alias("etapa"), year.alias("a_o_hecho"),
        F.when(key % 31 == 0, " ").otherwise(F.col("c_mktsegment")).alias("titulo_delito"))


def funnel_raw(spark: SparkSession, sf: str) -> DataFrame:
    rows = funnel_rows(spark, sf)
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("string").alias("n_procesos"))


def cube(spark: SparkSession, sf: str) -> DataFrame:
    return funnel.funnel_cube(funnel_raw(spark, sf))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return funnel.with_names(funnel.funnel_rate(cube(spark, sf), "territory"), reference(spark, sf))


def backtest(spark: SparkSession, sf: str) -> DataFrame:
    """Backtest whose forecast is a fixed mix of the two baselines, so that SQL can repeat it."""
    bt = baseline_backtest(panel(spark, sf), 6, 3)
    return bt.withColumn("yhat", 0.7 * F.col("estacional") + (1 - 0.7) * F.col("persistencia"))


def forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast table of the newest origin of that backtest."""
    bt = backtest(spark, sf)
    newest = bt.agg(F.max("origen")).scalar()
    half = F.sqrt(F.greatest("yhat", F.lit(1.0))) * F.sqrt("paso")
    return bt.where(F.col("origen") == newest).select(
        "cod_municipio", "categoria", "paso", "periodo", F.round("yhat", 2).alias("prediccion"),
        F.round(F.greatest(F.lit(0.0), F.col("yhat") - half), 2).alias("limite_inferior"),
        F.round(F.col("yhat") + half, 2).alias("limite_superior"))


def gazetteer(spark: SparkSession, sf: str) -> DataFrame:
    word = F.upper(F.translate(F.substring(F.md5(F.col("s_name")), 1, 8), "0123456789", "ghijklmnop"))
    rows = load(spark, sf, "supplier", ["s_suppkey", "s_name", "s_nationkey"]).join(
        load(spark, sf, "nation", ["n_nationkey", "n_name"]), F.col("s_nationkey") == F.col("n_nationkey"))
    name = (F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("SAN "), word))
            .when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("SANTIAGO DE "), word)).otherwise(word))
    return rows.select((F.col("s_suppkey") + 10000).cast("string").alias("cod_municipio"),
                       name.alias("municipio"), F.col("n_name").alias("departamento"),
                       word.alias("palabra"), "s_suppkey")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """One question per order about the territory of its first supplier."""
    first = load(spark, sf, "lineitem", ["l_orderkey", "l_suppkey"]).groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("sk"))
    rows = load(spark, sf, "orders", ["o_orderkey", "o_orderpriority"]).join(
        first, F.col("o_orderkey") == F.col("l_orderkey")).join(
        gazetteer(spark, sf), F.col("sk") == F.col("s_suppkey"))
    key = F.col("o_orderkey")
    start = F.when(key % 6 == 5, "¿Qué pasó con ").otherwise("¿Cuál es el pronóstico de ")
    topic = (F.when(F.col("o_orderpriority") == "1-URGENT", "homicidios")
             .when(F.col("o_orderpriority") == "2-HIGH", "hurto a carros")
             .when(F.col("o_orderpriority") == "3-MEDIUM", "amenazas")
             .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "capturas").otherwise("el clima"))
    mention = (F.when(key % 4 == 0, F.translate(F.lower("municipio"), "ao", "áó"))
               .when(key % 4 == 1, F.lower("palabra"))
               .when(key % 4 == 2, F.concat(F.substring("palabra", 1, 3), F.substring("palabra", 5, 100)))
               .when(key % 8 == 3, "Santiago").otherwise("el país"))
    return rows.select(key.alias("id"), F.concat(start, topic, F.lit(" en "), mention, F.lit("?")).alias("texto"))


def qa(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Questions with their criterion, and answers that are right, wrong, refused or missing."""
    key = F.col("o_orderkey")
    kind = key % 6
    rows = order_facts(spark, sf)
    amount = F.floor("o_totalprice").cast("bigint")
    expected = amount + F.when(key % 12 == 0, 1).otherwise(0)
    category = (F.when(kind.isin(3, 4), "fuera_alcance").when(kind == 0, "municipio")
                .when(kind == 1, "justicia").when(kind == 2, "ranking").otherwise("fuzzy"))
    questions_ = rows.select(
        key.cast("string").alias("id"), category.alias("categoria"),
        F.when(kind == 0, F.array(expected)).alias("cifras"),
        F.when(kind == 1, F.lit(8.51)).alias("decimal"),
        F.when(kind == 2, F.col("n_name")).alias("texto_esperado"),
        kind.isin(3, 4).alias("espera_abstencion"))
    text = (F.when(kind == 0, F.concat(F.lit("Se registraron "), F.translate(F.format_number(amount, 0), ",", "."),
                                       F.lit(" hechos en "), F.year("o_orderdate").cast("string")))
            .when(kind == 1, F.when(key % 4 == 1, "La tasa es 8,51 %").otherwise("La tasa es 851 %"))
            .when(kind == 2, F.concat(F.lit("El municipio con más casos es "), F.lower("n_name")))
            .when(kind == 3, "No encontré información sobre eso; datos a 2026.")
            .when(kind == 4, "No puedo responder, pero hubo 4500 casos"))
    answers_ = rows.select(
        key.cast("string").alias("id"), text.alias("respuesta"), (key % 3).alias("n_fuentes"),
        ((key % 50).cast("double") / 10).alias("latencia_s"))
    return questions_, answers_


def raw_sources(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """All-text raw sources in both families, with the kinds of dirt the cleaning handles."""
    key = F.col("o_orderkey")
    rows = order_facts(spark, sf)
    iso = rows.where("o_orderstatus = 'F'").select(
        F.when(key % 101 == 0, "fecha-mala").otherwise(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS")).alias("fecha_hecho"),
        dep_code().alias("cod_depto"),
        F.when(key % 89 == 0, "").when(key % 97 == 0, F.concat(F.lit("00"), F.substring(code(), 3, 3)))
        .otherwise(code()).alias("cod_muni"),
        F.col("r_name").alias("departamento"),
        F.when(key % 3 == 0, F.concat("n_name", F.lit(" (CT)")))
        .when(key % 3 == 1, F.translate(F.lower("n_name"), "ao", "áó"))
        .otherwise(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("municipio"),
        F.when(key % 7 == 0, "").when(key % 11 == 0, None).otherwise("Urbana").alias("zona"),
        F.col("c_mktsegment").alias("sexo"), F.lit("sin  empleo de  armas").alias("arma_medio"),
        F.when(key % 13 == 0, "x").when(key % 13 == 1, "0").when(key % 13 == 2, "-3")
        .when(key % 13 == 3, "2.7").otherwise("1").alias("cantidad"))
    dmy = rows.where("o_orderstatus = 'O'").select(
        F.when(key % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("fecha_hecho"),
        F.concat(code(), F.lit("000")).alias("codigo_dane"),
        F.col("r_name").alias("departamento"), F.col("n_name").alias("municipio_hecho"),
        F.concat(F.lit("ARTICULO 239. HURTO "), "o_orderpriority").alias("tipo_de_hurto"),
        F.lit("arma blanca").alias("armas_medios"), F.lower("c_mktsegment").alias("genero"))
    cap = rows.where("o_orderstatus = 'P'").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("fecha_hecho"),
        F.concat(F.substring(code(), 1, 2), F.lit("-"), F.substring(code(), 3, 3)).alias("codigo_dane"),
        F.col("r_name").alias("departamento"), F.col("n_name").alias("municipio"),
        F.when(key % 2 == 0, "adultos").alias("grupo_etario"), F.lit("1").alias("cantidad"))
    return {"src_iso": iso, "src_dmy": dmy, "src_cap": cap}
