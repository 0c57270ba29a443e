"""Scans, sinks, scalar functions and cleaning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from atalaya import functions as A
from atalaya.bindings import frames as B
from atalaya.bindings.registry import query
from atalaya.bindings.sql_base import CTES, sql
from atalaya.operators import quality
from atalaya.session import cut_lineage, scratch_path
from atalaya.sources import events as E, files as D, pages as P, readers as R, sinks as S
from atalaya.sources.catalog import SourceSpec

NOW_SQL = "DATE '2001-06-15'"

CTES["raw_iso"] = """
    SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN 'fecha-mala'
        ELSE strftime(o_orderdate, '%Y-%m-%dT00:00:00.000') END AS fecha_hecho,
      e.cod_departamento AS cod_depto,
      CASE WHEN o_orderkey % 89 = 0 THEN '' WHEN o_orderkey % 97 = 0 THEN '00' || substr(e.cod_municipio, 3, 3)
        ELSE e.cod_municipio END AS cod_muni, e.departamento,
      CASE o_orderkey % 3 WHEN 0 THEN e.municipio || ' (CT)' WHEN 1 THEN translate(lower(e.municipio), 'ao', 'áó')
        ELSE '  ' || e.municipio || ' ' END AS municipio,
      CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'Urbana' END AS zona,
      e.segmento AS sexo, 'sin  empleo de  armas' AS arma_medio,
      CASE o_orderkey % 13 WHEN 0 THEN 'x' WHEN 1 THEN '0' WHEN 2 THEN '-3' WHEN 3 THEN '2.7' ELSE '1' END AS cantidad
    FROM orders JOIN events_u e USING (o_orderkey) WHERE o_orderstatus = 'F'"""
CTES["raw_dmy"] = """
    SELECT CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
        ELSE strftime(o_orderdate, '%d/%m/%Y') END AS fecha_hecho,
      e.cod_municipio || '000' AS codigo_dane, e.departamento, e.municipio AS municipio_hecho,
      'ARTICULO 239. HURTO ' || o_orderpriority AS tipo_de_hurto, 'arma blanca' AS armas_medios,
      lower(e.segmento) AS genero
    FROM orders JOIN events_u e USING (o_orderkey) WHERE o_orderstatus = 'O'"""
CTES["raw_cap"] = """
    SELECT strftime(o_orderdate, '%d/%m/%Y') AS fecha_hecho,
      substr(e.cod_municipio, 1, 2) || '-' || substr(e.cod_municipio, 3, 3) AS codigo_dane, e.departamento,
      e.municipio, CASE WHEN o_orderkey % 2 = 0 THEN 'adultos' END AS grupo_etario, '1' AS cantidad
    FROM orders JOIN events_u e USING (o_orderkey) WHERE o_orderstatus = 'P'"""


def clean(col: str) -> str:
    text = (f"trim(regexp_replace(regexp_replace(strip_accents(upper(trim(regexp_replace({col}, '\\(.*?\\)', '', 'g')))),"
            "'[^\\x00-\\x7F]', '', 'g'), '\\s+', ' ', 'g'))")
    return f"CASE WHEN {col} IS NULL OR {text} IN ('', 'NAN') THEN 'NO REPORTADO' ELSE {text} END"


def code5(col: str, family: str) -> str:
    digits = f"regexp_replace({col}, '\\D', '', 'g')"
    if family == "B":
        digits = f"substr({digits}, 1, 5)"
    return (f"CASE WHEN length({digits}) BETWEEN 1 AND 5 AND substr(lpad({digits}, 5, '0'), 1, 2) <> '00' "
            f"THEN lpad({digits}, 5, '0') END")


def amount(col: str) -> str:
    return f"CAST(trunc(greatest(coalesce(TRY_CAST({col} AS DOUBLE), 1), 0)) AS BIGINT)"


DMY_SQL = ("coalesce(CAST(try_strptime(fecha_hecho, '%d/%m/%Y') AS DATE), "
           "TRY_CAST(substr(fecha_hecho, 1, 10) AS DATE))")
CTES["norm_events"] = f"""
    SELECT fecha, CAST(year(fecha) AS BIGINT) AS anio, CAST(month(fecha) AS BIGINT) AS mes, cod_departamento,
      departamento, cod_municipio, municipio, zona, categoria, arma_medio, sexo, grupo_etario, cantidad, fuente
    FROM (
      SELECT TRY_CAST(substr(fecha_hecho, 1, 10) AS DATE) AS fecha, cod_depto AS cod_departamento,
        {clean('departamento')} AS departamento, {code5('cod_muni', 'A')} AS cod_municipio,
        {clean('municipio')} AS municipio, {clean('zona')} AS zona, 'HURTO_PERSONAS' AS categoria,
        {clean('arma_medio')} AS arma_medio, {clean('sexo')} AS sexo, 'NO REPORTADO' AS grupo_etario,
        {amount('cantidad')} AS cantidad, 'src_iso' AS fuente FROM raw_iso
      UNION ALL
      SELECT {DMY_SQL}, substr({code5('codigo_dane', 'B')}, 1, 2), {clean('departamento')},
        {code5('codigo_dane', 'B')}, {clean('municipio_hecho')}, 'NO REPORTADO',
        regexp_replace(regexp_replace({clean('tipo_de_hurto')}, '^ARTICULO \\d+\\.\\s*', ''), '\\s+', '_', 'g'),
        {clean('armas_medios')}, {clean('genero')}, 'NO REPORTADO', CAST(1 AS BIGINT), 'src_dmy' FROM raw_dmy
      UNION ALL
      SELECT {DMY_SQL}, substr({code5('codigo_dane', 'B')}, 1, 2), {clean('departamento')},
        {code5('codigo_dane', 'B')}, {clean('municipio')}, 'NO REPORTADO', 'CAPTURAS', 'NO REPORTADO',
        'NO REPORTADO', {clean('grupo_etario')}, {amount('cantidad')}, 'src_cap' FROM raw_cap)
    WHERE fecha IS NOT NULL AND cod_municipio IS NOT NULL AND year(fecha) >= 1990 AND cantidad > 0"""
NORM_COLUMNS = ("fecha, anio, mes, cod_departamento, departamento, cod_municipio, municipio, zona, categoria, "
                "arma_medio, sexo, grupo_etario, cantidad, fuente")


def norm_events(spark: SparkSession, sf: str, named: bool = False) -> DataFrame:
    out = E.build_events(B.raw_sources(spark, sf), B.RAW_CATALOG,
                         reference=B.reference(spark, sf) if named else None)
    return out.withColumn("fecha", F.to_date("fecha")).drop("ingested_at")


# ---------------------------------------------------------------- scans and sources
@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return R.load(spark, sf, "orders", ["o_orderkey", "o_totalprice"])


@query("scan_catalog_union", sql(f"SELECT {NORM_COLUMNS} FROM norm_events WHERE fuente IN ('src_iso', 'src_cap')"))
def _(spark, sf):
    only = ["src_iso", "src_cap", "src_none"]
    out = E.build_events(B.raw_sources(spark, sf), B.RAW_CATALOG, only)
    return out.withColumn("fecha", F.to_date("fecha")).drop("ingested_at")


def _scratch(spark: SparkSession) -> str:
    return scratch_path(spark, "export")


@query("scan_csv_comments", sql("SELECT cod_municipio, periodo, categoria FROM doc_events"))
def _(spark, sf):
    """Written as CSV files with headers and comment lines, and read back with the code as text."""
    folder = _scratch(spark)
    rows = B.doc_events(spark, sf).select(
        "cod_municipio", "periodo", "categoria", F.lit("nota").alias("descripcion"), F.lit("prensa").alias("fuente"))
    rows.write.option("header", True).csv(folder)
    rows.select(F.concat(F.lit("# nota sobre "), "cod_municipio").alias("value")).write.mode("append").text(folder)
    return R.read_events_csv(spark, folder).select("cod_municipio", "periodo", "categoria")


@query("scan_headerless_report", sql("SELECT cod_municipio, anio, poblacion FROM people"))
def _(spark, sf):
    people = B.people(spark, sf)
    total = people.select(
        (F.monotonically_increasing_id() + 10).alias("row_id"),
        F.array(F.lit("x"), F.lit("x"), F.col("cod_municipio").try_cast("bigint").cast("string"), F.lit("m"),
                F.col("anio").cast("string"), F.lit(" Total "), F.col("poblacion").cast("string")).alias("cells"))
    town = total.withColumn("cells", F.transform("cells", lambda c: F.when(c == " Total ", "Cabecera").otherwise(c)))
    blank = total.withColumn("cells", F.transform("cells", lambda c, i: F.when(i == 2, "00000").otherwise(c)))
    junk = spark.range(2).select(F.col("id").alias("row_id"), F.array(F.lit("PROYECCIONES"), F.lit(None)).alias("cells"))
    head = spark.range(1).select(F.lit(2).cast("bigint").alias("row_id"), F.array(*[F.lit(c) for c in (
        "DP", "DPNOM", "DPMP", "MPIO", "AÑO", "ÁREA GEOGRÁFICA", "Población")]).alias("cells"))
    moved = [t.withColumn("cells", F.concat(F.slice("cells", 1, 2), F.slice("cells", 4, 1), F.slice("cells", 3, 1),
                                            F.slice("cells", 5, 3))) for t in (total, town, blank)]
    sheet = junk.unionByName(head)
    for part in moved:
        sheet = sheet.unionByName(part)
    return R.parse_population(sheet)


@query("row_cap_flag", "SELECT count(*) AS rows, CAST(5000 AS INTEGER) AS row_cap, count(*) >= 5000 AS capped "
       "FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 5000)")
def _(spark, sf):
    return R.cap_rows(R.load(spark, sf, "orders"), ["o_orderkey"], 5000)[1]


@query("lineage_record", """
    SELECT 'customer' AS fuente, count(*) AS rows, CAST(5 AS INTEGER) AS n_columns,
      'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' AS columns, CAST(NULL AS INTEGER) AS row_cap, false AS capped,
      CAST(sum(CAST('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '|' || c_name || '|' || CAST(c_nationkey AS VARCHAR) || '|'
        || CAST(c_acctbal AS VARCHAR) || '|' || c_mktsegment), 1, 12) AS BIGINT)) AS VARCHAR) AS content_hash FROM customer""")
def _(spark, sf):
    return R.lineage(R.load(spark, sf, "customer"), "customer")


@query("file_checksum", """
    SELECT source || '.txt' AS fichero, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS bytes, source <> 'src3' AS coincide
    FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source""")
def _(spark, sf):
    """Files of the document texts of each source next to digests computed from the table, one of them wrong."""
    docs = R.load(spark, sf, "documents", ["doc_id", "source", "text"]).where("text IS NOT NULL AND source IS NOT NULL")
    path = _scratch(spark)
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(path)
    line = F.concat("text", F.lit("\n"))
    texts = docs.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("t")))),
                                                                lambda r: r["t"]), "").alias("all"))
    published = texts.select(
        F.concat("source", F.lit(".txt")).alias("fichero"), F.sha2(F.col("all").cast("binary"), 256).alias("sha256"),
        (F.octet_length("all") + F.when(F.col("source") == "src3", 1).otherwise(0)).cast("bigint").alias("bytes"))
    name = F.concat(F.regexp_extract("path", "source=([^/]+)", 1), F.lit(".txt"))
    return R.verify_files(spark, f"{path}/source=*/*.txt", published, name).select("fichero", "bytes", "coincide")


@query("file_checksum_stream", """
    SELECT source || '.txt' AS fichero, b AS bytes, source <> 'src3' AS coincide, CAST(ceil(b / 65536.0) AS BIGINT) AS bloques FROM (
      SELECT source, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS b FROM documents
      WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY source)""")
def _(spark, sf):
    """Files of any size: digests of whole files as streams, and their blocks by other tasks; one published digest is wrong."""
    docs = R.load(spark, sf, "documents", ["doc_id", "source", "text"]).where("text IS NOT NULL AND source IS NOT NULL")
    path = _scratch(spark)
    docs.repartition("source").sortWithinPartitions("source", "doc_id").select("source", "text").write.partitionBy("source").text(path)
    name = F.concat(F.regexp_extract("path", "source=([^/]+)", 1), F.lit(".txt"))
    published = D.line_digests(docs, "source", "doc_id", "text").select(
        F.concat("fichero", F.lit(".txt")).alias("fichero"), "bytes",
        F.when(F.col("fichero") == "src3", F.lit("")).otherwise(F.col("sha256")).alias("sha256"))
    files = D.listed(spark, f"{path}/source=*/*.txt")
    blocks = D.block_digests(files, 65536).groupBy(name.alias("fichero")).agg(F.count(F.lit(1)).alias("bloques"))
    return D.verify_whole(files, published, name).select("fichero", "bytes", "coincide").join(blocks, "fichero")


@query("group_count_merge", sql("SELECT cod_municipio, categoria, segmento, count(*) AS n FROM events_u GROUP BY ALL"))
def _(spark, sf):
    return R.group_count(B.events_u(spark, sf), ["cod_municipio", "categoria", "segmento"])


@query("group_count_paged", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    """The same kind of counts from a source that hands out pages by key, here a published folder in key order."""
    events, path = R.load(spark, sf, "events", ["event_id", "event_type", "user_id"]), _scratch(spark)
    events.repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(path)
    cols = ["event_type", "user_id"]
    client = P.FolderClient(path, "event_id", cols)
    return P.count_pages(spark, client, events.select(*cols).schema, f"{path}-job")


@query("ingest_reconcile", "SELECT count(*) AS source_rows, count(*) AS source_count, CAST(0 AS BIGINT) AS diferencia FROM lineitem")
def _(spark, sf):
    lines = R.load(spark, sf, "lineitem", ["l_suppkey", "l_returnflag"])
    return R.ingest_reconcile(R.group_count(lines, ["l_suppkey", "l_returnflag"]), lines)


# ---------------------------------------------------------------- sinks, read back
@query("sink_parquet", sql("SELECT categoria, anio, cantidad, naturaleza FROM cat_year"))
def _(spark, sf):
    path = _scratch(spark)
    S.write_layer(B.cat_year(spark, sf), path)
    return spark.read.parquet(path)


@query("sink_relational", sql("SELECT cod_municipio, total_hechos, municipio FROM summary"))
def _(spark, sf):
    """Loads into a table of the session catalog; the second empties it and keeps its definition."""
    table, cols = f"carga_{uuid.uuid4().hex}", ["cod_municipio", "total_hechos", "municipio"]
    rows = B.summary(spark, sf)
    spark.createDataFrame([], rows.select(*cols).schema).write.option("path", _scratch(spark)).saveAsTable(table)
    S.write_table(rows.limit(3), table, cols)
    S.write_table(rows, table, cols)
    loaded = cut_lineage(spark.table(table))
    spark.sql(f"DROP TABLE {table}")
    return loaded


@query("sink_relational_swap", sql("SELECT cod_municipio, total_hechos, municipio FROM summary"))
def _(spark, sf):
    """Loads into a table of the session catalog that stands whole at any time; the second replaces the first."""
    table, cols, base = f"carga_{uuid.uuid4().hex}", ["cod_municipio", "total_hechos", "municipio"], _scratch(spark)
    rows = B.summary(spark, sf)
    S.load_table(rows.limit(3), table, cols, base)
    S.load_table(rows, table, cols, base)
    loaded = cut_lineage(spark.table(table))
    spark.sql(f"DROP TABLE {table}")
    return loaded


@query("sink_json_report", sql("""
    SELECT '{"categoria":"' || categoria || '","anio":' || anio || ',"cantidad":' || cantidad || ',"naturaleza":"'
      || naturaleza || '"}' AS value FROM cat_year"""))
def _(spark, sf):
    path = _scratch(spark)
    S.write_report(B.cat_year(spark, sf), path)
    return spark.read.text(path)


@query("sink_csv_export", """
    SELECT CAST(o_orderkey AS VARCHAR) AS Pedido, o_orderpriority AS Prioridad,
      CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'dijo "' || o_orderstatus || '", fin' END AS Nota FROM orders""")
def _(spark, sf):
    path = _scratch(spark)
    note = F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit('dijo "'), "o_orderstatus", F.lit('", fin')))
    rows = R.load(spark, sf, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"]).withColumn("nota", note)
    S.export_csv(rows, path, {"o_orderkey": "Pedido", "o_orderpriority": "Prioridad", "nota": "Nota"})
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)


# ---------------------------------------------------------------- scalar functions
CTES["odd_names"] = """
    SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN municipio || ' (CT)' WHEN 1 THEN translate(lower(municipio), 'ao', 'áó')
        WHEN 2 THEN '  ' || municipio || ' ' WHEN 3 THEN chr(9) || municipio || chr(10) ELSE chr(160) || municipio || chr(160) END AS municipio,
      CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN ' ' || chr(10) ELSE 'Urbana' END AS zona
    FROM orders JOIN (SELECT o_orderkey, municipio FROM events_u) USING (o_orderkey)"""


def clean_spaces(col: str) -> str:
    return clean(f"regexp_replace({col}, '[\\s\\x{{a0}}]+', ' ', 'g')")


@query("norm_text", sql(f"SELECT o_orderkey, {clean_spaces('municipio')} AS municipio, {clean_spaces('zona')} AS zona FROM odd_names"))
def _(spark, sf):
    key, name = F.col("o_orderkey"), F.col("n_name")
    rows = B.order_facts(spark, sf)
    name = (F.when(key % 5 == 0, F.concat(name, F.lit(" (CT)")))
            .when(key % 5 == 1, F.translate(F.lower(name), "ao", "áó")).when(key % 5 == 2, F.concat(F.lit("  "), name, F.lit(" ")))
            .when(key % 5 == 3, F.concat(F.lit("\t"), name, F.lit("\n"))).otherwise(F.concat(F.lit("\u00a0"), name, F.lit("\u00a0"))))
    zone = F.when(key % 7 == 0, "").when(key % 11 == 0, None).when(key % 13 == 0, " \n").otherwise("Urbana")
    return rows.select(key, A.norm_text(name).alias("municipio"), A.norm_text(zone).alias("zona"))


@query("unaccent_lower", "SELECT doc_id, translate(lower(text), 'áéíóúüñ', 'aeiouun') AS texto FROM documents")
def _(spark, sf):
    return R.load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", A.unaccent_lower(F.col("text")).alias("texto"))


@query("strip_marks", "SELECT doc_id, lower(strip_accents(text)) AS texto FROM documents")
def _(spark, sf):
    return R.load(spark, sf, "documents", ["doc_id", "text"]).select("doc_id", A.strip_marks(F.col("text")).alias("texto"))


@query("parse_dates", f"""
    SELECT o_orderkey, {DMY_SQL} AS fecha FROM (SELECT o_orderkey,
      CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT00:00:00.000') WHEN 1 THEN 'fecha-mala'
        ELSE strftime(o_orderdate, '%d/%m/%Y') END AS fecha_hecho FROM orders)""")
def _(spark, sf):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (F.when(key % 4 == 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSS")).when(key % 4 == 1, "fecha-mala")
            .otherwise(F.date_format(day, "dd/MM/yyyy")))
    return R.load(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).select(
        "o_orderkey", F.to_date(A.parse_dates(text, "dmy")).alias("fecha"))


@query("territory_code", f"""
    SELECT c_custkey, {code5('x', 'A')} AS a, {code5('x', 'B')} AS b FROM (SELECT c_custkey,
      CASE c_custkey % 5 WHEN 0 THEN CAST(c_custkey AS VARCHAR) WHEN 1 THEN '17-001-000' WHEN 2 THEN '00' || c_nationkey
        WHEN 3 THEN '' ELSE CAST(c_custkey * 1000000 + 5 AS VARCHAR) END AS x FROM customer)""")
def _(spark, sf):
    key = F.col("c_custkey")
    text = (F.when(key % 5 == 0, key.cast("string")).when(key % 5 == 1, "17-001-000")
            .when(key % 5 == 2, F.concat(F.lit("00"), "c_nationkey")).when(key % 5 == 3, "")
            .otherwise((key * 1000000 + 5).cast("string")))
    return R.load(spark, sf, "customer", ["c_custkey", "c_nationkey"]).select(
        key, A.territory_code(text, "A").alias("a"), A.territory_code(text, "B").alias("b"))


@query("parse_coord", """
    SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN NULL ELSE
      CASE WHEN c_custkey % 2 = 1 THEN -1 ELSE 1 END * CAST((c_custkey % 170) || '.' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
        || CASE WHEN c_custkey % 4 = 1 THEN '250' ELSE '' END AS DOUBLE) END AS coord FROM customer""")
def _(spark, sf):
    key = F.col("c_custkey")
    text = F.concat(F.when(key % 2 == 1, "-").otherwise(""), (key % 170).cast("string"), F.lit(","),
                    F.lpad((key % 1000).cast("string"), 3, "0"), F.when(key % 4 == 1, ",250").otherwise(""))
    text = F.when(key % 4 == 3, "nan").otherwise(text)
    return R.load(spark, sf, "customer", ["c_custkey"]).select(key, A.parse_coord(text).alias("coord"))


@query("coalesce_columns", "SELECT c_custkey, c_mktsegment AS elegido, CAST('NO REPORTADO' AS VARCHAR) AS ausente FROM customer")
def _(spark, sf):
    df = R.load(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    return df.select("c_custkey", E.pick(df, ["tipo_delito", "c_mktsegment"]).alias("elegido"),
                     E.pick(df, ["sexo", "genero"], F.lit("NO REPORTADO")).alias("ausente"))


@query("category_canon", sql("""
    SELECT tipo_de_hurto AS tipo, regexp_replace(regexp_replace(tipo_de_hurto, '^ARTICULO \\d+\\.\\s*', ''),
      '\\s+', '_', 'g') AS categoria, count(*) AS n FROM raw_dmy GROUP BY ALL"""))
def _(spark, sf):
    rows = B.raw_sources(spark, sf)["src_dmy"]
    return rows.groupBy(F.col("tipo_de_hurto").alias("tipo"), A.category_canon(F.col("tipo_de_hurto")).alias("categoria")).agg(
        F.count(F.lit(1)).alias("n"))


@query("parse_quantity", sql(f"SELECT cantidad AS texto, {amount('cantidad')} AS cantidad, count(*) AS n FROM raw_iso GROUP BY ALL"))
def _(spark, sf):
    rows = B.raw_sources(spark, sf)["src_iso"].select(
        F.col("cantidad").alias("texto"), A.parse_quantity(F.col("cantidad")).alias("cantidad"))
    return rows.groupBy("texto", "cantidad").agg(F.count(F.lit(1)).alias("n"))


@query("normalize_events", sql(f"SELECT {NORM_COLUMNS} FROM norm_events WHERE fuente = 'src_iso'"))
def _(spark, sf):
    spec: SourceSpec = B.RAW_CATALOG[0]
    out = E.normalize_events(B.raw_sources(spark, sf)["src_iso"], spec)
    return out.withColumn("fecha", F.to_date("fecha")).drop("ingested_at")


@query("nature_flag", sql("""
    SELECT categoria, CASE WHEN categoria IN ('4-NOT SPECIFIED', '5-LOW') THEN 'respuesta' ELSE 'delito' END AS naturaleza,
      count(*) AS n FROM events_u GROUP BY ALL"""))
def _(spark, sf):
    rows = B.events_u(spark, sf)
    return rows.groupBy("categoria", A.nature(F.col("categoria"), B.RESPONSE).alias("naturaleza")).agg(
        F.count(F.lit(1)).alias("n"))


@query("stage_class", sql("""
    SELECT etapa, CASE WHEN lower(strip_accents(etapa)) SIMILAR TO '.*(investigaci|juicio|ejecuci).*' THEN 'judicializado'
      WHEN contains(lower(strip_accents(etapa)), 'indagaci') THEN 'indagacion' ELSE 'desconocido' END AS clase, count(*) AS n
    FROM funnel_raw GROUP BY ALL"""))
def _(spark, sf):
    rows = B.funnel_raw(spark, sf)
    return rows.groupBy("etapa", A.stage_class(F.col("etapa")).alias("clase")).agg(F.count(F.lit(1)).alias("n"))


@query("stage_order", sql("""
    SELECT etapa, CAST(CASE trim(etapa) WHEN 'Indagación' THEN 0 WHEN 'Investigación' THEN 1 WHEN 'Juicio' THEN 2
      WHEN 'Ejecución De Penas' THEN 3 ELSE 4 END AS INTEGER) AS orden, count(*) AS n FROM funnel_raw GROUP BY ALL"""))
def _(spark, sf):
    rows = B.funnel_raw(spark, sf)
    return rows.groupBy("etapa", A.stage_order(F.col("etapa")).alias("orden")).agg(F.count(F.lit(1)).alias("n"))


@query("blank_to_label", sql("""
    SELECT CASE WHEN trim(titulo_delito) = '' THEN 'Sin información' ELSE trim(titulo_delito) END AS titulo, count(*) AS n
    FROM funnel_raw GROUP BY ALL"""))
def _(spark, sf):
    return B.funnel_raw(spark, sf).groupBy(A.blank_to(F.col("titulo_delito")).alias("titulo")).agg(F.count(F.lit(1)).alias("n"))


@query("rate_per_100k", sql("""
    SELECT cod_municipio, categoria, periodo, round(cantidad / greatest(poblacion, 1.0) * 100000, 6) AS tasa,
      round(cantidad / greatest(poblacion, 1.0) * 100000 * greatest(poblacion, 1.0) / 100000, 6) AS cuenta
    FROM panel_pop WHERE poblacion IS NOT NULL"""))
def _(spark, sf):
    rows = B.panel_pop(spark, sf).where("poblacion IS NOT NULL")
    rate = A.to_rate(F.col("cantidad"), F.col("poblacion"))
    return rows.select("cod_municipio", "categoria", "periodo", F.round(rate, 6).alias("tasa"),
                       F.round(A.to_count(rate, F.col("poblacion")), 6).alias("cuenta"))


@query("period_str", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS periodo FROM orders")
def _(spark, sf):
    return R.load(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).select(
        "o_orderkey", A.period_str(F.col("o_orderdate")).alias("periodo"))


@query("month_diff", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      CAST((year(l_shipdate) - 1998) * 12 + month(l_shipdate) - 3 AS INTEGER) AS meses FROM lineitem""")
def _(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return R.load(spark, sf, "lineitem", [*cols, "l_shipdate"]).select(
        *cols, A.month_diff(F.col("l_shipdate"), F.lit("1998-03-01").cast("date")).alias("meses"))


@query("region_prefix", sql("SELECT DISTINCT cod_municipio, substr(cod_municipio, 1, 2) AS region FROM events_u"))
def _(spark, sf):
    return B.events_u(spark, sf).select("cod_municipio", A.region(F.col("cod_municipio")).alias("region")).distinct()


@query("fmt_thousands", """
    SELECT o_orderkey, replace(format('{:,}', CAST(floor(o_totalprice) AS BIGINT)), ',', '.') AS miles,
      replace(format('{:.2f}', CAST(o_orderkey % 10000 AS DOUBLE) / 64), '.', ',') || ' %' AS pct FROM orders""")
def _(spark, sf):
    share = (F.col("o_orderkey") % 10000).cast("double") / 64
    return R.load(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).select(
        "o_orderkey", A.fmt_thousands(F.floor("o_totalprice")).alias("miles"), A.fmt_pct(share).alias("pct"))


@query("fmt_pct", """
    SELECT o_orderkey, replace(format('{:.2f}', CAST(o_orderkey % 10000 AS DOUBLE) / 64), '.', ',') || ' %' AS pct FROM orders""")
def _(spark, sf):
    share = (F.col("o_orderkey") % 10000).cast("double") / 64
    return R.load(spark, sf, "orders", ["o_orderkey"]).select("o_orderkey", A.fmt_pct(share).alias("pct"))


@query("region_name_lookup", sql("""
    SELECT DISTINCT cod_municipio, CASE substr(cod_municipio, 1, 2) WHEN '11' THEN 'Bogotá' WHEN '41' THEN 'Huila' END AS region
    FROM events_u"""))
def _(spark, sf):
    codes = B.events_u(spark, sf).select("cod_municipio").distinct()
    return codes.select("cod_municipio", A.region_name(A.region(F.col("cod_municipio"))).alias("region"))


# ---------------------------------------------------------------- quality over the cleaned events
@query("union_sources", sql(f"SELECT {NORM_COLUMNS} FROM norm_events"))
def _(spark, sf):
    return norm_events(spark, sf)


@query("provenance", sql("""
    SELECT r.fuente, n_raw AS filas_crudas, coalesce(n_ok, 0) AS filas_validas,
      round(100 * (1 - coalesce(n_ok, 0) / n_raw), 2) AS descartadas_pct
    FROM (SELECT 'src_iso' AS fuente, count(*) AS n_raw FROM raw_iso UNION ALL SELECT 'src_dmy', count(*) FROM raw_dmy
      UNION ALL SELECT 'src_cap', count(*) FROM raw_cap) r
    LEFT JOIN (SELECT fuente, count(*) AS n_ok FROM norm_events GROUP BY fuente) o ON r.fuente = o.fuente"""))
def _(spark, sf):
    raw = B.raw_sources(spark, sf)
    return quality.provenance(quality.raw_counts(raw), norm_events(spark, sf))


@query("source_inventory", sql("""
    SELECT c.*, n AS filas FROM (VALUES ('src_iso', 'A', 'iso', 'HURTO_PERSONAS', 'delito'),
      ('src_dmy', 'B', 'dmy', 'HURTO_OTRAS_MODALIDADES', 'delito'), ('src_cap', 'B', 'dmy', 'CAPTURAS', 'respuesta'),
      ('src_none', 'A', 'iso', 'SECUESTRO', 'delito')) c(fuente, familia, formato_fecha, categoria, naturaleza)
    LEFT JOIN (SELECT 'src_iso' AS fuente, count(*) AS n FROM raw_iso UNION ALL SELECT 'src_dmy', count(*) FROM raw_dmy
      UNION ALL SELECT 'src_cap', count(*) FROM raw_cap) r ON c.fuente = r.fuente"""))
def _(spark, sf):
    return quality.source_inventory(spark, B.RAW_CATALOG, B.raw_sources(spark, sf))


LABELLED = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query("completeness", "SELECT unnest([" + ", ".join(f"'{c}'" for c in LABELLED) + "]) AS columna, unnest(["
       + ", ".join(f"round(100.0 * count({c}) / count(*), 2)" for c in LABELLED)
       + "]) AS completitud_pct FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    return quality.completeness(R.load(spark, sf, "documents").join(R.load(spark, sf, "labels"), "doc_id", "left"))


TEXT_COLUMNS = ["cod_departamento", "departamento", "cod_municipio", "municipio", "zona", "categoria", "arma_medio",
                "sexo", "grupo_etario", "fuente"]


@query("placeholder_share", sql("SELECT columna, round(p, 2) AS placeholder_pct FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS columna, 100.0 * sum(CASE WHEN {c} = 'NO REPORTADO' THEN 1 ELSE 0 END) / count(*) AS p FROM norm_events"
    for c in TEXT_COLUMNS) + ") WHERE p > 0"))
def _(spark, sf):
    return quality.placeholder_share(norm_events(spark, sf))


@query("source_counts", sql("""
    SELECT fuente, a.n AS filas, b.n AS filas_esperadas, a.n IS NOT DISTINCT FROM b.n AS coincide
    FROM (SELECT fuente, count(*) AS n FROM norm_events GROUP BY fuente) a
    FULL JOIN (SELECT 'src_iso' AS fuente, count(*) AS n FROM raw_iso UNION ALL SELECT 'src_dmy', count(*) FROM raw_dmy
      UNION ALL SELECT 'src_otra', CAST(7 AS BIGINT)) b USING (fuente)"""))
def _(spark, sf):
    raw = B.raw_sources(spark, sf)
    expected = quality.raw_counts({k: raw[k] for k in ("src_iso", "src_dmy")}).withColumnRenamed("filas_crudas", "filas")
    other = spark.range(1).select(F.lit("src_otra").alias("fuente"), F.lit(7).cast("bigint").alias("filas"))
    return quality.source_counts(norm_events(spark, sf), expected.unionByName(other))


@query("quality_summary", sql("""
    SELECT count(*) AS filas, min(fecha) AS fecha_min, max(fecha) AS fecha_max,
      count(DISTINCT cod_municipio) AS municipios_unicos, CAST(sum(cantidad) AS BIGINT) AS total_hechos,
      (SELECT string_agg(categoria, ', ' ORDER BY categoria) FROM (SELECT DISTINCT categoria FROM norm_events
        ORDER BY categoria LIMIT 50)) AS categorias FROM norm_events"""))
def _(spark, sf):
    return quality.quality_summary(norm_events(spark, sf))


CTES["typed_iso"] = f"""
    SELECT {code5('cod_muni', 'A')} AS cod_municipio, {amount('cantidad')} AS cantidad,
      TRY_CAST(substr(fecha_hecho, 1, 10) AS DATE) AS fecha FROM raw_iso"""


@query("quality_checks", sql(f"""
    SELECT * FROM (
      SELECT 'sin_codigo_municipio' AS regla, count(*) FILTER (cod_municipio IS NULL) AS n FROM typed_iso
      UNION ALL SELECT 'cantidad_no_positiva', count(*) FILTER (cantidad <= 0) FROM typed_iso
      UNION ALL SELECT 'fecha_nula', count(*) FILTER (fecha IS NULL) FROM typed_iso
      UNION ALL SELECT 'fecha_futura', count(*) FILTER (fecha > {NOW_SQL}) FROM typed_iso
      UNION ALL SELECT 'fuente_truncada:src_iso', 100) WHERE n > 0"""))
def _(spark, sf):
    raw = B.raw_sources(spark, sf)["src_iso"].select(
        A.territory_code(F.col("cod_muni"), "A").alias("cod_municipio"), A.parse_quantity(F.col("cantidad")).alias("cantidad"),
        F.to_date(A.parse_dates(F.col("fecha_hecho"))).alias("fecha"))
    capped = R.cap_rows(raw, ["fecha"], 100)[1].select(F.lit("src_iso").alias("fuente"), "capped", "row_cap")
    return quality.quality_checks(raw, F.lit("2001-06-15").cast("date"), capped)


@query("duplicate_share", sql(f"""
    SELECT fuente, round(sum(cantidad * n) / sum(n), 2) AS cantidad_media,
      round(100.0 * sum(n - 1) / sum(n), 1) AS filas_repetidas_pct
    FROM (SELECT {NORM_COLUMNS}, count(*) AS n FROM norm_events GROUP BY ALL) GROUP BY fuente"""))
def _(spark, sf):
    return quality.duplicate_share(norm_events(spark, sf))


PROFILE = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_totalprice": True, "dia": False, "o_orderpriority": False}


def profile_sql(c: str, number: bool) -> str:
    """The profile row of one column of `o`."""
    num = lambda x: x if number else "CAST(NULL AS DOUBLE)"
    x = f"CAST({c} AS DOUBLE)"
    plain = "CAST(NULL AS VARCHAR)" if number else f"{c}::VARCHAR"
    ranked = f"SELECT {c}::VARCHAR AS v, count(*) AS k FROM o WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY k DESC, v LIMIT 5"
    quarts = ", ".join(num(f"round(quantile_cont({x}, {q / 100}), 4)") + f" AS q{q}" for q in (25, 50, 75))
    return f"""
    SELECT '{c}' AS columna, count(*) AS n, count(*) - count({c}) AS nulos, min({plain}) AS minimo, max({plain}) AS maximo,
      {num(f'min({x})')} AS minimo_num, {num(f'max({x})')} AS maximo_num, {num(f'round(avg({x}), 4)')} AS media,
      {num(f'round(stddev_samp({x}), 4)')} AS desviacion, count(DISTINCT {c}) AS distintos, {quarts},
      (SELECT first(v ORDER BY k DESC, v) FROM ({ranked})) AS mas_frecuente, (SELECT max(k) FROM ({ranked})) AS n_mas_frecuente,
      (SELECT string_agg(v || ' (' || k || ')', '; ' ORDER BY k DESC, v) FROM ({ranked})) AS frecuentes FROM o"""


@query("column_profile", "WITH o AS (SELECT * EXCLUDE (o_orderdate), CAST(o_orderdate AS DATE) AS dia FROM orders)"
       + "\nUNION ALL\n".join(profile_sql(c, number) for c, number in PROFILE.items()))
def _(spark, sf):
    orders = R.load(spark, sf, "orders").withColumn("dia", F.to_date("o_orderdate")).drop("o_orderdate")
    return quality.column_profile(orders)


@query("reconcile_checks", sql("""
    SELECT medida, a AS valor_a, b AS valor_b, a IS NOT DISTINCT FROM b AS coincide FROM (
      SELECT 'filas' AS medida, CAST((SELECT count(*) FROM norm_events) AS VARCHAR) AS a,
        CAST((SELECT count(*) FROM events_u) AS VARCHAR) AS b
      UNION ALL SELECT 'municipios', CAST((SELECT count(DISTINCT cod_municipio) FROM norm_events) AS VARCHAR),
        CAST((SELECT count(DISTINCT cod_municipio) FROM events_u) AS VARCHAR)
      UNION ALL SELECT 'fecha_min', CAST((SELECT min(fecha) FROM norm_events) AS VARCHAR),
        CAST((SELECT min(fecha) FROM events_u) AS VARCHAR))"""))
def _(spark, sf):
    return quality.reconcile(norm_events(spark, sf), B.events_u(spark, sf), {
        "filas": F.count(F.lit(1)), "municipios": F.count_distinct("cod_municipio"), "fecha_min": F.min("fecha")})


@query("join_official_names", sql("""
    SELECT o_orderkey, coalesce(r.municipio, e.municipio) AS municipio, coalesce(r.departamento, e.departamento) AS departamento,
      coalesce(r.cod_departamento, e.cod_departamento) AS cod_departamento, e.cod_municipio
    FROM events_v e LEFT JOIN reference r ON e.cod_municipio = r.cod_municipio"""))
def _(spark, sf):
    cols = ["o_orderkey", "municipio", "departamento", "cod_departamento", "cod_municipio"]
    return E.apply_names(B.events_v(spark, sf).select(*cols), B.reference(spark, sf))


@query("name_coverage", sql("""
    SELECT count(*) AS eventos, round(100.0 * count(r.cod_municipio) / count(*), 1) AS cobertura_pct
    FROM events_v e LEFT JOIN reference r ON e.cod_municipio = r.cod_municipio"""))
def _(spark, sf):
    return E.name_coverage(B.events_v(spark, sf), B.reference(spark, sf))


@query("dedupe_keep_last", """
    SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS anio, arg_max(o_totalprice, o_orderkey) AS o_totalprice,
      max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL""")
def _(spark, sf):
    rows = R.load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice", "o_orderkey"])
    rows = rows.select("o_custkey", F.year("o_orderdate").alias("anio"), "o_totalprice", "o_orderkey")
    return R.dedupe_last(rows, ["o_custkey", "anio"], ["o_orderkey"])


@query("dedupe_prefer", """
    SELECT c_nationkey, c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey
      ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 1 END, c_custkey) AS r FROM customer) WHERE r = 1""")
def _(spark, sf):
    rows = R.load(spark, sf, "customer", ["c_nationkey", "c_custkey", "c_mktsegment"])
    return R.dedupe_prefer(rows, "c_nationkey", F.col("c_mktsegment") == "MACHINERY", ["c_custkey"])


@query("territory_reference", sql("""
    SELECT cod_municipio, cod_departamento, municipio, departamento, lat, lon FROM reference"""))
def _(spark, sf):
    """Official towns as comma-decimal text, each with a lesser place that must not win."""
    ref = B.reference(spark, sf)

    def comma(col):
        return F.translate(col.cast("string"), ".", ",")

    cm = ref.select(F.col("cod_municipio").alias("codigo_municipio"), F.col("cod_departamento").alias("codigo_departamento"),
                    F.concat(F.lit(" "), "municipio").alias("nombre_municipio"), F.col("departamento").alias("nombre_departamento"),
                    comma(F.col("lat")).alias("latitud"), comma(F.col("lon")).alias("longitud"), F.lit("CM").alias("tipo_centro_poblado"))
    cp = cm.withColumn("nombre_municipio", F.lit("AAA")).withColumn("tipo_centro_poblado", F.lit("CP"))
    return R.territory_reference(cm.unionByName(cp)).select(
        "cod_municipio", "cod_departamento", "municipio", "departamento", "lat", "lon")
