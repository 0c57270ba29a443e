"""Searchable text corpus: document chunks and summary cards written from result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from atalaya.constants import CHUNK_OVERLAP, CHUNK_SIZE
from atalaya.functions import period_str
from atalaya.operators import funnel
from atalaya.operators.serve import category_ranking
from atalaya.sources.catalog import ADMIN_RECIPES, AdminRecipe

# White space as a Unicode-aware split sees it.
WHITE_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"
# Wording of the cards.
TERRITORY_CARD = (
    "Municipio: %s (%s), código DANE %s. Total de hechos registrados: %d entre %d y %d, en %d "
    "categorías de delito. Delitos más frecuentes: %s.")
CATEGORY_CARD = "Categoría de delito '%s'. Hechos por año a nivel nacional: %s."
RANKING_CARD = (
    "¿Dónde hay más %s? Ranking nacional de municipios con MÁS hechos de %s, de mayor a menor. "
    "Total nacional: %d. Top %d: %s.")
TITLE_CARD = (
    "Título penal «%s»: %d procesos, %d superaron la indagación (%s%% de los de etapa conocida).")
FUNNEL_TERRITORY_CARD = (
    "Justicia en %s (%s), código DANE %s: %d procesos, %d judicializados (superaron la "
    "indagación). Tasa de judicialización: %s%%.")
FUNNEL_NATIONAL_CARD = (
    "Justicia: de %d procesos penales, la TASA DE JUDICIALIZACIÓN nacional es %s%%. Embudo: "
    "indagación %d, judicializado %d.")
CONTEXT_ROWS = [
    ("acerca_de", "Series mensuales, pronósticos por municipio, anomalías y preguntas sobre datos abiertos."),
    ("limitaciones", "Los datos reflejan hechos registrados, no la criminalidad real; no hay datos personales."),
]


def meta(**pairs: str | Column) -> Column:
    """Metadata map of a card."""
    items = [x if isinstance(x, Column) else F.lit(x)
             for k, v in pairs.items() for x in (k, v)]
    return F.create_map(*items)


def chunk_array(flat: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows over a whole text whose white space is already collapsed, as an array.

    The text is cut once into pieces of one step, and each is joined to the beginning of what
    follows, so the work grows with the length of the text.
    """
    step = max(1, size - overlap)
    pieces = F.regexp_extract_all(flat, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    windows = pieces
    for k in range(1, -(-size // step)):
        behind = F.slice(pieces, k + 1, F.greatest(F.size(pieces), F.lit(1)))
        windows = F.zip_with(windows, behind, lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
    count = F.greatest(F.ceil((F.length(flat) - size) / F.lit(step)), F.lit(0)).cast("int") + 1
    windows = F.transform(F.slice(windows, 1, count), lambda w: F.trim(F.substring(w, 1, size)))
    return F.filter(windows, lambda w: w != "")


def chunk(docs: DataFrame, text: str = "text", size: int = CHUNK_SIZE,
          overlap: int = CHUNK_OVERLAP) -> DataFrame:
    rest = [c for c in docs.columns if c != text]
    # A column of its own: inside the array lambda the collapse would run once per chunk.
    flat = docs.select(*rest, F.trim(F.regexp_replace(text, WHITE_SPACE, " ")).alias("_flat"))
    return flat.select(*rest, F.posexplode(chunk_array(F.col("_flat"), size, overlap)).alias("n", "content"))


def document_cards(docs: DataFrame, text: str = "text", source: str = "source",
                   page: str | None = None) -> DataFrame:
    """Chunks with citation metadata; documents without text give no card."""
    cut = chunk(docs, text)
    info = meta(tipo="documento", fuente=F.col(source).cast("string"))
    if page is not None:
        info = F.when(F.col(page).isNull(), info).otherwise(
            meta(tipo="documento", fuente=F.col(source).cast("string"), pagina=F.col(page).cast("string")))
    return cut.select("content", info.alias("metadata"))


def top_categories(totals: DataFrame, n: int = 5) -> DataFrame:
    """`CAT (n), ...` per territory. Window partitions hold one row per category."""
    sums = totals.groupBy("cod_municipio", "categoria").agg(F.sum("total").alias("total"))
    order = Window.partitionBy("cod_municipio").orderBy(F.desc("total"), "categoria")
    top = sums.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    piece = F.format_string("%s (%d)", "categoria", "total")
    return top.groupBy("cod_municipio").agg(_joined("r", piece, ", ").alias("top_categorias"))


def _joined(order: str, piece: Column, separator: str) -> Column:
    """Concatenate a bounded group of pieces in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), piece.alias("t")))),
                                    lambda s: s.getField("t")), separator)


def cards_territory(summary: DataFrame, totals: DataFrame, limit: int = 300) -> DataFrame:
    top = summary.orderBy(F.desc("total_delitos"), "cod_municipio").limit(limit)
    rows = top.join(top_categories(totals), "cod_municipio", "left")
    text = F.format_string(
        TERRITORY_CARD, "municipio", "departamento", "cod_municipio", "total_hechos", "primer_anio",
        "ultimo_anio", "categorias", F.coalesce("top_categorias", F.lit("")))
    return rows.select(text.alias("content"), meta(
        tipo="municipio", cod_municipio=F.col("cod_municipio"), municipio=F.col("municipio")).alias("metadata"))


def cards_category(cat_year: DataFrame) -> DataFrame:
    piece = F.format_string("%d: %d", "anio", "cantidad")
    rows = cat_year.groupBy("categoria").agg(_joined("anio", piece, ", ").alias("serie"))
    return rows.select(F.format_string(CATEGORY_CARD, "categoria", "serie").alias("content"),
                       meta(tipo="categoria", categoria=F.col("categoria")).alias("metadata"))


def cards_ranking(totals: DataFrame, n: int = 15) -> DataFrame:
    top = category_ranking(totals, n)
    piece = F.format_string("%d. %s (%s): %d", "puesto", "municipio", "departamento", "total")
    rows = top.groupBy("categoria", "total_nacional").agg(_joined("puesto", piece, ", ").alias("lista"))
    text = F.format_string(RANKING_CARD, "categoria", "categoria", "total_nacional", F.lit(n), "lista")
    return rows.select(text.alias("content"),
                       meta(tipo="ranking", categoria=F.col("categoria")).alias("metadata"))


def admin_breakdown(df: DataFrame, dims: list[tuple[str, str, int]]) -> DataFrame:
    """Top values per dimension with the number of distinct values.

    Each dimension is counted on its own from its one column, and its `n` first values are taken
    task by task, so a dimension of nearly unique values never meets in one place.
    """
    parts = []
    for c, label, n in dims:
        if c not in df.columns:
            continue
        counts = df.select(F.col(c).cast("string").alias("valor")).where("valor IS NOT NULL").groupBy("valor").agg(
            F.count(F.lit(1)).alias("n"))
        order = [F.desc("n"), "valor"]
        place = F.row_number().over(Window.partitionBy("dimension").orderBy(*order))
        parts.append(counts.orderBy(*order).limit(n).withColumn("dimension", F.lit(label)).withColumn("orden", place).withColumn(
            "distintos", counts.agg(F.count(F.lit(1))).scalar()))
    return reduce(DataFrame.unionByName, parts).select("dimension", "orden", "valor", "n", "distintos")


def cards_admin(df: DataFrame, name: str, date_col: str, dims: list[tuple[str, str, int]],
                about: str = "") -> DataFrame:
    """One summary card of a non-event source: size, years and breakdown by dimension."""
    order = {label: i for i, (_, label, _) in enumerate(dims)}
    top = admin_breakdown(df, dims)
    piece = F.format_string("%s (%d)", "valor", "n")
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("dimension"))
    lines = top.groupBy("dimension").agg(
        F.max("distintos").alias("k"), F.count(F.lit(1)).alias("m"), _joined("orden", piece, ", ").alias("l"))
    line = F.when(F.col("k") > F.col("m"), F.format_string(
        "Por %s (%d distintos, los de mayor volumen): %s.", "dimension", "k", "l")).otherwise(
        F.format_string("Por %s: %s.", "dimension", "l"))
    body = lines.withColumn("_o", rank).agg(_joined("_o", line, " ").alias("t")).scalar()
    year = F.year(F.col(date_col).try_cast("timestamp"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.min(year).alias("lo"), F.max(year).alias("hi"))
    span = F.when(F.col("lo").isNotNull(), F.format_string(" entre %d y %d", "lo", "hi")).otherwise(F.lit(""))
    text = F.trim(F.concat(F.format_string("Transparencia institucional — '%s': %d registros", F.lit(name), "n"),
                           span, F.lit(". "), F.coalesce(body, F.lit("")), F.lit(" " + about)))
    return row.select(text.alias("content"), meta(tipo="administrativo", fuente=name).alias("metadata"))


def cards_by_recipe(df: DataFrame, name: str, recipes: dict[str, AdminRecipe] = ADMIN_RECIPES) -> DataFrame:
    """The card of a source by its recipe; a source without one, or without its columns, gets its size."""
    recipe = recipes.get(name)
    dims = [d for d in recipe.dims if d[0] in df.columns] if recipe else []
    if dims and recipe.date in df.columns:
        return cards_admin(df, name, recipe.date, dims, recipe.about)
    size = df.agg(F.count(F.lit(1)).alias("n"))
    text = F.format_string("Transparencia institucional — '%s': %d registros.", F.lit(name), "n")
    return size.select(text.alias("content"), meta(tipo="administrativo", fuente=name).alias("metadata"))


def cards_funnel(cube: DataFrame, reference: DataFrame, top: int = 200,
                 min_title: int = funnel.MIN_KNOWN_TITLE,
                 min_territory: int = funnel.MIN_KNOWN_TERRITORY, extremes: int = 15) -> DataFrame:
    """National, per-title, per-territory and extreme-rate cards."""
    national = funnel.funnel_class(cube)
    rate = F.format_string("%.2f", "tasa_judicializacion_pct")
    parts = [national.select(
        F.format_string(FUNNEL_NATIONAL_CARD, "total_procesos", rate, "indagacion", "judicializado").alias("content"),
        meta(tipo="justicia", alcance="nacional").alias("metadata"))]
    rates = funnel.serving_labels(funnel.with_names(funnel.funnel_rate(cube, "territory"), reference))
    if "titulo_delito" in cube.columns:
        titles = funnel.funnel_rate(cube, "title")
        parts.append(titles.select(
            F.format_string(TITLE_CARD, "titulo_delito", "total_procesos", "n_judicializados", rate).alias("content"),
            meta(tipo="justicia", alcance="titulo", titulo_delito=F.col("titulo_delito")).alias("metadata")))
        parts.append(_extreme_card(funnel.eligible_titles(titles, min_title), "titulo_delito", 3,
                                   "Títulos por tasa de judicialización", "ranking-titulo"))
    biggest = rates.orderBy(F.desc("total_procesos"), "cod_municipio").limit(top)
    parts.append(biggest.select(
        F.format_string(FUNNEL_TERRITORY_CARD, "municipio", "departamento", "cod_municipio",
                        "total_procesos", "n_judicializados", rate).alias("content"),
        meta(tipo="justicia", alcance="municipio", cod_municipio=F.col("cod_municipio")).alias("metadata")))
    parts.append(_extreme_card(rates.where(F.col("procesos_etapa_conocida") >= min_territory), "municipio",
                               extremes, "Municipios por tasa de judicialización", "ranking"))
    return reduce(DataFrame.unionByName, parts)


def _extreme_card(rates: DataFrame, label: str, n: int, title: str, scope: str) -> DataFrame:
    """Highest and lowest rates as one text; both lists are bounded top-n."""
    both = funnel.extremes(rates.select(label, "tasa_judicializacion_pct"), label, "tasa_judicializacion_pct", n)
    sign = F.when(F.col("tipo") == "mayor_tasa", -F.col("tasa_judicializacion_pct")).otherwise(
        F.col("tasa_judicializacion_pct"))
    piece = F.format_string("%s: %.2f%%", label, "tasa_judicializacion_pct")
    ordered = both.withColumn("_o", F.struct(sign.alias("s"), F.col(label).alias("l")))
    rows = ordered.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("tipo") == "mayor_tasa", F.struct("_o", piece.alias("t"))))), lambda s: s.getField("t")), ", ").alias("hi"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(
            F.col("tipo") == "menor_tasa", F.struct("_o", piece.alias("t"))))), lambda s: s.getField("t")), ", ").alias("lo"))
    return rows.where("hi <> ''").select(
        F.format_string(title + ". Mayor tasa: %s. Menor tasa: %s.", "hi", "lo").alias("content"),
        meta(tipo="justicia", alcance=scope).alias("metadata"))


def context_cards(spark, rows: list[tuple[str, str]] = CONTEXT_ROWS) -> DataFrame:
    base = spark.createDataFrame(rows, "tema string, content string")
    return base.select("content", meta(tipo="contexto", tema=F.col("tema")).alias("metadata"))


def corpus(*cards: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, cards)


def territory_facts(summary: DataFrame, totals: DataFrame, panel: DataFrame, anomalies: DataFrame,
                    rates: DataFrame, forecast_texts: DataFrame | None = None) -> DataFrame:
    """One wide row per territory; every part is already reduced to one row per territory."""
    span = panel.groupBy("cod_municipio").agg(
        F.concat_ws(" a ", period_str(F.min("periodo")), period_str(F.max("periodo"))).alias("periodo"))
    crimes = totals.where("naturaleza = 'delito'")
    leader = crimes.groupBy("cod_municipio", "categoria").agg(F.sum("total").alias("t")).groupBy("cod_municipio").agg(
        F.min_by("categoria", F.struct((-F.col("t")).alias("t"), "categoria")).alias("categoria_principal"))
    newest = Window.partitionBy("cod_municipio").orderBy(F.desc("periodo"), "categoria")
    recent = anomalies.withColumn("r", F.row_number().over(newest)).where("r <= 3")
    piece = F.format_string("%s en %s (severidad %s, %d hechos)", "categoria", period_str(F.col("periodo")),
                            "severidad", "cantidad")
    recent = recent.groupBy("cod_municipio").agg(_joined("r", piece, "; ").alias("anomalias_recientes"))
    out = summary.select("cod_municipio", "municipio", "departamento", "total_delitos", "total_respuestas")
    for part in (span, top_categories(crimes), leader, recent,
                 rates.select("cod_municipio", "total_procesos", "n_judicializados", "tasa_judicializacion_pct")):
        out = out.join(part, "cod_municipio", "left")
    if forecast_texts is not None:
        texts = forecast_texts.select("cod_municipio", F.col("categoria").alias("categoria_principal"), "proyeccion")
        out = out.join(texts, ["cod_municipio", "categoria_principal"], "left")
    return out
