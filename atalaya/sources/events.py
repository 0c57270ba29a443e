"""Clean raw event sources of two families into one schema, as one projection per source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from atalaya.constants import MIN_YEAR_EVENTS, PLACEHOLDER, UNIFIED_COLUMNS
from atalaya.functions import category_canon, norm_text, parse_dates, parse_quantity, territory_code
from atalaya.functions.territory import pad_code
from atalaya.sources.catalog import CATALOG, SourceSpec


def pick(df: DataFrame, names: list[str], default: Column | None = None) -> Column:
    """First of several synonymous columns that exists; existence decides, not nulls."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast("string") if default is None else default


def normalize_events(df: DataFrame, spec: SourceSpec, ingested_at: Column | None = None) -> DataFrame:
    """Unified events of one source; rows without a usable date, code or quantity are dropped."""
    absent = F.lit(PLACEHOLDER)
    if spec.family == "A":
        code = territory_code(pick(df, ["cod_muni"]), "A")
        digits = F.regexp_replace(pick(df, ["cod_depto"]), r"\D", "")
        region_code = pad_code(digits, 2)
    else:
        code = territory_code(pick(df, ["codigo_dane"]), "B")
        region_code = F.substring(code, 1, 2)
    typed = pick(df, ["tipo_delito", "tipo_de_hurto"], F.lit(""))
    has_type = any(c in df.columns for c in ("tipo_delito", "tipo_de_hurto"))
    category = norm_text(typed) if has_type else F.lit(spec.category)
    rows = df.select(
        parse_dates(pick(df, ["fecha_hecho"]), spec.date_format).alias("fecha"),
        region_code.alias("cod_departamento"),
        norm_text(pick(df, ["departamento"])).alias("departamento"),
        code.alias("cod_municipio"),
        norm_text(pick(df, ["municipio", "municipio_hecho"])).alias("municipio"),
        norm_text(pick(df, ["zona"], absent)).alias("zona"),
        category_canon(category).alias("categoria"),
        norm_text(pick(df, ["arma_medio", "armas_medios"], absent)).alias("arma_medio"),
        norm_text(pick(df, ["sexo", "genero"], absent)).alias("sexo"),
        norm_text(pick(df, ["grupo_etario"], absent)).alias("grupo_etario"),
        parse_quantity(pick(df, ["cantidad"], F.lit("1"))).alias("cantidad"),
        F.lit(spec.id).alias("fuente"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"),
    )
    rows = rows.withColumns({"anio": F.year("fecha").cast("bigint"),
                             "mes": F.month("fecha").cast("bigint")})
    kept = (F.col("fecha").isNotNull() & F.col("cod_municipio").isNotNull()
            & (F.col("anio") >= MIN_YEAR_EVENTS) & (F.col("cantidad") > 0))
    return rows.where(kept).select(*UNIFIED_COLUMNS)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Concatenate without removing repeats: equal rows are separate facts."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def build_events(sources: dict[str, DataFrame], catalog: list[SourceSpec] = CATALOG,
                 only: list[str] | None = None, reference: DataFrame | None = None,
                 ingested_at: Column | None = None) -> DataFrame:
    """Normalise and union every catalogued source that is present."""
    frames = [normalize_events(sources[s.id], s, ingested_at) for s in catalog
              if s.is_event and s.id in sources and (only is None or s.id in only)]
    if not frames:
        raise ValueError("none of the catalogued sources is present")
    events = union_sources(frames)
    return events if reference is None else apply_names(events, reference)


def apply_names(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Official names where the code is known, the source's own names elsewhere.

    Spark broadcasts a reference that its size statistics show to be small; otherwise adaptive
    execution splits the partitions of a hot code.
    """
    official = reference.select(
        F.col("cod_municipio").alias("_code"), F.col("municipio").alias("_m"),
        F.col("departamento").alias("_d"), F.col("cod_departamento").alias("_cd"))
    joined = events.join(official, F.col("cod_municipio") == F.col("_code"), "left")
    return joined.withColumns({
        "municipio": F.coalesce("_m", "municipio"),
        "departamento": F.coalesce("_d", "departamento"),
        "cod_departamento": F.coalesce("_cd", "cod_departamento"),
    }).select(*events.columns)


def name_coverage(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Share of events whose code has an official name, from counts per code."""
    counts = events.groupBy("cod_municipio").agg(F.count(F.lit(1)).alias("n"))
    known = reference.select("cod_municipio", F.lit(1).alias("_k"))
    joined = counts.join(known, "cod_municipio", "left")
    return joined.agg(F.sum("n").alias("eventos"), F.round(
        100 * F.sum(F.when(F.col("_k") == 1, F.col("n")).otherwise(0)) / F.sum("n"), 1)
        .alias("cobertura_pct"))
