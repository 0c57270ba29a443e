"""Data quality, provenance and reconciliation reports as flat result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from atalaya.constants import PLACEHOLDER
from atalaya.operators.quantiles import exact_quantiles
from atalaya.sources.catalog import SourceSpec, catalog_frame


def unpivot_row(row: DataFrame, values: list[str], name: str, value: str,
                ids: list[str] | None = None) -> DataFrame:
    """Turn a one-row aggregate into (name, value) rows."""
    return row.unpivot([F.col(c) for c in ids or []], values, name, value)


def completeness(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.round(100 * F.avg(F.col(c).isNotNull().cast("int")), 2).alias(c)
                   for c in df.columns])
    return unpivot_row(row, df.columns, "columna", "completitud_pct")


def placeholder_share(df: DataFrame, label: str = PLACEHOLDER) -> DataFrame:
    """Percentage of the placeholder per text column, over all rows, where it occurs at all."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    share = [100 * F.avg(F.coalesce(F.col(c) == label, F.lit(False)).cast("int")) for c in texts]
    row = df.agg(*[s.alias(c) for c, s in zip(texts, share, strict=True)])
    out = unpivot_row(row, texts, "columna", "placeholder_pct").where("placeholder_pct > 0")
    return out.withColumn("placeholder_pct", F.round("placeholder_pct", 2))


def source_counts(events: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Rows per source; with `expected(fuente, filas)`, a side-by-side comparison."""
    counts = events.groupBy("fuente").agg(F.count(F.lit(1)).alias("filas"))
    if expected is None:
        return counts.orderBy(F.desc("filas"), "fuente")
    other = expected.select("fuente", F.col("filas").alias("filas_esperadas"))
    return counts.join(other, "fuente", "full_outer").withColumn(
        "coincide", F.col("filas").eqNullSafe(F.col("filas_esperadas")))


def provenance(raw_counts: DataFrame, events: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """Raw to valid rows per source, with the cap recorded at ingestion when there was one."""
    valid = events.groupBy("fuente").agg(F.count(F.lit(1)).alias("filas_validas"))
    out = raw_counts.where("filas_crudas > 0").join(valid, "fuente", "left").withColumn(
        "filas_validas", F.coalesce("filas_validas", F.lit(0)))
    out = out.withColumn("descartadas_pct", F.round(
        100 * (1 - F.col("filas_validas") / F.col("filas_crudas")), 2))
    if lineage is not None:
        out = out.join(lineage.select("fuente", "capped", "row_cap"), "fuente", "left")
    return out


def raw_counts(sources: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("filas_crudas")).select(F.lit(n).alias("fuente"), "filas_crudas")
             for n, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def source_inventory(spark, catalog: list[SourceSpec], sources: dict[str, DataFrame]) -> DataFrame:
    """Catalog entries with their row counts; a missing source keeps a null count."""
    return catalog_frame(spark, catalog).join(raw_counts(sources), "fuente", "left").withColumnRenamed(
        "filas_crudas", "filas")


def quality_summary(events: DataFrame, n_categories: int = 50) -> DataFrame:
    """One row: size, date range, territories, total and the first sorted categories."""
    names = events.select("categoria").where("categoria IS NOT NULL").distinct().orderBy(
        "categoria").limit(n_categories)
    listed = names.agg(F.array_join(F.array_sort(F.collect_list("categoria")), ", "))
    return events.agg(
        F.count(F.lit(1)).alias("filas"), F.to_date(F.min("fecha")).alias("fecha_min"),
        F.to_date(F.max("fecha")).alias("fecha_max"),
        F.count_distinct("cod_municipio").alias("municipios_unicos"),
        F.coalesce(F.sum("cantidad"), F.lit(0)).alias("total_hechos"),
    ).withColumn("categorias", listed.scalar())


def quality_checks(events: DataFrame, now: Column, lineage: DataFrame | None = None) -> DataFrame:
    """Broken rules with the number of rows behind each."""
    rules = {
        "sin_codigo_municipio": F.col("cod_municipio").isNull(),
        "cantidad_no_positiva": F.col("cantidad") <= 0,
        "fecha_nula": F.col("fecha").isNull(),
        "fecha_futura": F.col("fecha") > now,
    }
    row = events.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    out = unpivot_row(row, list(rules), "regla", "n").where("n > 0")
    if lineage is not None:
        cut = lineage.where("capped").select(
            F.concat(F.lit("fuente_truncada:"), "fuente").alias("regla"), F.col("row_cap").alias("n"))
        out = out.unionByName(cut.withColumn("n", F.col("n").cast("bigint")))
    return out


def duplicate_share(events: DataFrame, by: str = "fuente",
                    exclude: tuple[str, ...] = ("ingested_at",)) -> DataFrame:
    """Mean quantity and share of repeated rows per source; nothing is removed."""
    cols = [c for c in events.columns if c not in exclude]
    groups = events.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(by).agg(
        F.round(F.sum(F.col("cantidad") * F.col("n")) / F.sum("n"), 2).alias("cantidad_media"),
        F.round(100 * F.sum(F.col("n") - 1) / F.sum("n"), 1).alias("filas_repetidas_pct"),
    )


PROFILE_QUANTILES = [0.25, 0.5, 0.75]


def column_profile(df: DataFrame, top: int = 5) -> DataFrame:
    """Count, nulls, distinct and most frequent values of every column; of numbers also range, mean,
    deviation and exact quartiles.

    One pass gives the plain statistics of all columns. Values are counted column by column, so
    columns are never unpivoted and a hot value is folded before it is shuffled.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    text = lambda c: F.col(f"`{c}`").cast("string")
    parts = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        number = col.cast("double") if c in numeric else F.lit(None).cast("double")
        plain = F.lit(None).cast("string") if c in numeric else text(c)
        counts = df.select(text(c).alias("valor")).where("valor IS NOT NULL").groupBy("valor").agg(F.count(F.lit(1)).alias("n"))
        first = counts.orderBy(F.desc("n"), "valor").limit(top).agg(F.array_sort(F.collect_list(
            F.struct((-F.col("n")).alias("k"), "valor", "n")))).scalar()
        quarts = exact_quantiles(df, number, PROFILE_QUANTILES) if c in numeric else [None] * 3
        row = df.agg(
            F.lit(c).alias("columna"), F.count(F.lit(1)).alias("n"), F.count_if(col.isNull()).alias("nulos"),
            F.min(plain).alias("minimo"), F.max(plain).alias("maximo"), F.min(number).alias("minimo_num"), F.max(number).alias("maximo_num"),
            F.round(F.avg(number), 4).alias("media"), F.round(F.stddev_samp(number), 4).alias("desviacion"))
        parts.append(row.withColumn("_top", first).withColumns({
            "distintos": counts.agg(F.count(F.lit(1))).scalar(),
            **{f"q{round(100 * q)}": F.round(F.lit(v).cast("double"), 4) for q, v in zip(PROFILE_QUANTILES, quarts)},
            "mas_frecuente": F.get("_top", F.lit(0))["valor"], "n_mas_frecuente": F.get("_top", F.lit(0))["n"],
            "frecuentes": F.array_join(F.transform("_top", lambda t: F.concat(t["valor"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))), "; "),
        }).drop("_top"))
    return reduce(DataFrame.unionByName, parts)


def reconcile(a: DataFrame, b: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Compare the same measures over two tables, one row per measure."""
    def side(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(*[m.cast("string").alias(k) for k, m in measures.items()])
        return unpivot_row(row, list(measures), "medida", name)

    both = side(a, "valor_a").join(side(b, "valor_b"), "medida", "full_outer")
    return both.withColumn("coincide", F.col("valor_a").eqNullSafe(F.col("valor_b")))


def series_stats(panel: DataFrame, min_nonzero: int = 12) -> DataFrame:
    """Size of the modelled universe and the share of series and facts that it keeps.

    The panel is reduced to one row per series first; the universe is a filter on that.
    """
    series = panel.groupBy("cod_municipio", "categoria").agg(
        F.count_if(F.col("cantidad") > 0).alias("busy"), F.sum("cantidad").alias("q"),
        F.min("periodo").alias("lo"), F.max("periodo").alias("hi"),
    )
    kept = F.col("busy") >= min_nonzero
    return series.agg(
        F.count_if(kept).alias("series_modeladas"),
        F.count_distinct(F.when(kept, F.col("cod_municipio"))).alias("municipios_modelados"),
        F.count_distinct(F.when(kept, F.col("categoria"))).alias("categorias_modeladas"),
        F.coalesce(F.sum(F.when(kept, F.col("q"))), F.lit(0)).alias("hechos_modelados"),
        F.date_format(F.min(F.when(kept, F.col("lo"))), "yyyy-MM").alias("periodo_min"),
        F.date_format(F.max(F.when(kept, F.col("hi"))), "yyyy-MM").alias("periodo_max"),
        F.round(100 * F.count_if(kept) / F.count(F.lit(1)), 1).alias("series_pct"),
        F.round(100 * F.sum(F.when(kept, F.col("q"))) / F.sum("q"), 1).alias("hechos_pct"),
    )
