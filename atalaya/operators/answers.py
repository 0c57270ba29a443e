"""Score answers against questions with a verifiable criterion."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from atalaya.constants import INTEGER_PATTERN, OUT_OF_SCOPE, REFUSAL_PHRASES, YEAR_RANGE
from atalaya.functions import ascii_fold
from atalaya.operators.funnel import eligible_titles

OUT_OF_SCOPE_CATEGORY = "fuera_alcance"


# The classes of engines whose \d, \s and \b know ASCII only; Java's own differ by version and in \x0B.
ASCII_CLASSES = {r"\d": "[0-9]", r"\s": r"\t\n\f\r ", r"\b": "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"}


def extract_integers(col: Column, ascii_only: bool = False) -> Column:
    """Whole numbers of a text as digits without leading zeros, of any length.

    Thousands separators are joined, no-break spaces among them; decimals are not. Digits of other
    scripts become ASCII ones. With `ascii_only` digits, spaces and word characters are those of
    ASCII, and any other character ends a word.
    """
    integer, joint, text = "(?U)" + INTEGER_PATTERN, r"(?U)[.,\s]", ascii_digits(col)
    if ascii_only:
        integer, joint, text = _ascii_classes(INTEGER_PATTERN), _ascii_classes(r"[.,\s]"), col
    found = F.regexp_extract_all(text, F.lit(integer), F.lit(0))
    return F.array_distinct(F.transform(
        found, lambda x: F.regexp_replace(F.regexp_replace(x, joint, ""), r"^0+(?=\d)", "")))


def _ascii_classes(pattern: str) -> str:
    return reduce(lambda p, c: p.replace(*c), ASCII_CLASSES.items(), pattern)


def ascii_digits(col: Column) -> Column:
    """Every decimal digit of Unicode as 0-9."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, col).otherwise(F.translate(col, *_digit_tables()))


@lru_cache(maxsize=1)
def _digit_tables() -> tuple[str, str]:
    found = [chr(p) for p in range(0x80, sys.maxunicode + 1) if chr(p).isdecimal()]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def contains_figure(answer: Column, figures: Column) -> Column:
    """Any of the accepted whole numbers appears."""
    return F.coalesce(F.arrays_overlap(extract_integers(answer),
                                       F.transform(figures, lambda x: x.cast("string"))), F.lit(False))


def contains_decimal(answer: Column, value: Column) -> Column:
    """The decimal appears, with a point or a comma."""
    pattern = F.concat(F.lit(r"\b"), F.regexp_replace(value.cast("string"), r"\.", "[.,]"), F.lit(r"\b"))
    return F.rlike(answer, pattern)


def contains_text(answer: Column, expected: Column) -> Column:
    return F.contains(F.lower(ascii_fold(answer)), F.lower(ascii_fold(expected)))


def is_abstention(col: Column) -> Column:
    return F.lower(ascii_fold(col)).rlike("|".join(REFUSAL_PHRASES))


def invents_figures(col: Column) -> Column:
    """A number of at least 100 that is not a plausible year."""
    low, high = YEAR_RANGE
    year = lambda n: (F.length(n) == 4) & n.between(str(low), str(high))
    return F.exists(extract_integers(col), lambda n: (F.length(n) >= 3) & ~year(n))


def score(questions: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Join answers to questions and apply the criterion each question carries."""
    rows = questions.join(answers, key, "left").withColumn("_a", F.coalesce("respuesta", F.lit("")))
    answer = F.col("_a")
    has_figures = F.coalesce(F.size("cifras"), F.lit(0)) > 0
    has_text = F.coalesce(F.col("texto_esperado"), F.lit("")) != ""
    figure_ok = F.when(has_figures, contains_figure(answer, F.col("cifras")))
    decimal_ok = F.when(F.col("decimal").isNotNull(), contains_decimal(answer, F.col("decimal")))
    text_ok = F.when(has_text, contains_text(answer, F.col("texto_esperado")))
    rows = rows.withColumns({
        "abstiene": is_abstention(answer), "inventa_cifras": invents_figures(answer),
        "cifra_ok": figure_ok, "decimal_ok": decimal_ok, "texto_ok": text_ok,
        "cita_fuentes": F.coalesce(F.col("n_fuentes"), F.lit(0)) > 0})
    passed = reduce(lambda a, b: a & b, [F.coalesce(F.col(c), F.lit(True))
                                         for c in ("cifra_ok", "decimal_ok", "texto_ok")])
    answered = F.col("respuesta").isNotNull()
    hit = answered & F.when(F.col("espera_abstencion"),
                            F.col("abstiene") & ~F.col("inventa_cifras")).otherwise(passed)
    return rows.withColumn("acierto", hit).drop("_a")


def answer_report(scored: DataFrame) -> DataFrame:
    """Accuracy on verifiable questions, correct abstention, citation among hits, mean latency."""
    outside = F.col("categoria") == OUT_OF_SCOPE_CATEGORY
    hit = F.col("acierto").cast("int")

    def share(of: Column, where: Column) -> Column:
        return F.round(F.avg(F.when(where, of.cast("int"))), 3)

    return scored.agg(
        F.count(F.lit(1)).alias("n_preguntas"), share(hit, ~outside).alias("exactitud_cifras"),
        share(hit, outside).alias("abstencion_correcta"),
        share(F.col("cita_fuentes"), ~outside & F.col("acierto")).alias("citacion_en_aciertos"),
        F.round(F.avg("latencia_s"), 1).alias("latencia_media_s"))


def answer_report_by_category(scored: DataFrame) -> DataFrame:
    return scored.groupBy("categoria").agg(F.count(F.lit(1)).alias("n"),
                                           F.count_if("acierto").alias("aciertos"))


QUESTION_SCHEMA = ("id string, categoria string, texto string, cifras array<bigint>, decimal double, "
                   "texto_esperado string, espera_abstencion boolean")


def _question(df: DataFrame, id_: Column, category: str, text: Column, figures: Column | None = None,
              decimal: Column | None = None, expected: Column | None = None) -> DataFrame:
    return df.select(
        id_.alias("id"), F.lit(category).alias("categoria"), text.alias("texto"),
        (F.lit(None) if figures is None else figures).cast("array<bigint>").alias("cifras"),
        (F.lit(None) if decimal is None else decimal).cast("double").alias("decimal"),
        (F.lit(None) if expected is None else expected).cast("string").alias("texto_esperado"),
        F.lit(False).alias("espera_abstencion"))


def short_name(col: Column) -> Column:
    return F.trim(F.substring_index(col, ",", 1))


def golden_questions(summary: DataFrame, cat_reference: DataFrame, leaders: DataFrame,
                     national: DataFrame, rates: DataFrame, titles: DataFrame,
                     min_title: int | None = None, admin: DataFrame | None = None,
                     typo: tuple[str, str] | None = None) -> DataFrame:
    """Questions with expected answers derived from the result tables; each part is a top-n.

    `typo` is a (misspelt, official fragment) pair that must still resolve.
    """
    top = summary.orderBy(F.desc("total_delitos"), "cod_municipio").limit(5)
    parts = [_question(top, F.concat(F.lit("muni_"), "cod_municipio"), "municipio",
                       F.concat(F.lit("¿Cuál es el total de hechos registrados en "), short_name(F.col("municipio")), F.lit("?")),
                       F.array("total_hechos", "total_delitos"))]
    if typo is not None:
        wrong, fragment = typo
        row = summary.where(F.contains("municipio", F.lit(fragment))).orderBy(
            F.desc("total_delitos"), "cod_municipio").limit(1)
        parts.append(_question(row, F.lit("fuzzy_typo"), "fuzzy",
                               F.lit(f"¿Cuál es el total de hechos registrados en {wrong}?"),
                               F.array("total_hechos", "total_delitos"), expected=F.col("municipio")))
    parts.append(_question(
        cat_reference.where("cantidad IS NOT NULL"), F.concat_ws("_", F.lit("cat"), "categoria", "anio"),
        "categoria_anual", F.format_string("¿Cuántos hechos de %s se registraron a nivel nacional en %d?", "categoria", "anio"),
        F.array("cantidad")))
    parts.append(_question(leaders, F.concat(F.lit("rank_"), "categoria"), "ranking",
                           F.format_string("¿Qué municipio tiene más %s?", "categoria"),
                           expected=short_name(F.col("municipio"))))
    parts.append(_question(national, F.lit("justicia_tasa"), "justicia",
                           F.lit("¿Cuál es la tasa de judicialización nacional?"),
                           decimal=F.col("tasa_judicializacion_pct")))
    parts.append(_question(national, F.lit("justicia_total"), "justicia",
                           F.lit("¿Cuántos procesos penales se analizan?"), F.array("total_procesos")))
    biggest = rates.orderBy(F.desc("total_procesos"), "cod_municipio").limit(1)
    parts.append(_question(biggest, F.concat(F.lit("justicia_"), "cod_municipio"), "justicia",
                           F.concat(F.lit("¿Cuántos procesos tiene "), short_name(F.col("municipio")), F.lit("?")),
                           F.array("total_procesos")))
    worst = (eligible_titles(titles) if min_title is None else eligible_titles(titles, min_title)).orderBy(
        "tasa_judicializacion_pct", "titulo_delito").limit(1)
    parts.append(_question(worst, F.lit("justicia_delito_menor"), "justicia",
                           F.lit("¿Qué tipo de delito tiene la menor tasa de judicialización?"),
                           expected=F.col("titulo_delito")))
    if admin is not None:
        parts.append(_question(admin.agg(F.count(F.lit(1)).alias("n")), F.lit("admin_demandas"), "administrativo",
                               F.lit("¿Cuántas demandas se han notificado?"), F.array("n")))
    outside = summary.sparkSession.createDataFrame(OUT_OF_SCOPE, "id string, texto string")
    parts.append(_question(outside, F.col("id"), OUT_OF_SCOPE_CATEGORY, F.col("texto")).withColumn(
        "espera_abstencion", F.lit(True)))
    return reduce(DataFrame.unionByName, parts)
