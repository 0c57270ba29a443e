"""Resolve the territory and category a question mentions: phrase, token, then fuzzy token.

Names are reduced to one row per phrase or token before any join, so a frequent word joins each
question to a single row and never to every name that contains it.
"""

from __future__ import annotations

import difflib
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from atalaya.constants import (
    CATEGORY_HINTS, FORECAST_STEMS, FUZZY_CUTOFF, FUZZY_MARGIN, FUZZY_MIN_LEN, TOKEN_MIN_LEN,
)
from atalaya.functions import ascii_fold, words
from atalaya.session import cut_lineage

NAME_COLUMNS = ["cod_municipio", "municipio", "departamento"]


def forecast_intent(col: Column) -> Column:
    """Does the question look ahead?"""
    return F.lower(ascii_fold(col)).rlike("|".join(FORECAST_STEMS))


# Of names that match equally well the one with the smallest `orden` is taken, then the smallest code.
ORDER = "orden"

# Most variants of a token, and the longest token that has no more when 0, 1, 2... characters are left out.
VARIANTS = 2000
LONGEST = [max(n for n in range(gone, VARIANTS + 1) if comb(n, gone) <= VARIANTS) for gone in range(12)]


def _ordered(names: DataFrame) -> DataFrame:
    """The name table with an order of preference; without one, codes decide."""
    return names if ORDER in names.columns else names.withColumn(ORDER, F.lit(0))


def _name_row() -> Column:
    return F.struct(*NAME_COLUMNS, ORDER)


def _first(size: Column) -> Column:
    return F.struct((-size).alias("s"), F.col(f"fila.{ORDER}"), F.col("fila.cod_municipio"))


def _phrases(names: DataFrame) -> DataFrame:
    """One row per normalised full name, with its number of words."""
    tokens = words(F.col("municipio"))
    rows = _ordered(names).select(*NAME_COLUMNS, ORDER, F.array_join(tokens, " ").alias("frase"),
                        F.size(tokens).alias("n"))
    return rows.where(F.length("frase") >= TOKEN_MIN_LEN).groupBy("frase", "n").agg(
        F.min_by(_name_row(), F.struct(ORDER, "cod_municipio")).alias("fila"))


def _tokens(names: DataFrame, min_len: int) -> DataFrame:
    """One row per name token: smallest and largest name that has it, and the row to return."""
    rows = _ordered(names).select(*NAME_COLUMNS, ORDER, F.explode(F.array_distinct(words(F.col("municipio")))).alias("token"))
    return rows.where(F.length("token") >= min_len).groupBy("token").agg(
        F.min("municipio").alias("n1"), F.max("municipio").alias("n2"),
        F.min_by(_name_row(), F.struct(ORDER, "cod_municipio")).alias("fila"))


def _query_tokens(queries: DataFrame, key: str, min_len: int) -> DataFrame:
    exploded = queries.select(key, F.explode(F.array_distinct(words(F.col("texto")))).alias("token"))
    return exploded.where(F.length("token") >= min_len)


def match_phrase(queries: DataFrame, names: DataFrame, key: str = "id") -> DataFrame:
    """Question contains a full official name as a phrase; the longest name wins."""
    phrases = _phrases(names)
    longest = phrases.agg(F.coalesce(F.max("n"), F.lit(1))).scalar()
    tokenised = queries.select(key, words(F.col("texto")).alias("w")).withColumn("_n", longest)
    grams = F.flatten(F.transform(
        F.sequence(F.lit(1), F.least("_n", F.greatest(F.size("w"), F.lit(1)))),
        lambda n: F.transform(
            F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))),
            lambda i: F.array_join(F.slice(F.col("w"), i, n), " "))))
    exploded = tokenised.select(key, F.explode(F.array_distinct(grams)).alias("frase"))
    hits = exploded.join(phrases, "frase")
    best = F.min_by("fila", _first(F.length("frase")))
    return hits.groupBy(key).agg(best.alias("fila")).select(key, *[f"fila.{c}" for c in NAME_COLUMNS])


def token_candidates(queries: DataFrame, names: DataFrame, key: str = "id",
                     min_len: int = TOKEN_MIN_LEN) -> DataFrame:
    """Best token match per question, flagged when several names share the longest token."""
    hits = _query_tokens(queries, key, min_len).join(_tokens(names, min_len), "token")
    size = F.length("token")
    return hits.groupBy(key).agg(
        F.min_by("n1", F.struct((-size).alias("l"), "n1")).alias("n1"),
        F.max_by("n2", F.struct(size.alias("l"), "n2")).alias("n2"),
        F.min_by("fila", _first(size)).alias("fila"),
    ).select(key, *[f"fila.{c}" for c in NAME_COLUMNS], (F.col("n1") != F.col("n2")).alias("ambiguo"))


def match_tokens(queries: DataFrame, names: DataFrame, key: str = "id",
                 min_len: int = TOKEN_MIN_LEN) -> DataFrame:
    return token_candidates(queries, names, key, min_len).where("NOT ambiguo").drop("ambiguo")


def _allowed_edits(a: Column, b: Column, cutoff: float, kind: str) -> Column:
    """Most edits two tokens of these lengths may differ by and still reach the cutoff.

    A gestalt ratio of r leaves at most (1 - r)(a + b) unmatched characters, an upper bound on
    insertions plus deletions; a Levenshtein similarity of r allows (1 - r) max(a, b) edits.
    """
    span = a + b if kind == "gestalt" else F.greatest(a, b)
    return F.floor(F.lit(1.0 - cutoff) * span + 1e-9).cast("int")


def _length_pairs(queries: DataFrame, names: DataFrame, cutoff: float, kind: str) -> DataFrame:
    """Lengths `a` and `b` of tokens that occur and can reach the cutoff.

    `t` edits are allowed, and `m` characters at least are common to both tokens in order. `few` says
    that neither token has more than `VARIANTS` ways to leave out all but `m` characters.
    """
    own = queries.select(F.length("q_token").alias("a")).distinct()
    low, high = F.ceil(F.col("a") * (cutoff / (2 - cutoff))), F.floor(F.col("a") * ((2 - cutoff) / cutoff))
    pairs = own.select("a", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("b"))
    pairs = pairs.join(names.select(F.length("n_token").alias("b")).distinct(), "b")
    a, b, t = F.col("a"), F.col("b"), F.col("t")
    pairs = pairs.withColumn("t", _allowed_edits(a, b, cutoff, kind)).where(F.abs(a - b) <= t)
    common = F.ceil((a + b - t) / 2) if kind == "gestalt" else F.greatest(a, b) - t
    pairs = pairs.withColumn("m", common.cast("int")).where((F.col("m") > 0) & (F.col("m") <= F.least(a, b)))
    most = F.array(*[F.lit(n) for n in LONGEST])
    few = [F.coalesce(n <= F.get(most, n - F.col("m")), F.lit(False)) for n in (a, b)]
    return pairs.withColumn("few", few[0] & few[1])


def _variants(tokens: DataFrame, column: str, pairs: DataFrame, length: str) -> DataFrame:
    """What is left of each token when all but `m` characters are left out, in every way.

    Tokens within the cutoff have a common subsequence of `m` characters, so they share a variant;
    as it is nearly the whole token, few others share it.
    """
    rows = tokens.select(column, F.length(column).alias(length)).join(F.broadcast(pairs.where("few")), length)

    def without_one(rests: Column, _: Column) -> Column:
        shorter = F.transform(rests, lambda x: F.transform(
            F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x)))))
        return F.array_distinct(F.flatten(shorter))

    gone = F.col(length) - F.col("m")
    rests = F.when(gone == 0, F.array(column)).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.greatest(gone, F.lit(1))), F.array(column), without_one))
    return rows.select(column, "a", "b", F.explode(rests).alias("trozo"))


def _segments(tokens: DataFrame, column: str, pairs: DataFrame, probing: bool) -> DataFrame:
    """Positional segments of tokens too long for variants, by the pigeonhole principle.

    A name token of length b is cut into t + 1 pieces; t edits cannot touch all of them, so an
    acceptable partner holds one piece unchanged, at most t places away. Names emit their own
    pieces, questions emit the substrings that could equal one.
    """
    length = "a" if probing else "b"
    rows = tokens.select(column, F.length(column).alias(length)).join(F.broadcast(pairs.where("not few")), length)
    rows = rows.withColumn("k", F.least(F.col("t") + 1, F.col("b")))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    start = F.floor(F.col("i") * F.col("b") / F.col("k")).cast("int")
    stop = F.floor((F.col("i") + 1) * F.col("b") / F.col("k")).cast("int")
    rows = rows.withColumns({"s": start + 1, "len": stop - start})
    if not probing:
        return rows.select(column, "a", "b", "i", F.substring(column, F.col("s"), F.col("len")).alias("trozo"))
    first = F.greatest(F.lit(1), F.col("s") - F.col("t"))
    last = F.least(F.col("a") - F.col("len") + 1, F.col("s") + F.col("t"))
    rows = rows.where(first <= last).withColumn("p", F.explode(F.sequence(first, last)))
    return rows.select(column, "a", "b", "i",
                       F.substring(column, F.col("p"), F.col("len")).alias("trozo")).distinct()


@F.pandas_udf(DoubleType())
def gestalt_ratio(name: pd.Series, query: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of candidate pairs, for which Spark has no built-in."""
    return pd.Series([difflib.SequenceMatcher(None, a, b).ratio()
                      for a, b in zip(name, query, strict=True)], dtype="float64")


def candidate_tokens(queries: DataFrame, names: DataFrame, cutoff: float = FUZZY_CUTOFF, kind: str = "gestalt") -> DataFrame:
    """Pairs (q_token, n_token) among which are all that reach the cutoff."""
    asked, known = (cut_lineage(x.distinct()) for x in (queries.select("q_token"), names.select("n_token")))
    lengths = cut_lineage(_length_pairs(asked, known, cutoff, kind))
    short = _variants(asked, "q_token", lengths, "a").join(_variants(known, "n_token", lengths, "b"), ["a", "b", "trozo"])
    long = _segments(asked, "q_token", lengths, True).join(_segments(known, "n_token", lengths, False), ["a", "b", "i", "trozo"])
    return short.select("q_token", "n_token").unionByName(long.select("q_token", "n_token")).distinct()


def similar_tokens(queries: DataFrame, names: DataFrame, cutoff: float = FUZZY_CUTOFF,
                   kind: str = "gestalt") -> DataFrame:
    """Pairs (q_token, n_token, ratio) at or above the cutoff between two distinct vocabularies."""
    pairs = candidate_tokens(queries, names, cutoff, kind)
    if kind == "gestalt":
        ratio = gestalt_ratio("n_token", "q_token")
    else:
        ratio = 1 - F.levenshtein("q_token", "n_token") / F.greatest(F.length("q_token"), F.length("n_token"))
    return pairs.withColumn("ratio", ratio).where(F.col("ratio") >= cutoff)


def match_fuzzy(queries: DataFrame, names: DataFrame, key: str = "id", cutoff: float = FUZZY_CUTOFF,
                margin: float = FUZZY_MARGIN, min_len: int = FUZZY_MIN_LEN,
                kind: str = "gestalt") -> DataFrame:
    """Most similar name per question, or none when another name comes within the margin."""
    # The questions' tokens feed the search for pairs and the join back: they are stored, not replayed.
    asked = cut_lineage(_query_tokens(queries, key, min_len).withColumnRenamed("token", "q_token"))
    known = _tokens(names, min_len).withColumnRenamed("token", "n_token")
    pairs = similar_tokens(asked, known, cutoff, kind)
    scored = asked.join(pairs, "q_token").groupBy(key, "n_token").agg(F.max("ratio").alias("ratio"))
    # A question keeps at most one row per name token, so this window is bounded by the gazetteer.
    best = F.max("ratio").over(Window.partitionBy(key))
    near = scored.withColumn("_best", best).where(
        (F.col("ratio") == F.col("_best")) | (F.col("_best") - F.col("ratio") < margin))
    found = near.join(known, "n_token").groupBy(key).agg(
        F.min("n1").alias("n1"), F.max("n2").alias("n2"), F.max("ratio").alias("ratio"),
        F.min_by("fila", _first(F.col("ratio"))).alias("fila"))
    return found.where("n1 = n2").select(key, *[f"fila.{c}" for c in NAME_COLUMNS], "ratio")


def resolve(queries: DataFrame, names: DataFrame, panel: DataFrame | None = None,
            key: str = "id") -> DataFrame:
    """Phrase, then token, then fuzzy; a later rung only sees what earlier ones left open.

    An ambiguous token match ends the search without a result.
    """
    # Questions and names feed every rung, and a rung both the result and the filter of the next one.
    queries = cut_lineage(queries.select(key, "texto"))
    names = cut_lineage(_ordered(names).select(*NAME_COLUMNS, ORDER))
    phrase = cut_lineage(match_phrase(queries, names, key).withColumn("via", F.lit("frase")))
    rest = queries.join(phrase.select(key), key, "left_anti")
    tokens = cut_lineage(token_candidates(rest, names, key))
    by_token = tokens.where("NOT ambiguo").drop("ambiguo").withColumn("via", F.lit("token"))
    open_rest = rest.join(tokens.select(key), key, "left_anti")
    fuzzy = match_fuzzy(open_rest, names, key).drop("ratio").withColumn("via", F.lit("difuso"))
    out = phrase.unionByName(by_token).unionByName(fuzzy)
    if panel is None:
        return out
    available = panel.groupBy("cod_municipio").agg(
        F.array_sort(F.collect_set("categoria")).alias("categorias"))
    return out.join(available, "cod_municipio", "left")


def _plain(col: Column) -> Column:
    """Category names and hints compare with one separator."""
    return F.translate(F.upper(F.trim(ascii_fold(col))), "_", " ")


def match_category(text: Column, categories: Column,
                   hints: list[tuple[str, str]] = CATEGORY_HINTS) -> Column:
    """First keyword of the ordered list that occurs in the text and has a category.

    `categories` is the sorted array of what the territory has; the smallest match is taken.
    """
    asked = F.lower(ascii_fold(text))

    def smallest_with(fragment: str) -> Column:
        wanted = F.lit(fragment.replace("_", " "))
        return F.array_min(F.filter(categories, lambda c: F.contains(_plain(c), wanted)))

    return F.coalesce(*[F.when(asked.contains(stem), smallest_with(fragment)) for stem, fragment in hints])


def resolve_category(text: Column, categories: Column) -> Column:
    """Exact name, then containment either way, then the keyword list."""
    asked = F.upper(F.trim(ascii_fold(text)))
    def folded(c: Column) -> Column:
        return F.upper(F.trim(ascii_fold(c)))

    exact = F.array_min(F.filter(categories, lambda c: folded(c) == asked))
    inside = F.array_min(F.filter(categories, lambda c: F.contains(folded(c), asked)
                                  | F.contains(asked, folded(c))))
    return F.coalesce(exact, F.when(asked != "", inside), match_category(text, categories))


def forecast_context(resolved: DataFrame, forecast_texts: DataFrame, key: str = "id") -> DataFrame:
    """Citable forecast passage for questions with intent, territory and category."""
    asked = resolved.where(forecast_intent(F.col("texto"))).withColumn(
        "categoria", match_category(F.col("texto"), F.col("categorias"))).where("categoria IS NOT NULL")
    text = F.format_string(
        "Pronóstico del modelo para %s en %s (%s), próximos %d meses, con banda de incertidumbre ~80%%: %s.",
        "categoria", "municipio", "departamento", "meses", "proyeccion")
    return asked.join(forecast_texts, ["cod_municipio", "categoria"]).select(
        key, "cod_municipio", "categoria", text.alias("contenido"), F.lit(1.0).alias("score"))
