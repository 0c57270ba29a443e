"""Numbers: tolerant parsing, rates and es-CO formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from atalaya.constants import RATE_SCALE


NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def number(col: Column) -> Column:
    """A plain decimal number, or null. A bare cast would also take suffixes such as `2d` and `4f`."""
    text = F.regexp_replace(col, r"^\s+|\s+$", "")
    return F.when(text.rlike(NUMBER), text).try_cast("double")


def parse_quantity(col: Column) -> Column:
    """Unreadable counts as one event; negatives as zero; fractions are cut."""
    return F.greatest(F.coalesce(number(col), F.lit(1.0)), F.lit(0.0)).try_cast("bigint")


def to_rate(count: Column, population: Column) -> Column:
    return count.cast("double") / F.greatest(population.cast("double"), F.lit(1.0)) * RATE_SCALE


def to_count(rate: Column, population: Column) -> Column:
    return rate * F.greatest(population.cast("double"), F.lit(1.0)) / RATE_SCALE


def parse_coord(col: Column) -> Column:
    """Decimal-comma coordinate: the first comma is the decimal point, later ones are dropped."""
    text = F.trim(col)
    parts = F.split(F.regexp_replace(text, "^-+", ""), ",")
    tail = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "")
    joined = F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat(parts[0], F.lit("."), tail))
    value = number(joined)
    value = F.when(F.abs(value) <= 180, value)
    return F.when(text.startswith("-"), -value).otherwise(value)


def fmt_thousands(col: Column) -> Column:
    """23029390 -> 23.029.390"""
    return F.translate(F.format_number(col, 0), ",", ".")


def fmt_pct(col: Column, decimals: int = 2) -> Column:
    """8.51 -> 8,51 %"""
    return F.concat(F.translate(F.format_number(col, decimals), ",.", ".,"), F.lit(" %"))
