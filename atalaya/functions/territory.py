"""Territory codes, event nature and process stages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from atalaya.constants import (
    ADVANCED, CRIME, INQUIRY, NO_TITLE, REGION_NAMES, RESPONSE, STAGE_CHAIN, UNKNOWN_STAGE,
)
from atalaya.functions.text import strip_marks


def pad_code(digits: Column, width: int) -> Column:
    """Left-pad with zeros without ever cutting a longer code."""
    return F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits)


def territory_code(col: Column, family: str = "A") -> Column:
    """Five-digit territory code kept as text; unusable codes become null."""
    digits = F.regexp_replace(col, r"\D", "")
    if family == "B":
        digits = F.substring(digits, 1, 5)
    code = F.when(F.length(digits).between(1, 5), F.lpad(digits, 5, "0"))
    return F.when(~code.startswith("00"), code)


def region(col: Column) -> Column:
    return F.substring(col, 1, 2)


def region_name(col: Column) -> Column:
    """Searchable name of a region code, null when the code is not a region."""
    table = F.create_map(*[F.lit(x) for pair in REGION_NAMES.items() for x in pair])
    return table[col]


def nature(category: Column, response: Iterable[str]) -> Column:
    return F.when(category.isin(*response), F.lit(RESPONSE)).otherwise(F.lit(CRIME))


def stage_class(col: Column) -> Column:
    """Later stages win over the inquiry stage when a label mentions both."""
    text = strip_marks(col)
    return (
        F.when(text.rlike("|".join(STAGE_CHAIN[1:])), F.lit(ADVANCED))
        .when(text.contains(STAGE_CHAIN[0]), F.lit(INQUIRY))
        .otherwise(F.lit(UNKNOWN_STAGE))
    )


def stage_order(col: Column) -> Column:
    """Position in the chain; unknown stages come last."""
    text = strip_marks(col)
    order = F.lit(len(STAGE_CHAIN))
    for position, stem in reversed(list(enumerate(STAGE_CHAIN))):
        order = F.when(text.contains(stem), F.lit(position)).otherwise(order)
    return order


def blank_to(col: Column, label: str = NO_TITLE) -> Column:
    text = F.trim(col)
    return F.when(text.isNull() | (text == ""), F.lit(label)).otherwise(text)
