"""Exact quantiles of a whole column without sending the column to one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from atalaya.session import cut_lineage

SKETCH_ACCURACY = 10_000
# Distinct values that one ordering task takes in the last step; more are narrowed down further first.
ORDERED_VALUES = 100_000


def exact_quantiles(df: DataFrame, value: Column, probs: list[float], ordered_values: int = ORDERED_VALUES) -> list[float | None]:
    """Linear-interpolated quantiles, as `percentile` gives them, for any number of rows.

    A constant-size sketch brackets each wanted rank; rows below a bracket are only counted and rows
    inside it are grouped by value. Only those counts are ordered, so neither ties nor one hot value
    reach a single task as rows. The same steps serve every size.
    """
    values = cut_lineage(df.select(value.cast("double").alias("v")).where("v IS NOT NULL"))
    n = values.count()
    if n == 0:
        return [None] * len(probs)
    ranks = sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    found = _values_at_ranks(values, n, ranks, ordered_values)
    out = []
    for p in probs:
        position = p * (n - 1)
        low, high = found[math.floor(position)], found[math.ceil(position)]
        out.append(low + (high - low) * (position - math.floor(position)))
    return out


def _values_at_ranks(values: DataFrame, n: int, ranks: list[int], limit: int) -> dict[int, float]:
    """Value at each zero-based rank; `ranks` is a short list, a pair per wanted quantile."""
    found: dict[int, float] = {}
    for rank in ranks:
        if rank in found:
            continue
        inside, below = _bracket(values, n, rank, limit)
        # About `limit` (value, count) rows are ordered here; only the wanted ones are returned.
        through = F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("v")) + F.lit(below)
        steps = inside.groupBy("v").count().withColumn("to", through).withColumn(
            "from", F.col("to") - F.col("count"))
        wanted = reduce(lambda a, b: a | b, [F.lit(r).between(F.col("from"), F.col("to") - 1) for r in ranks])
        for step in steps.where(wanted).collect():
            found.update({r: step["v"] for r in ranks if step["from"] <= r < step["to"]})
    return found


def _bracket(values: DataFrame, n: int, rank: int, limit: int) -> tuple[DataFrame, int]:
    """Rows of a value range that holds the rank, and the number of rows below the range.

    The range is narrowed with a constant-size sketch until it has few distinct values. A sketch
    that misses the rank is retried with a wider margin, so the result never depends on it.
    """
    inside, below, within, slack = values, 0, n, 3.0 / SKETCH_ACCURACY
    while inside.agg(F.approx_count_distinct("v")).first()[0] > limit:
        share = (rank - below) / within
        probs = [max(0.0, share - slack), min(1.0, share + 1.0 / within + slack)]
        low, high = inside.agg(F.percentile_approx(
            "v", F.array(*[F.lit(p) for p in probs]), SKETCH_ACCURACY)).first()[0]
        row = inside.agg(F.count_if(F.col("v") < low).alias("below"),
                         F.count_if(F.col("v").between(low, high)).alias("within")).first()
        if not row["below"] <= rank - below < row["below"] + row["within"]:
            slack *= 4
        elif row["within"] == within:
            break  # the sketch is as fine as the data: a limit below its accuracy gains nothing
        else:
            inside = inside.where(F.col("v").between(low, high))
            below, within = below + row["below"], row["within"]
    return inside, below


def step_class(value: Column, breaks: list[float]) -> Column:
    """Number of breaks strictly below the value: the class index of a quantile legend."""
    tests = [F.when(value > b, 1).otherwise(0) for b in breaks]
    return reduce(lambda a, b: a + b, tests, F.lit(0))
