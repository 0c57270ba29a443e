"""Ridge regression over a panel: one pass gives the sums of every month, their running totals every origin.

A fit needs the means and products of inputs and target over the months before its origin. Spark adds
them up by month, so what reaches the driver is one row a month of (inputs + 1)^2 / 2 numbers, whatever
the number of series. Origins, strengths and choices of inputs are then small equations.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class Ridge:
    """What to fit: the inputs (all by default) and a penalty relative to the variance of each input."""

    features: tuple[str, ...] | None = None
    strength: float = 0.0


@dataclass(frozen=True)
class LinearModel:
    """Weights of the named inputs, those left out being zero, and a constant."""

    names: tuple[str, ...]
    weights: tuple[float, ...]
    constant: float

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add `pred` from the vector `features`, whose places are those of `names`."""
        weights = F.array(*[F.lit(w) for w in self.weights])
        products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        return rows.withColumn("pred", F.aggregate(products, F.lit(self.constant), lambda a, x: a + x))


@dataclass(frozen=True)
class Moments:
    """Running totals by month of count, sums and products of the inputs, the target last."""

    names: tuple[str, ...]
    periods: list[date]
    count: np.ndarray
    total: np.ndarray
    cross: np.ndarray

    def model(self, ridge: Ridge, before: date | None = None) -> LinearModel:
        """The fit over the months before an origin; without rows all weights are zero."""
        upto = len(self.periods) if before is None else bisect_left(self.periods, before)
        weights = np.zeros(len(self.names))
        if upto == 0:
            return LinearModel(self.names, tuple(weights.tolist()), 0.0)
        unknown = set(ridge.features or ()) - set(self.names)
        if unknown:
            raise ValueError(f"the panel has no inputs {sorted(unknown)}")
        chosen = [i for i, name in enumerate(self.names) if ridge.features is None or name in ridge.features]
        mean = self.total[upto - 1] / self.count[upto - 1]
        spread = self.cross[upto - 1] / self.count[upto - 1] - np.outer(mean, mean)
        # In units of each input's deviation, so that the scale of an input decides nothing.
        scale = np.sqrt(np.maximum(np.diag(spread)[chosen], 0.0))
        scale[scale <= 1e-9 * np.maximum(1.0, np.abs(mean[chosen]))] = np.inf  # constant inputs get no weight
        normal = spread[np.ix_(chosen, chosen)] / np.outer(scale, scale) + np.diag(np.where(np.isinf(scale), 0.0, ridge.strength))
        weights[chosen] = np.linalg.lstsq(normal, spread[chosen, -1] / scale, rcond=1e-10)[0] / scale
        return LinearModel(self.names, tuple(weights.tolist()), float(mean[-1] - weights @ mean[:-1]))


def moments(rows: DataFrame, names: list[str], target: str = "objetivo") -> Moments:
    """Add up complete rows by `periodo`; an input that is null counts as zero, as in every other fit."""
    size = len(names) + 1
    known = rows.select("periodo", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"z{i}")
                                     for i, c in enumerate([*names, target])])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = known.groupBy("periodo").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f"z{i}") for i in range(size)]).alias("s"),
        F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}")) for i, j in pairs]).alias("p")).collect()
    found.sort(key=lambda r: r["periodo"])
    cross = np.zeros((len(found), size, size))
    if found:
        first, second = (list(x) for x in zip(*pairs, strict=True))
        products = np.array([r["p"] for r in found])
        cross[:, first, second] = products
        cross[:, second, first] = products
    total = np.array([r["s"] for r in found]).reshape(len(found), size)
    return Moments(tuple(names), [r["periodo"] for r in found], np.cumsum([r["n"] for r in found]),
                   np.cumsum(total, axis=0), np.cumsum(cross, axis=0))
