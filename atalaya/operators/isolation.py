"""Isolation forest whose trees grow in parallel on hash-drawn samples of at most 256 rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from atalaya.constants import CONTAMINATION
from atalaya.operators.quantiles import exact_quantiles

EULER_GAMMA = 0.5772156649015329
_NODE_SCHEMA = ("arbol int, nodo int, dim int, corte double, izq int, der int, "
                "largo double, n int")
_OVERSAMPLE = 4
_HASH_RANGE = 1 << 50


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Average depth of an unsuccessful search among n points, the usual normaliser."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def draw_samples(df: DataFrame, cols: list[str], keys: list[str], trees: int, size: int,
                 seed: int) -> DataFrame:
    """At most `size` rows for each tree, chosen by a hash of the row key.

    A cheap hash filter in the scan leaves a few thousand candidates per tree at any input size,
    so the exact cut per tree ranks a bounded group. Row-key hashes make the draw repeatable.
    """
    n = df.count()
    per_tree = min(1.0, _OVERSAMPLE * size / max(n, 1))
    key = [F.col(k) for k in keys]
    # Each tree draws for itself at every size; a row is only repeated for the trees that it enters.
    ids = F.sequence(F.lit(0), F.lit(trees - 1))
    keep = F.filter(ids, lambda t: F.pmod(F.xxhash64(*key, t, F.lit(seed)), F.lit(_HASH_RANGE))
                    < F.lit(int(per_tree * _HASH_RANGE)))
    rows = df.withColumn("arbol", F.explode(keep))
    order = F.xxhash64(*key, F.col("arbol"), F.lit(seed + 2))
    rank = F.row_number().over(Window.partitionBy("arbol").orderBy(order, *key))
    return rows.withColumn("orden", rank).where(F.col("orden") <= size).select("arbol", "orden", *cols)


def grow_trees(samples: DataFrame, cols: list[str], seed: int) -> DataFrame:
    """One node table row per node of every tree."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("orden")
        tree, points = int(pdf["arbol"].iloc[0]), pdf[cols].to_numpy(float)
        rng = np.random.default_rng([seed, tree])
        limit = int(np.ceil(np.log2(max(len(points), 2))))
        nodes, stack = [], [(0, points, 0)]
        next_id = 1
        while stack:
            node, block, depth = stack.pop()
            low, high = block.min(axis=0), block.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(block) <= 1 or len(usable) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1,
                              depth + float(_mean_path(len(block))), len(points)))
                continue
            dim = int(rng.choice(usable))
            # Strictly below the maximum, so that neither side of the cut is ever empty.
            cut = float(min(rng.uniform(low[dim], high[dim]), np.nextafter(high[dim], low[dim])))
            left = block[:, dim] <= cut
            nodes.append((tree, node, dim, cut, next_id, next_id + 1, 0.0, len(points)))
            stack += [(next_id, block[left], depth + 1), (next_id + 1, block[~left], depth + 1)]
            next_id += 2
        names = ["arbol", "nodo", "dim", "corte", "izq", "der", "largo", "n"]
        return pd.DataFrame(nodes, columns=names)

    return samples.groupBy("arbol").applyInPandas(grow, _NODE_SCHEMA)


def isolation_score(df: DataFrame, cols: list[str], keys: list[str],
                    contamination: float = CONTAMINATION, seed: int = 42, trees: int = 100,
                    size: int = 256) -> DataFrame:
    """Add `aislamiento` (higher is more isolated) and the flag of the most isolated share.

    Only the forest travels to the executors: trees * (2 * size - 1) nodes at most.
    """
    nodes = grow_trees(draw_samples(df, cols, keys, trees, size, seed), cols, seed)
    forest = [t.sort_values("nodo").reset_index(drop=True)
              for _, t in nodes.toPandas().groupby("arbol")]
    tables = [(t["dim"].to_numpy(), t["corte"].to_numpy(), t["izq"].to_numpy(),
               t["der"].to_numpy(), t["largo"].to_numpy(), int(t["n"].iloc[0])) for t in forest]
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            points = np.column_stack([b.to_numpy(float) for b in batch])
            total = np.zeros(len(points))
            norm = 0.0
            for dim, cut, left, right, length, n in shared.value:
                at = np.zeros(len(points), dtype=int)
                moving = dim[at] >= 0
                while moving.any():
                    here = at[moving]
                    value = points[moving, dim[here]]
                    at[moving] = np.where(value <= cut[here], left[here], right[here])
                    moving = dim[at] >= 0
                total += length[at]
                norm += float(_mean_path(n))
            yield pd.Series(np.power(2.0, -total / max(norm, 1e-12)))

    scored = df.withColumn("aislamiento", F.pandas_udf(score, "double")(*cols)) if tables else \
        df.withColumn("aislamiento", F.lit(None).cast("double"))
    cut = exact_quantiles(scored, F.col("aislamiento"), [1.0 - contamination])[0]
    return scored.withColumn("aislado", F.coalesce(F.col("aislamiento") > F.lit(cut), F.lit(False)))
