"""Nearest neighbours by a block matrix join with int8 tiles.

Queries are dealt into blocks and candidates into lanes; each (block, lane) cell is one stream in one
task: its queries first, then its candidates, tile after tile. A tile is a product of int8 codes,
whose distance from the true inner product is bounded by the rounding errors of both vectors. Only
pairs whose upper bound reaches the query's current floor are recomputed from the original vectors, in
double precision, and merged into its heap of the best k. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from atalaya.llm.common import stored

TILE_QUERIES, TILE_ROWS = 1024, 4096


@dataclass
class Coded:
    """Vectors with int8 codes (held as floats, whose products are exact) and what bounds their error."""
    ids: np.ndarray
    exact: np.ndarray
    codes: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray) -> "Coded":
        scale = np.abs(vectors).max(axis=1) / 127
        codes = np.clip(np.rint(vectors / np.where(scale > 0, scale, 1)[:, None]), -127, 127).astype(np.int8)
        rounded = codes * scale[:, None]
        wide = np.float32 if vectors.shape[1] <= 1024 else np.float64
        return cls(ids, vectors, codes.astype(wide), scale, np.sqrt((rounded ** 2).sum(axis=1)),
                   np.sqrt(((vectors - rounded) ** 2).sum(axis=1)))

    def part(self, start: int, stop: int) -> "Coded":
        return Coded(*(x[start:stop] for x in (self.ids, self.exact, self.codes, self.scale, self.norm, self.error)))


@dataclass
class Heaps:
    """The k best (score, id) of each query, best first; ties go to the smaller id."""
    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def empty(cls, queries: int, k: int) -> "Heaps":
        return cls(np.full((queries, k), -np.inf), np.full((queries, k), -1, np.int64))

    def merge(self, row: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        touched = np.unique(row)
        old_row = np.repeat(touched, k)
        row = np.concatenate([old_row, row])
        scores = np.concatenate([self.scores[touched].ravel(), scores])
        ids = np.concatenate([self.ids[touched].ravel(), ids])
        order = np.lexsort((ids, -scores, row))
        row, scores, ids = row[order], scores[order], ids[order]
        first = np.searchsorted(row, touched)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        best = place < k
        self.scores[row[best], place[best]] = scores[best]
        self.ids[row[best], place[best]] = ids[best]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last, so that a score has one value everywhere."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def tile(queries: Coded, rows: Coded, heaps: Heaps, start: int) -> None:
    """Meet `queries` (from position `start` of the heaps) with `rows`."""
    k, n = heaps.scores.shape[1], len(queries.ids)
    near = (queries.codes @ rows.codes.T) * np.outer(queries.scale, rows.scale)
    bound = np.outer(queries.error, rows.norm + rows.error) + np.outer(queries.norm, rows.error)
    bound += 1e-6 * np.outer(queries.norm + queries.error, rows.norm + rows.error)
    own = queries.ids[:, None] == rows.ids[None, :]
    near[own] = -np.inf
    floor = heaps.scores[start:start + n, -1].copy()
    fresh = np.flatnonzero(np.isneginf(floor))
    if len(fresh) and len(rows.ids) > k:
        lower = near[fresh] - bound[fresh]
        floor[fresh] = np.partition(lower, len(rows.ids) - k, axis=1)[:, len(rows.ids) - k]
    q, r = np.nonzero((near + bound >= floor[:, None]) & ~own)
    for at in range(0, len(q), 1 << 18):
        i, j = q[at:at + (1 << 18)], r[at:at + (1 << 18)]
        heaps.merge(i + start, inner_products(queries.exact[i], rows.exact[j]), rows.ids[j])


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(`id`, `vec` as doubles): no null id, no null, zero or empty vector, none with a null or non-finite component.

    Rows that share an id count once, with the smallest of their vectors.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    good = (F.col("id").isNotNull() & F.col("vec").isNotNull()
            & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists("vec", lambda x: x != 0))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.coalesce(good, F.lit(False)))
            .groupBy("id").agg(F.min("vec").alias("vec")))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            query_block: int = 16_384, lanes: int = 16) -> DataFrame:
    """The `k` largest inner products of each query: `query_id`, `rank` (from 1), `vec_id`, `score`.

    Queries are the rows whose id is divisible by `every`; candidates are all rows but the query's own.
    Vectors meet only vectors of the same length. See `clean` for the rows that take no part. With
    fewer than `k` candidates all are returned; an empty table gives no rows.
    """
    rows = stored(clean(vectors, id_col, vec_col).withColumn("dim", F.size("vec")), "vectors")
    blocks = -(-rows.where(F.col("id") % every == 0).count() // query_block) or 1
    block = F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long"))
    lane = F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(lanes).cast("long"))
    asked = rows.where(F.col("id") % every == 0).select(
        "dim", F.explode(F.sequence(block * lanes, block * lanes + (lanes - 1))).alias("cell"), F.lit(0).alias("role"), "id", "vec")
    offered = rows.select("dim", F.explode(F.sequence(lane, lane + (blocks - 1) * lanes, F.lit(lanes).cast("long"))).alias("cell"),
                          F.lit(1).alias("role"), "id", "vec")
    cells = asked.unionByName(offered).repartition("dim", "cell").sortWithinPartitions("dim", "cell", "role")

    def answer(queries: Coded | None, heaps: Heaps | None) -> Iterator[pa.RecordBatch]:
        if queries is not None:
            found = heaps.ids.ravel() >= 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(queries.ids, k)[found]), pa.array(heaps.ids.ravel()[found]), pa.array(heaps.scores.ravel()[found])],
                ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, queries, heaps = None, [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, own, role, ids = (batch.column(c).to_numpy() for c in ("dim", "cell", "role", "id"))
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(dim)
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(own) != 0) | (np.diff(role) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(ids)]):
                if (dim[start], own[start]) != cell:
                    yield from answer(queries, heaps)
                    cell, held, queries, heaps = (dim[start], own[start]), [], None, None
                part = flat[ends[start] - dim[start]:ends[stop - 1]].reshape(stop - start, dim[start])
                if role[start] == 0:
                    held.append((ids[start:stop].copy(), part.copy()))
                    continue
                if held:
                    queries = Coded.of(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    heaps, held = Heaps.empty(len(queries.ids), k), []
                if queries is None:
                    continue
                rows_in = Coded.of(ids[start:stop], part)
                for r in range(0, stop - start, TILE_ROWS):
                    for q in range(0, len(queries.ids), TILE_QUERIES):
                        tile(queries.part(q, q + TILE_QUERIES), rows_in.part(r, r + TILE_ROWS), heaps, q)
        yield from answer(queries, heaps)

    best = cells.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
