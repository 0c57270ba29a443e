"""Exact cosine top-k over an embedding table, and the score threshold with abstention."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from atalaya.constants import MIN_SCORE, TOP_K

TILE = 1024


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    matrix = flat.reshape(-1, dim).astype(np.float64)
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    # A zero vector has no direction: it scores 0 against everything.
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=str if pa.types.is_string(column.type) else None)


class _Best:
    """The k best corpus rows of each query met so far; equal scores keep the smaller id."""

    def __init__(self, vectors: np.ndarray, k: int) -> None:
        self.vectors, self.k = vectors, k
        self.rows, self.sims, self.keys = np.zeros(0, np.int64), np.zeros(0), None
        self.floor = np.full(len(vectors), -np.inf)

    def meet(self, keys: np.ndarray, block: np.ndarray) -> None:
        for q in range(0, len(self.vectors), TILE):
            sims = self.vectors[q:q + TILE] @ block.T
            floor = self.floor[q:q + TILE]
            if sims.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(sims, -self.k, axis=1)[:, -self.k])
            row, col = np.nonzero(sims >= floor[:, None])
            self.rows = np.concatenate([self.rows, row + q])
            self.sims = np.concatenate([self.sims, sims[row, col]])
            self.keys = keys[col] if self.keys is None else np.concatenate([self.keys, keys[col]])
        order = np.lexsort((self.keys, -self.sims, self.rows))
        rows = self.rows[order]
        count = np.bincount(rows, minlength=len(self.vectors))
        first = np.cumsum(count) - count
        kept = order[np.arange(len(rows)) - np.repeat(first, count) < self.k]
        self.rows, self.sims, self.keys = self.rows[kept], self.sims[kept], self.keys[kept]
        full = np.flatnonzero(count >= self.k)
        count = np.minimum(count, self.k)
        self.floor[full] = self.sims[(np.cumsum(count) - 1)[full]]


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = TOP_K, query_id: str = "query_id",
                corpus_id: str = "vec_id", vector: str = "embedding", query_block: int = 8192,
                lanes: int = 16) -> DataFrame:
    """Exact k nearest by cosine. Score = 1 - distance, rounded to 3 decimals.

    Queries are dealt into blocks and the corpus into lanes; a task reads one block and then streams
    one lane past it, keeping k rows per query. So queries never pass through the driver and k rows
    per query and lane are shuffled, however large the corpus is. Null vectors and vectors with a
    null component take no part; vectors meet only those of the same length.
    """
    def usable(df: DataFrame, key: str) -> DataFrame:
        rows = df.select(F.col(key).alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("vec"))
        return rows.where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND forall(vec, v -> v IS NOT NULL)")

    asked, offered = usable(queries, query_id), usable(corpus, corpus_id)
    q_type, c_type = queries.schema[query_id].dataType.simpleString(), corpus.schema[corpus_id].dataType.simpleString()
    blocks = max(1, -(-asked.count() // query_block))
    start = F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long")) * lanes
    lane = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(lanes).cast("long"))
    none = lambda kind: F.lit(None).cast(kind)
    left = asked.select(F.size("vec").alias("dim"), F.explode(F.sequence(start, start + (lanes - 1))).alias("cell"), F.lit(0).alias("role"),
                        F.col("id").alias("q"), none(c_type).alias("c"), "vec")
    right = offered.select(F.size("vec").alias("dim"), F.explode(F.sequence(lane, lane + (blocks - 1) * lanes, F.lit(lanes).cast("long"))).alias("cell"),
                           F.lit(1).alias("role"), none(q_type).alias("q"), F.col("id").alias("c"), "vec")
    cells = left.unionByName(right).repartition("dim", "cell").sortWithinPartitions("dim", "cell", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, names, best, types = None, [], [], None, None

        def answer() -> Iterator[pa.RecordBatch]:
            if best is not None and best.keys is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[r] for r in best.rows], types[0]), pa.array(best.keys.tolist(), types[1]), pa.array(best.sims)],
                    [query_id, corpus_id, "sim"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            types = batch.column("q").type, batch.column("c").type
            dim, own, role = (batch.column(n).to_numpy() for n in ("dim", "cell", "role"))
            flat, ends = batch.column("vec").flatten().to_numpy(zero_copy_only=False), np.cumsum(dim)
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(own) != 0) | (np.diff(role) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(dim)]):
                if (dim[a], own[a]) != cell:
                    yield from answer()
                    cell, held, names, best = (dim[a], own[a]), [], [], None
                block = _unit(flat[ends[a] - dim[a]:ends[b - 1]], int(dim[a]))
                if role[a] == 0:
                    held.append(block)
                    names += batch.column("q")[a:b].to_pylist()
                    continue
                if held:
                    best, held = _Best(np.concatenate(held), k), []
                if best is not None:
                    for r in range(0, b - a, 4 * TILE):
                        stop = min(b - a, r + 4 * TILE)
                        best.meet(_ids(batch.column("c")[a + r:a + stop]), block[r:stop])
        yield from answer()

    hits = cells.mapInArrow(run, f"{query_id} {q_type}, {corpus_id} {c_type}, sim double")
    order = Window.partitionBy(query_id).orderBy(F.desc("sim"), corpus_id)
    return hits.withColumn("puesto", F.row_number().over(order)).where(F.col("puesto") <= k).select(
        query_id, "puesto", corpus_id, F.round("sim", 3).alias("score"))


def threshold(queries: DataFrame, hits: DataFrame, min_score: float = MIN_SCORE,
              query_id: str = "query_id") -> DataFrame:
    """Hits at or above the minimum; a query left without any becomes one abstaining row."""
    kept = hits.where(F.col("score") >= min_score)
    return queries.select(query_id).join(kept, query_id, "left").withColumn(
        "abstiene", F.col("score").isNull())
