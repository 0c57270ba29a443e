"""What the operators of this folder share: reading, storing intermediate tables, held-out folds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from atalaya.session import file_system, prepare, release, scratch_path  # noqa: F401

_TEMPORARY: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on Python tasks of the session take at most so many rows at once, so that batches of whole texts stay at a few MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside the block are deleted at its end, but those stored with `keep`."""
    _TEMPORARY.append([])
    try:
        yield
    finally:
        for path in _TEMPORARY.pop():
            found, files = file_system(spark, path)
            files.delete(found, True)


def stored(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back.

    Later steps then read the files, so losing an executor replays none of the work before them.
    `release` deletes them when all results have been consumed; see `temporary` too.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{tag}")
    if _TEMPORARY and not keep:
        _TEMPORARY[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty. Texts of plain ASCII take the fast path."""
    text = F.coalesce(text, F.lit(""))
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(folded)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null ids fall in no fold (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def drawn(rows: DataFrame, id_col: str, at_most: int) -> DataFrame:
    """About `at_most` rows drawn by a hash of the id, and never more than twice as many."""
    share = min(1.0, at_most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1_000_003)) < share * 1_000_003).limit(2 * at_most)


def meet(left: DataFrame, right: DataFrame, on: list[str], n: str, least: int = 10_000) -> DataFrame:
    """`left` with its row of `right` (one per key; column `n`: rows of `left` that have the key), inner.

    Keys of more than a thousandth of the rows are at most a thousand: they are broadcast and their
    rows stay where they are. The other keys shuffle. Both tables should be stored.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(least, total // 1000)
    many = right.where(hot)
    if not many.limit(1).count():
        return left.join(right, on)
    few = left.join(F.broadcast(many.select(*on)), on, "left_anti").join(right.where(~hot), on)
    return few.unionByName(left.join(F.broadcast(many), on))


def packed(rows: DataFrame) -> DataFrame:
    """`rows` with its column `raw` compressed, for exchanges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            at = batch.schema.names.index("raw")
            small = pa.array([press.compress(raw.as_py()) for raw in batch.column(at)], pa.binary())
            yield batch.set_column(at, "raw", small)

    return rows.mapInArrow(run, rows.schema)


def unpack(value: pa.BinaryScalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_py())
