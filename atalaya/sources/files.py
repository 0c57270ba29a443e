"""Digests of raw files of any size: whole files as streams, blocks read by many tasks, and a tree over the blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK = 8 << 20
FAN = 1024


def arrow_files(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path and the path inside it, for reads in tasks."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return pafs.LocalFileSystem(), url.path
    return pafs.FileSystem.from_uri(path)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Path and length of the files; their content is not read. Spark lists no empty files, so a published empty file counts as missing."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def whole_digests(files: DataFrame, piece: int = BLOCK) -> DataFrame:
    """SHA-256 of each whole file. A file is one task's stream, of which it holds one piece at a time."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                store, inner = arrow_files(path)
                total, size = hashlib.sha256(), 0
                with store.open_input_stream(inner) as data:
                    while part := data.read(piece):
                        total.update(part)
                        size += len(part)
                yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "sha256": [total.hexdigest()]})

    return files.select("path").repartition("path").mapInArrow(digests, "path string, bytes bigint, sha256 string")


def block_digests(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """SHA-256 of each block of `block` bytes: blocks of one huge file go to many tasks."""
    last = (F.ceil(F.col("bytes") / block) - 1).cast("bigint")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("bloque"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, number in zip(batch["path"].to_pylist(), batch["bloque"].to_pylist()):
                store, inner = arrow_files(path)
                with store.open_input_file(inner) as data:
                    data.seek(number * block)
                    part = data.read(block)
                yield pa.RecordBatch.from_pydict({"path": [path], "bloque": [number], "bytes": [len(part)],
                                                  "sha256": [hashlib.sha256(part).hexdigest()]})

    return blocks.repartition("path", "bloque").mapInArrow(digests, "path string, bloque bigint, bytes bigint, sha256 string")


def digest_tree(blocks: DataFrame, name: str = "path", most_blocks: int = FAN ** 3, fan: int = FAN) -> DataFrame:
    """One digest per file over its block digests in order: each node is the SHA-256 of up to `fan` joined digests below it.

    Files of up to `most_blocks` blocks get the same depth, so equal files have equal roots. No group holds more than `fan` digests.
    """
    nodes, left = blocks.select(name, F.col("bloque").alias("_i"), "sha256"), most_blocks
    while left > 1:
        ordered = F.array_sort(F.collect_list(F.struct("_i", "sha256")))
        nodes = nodes.groupBy(name, F.floor(F.col("_i") / fan).alias("_i")).agg(
            F.sha2(F.array_join(F.transform(ordered, lambda r: r["sha256"]), ""), 256).alias("sha256"))
        left = -(-left // fan)
    return nodes.select(name, F.col("sha256").alias("raiz"))


def verify_whole(files: DataFrame, expected: DataFrame, name: Column) -> DataFrame:
    """SHA-256 and size of files of any size next to the published values (fichero, sha256, bytes)."""
    found = whole_digests(files).withColumn("fichero", name).drop("path")
    other = expected.select("fichero", F.col("sha256").alias("sha256_publicado"), F.col("bytes").alias("bytes_publicados"))
    return found.join(other, "fichero", "full_outer").withColumn("coincide", F.coalesce(
        (F.col("sha256") == F.col("sha256_publicado")) & (F.col("bytes") == F.col("bytes_publicados")), F.lit(False)))


def verify_blocks(found: DataFrame, expected: DataFrame, name: str = "path") -> DataFrame:
    """Per file the number of blocks and of those that differ, and the first that does; a file missing on one side differs whole."""
    both = found.select(name, "bloque", F.col("sha256").alias("_a")).join(
        expected.select(name, "bloque", F.col("sha256").alias("_b")), [name, "bloque"], "full_outer")
    differs = ~F.col("_a").eqNullSafe(F.col("_b"))
    return both.groupBy(name).agg(F.count(F.lit(1)).alias("bloques"), F.count_if(differs).alias("distintos"),
                                  F.min(F.when(differs, F.col("bloque"))).alias("primero"))


def line_digests(rows: DataFrame, name: str, order: str, text: str) -> DataFrame:
    """Size and SHA-256 of each name's texts in order, a line feed after each, without holding them together.

    Rows come sorted to the task of their name, which keeps a running digest: a hot name takes time, not memory.
    """
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, size = None, hashlib.sha256(), 0
        out = lambda: pa.RecordBatch.from_pydict({"fichero": [at], "bytes": [size], "sha256": [total.hexdigest()]})
        for batch in batches:
            for key, line in zip(batch[name], batch[text]):
                key = key.as_py()
                if key != at:
                    if at is not None:
                        yield out()
                    at, total, size = key, hashlib.sha256(), 0
                data = line.as_py().encode() + b"\n"
                total.update(data)
                size += len(data)
        if at is not None:
            yield out()

    sorted_rows = rows.where(F.col(name).isNotNull() & F.col(text).isNotNull()).select(name, order, text).repartition(name).sortWithinPartitions(name, order)
    return sorted_rows.mapInArrow(digests, "fichero string, bytes bigint, sha256 string")
