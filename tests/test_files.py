"""Digests of files by stream, block and tree, and loads that swap whole versions."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from atalaya.sources import files as D, sinks as S


def test_whole_blocks_and_tree(spark, tmp_path, tmp_path_factory):
    data = {"a.bin": os.urandom(10_000), "b.bin": b"1", "c d.bin": os.urandom(1000), "e.bin": os.urandom(700_001)}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    files = D.listed(spark, str(tmp_path))
    name = F.url_decode(F.regexp_extract("path", "[^/]+$", 0))
    whole = {r.n: (r.bytes, r.sha256) for r in D.whole_digests(files, 512).select(name.alias("n"), "bytes", "sha256").collect()}
    assert whole == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in data.items()}
    kept = str(tmp_path_factory.mktemp("digests") / "blocks")
    D.block_digests(files, 1000).withColumn("n", name).drop("path").write.parquet(kept)
    blocks = spark.read.parquet(kept)
    want = {(n, i): hashlib.sha256(c[i * 1000:(i + 1) * 1000]).hexdigest() for n, c in data.items() for i in range(-(-len(c) // 1000))}
    assert {(r.n, r.bloque): r.sha256 for r in blocks.collect()} == want

    def root(n):
        level = [d for (m, _), d in sorted(want.items()) if m == n]
        for _ in range(4):  # 10 ** 4 blocks by tens
            level = [hashlib.sha256("".join(level[i:i + 10]).encode()).hexdigest() for i in range(0, len(level), 10)]
        return level[0]

    assert {r.n: r.raiz for r in D.digest_tree(blocks, "n", 10_000, 10).collect()} == {n: root(n) for n in data}
    # One byte of block 123 changes, one file goes.
    broken = bytearray(data["e.bin"])
    broken[123_456] ^= 1
    (tmp_path / "e.bin").write_bytes(broken)
    (tmp_path / "b.bin").unlink()
    now = D.block_digests(D.listed(spark, str(tmp_path)), 1000).withColumn("n", name).drop("path")
    found = {r.n: (r.bloques, r.distintos, r.primero) for r in D.verify_blocks(now, blocks, "n").collect()}
    assert found == {"a.bin": (10, 0, None), "b.bin": (1, 1, 0), "c d.bin": (1, 0, None), "e.bin": (701, 1, 123)}


def test_running_digests(spark):
    rows = [(i, "sñt"[i % 3] if i % 5 else None, None if i % 7 == 0 else "é" * (i % 4)) for i in range(300)]
    got = {r.fichero: (r.bytes, r.sha256) for r in D.line_digests(spark.createDataFrame(rows, "i long, k string, t string"), "k", "i", "t").collect()}
    want = {}
    for _, k, t in rows:
        if k is not None and t is not None:
            want[k] = want.get(k, b"") + t.encode() + b"\n"
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()}


def test_load_stands_whole_or_not_at_all(spark, tmp_path):
    base, table = str(tmp_path / "t"), "carga_prueba"
    ids = lambda: sorted(r.id for r in spark.table(table).collect())
    frame = lambda n: spark.range(n).withColumn("x", F.lit("a")).withColumn("extra", F.lit(1))
    try:
        S.load_table(frame(5), table, ["id", "x"], base)
        assert ids() == list(range(5)) and spark.table(table).columns == ["id", "x"]
        before = spark.table(table)
        breaks = spark.range(0, 100, 1, 8).withColumn("x", F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.lit("b")))
        with pytest.raises(Exception, match="lost"):
            S.load_table(breaks, table, ["id", "x"], base)
        assert ids() == list(range(5))
        S.load_table(frame(9).withColumn("id", F.col("id").cast("int")), table, ["x", "id"], base)
        assert ids() == list(range(9)) and dict(spark.table(table).dtypes) == {"id": "bigint", "x": "string"}
        assert before.count() == 5  # a reader that began before the swap ends with the rows it began with
        S.load_table(frame(0), table, ["id", "x"], base)
        assert ids() == [] and len(list((tmp_path / "t").iterdir())) == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
