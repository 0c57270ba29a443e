"""Paged counting: whole results, a source that fails between pages, replays, folds and sparse keys."""

import os
import shutil
import sys
from collections import Counter

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql.types import StructType

from atalaya.sources import pages as P

ROWS = [(k, "abc"[k % 3] if k % 7 else None, k % 5) for k in range(10, 400)] + [(10**12 + k, "z", None) for k in range(30)]
GROUPS = StructType().add("g", "string").add("h", "long")
WANT = Counter((g, h) for _, g, h in ROWS)


def folder(spark, path, rows=ROWS):
    spark.createDataFrame(rows, "id bigint, g string, h bigint").repartitionByRange(4, "id").write.mode("append").parquet(path)
    return P.FolderClient(path, "id", ["g", "h"])


def got(df):
    return {(r.g, r.h): r.n for r in df.collect()}


class Flaky(P.PageClient):
    """Serves single pages; fails for good behind a key while its flag file exists, and once on every page otherwise."""

    def __init__(self, flag, log):
        self.flag, self.log, self.key, self.pause, self.failed = flag, log, "id", 0.0, set()

    def bounds(self):
        return ROWS[0][0], 399

    def page(self, after, upto, limit):
        if after >= 200 and os.path.exists(self.flag):
            raise OSError("source is gone")
        if after not in self.failed:
            self.failed.add(after)
            raise ValueError("not JSON")
        with open(self.log, "a") as out:
            out.write(f"{after}\n")
        rows = [r for r in ROWS if after < r[0] <= upto][:limit]
        return pa.Table.from_pylist([{"id": k, "g": g, "h": h} for k, g, h in rows],
                                    schema=pa.schema([("id", pa.int64()), ("g", pa.string()), ("h", pa.int64())]))


@pytest.mark.parametrize("every", [2, 100])
def test_whole_counts_by_small_batches(spark, tmp_path, every):
    client, base = folder(spark, str(tmp_path / "in")), str(tmp_path / "job")
    count = lambda: P.count_pages(spark, client, GROUPS, base, rows=60, ranges=2, limit=7, every=every)
    assert got(count()) == WANT
    batches = P.marks(spark, base).orderBy("lote").collect()
    assert batches[-1].filas == len(ROWS) and batches[-1].hasta == ROWS[-1][0]
    assert 3 < len(batches) < 7  # the gap of 10**12 keys costs no batches
    n = len(batches)
    # Nothing new: no batch. New rows: they alone are read.
    assert got(count()) == WANT and P.marks(spark, base).count() == n
    folder(spark, str(tmp_path / "in"), [(10**12 + 100, "z", None)])
    assert got(count()) == WANT + Counter({("z", None): 1})
    # The driver is lost before the commit of the last batch: it is run again and changes nothing.
    for name in (f"{n}", f".{n}.crc"):
        (tmp_path / "job" / "state" / "commits" / name).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "job" / "marks" / f"{n}")
    assert got(count()) == WANT + Counter({("z", None): 1})
    assert P.marks(spark, base).agg({"filas": "max"}).first()[0] == len(ROWS) + 1


def test_source_that_fails_between_pages(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    flag, log, base = tmp_path / "down", tmp_path / "log", str(tmp_path / "job")
    flag.touch()
    client = Flaky(str(flag), str(log))
    count = lambda: P.count_pages(spark, client, GROUPS, base, rows=50, ranges=2, limit=20)
    with pytest.raises(StreamingQueryException):
        count()
    before = log.read_text().split()
    assert P.marks(spark, base).agg({"hasta": "max"}).first()[0] == 209
    flag.unlink()
    assert got(count()) == Counter((g, h) for k, g, h in ROWS if k < 400)
    again = log.read_text().split()[len(before):]
    finished = P.marks(spark, base).orderBy("lote").collect()
    assert finished[-1].filas == 390
    # Pages of finished batches were not asked for again.
    assert min(map(int, again)) >= 209


def test_empty_source_and_bounded_counts(spark, tmp_path):
    client, base = folder(spark, str(tmp_path / "in"), []), str(tmp_path / "job")
    assert got(P.count_pages(spark, client, GROUPS, base)) == {}
    parts = [pa.table({"g": [str(i % 50) for i in range(j, j + 40)]}) for j in range(0, 400, 40)]
    out = list(P.counted(iter(parts), ["g"], 20))
    assert max(t.num_rows for t in out) <= 60
    total = Counter()
    for t in out:
        total.update(dict(zip(t["g"].to_pylist(), t["count_all"].to_pylist())))
    assert total == Counter(str(i % 50) for i in range(400))
