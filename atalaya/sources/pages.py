"""Group counts of a source that hands out pages by key: a Python data source whose offset is the last key read."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import LongType, StructType

from atalaya.session import file_system, path_exists
from atalaya.sources.files import arrow_files

MARK = "lote bigint, hasta bigint, filas bigint"
RETRIES = 5
COLLAPSE_ROWS = 200_000


class PageClient:
    """A source with a whole-number key: a subclass says how to ask it. Only group columns are asked for."""

    def bounds(self) -> tuple[int, int] | None:
        """The smallest and the largest key now, or None while the source is empty."""
        raise NotImplementedError

    def page(self, after: int, upto: int, limit: int) -> pa.Table:
        """At most `limit` rows with after < key <= upto, in the order of the key."""
        raise NotImplementedError

    def cuts(self, after: int, rows: int, count: int) -> list[int]:
        """Ends of up to `count` stretches behind `after` of about `rows` rows; here the keys are taken for dense."""
        top = self.bounds()[1]
        return sorted({min(top, after + rows * (i + 1)) for i in range(count)} - {after})

    def places(self, low: int, high: int) -> tuple[str, ...]:
        """Where the driver knows the rows of a range to be, for the task that reads them."""
        return ()

    def pages(self, low: int, high: int, places: tuple[str, ...], limit: int) -> Iterator[pa.Table]:
        """Pages of a range, each asked for behind the last key of the one before and again if it fails."""
        after = low
        while True:
            rows = self._retried(after, high, limit)
            if rows.num_rows:
                yield rows
                after = pc.max(rows[self.key]).as_py()
            if rows.num_rows < limit:
                return

    def _retried(self, after: int, high: int, limit: int) -> pa.Table:
        for attempt in range(RETRIES):
            try:
                return self.page(after, high, limit)
            except (OSError, ValueError):
                if attempt == RETRIES - 1:
                    raise
                time.sleep(self.pause * 2 ** attempt)

    key: str
    pause: float = 1.0


class FolderClient(PageClient):
    """Parquet files of a shared folder. Their footers give the driver the keys of each file; tasks open only theirs.

    Rows with a null key are on no page: the reconciliation with the row count of the source shows them.
    """

    def __init__(self, path: str, key: str, cols: list[str]):
        self.path, self.key, self.cols, self.groups = path, key, list(cols), {}

    def bounds(self):
        files, inner = arrow_files(self.path)
        for part in ds.dataset(inner, filesystem=files, format="parquet").get_fragments():
            if part.path not in self.groups:
                stats = [(g.statistics[self.key], g.num_rows) for g in part.row_groups if self.key in (g.statistics or {})]
                self.groups[part.path] = [(s["min"], s["max"], n) for s, n in stats]
        every = [g for groups in self.groups.values() for g in groups]
        return (min(g[0] for g in every), max(g[1] for g in every)) if every else None

    def cuts(self, after, rows, count):
        # Rows are spread evenly over the keys of their row group, so a stretch misses `rows` by row groups at most.
        left = [g for groups in self.groups.values() for g in groups if g[1] > after]
        if not left:
            return []
        low, high = (np.array([f(g) for g in left], dtype=np.int64) for f in (lambda g: max(g[0] - 1, after), lambda g: g[1]))
        edges = np.unique(np.concatenate([low, high]))
        first, last = np.searchsorted(edges, low), np.searchsorted(edges, high)
        density, cover = np.zeros(len(edges)), np.zeros(len(edges), dtype=np.int64)
        each = np.array([n / (g_high - g_low + 1) for g_low, g_high, n in left])
        for to, sign in ((first, 1), (last, -1)):
            np.add.at(density, to, sign * each)
            np.add.at(cover, to, sign)
        density = np.where(np.cumsum(cover) > 0, np.maximum(np.cumsum(density), 0.0), 0.0)[:-1]
        total = np.concatenate([[0.0], np.cumsum(density * np.diff(edges))])
        found = set()
        for target in (rows * (i + 1) for i in range(count)):
            i = int(np.searchsorted(total, target)) - 1
            if i >= len(density):
                found.add(int(edges[-1]))
                break
            step = int((target - total[i]) / density[i]) if density[i] > 0 else 0
            found.add(min(int(edges[i + 1]), int(edges[i]) + max(step, 1)))
        return sorted(found)

    def places(self, low, high):
        return tuple(sorted(f for f, groups in self.groups.items() if any(a <= high and b > low for a, b, _ in groups)))

    def pages(self, low, high, places, limit):
        if places:
            key = ds.field(self.key)
            data = ds.dataset(list(places), filesystem=arrow_files(self.path)[0], format="parquet")
            for batch in data.to_batches(columns=self.cols, filter=(key > low) & (key <= high), batch_size=limit, batch_readahead=1, fragment_readahead=1):
                yield pa.Table.from_batches([batch])


@dataclass
class KeyRange(InputPartition):
    """Keys above `low`, up to `high`: the work of one task."""

    low: int
    high: int
    places: tuple[str, ...]


def counted(pages: Iterator[pa.Table], cols: list[str], bound: int = COLLAPSE_ROWS) -> Iterator[pa.Table]:
    """Counts per group of a run of pages; more than `bound` groups are given out in parts, which merge later."""
    kept, rows = [], 0
    for page in pages:
        if not page.num_rows:
            continue
        part = page.group_by(cols).aggregate([([], "count_all")])
        kept.append(part)
        rows += part.num_rows
        if rows > bound:
            whole = _collapsed(kept, cols)
            kept, rows = [whole], whole.num_rows
            if rows > bound:
                yield whole
                kept, rows = [], 0
    if kept:
        yield _collapsed(kept, cols)


def _collapsed(parts: list[pa.Table], cols: list[str]) -> pa.Table:
    whole = pa.concat_tables(parts).group_by(cols).aggregate([("count_all", "sum")])
    return whole.select([*cols, "count_all_sum"]).rename_columns([*cols, "count_all"])


class PageReader(DataSourceStreamReader):
    """Offset: the last key read. A batch is `ranges` stretches of about `rows` rows, one task each."""

    def __init__(self, client: PageClient, schema: StructType, after: int | None, rows: int, ranges: int, limit: int):
        self.client, self.at, self.rows, self.ranges, self.limit = client, after, rows, ranges, limit
        self.names, self.cols = schema.names, [c for c in schema.names if c not in ("_n", "_hasta")]
        self.types = [f.dataType for f in schema.fields]

    def initialOffset(self) -> dict:
        found = self.client.bounds()
        return {"hasta": found[0] - 1 if found else None}

    def latestOffset(self) -> dict:
        found = self.client.bounds()
        if found is None:
            return {"hasta": self.at}
        start = found[0] - 1 if self.at is None else self.at
        return {"hasta": (self.client.cuts(start, self.rows, self.ranges) or [start])[-1] if start < found[1] else start}

    def partitions(self, start: dict, end: dict) -> list[KeyRange]:
        # A planned batch that is run again after a restart comes here first, so reading goes on behind it.
        low, high = start["hasta"], end["hasta"]
        self.at = high
        if high is None:
            return []
        known = self.client.bounds()
        low = known[0] - 1 if low is None else low
        cuts = [low, *[c for c in self.client.cuts(low, self.rows, self.ranges) if c < high], high]
        return [KeyRange(a, b, self.client.places(a, b)) for a, b in zip(cuts, cuts[1:])]

    def read(self, part: KeyRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        schema = pa.schema([(n, to_arrow_type(t)) for n, t in zip(self.names, self.types)])
        for counts in counted(self.client.pages(part.low, part.high, part.places, self.limit), self.cols):
            columns = [*[counts[c] for c in self.cols], counts["count_all"], pa.nulls(counts.num_rows, pa.int64())]
            yield from pa.table(columns, names=self.names).cast(schema).to_batches()
        # The last row of a range tells how far it went.
        yield pa.RecordBatch.from_pylist([{"_n": 0, "_hasta": part.high}], schema=schema)

    def commit(self, end: dict) -> None:
        pass


def paged_source(client: PageClient, schema: StructType) -> type[DataSource]:
    """A data source over a client; `schema` types the group columns."""
    full = StructType([*schema.fields]).add("_n", LongType()).add("_hasta", LongType())

    class Paged(DataSource):
        @classmethod
        def name(cls) -> str:
            return "atalaya_pages"

        def schema(self) -> StructType:
            return full

        def streamReader(self, schema: StructType) -> PageReader:
            after = self.options.get("after")
            return PageReader(client, full, int(after) if after else None, *(int(self.options[k]) for k in ("rows", "ranges", "limit")))

    return Paged


def marks(spark: SparkSession, base: str) -> DataFrame:
    """One row per finished batch: the last key read and the source rows counted so far."""
    if not path_exists(spark, f"{base}/marks"):
        return spark.createDataFrame([], MARK)
    return spark.read.schema(MARK).parquet(f"{base}/marks/*")


def _drop(spark: SparkSession, path: str) -> None:
    found, files = file_system(spark, path)
    files.delete(found, True)


def _standing(spark: SparkSession, base: str, schema: StructType, upto: int, every: int) -> DataFrame:
    """Counts of batches 0 to `upto`: the last collapsed table and the parts behind it."""
    whole = (upto + 1) // every * every - 1
    paths = ([f"{base}/whole/{whole}"] if whole >= 0 else []) + [f"{base}/parts/{b}" for b in range(whole + 1, upto + 1)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _summed(parts: DataFrame, cols: list[str], count_as: str) -> DataFrame:
    # A range without rows of its own still leaves its last row, which counts nothing.
    return parts.where(F.col(count_as) > 0).groupBy(*cols).agg(F.sum(count_as).alias(count_as))


def count_pages(spark: SparkSession, client: PageClient, schema: StructType, base: str, count_as: str = "n", rows: int = 1_000_000,
                ranges: int = 64, limit: int = 50_000, every: int = 16) -> DataFrame:
    """Counts per group of all rows that a paged source has now; the same `base` goes on behind the last batch.

    Tasks count their own pages, so only counts per group leave them, whatever the source holds. A
    batch writes its counts under its number and then its mark; every `every`-th folds the parts
    before it into one table, and what that table replaced goes with the next fold. A batch run again
    reads what stood before it and writes the same again. Rows that get a key below the last one read
    are not seen, null groups are groups, and an empty source gives no rows. `every` stays as it was
    for a given `base`.
    """
    cols = schema.names
    stored = StructType([*schema.fields]).add(count_as, LongType())

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        part = f"{base}/parts/{number}"
        batch.groupBy(*cols).agg(F.sum("_n").alias(count_as), F.max("_hasta").alias("_hasta")).write.mode("overwrite").parquet(part)
        # Tasks may have been run again, so rows are counted from what was written.
        taken = session.read.parquet(part).agg(F.sum(count_as).alias("filas"), F.max("_hasta").alias("hasta")).first()
        before = session.read.schema(MARK).parquet(f"{base}/marks/{number - 1}").first() if number else None
        if (number + 1) % every == 0:
            both = _standing(session, base, stored, number - 1, every).unionByName(session.read.schema(stored).parquet(part))
            _summed(both, cols, count_as).write.mode("overwrite").parquet(f"{base}/whole/{number}")
            if number >= every:
                for old in range(number - 2 * every + 1, number - every + 1):
                    _drop(session, f"{base}/parts/{old}")
                _drop(session, f"{base}/whole/{number - 2 * every}")
        total = (taken["filas"] or 0) + (before["filas"] if before else 0)
        session.createDataFrame([(number, taken["hasta"], total)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{base}/marks/{number}")

    last = marks(spark, base).orderBy(F.desc("lote")).first()
    spark.dataSource.register(paged_source(client, schema))
    reader = spark.readStream.format("atalaya_pages").option("rows", rows).option("ranges", ranges).option("limit", limit)
    if last:
        reader = reader.option("after", last["hasta"])
    query = reader.load().writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    done = marks(spark, base).agg(F.max("lote")).first()[0]
    return _summed(_standing(spark, base, stored, -1 if done is None else done, every), cols, count_as)
