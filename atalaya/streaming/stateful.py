"""Counters with expiry and a news feed that live in the state and the tables of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from atalaya.session import file_system, path_exists
from atalaya.streaming.jobs import ranked, top_items

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which value states and timers need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


class FailureCounter(StatefulProcessor):
    """Failures of a key since its last success or expiry, with a timer that clears a dead counter."""

    def __init__(self, key: str, span: int) -> None:
        self.key, self.span = key, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("contador", "n int, desde long")

    def expiry(self, start: int) -> int:
        """The first whole millisecond at which a counter opened at `start` is over."""
        return -(-(start + self.span) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Three numbers a row: other columns never reach the processor.
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch.sort_values(["instante", "event_id"], kind="stable")
        count, start = self.counter.get() if self.counter.exists() else (0, 0)
        before = (count, start)
        out = np.zeros(len(batch), dtype="int32")
        for i, (at, fails) in enumerate(zip(batch["instante"].tolist(), batch["falla"].tolist(), strict=True)):
            if count and at >= start + self.span:
                count = 0
            if fails and count == 0:
                start = at
            count = count + 1 if fails else 0
            out[i] = count
        if (count, start) != before:
            if before[0] and (not count or start != before[1]):
                self.handle.deleteTimer(self.expiry(before[1]))
            if count:
                self.counter.update((count, start))
                if not before[0] or start != before[1]:
                    self.handle.registerTimer(self.expiry(start))
            else:
                self.counter.clear()
        yield pd.DataFrame({self.key: key[0], "event_id": batch["event_id"].to_numpy(), "fallos": out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counter.clear()
        return iter([])

    def close(self) -> None:
        pass


def failure_counter(events: DataFrame, key: str, failed: Column, limit: int, seconds: float,
                    late: str, strict: bool = False) -> DataFrame:
    """`count_failures` as a stream: per event the failures since the last success or expiry.

    The state of a key is two numbers. It goes with a success, and a timer clears it once the
    watermark, `late` behind the newest event, has passed its expiry; so it is bounded by the keys
    with a live counter. Batches count in the order in which they arrive, rows of one batch by time
    and id; rows older than the watermark are dropped, and `late_rows` says how many. Rows without
    a time or a key have no place in an order and are left out; a null outcome is no failure. Start
    the query inside `rocksdb_state`.
    """
    span = int(seconds * 1_000_000)
    rows = events.where(F.col("ts").isNotNull() & F.col(key).isNotNull()).withWatermark("ts", late).select(
        key, "event_id", "ts", F.unix_micros("ts").alias("instante"), F.coalesce(failed, F.lit(False)).alias("falla"))
    key_type, id_type = (events.schema[c].dataType.simpleString() for c in (key, "event_id"))
    counted = rows.groupBy(key).transformWithStateInPandas(
        FailureCounter(key, span), f"{key} {key_type}, event_id {id_type}, fallos int", "Append", "EventTime")
    fallos = F.col("fallos")
    return counted.withColumn("bloqueado", fallos > limit if strict else fallos >= limit)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query dropped because the watermark had passed them."""
    return sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)


def state_rows(query: StreamingQuery) -> int:
    """Rows of state that a query held after its last batch."""
    last = query.lastProgress
    return sum(o.numRowsTotal for o in last.stateOperators) if last else 0


def keep_feed(items: DataFrame, base: str, n: int = 12, late: str = "7 days") -> StreamingQuery:
    """Drain press items into a feed table of at most `n` rows a region; `feed` reads it.

    Repeated items go within the watermark. Each batch is cut to its own n newest per region and
    merged with the feed of the batch before, so no batch reads older items again: an item that is
    not among the n newest of its batch has n newer ones before it for good. A batch writes its own
    folder from that of its predecessor and reads no other, so a replay writes the same rows again.
    """
    once = items.withWatermark("ts", late).dropDuplicatesWithinWatermark(["region", "url", "ts", "titulo", "fuente"])

    def merge(batch: DataFrame, number: int) -> None:
        kept = top_items(batch, n)
        spark = batch.sparkSession
        if number and path_exists(spark, f"{base}/feed/{number - 1}"):
            kept = top_items(kept.unionByName(spark.read.schema(kept.schema).parquet(f"{base}/feed/{number - 1}")), n)
        kept.write.mode("overwrite").parquet(f"{base}/feed/{number}")

    query = (once.writeStream.outputMode("append").foreachBatch(merge)
             .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def feed(spark: SparkSession, base: str, items: DataFrame, n: int = 12) -> DataFrame:
    """The feed as the last finished batch of `keep_feed` left it, in order; empty before the first one.

    A batch is finished when the commit log of the stream names it, so a half-done batch is not seen.
    """
    done = finished(spark, base)
    if done is None:
        return ranked(spark.createDataFrame([], items.select("region", "url", "titulo", "fuente", "fecha", "ts").schema), n)
    return ranked(spark.read.parquet(f"{base}/feed/{done}"), n)


def finished(spark: SparkSession, base: str) -> int | None:
    """Number of the last batch in the commit log of a stream, None before the first one."""
    found, files = file_system(spark, f"{base}/state/commits")
    if not files.exists(found):
        return None
    names = [s.getPath().getName() for s in files.listStatus(found)]
    return max((int(x) for x in names if x.isdigit()), default=None)
