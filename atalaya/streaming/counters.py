"""Failure counters over a finite log, with every key cut into slices of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from atalaya.session import cut_lineage

# Spans of a counter in one slice: what one task holds of one key at a time.
SLICE_SPANS = 64


def count_failures(events: DataFrame, key: str, failed: Column, limit: int, seconds: float,
                   strict: bool = False, slice_spans: int = SLICE_SPANS) -> DataFrame:
    """Per event: failures counted since the last success or expiry, and whether that locks.

    The counter of a key starts at its first counted event, expires `seconds` later, and a success
    clears it. With every event counted as a failure this is a first-hit rate limit. Events of a key
    are ordered by time and id, whatever files or batches brought them; those without a time are
    left out, and a null outcome is no failure.

    A success, or a gap of `seconds`, clears the counter whatever came before, so a key falls into
    independent stretches. Rows before the first expiry of their stretch are counted by their place
    in it. Later ones follow a chain of counters, each opened by the first row after its predecessor
    expired. No task holds a whole key for either: places come from slices of time and one summary
    row per slice, and chains from the map of each slice from the counter that enters it to the one
    that leaves it, which is then handed from slice to slice.
    """
    span = int(seconds * 1_000_000)
    width = span * slice_spans
    known = events.where(F.col("ts").isNotNull())
    # A struct as key, since a key that is null is a key like any other.
    rows = known.select(F.struct(F.col(key).alias("k")).alias("who"), "event_id", F.unix_micros("ts").alias("t"),
                        F.coalesce(failed, F.lit(False)).alias("fail"))
    marked = cut_lineage(places(rows.withColumn("slice", F.floor(F.col("t") / width)), span))
    settled = F.col("t") < F.col("opened.t") + span
    early = marked.where(settled).select("who.k", "event_id", "fail", (F.col("pos") - F.col("opened.pos") + 1).alias("n"))
    late = marked.where(~settled).select("who", "event_id", "fail", "t", "pos", "slice", F.col("opened.pos").alias("stretch"),
                                         F.col("opened.t").alias("since"))
    out = early.unionByName(chained(late, span, width)).select(
        F.col("k").alias(key), "event_id", F.when(F.col("fail"), F.col("n")).otherwise(0).cast("int").alias("fallos"))
    return out.withColumn("bloqueado", F.col("fallos") > limit if strict else F.col("fallos") >= limit)


def places(rows: DataFrame, span: int) -> DataFrame:
    """Place of each row in the order of its key, and place and time of the row that opened its stretch."""
    inside = Window.partitionBy("who", "slice").orderBy("t", "event_id")
    numbered = rows.withColumns({
        "place": F.row_number().over(inside),
        "opens": ~F.lag("fail").over(inside) | (F.col("t") - F.lag("t").over(inside) >= span)})  # null at the first row
    opened_at = F.when(F.col("opens"), F.struct("place", "t"))
    summary = numbered.groupBy("who", "slice").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"),
        F.max_by("fail", "place").alias("last_fail"), F.max(opened_at).alias("last_open"))
    order = Window.partitionBy("who").orderBy("slice")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumns({
        "base": F.coalesce(F.sum("n").over(before), F.lit(0)),
        "opens": F.coalesce(~F.lag("last_fail").over(order) | (F.col("first_t") - F.lag("last_t").over(order) >= span), F.lit(True))})
    first = F.when(F.col("opens"), F.struct((F.col("base") + 1).alias("pos"), F.col("first_t").alias("t")))
    newest = F.coalesce(F.when(F.col("last_open").isNotNull(), F.struct(
        (F.col("base") + F.col("last_open.place")).alias("pos"), F.col("last_open.t").alias("t"))), first)
    entry = summary.withColumns({"first": first, "newest": newest}).select(
        "who", "slice", "base", F.coalesce("first", F.last("newest", True).over(before)).alias("entry"))
    marked = numbered.join(entry, ["who", "slice"]).withColumn("pos", F.col("base") + F.col("place"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.max(F.when(F.col("opens"), F.struct("pos", "t"))).over(upto)
    return marked.select("who", "event_id", "t", "fail", "slice", "pos", F.coalesce(opened, F.col("entry")).alias("opened"))


def followers(t: np.ndarray, span: int) -> np.ndarray:
    """For each time of a slice the first one at which its counter is over; the length where there is none."""
    return np.searchsorted(t, t + span, "left")


def chained(late: DataFrame, span: int, width: int) -> DataFrame:
    """Counts of rows beyond the first expiry of their stretch."""
    who = late.schema["who"].dataType.simpleString()

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        t, first = np.unique(pdf["t"].to_numpy(), return_index=True)
        pos = pdf["pos"].to_numpy()[first]
        after = followers(t, span)
        last = np.where(after == len(t), np.arange(len(t)), np.minimum(after, len(t) - 1))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        # A counter that enters opened before the slice, so it is over by the first time a span after the slice begins.
        doors = min(len(t), int(np.searchsorted(t, (int(pdf["slice"].iloc[0]) * width) + span, "left")) + 1)
        last = last[:doors]
        ends = np.append(last[1:] != last[:-1], True)  # neighbours that leave alike are one step
        return pd.DataFrame({"who": [pdf["who"].iloc[0]], "stretch": [pdf["stretch"].iloc[0]], "slice": [pdf["slice"].iloc[0]],
                             "since": [pdf["since"].iloc[0]], "upto": [t[:doors][ends]], "left_t": [t[last[ends]]], "left_pos": [pos[last[ends]]]})

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("slice")
        since, place = int(pdf["since"].iloc[0]), int(pdf["stretch"].iloc[0])
        entries = []
        for upto, left_t, left_pos in zip(pdf["upto"], pdf["left_t"], pdf["left_pos"], strict=True):
            entries.append((since, place))
            step = int(np.searchsorted(upto, since + span, "left"))
            if step < len(upto):
                since, place = int(left_t[step]), int(left_pos[step])
        return pd.DataFrame({"who": pdf["who"], "stretch": pdf["stretch"], "slice": pdf["slice"],
                             "entry_t": [e[0] for e in entries], "entry_pos": [e[1] for e in entries]})

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        since = place = 0
        for pdf in frames:
            out = []
            columns = (pdf[c].tolist() for c in ("opening", "t", "pos", "entry_t", "entry_pos"))
            for opening, t, pos, entry_t, entry_pos in zip(*columns, strict=True):
                if opening:
                    since, place = entry_t, entry_pos
                if t >= since + span:
                    since, place = t, pos
                out.append(pos - place + 1)
            yield pd.DataFrame({"k": pdf["k"], "event_id": pdf["event_id"], "fail": pdf["fail"], "n": out})

    group = ["who", "stretch", "slice"]
    # Only a stretch of several slices has counters that pass from one to the next.
    wide = late.groupBy("who", "stretch").agg(F.min("slice").alias("a"), F.max("slice").alias("b")).where("a < b").select("who", "stretch")
    steps = late.select(*group, "t", "pos", "since").join(wide, ["who", "stretch"], "left_semi").groupBy(*group).applyInPandas(
        leave, f"who {who}, stretch bigint, slice bigint, since bigint, upto array<bigint>, left_t array<bigint>, left_pos array<bigint>")
    entries = steps.groupBy("who", "stretch").applyInPandas(
        carry, f"who {who}, stretch bigint, slice bigint, entry_t bigint, entry_pos bigint")
    entered = late.join(entries, group, "left").withColumns({
        "entry_t": F.coalesce("entry_t", "since"), "entry_pos": F.coalesce("entry_pos", "stretch"),
        "opening": F.row_number().over(Window.partitionBy(*group).orderBy("pos")) == 1})
    # Slices lie in a task one after the other, each in order, and a fold holds two numbers at a time.
    rows = entered.sortWithinPartitions(*group, "pos").select("who.k", "event_id", "fail", "opening", "t", "pos", "entry_t", "entry_pos")
    key_type, id_type = (rows.schema[c].dataType.simpleString() for c in ("k", "event_id"))
    return rows.mapInPandas(count, f"k {key_type}, event_id {id_type}, fail boolean, n bigint")
