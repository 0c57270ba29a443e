"""Repeated passages by a depth-limited radix sort of suffixes.

A passage is repeated if its `least` bytes start anywhere else, in the same text or another. Suffixes
are ordered through `least` bytes only, by passes over digits with the most significant first, and a
suffix leaves as soon as its group is its own; groups that stay equal through `least` bytes are the
repeated passages.

A first digit has to deal suffixes into groups that can be sorted apart, and must not ship a suffix for
each byte. It is the smallest hash of the grams (a third of `least` bytes) that lie within the window of
`least` bytes from the suffix on: equal windows have the same smallest gram at the same place. Suffixes
with the same gram at the same place of the text make one stretch, and only stretches move:

1. every stretch gives (gram, hash of the stretch). Grams that occur once are done. Of the other grams,
   stretches that occur twice or more repeat as a whole; what is left are stretches of one place whose
   gram also occurs in other ones;
2. those grams ship their distinct stretches, about a twentieth of all. In each group the bytes right
   of the gram and those left of it are sorted by digits of eight bytes, which orders the windows at
   every offset at once: two windows are equal if neither order parts them within their depth;
3. a gram with more than `limit` distinct stretches is ordered by Spark: its windows are grouped by 128
   bits of their hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from atalaya.llm.common import meet, packed, stored, unpack

LEAST = 200
PIECE = 1 << 20  # suffixes looked at together
SEED = 42
LETTERS = np.random.default_rng(SEED).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TURNS = np.random.default_rng(SEED + 1).integers(1 << 63, size=32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64((1 << 22) - 1)  # a place within a piece
ROWS = 4096  # stretches in one batch


def gram_of(least: int) -> int:
    return max(1, least // 3)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of `gram` bytes, by doubling."""
    double, width, done, done_width = LETTERS[raw], 1, None, 0
    for step in range(gram.bit_length()):
        if gram >> step & 1:
            if done is None:
                done, done_width = double, width
            else:
                n = len(raw) - done_width - width + 1
                done = done[:n] * TURNS[16 + step] + double[done_width:done_width + n]
                done_width += width
        n = len(double) - width
        if gram >> (step + 1) and n > 0:
            double = double[:n] * TURNS[step] + double[width:width + n]
            double ^= double >> np.uint64(29)
            width *= 2
    return done ^ (done >> np.uint64(31))


def stretches(raw: bytes, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(`grams`, `at`, `start`, `stop`) by piece: the windows from start to stop - 1 have their smallest gram at `at`.

    Of grams that compare equal the leftmost counts. Every window is in one stretch.
    """
    gram = gram_of(least)
    wide = least - gram + 1
    whole = np.frombuffer(raw, np.uint8)
    for begin in range(0, len(raw) - least + 1, PIECE):
        hashes = gram_hashes(whole[begin:begin + PIECE + least - 1], gram)
        low, width = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
        while 2 * width <= wide:
            low = np.minimum(low[:len(low) - width], low[width:])
            width *= 2
        n = len(hashes) - wide + 1
        low = np.minimum(low[:n], low[wide - width:wide - width + n])
        at = (low & PLACE).astype(np.int64)
        start = np.flatnonzero(np.diff(at, prepend=-1))
        stop = np.append(start[1:], n)
        at = at[start]
        yield hashes[at].view(np.int64), at + begin, start + begin, stop + begin


def batches_of(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema.names)


def digest(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw, SEED) - (1 << 63)


def anchors(texts: DataFrame, least: int) -> DataFrame:
    """(`gram`, `cid`, `h1`, `h2`) for every stretch of the texts (`h1`, `h2`, `raw`); `cid` is a hash of the stretch."""
    names = ["gram", "cid", "h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            for h1, h2, raw in zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), batch.column("raw")):
                raw = raw.as_py()
                for grams, _, start, stop in stretches(raw, least):
                    n = len(grams)
                    cids = np.fromiter((digest(raw[s:e + least - 1]) for s, e in zip(start.tolist(), stop.tolist())), np.int64, n)
                    held.append((grams, cids, np.full(n, h1), np.full(n, h2)))
                    count += n
                    if count >= 4 * ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
                        held, count = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)

    return texts.where(F.octet_length("raw") >= least).mapInArrow(run, "gram long, cid long, h1 long, h2 long")


PARTS = "gram long, cid long, hi int, bytes binary, n long, h1 long, h2 long"


def shipped(texts: DataFrame, least: int) -> DataFrame:
    """`PARTS` for the stretches that `wanted` (`gram`, `cid`, `n`) names, of (packed `raw`, `wanted`, `h1`, `h2`).

    `hi` is the place of the gram in the stretch.
    """
    schema = pa.schema([("gram", pa.int64()), ("cid", pa.int64()), ("hi", pa.int32()), ("bytes", pa.binary()), ("n", pa.int64()),
                        ("h1", pa.int64()), ("h2", pa.int64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for packed_raw, wanted, h1, h2 in zip(*(batch.column(c) for c in ("raw", "wanted", "h1", "h2"))):
                raw, h1, h2 = unpack(packed_raw), h1.as_py(), h2.as_py()
                times = {(x["gram"], x["cid"]): x["n"] for x in wanted.as_py()}
                own = np.array([gram for gram, _ in times])
                for grams, at, start, stop in stretches(raw, least):
                    some = np.isin(grams, own)
                    for gram, a, s, e in zip(*(x[some].tolist() for x in (grams, at, start, stop))):
                        part = raw[s:e + least - 1]
                        cid = digest(part)
                        if (gram, cid) in times:
                            yield gram, cid, a - s, part, times[gram, cid], h1, h2

    return texts.select("raw", "wanted", "h1", "h2").mapInArrow(lambda batches: batches_of(found(batches), schema), PARTS)


def radix_order(groups: np.ndarray, digits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `digits` (uint64) within their groups, and the bytes each shares with the row before it (-1: another group).

    One pass a digit, the most significant first; rows whose group is their own leave.
    """
    order = np.argsort(groups, kind="stable")
    sorted_groups = groups[order]
    first = np.flatnonzero(np.diff(sorted_groups, prepend=sorted_groups[0] - 1))
    rank = np.empty(len(groups), np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(groups))))
    active = np.arange(len(groups))
    for k in range(digits.shape[1]):
        sizes = np.bincount(rank[active], minlength=len(groups))
        active = active[sizes[rank[active]] > 1]
        if not len(active):
            break
        active = active[np.lexsort((digits[active, k], rank[active]))]
        own, digit, index = rank[active], digits[active, k], np.arange(len(active))
        new = np.diff(own, prepend=-1) != 0
        parted = new.copy()
        parted[1:] |= digit[1:] != digit[:-1]
        rank[active] = own + np.maximum.accumulate(np.where(parted, index, 0)) - np.maximum.accumulate(np.where(new, index, 0))
    order = np.argsort(rank, kind="stable")
    apart = digits[order[1:]] ^ digits[order[:-1]]
    column = np.argmax(apart != 0, axis=1) if digits.shape[1] else np.zeros(len(apart), np.int64)
    value = apart[np.arange(len(apart)), column] if digits.shape[1] else np.zeros(len(apart), np.uint64)
    zeros = sum((value < np.uint64(1 << 8 * j)).astype(np.int64) for j in range(1, 8))
    shared = np.where(value == 0, 8 * digits.shape[1], 8 * column + zeros)
    shared[groups[order[1:]] != groups[order[:-1]]] = -1
    return order, np.append([-1], shared)


def repeated(groups: np.ndarray, hi: np.ndarray, parts: list[bytes], n: np.ndarray, least: int) -> list[list[tuple[int, int]]]:
    """For each stretch the runs of offsets (of the gram in the window) at which its window repeats in its group.

    `n` is how often a stretch occurs; distinct stretches of a group are distinct rows.
    """
    most = least - gram_of(least)
    low = hi - (np.array([len(p) for p in parts], np.int64) - least)
    right = np.zeros((len(parts), -(-least // 8) * 8), np.uint8)
    left = np.zeros((len(parts), -(-most // 8) * 8), np.uint8)
    for k, (part, h) in enumerate(zip(parts, hi.tolist())):
        own = np.frombuffer(part, np.uint8)
        right[k, :len(part) - h] = own[h:]
        left[k, :h] = own[:h][::-1]
    sides = [radix_order(groups, side.view(">u8").astype(np.uint64)) for side in (left, right)]
    total = len(parts)
    hit = np.zeros((total, most + 1), bool)
    for offset in range(most + 1):
        key = np.zeros(total, np.int64)
        for (order, shared), depth in zip(sides, (offset, least - offset)):
            group = np.empty(total, np.int64)
            group[order] = np.cumsum(shared < depth)
            key = key * (total + 1) + group
        rows = np.flatnonzero((low <= offset) & (offset <= hi))
        _, place = np.unique(key[rows], return_inverse=True)
        times = np.bincount(place, weights=n[rows])
        hit[rows, offset] = times[place] > 1
    edges = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(total)]
    for (row, start), stop in zip(np.argwhere(edges > 0).tolist(), np.argwhere(edges < 0)[:, 1].tolist()):
        runs[row].append((start, stop - 1))
    return runs


RUNS = "array<struct<low: int, high: int>>"


def compared(parts: DataFrame, least: int, rows_at_once: int = 20_000) -> DataFrame:
    """(`gram`, `cid`, `h1`, `h2`, `runs`) of the stretches of one place among distinct `PARTS`, whole grams in one task."""
    dealt = parts.repartition("gram").sortWithinPartitions("gram")
    runs_type = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
            runs = repeated(gram, table.column("hi").to_numpy().astype(np.int64), table.column("bytes").to_pylist(), n, least)
            once = np.flatnonzero(n == 1)
            runs = [[{"low": a, "high": b} for a, b in runs[k]] for k in once.tolist()]
            own = table.select(["gram", "cid", "h1", "h2"]).take(pa.array(once)).combine_chunks()
            yield pa.RecordBatch.from_arrays([*(own.column(c).combine_chunks() for c in own.column_names), pa.array(runs, runs_type)],
                                             ["gram", "cid", "h1", "h2", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count < rows_at_once:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            gram = whole.column("gram").to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on in the next batch
            if cut:
                yield from answer(whole.slice(0, cut).to_batches())
                held, count = whole.slice(cut).to_batches(), whole.num_rows - cut
        if held:
            yield from answer(held)

    return dealt.mapInArrow(run, f"gram long, cid long, h1 long, h2 long, runs {RUNS}")


def spread_out(parts: DataFrame, least: int) -> DataFrame:
    """The result of `compared` for grams of any number of stretches: windows are grouped by Spark."""
    place = F.explode(F.sequence(F.lit(0), (F.octet_length("bytes") - least).cast("int")))
    windows = parts.select("gram", "cid", "hi", "bytes", "n", place.alias("k"))
    window = F.expr(f"substring(bytes, k + 1, {least})")
    windows = stored(windows.select("gram", "cid", (F.col("hi") - F.col("k")).alias("low"), "n", F.xxhash64(window).alias("w1"),
                                    F.xxhash64(F.lit(1), window).alias("w2")), "windows")
    again = windows.groupBy("w1", "w2").agg(F.count_if(F.col("n") == 1).alias("rows"), F.sum("n").alias("times")).where("times > 1")
    once = windows.where("n = 1").select("gram", "cid", "low", "w1", "w2")
    hits = meet(once, stored(again.select("w1", "w2", "rows"), "again"), ["w1", "w2"], "rows")
    hits = hits.groupBy("gram", "cid").agg(F.array_sort(F.collect_set(F.struct("low", F.col("low").alias("high")))).alias("runs"))
    return (parts.where("n = 1").select("gram", "cid", "h1", "h2").join(hits, ["gram", "cid"], "left")
            .withColumn("runs", F.coalesce("runs", F.array().cast(RUNS))))


def removed(raw: bytes, least: int, grams_again: np.ndarray, once: dict[tuple[int, int], list[dict]]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that a repeated window covers.

    The stretches of `grams_again` repeat, but those of one place (`once`) only at the offsets named there.
    """
    found: list[tuple[int, int]] = []
    for grams, at, start, stop in stretches(raw, least):
        some = np.isin(grams, grams_again)
        if not once:
            found += zip(start[some].tolist(), (stop[some] - 1 + least).tolist())
            continue
        for gram, a, s, e in zip(*(x[some].tolist() for x in (grams, at, start, stop))):
            runs = once.get((gram, digest(raw[s:e + least - 1])))
            found += [(s, e - 1 + least)] if runs is None else [(a - run["high"], a - run["low"] + least) for run in runs]
    found.sort()
    spans: list[tuple[int, int]] = []
    for start, stop in found:
        if spans and start <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(stop, spans[-1][1]))
        else:
            spans.append((start, stop))
    return spans


def cut_out(todo: DataFrame, least: int, id_type: str) -> DataFrame:
    """(`id`, `n_bytes`, `spans`, `kept`) of (`id`, packed `raw`, `again`, `once`)."""
    schema = pa.schema([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch, rows = whole.slice(at, 512), []
                for packed_raw, again, once in zip(*(batch.column(c) for c in ("raw", "again", "once"))):
                    text, gone = unpack(packed_raw), []
                    if again.is_valid:
                        gone = removed(text, least, again.values.to_numpy(), {(x["gram"], x["cid"]): x["runs"] for x in once.as_py() or ()})
                    ends = [0, *(x for span in gone for x in span), len(text)]
                    rows.append((len(text), [{"start": a, "stop": b} for a, b in gone], b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2]))))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*rows), schema.types))],
                                                 ["id", *schema.names])

    return todo.mapInArrow(run, f"id {id_type}, n_bytes long, spans {SPANS}, kept binary")


SPANS = "array<struct<start: bigint, stop: bigint>>"


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST,
                 limit: int = 32_768) -> DataFrame:
    """One row per row of `docs`: `id`, `n_bytes`, `spans` (start, stop) of the bytes removed, `kept` (what is left, binary).

    A byte goes if it is covered by `least` bytes that also start anywhere else, in this text or another;
    overlaps count, and all is judged on the input. Texts are their UTF-8 bytes, null texts empty; a text
    shorter than `least` keeps all. Repeated rows are copies of one another, whatever their ids, null ids
    included. Very long texts are read in pieces of `PIECE` windows. Further columns of `docs` are not read.
    Texts and stretches count as equal if 128 bits of their hashes are. An empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), raw.alias("raw"))
    rows = rows.select("id", F.xxhash64("raw").alias("h1"), F.xxhash64(F.lit(1), "raw").alias("h2"), "raw")

    # Texts of which the table is full: at most a thousand. All their windows repeat, and one copy stands for all.
    copies = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    bound = max(1000, rows.count() // 1000)
    hot = stored(copies.where(F.col("n") > bound).select("h1", "h2"), "hot-texts")
    cold = rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti")
    copied = rows.join(F.broadcast(hot), ["h1", "h2"])

    found = stored(anchors(rows.select("h1", "h2", "raw"), least), "anchors")
    grams = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("cid") != F.max("cid")).alias("mixed")).where("n > 1")
    again = stored(meet(found, stored(grams, "grams"), ["gram"], "n").select("gram", "cid", "h1", "h2", "mixed"), "again")

    # Each distinct stretch of a mixed gram is shipped from one text.
    wanted = (again.where("mixed").groupBy("gram", "cid").agg(F.count(F.lit(1)).alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2"))
              .groupBy("h1", "h2").agg(F.collect_list(F.struct("gram", "cid", "n")).alias("wanted")))
    one = copied.groupBy("h1", "h2").agg(F.first("raw").alias("raw"))
    texts = packed(cold.select("h1", "h2", "raw").unionByName(one).where(F.octet_length("raw") >= least))
    parts = stored(shipped(texts.join(stored(wanted, "wanted"), ["h1", "h2"]), least).distinct(), "stretches")
    many = stored(parts.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > limit).select("gram"), "many")
    once = compared(parts.join(many, "gram", "left_anti"), least)
    if many.limit(1).count():
        once = once.unionByName(spread_out(parts.join(many, "gram"), least))
    once = once.groupBy("h1", "h2").agg(F.collect_list(F.struct("gram", "cid", "runs")).alias("once"))
    again = again.groupBy("h1", "h2").agg(F.collect_set("gram").alias("again"))

    todo = packed(cold).join(again, ["h1", "h2"], "left").join(once, ["h1", "h2"], "left").select("id", "raw", "again", "once")
    rest = cut_out(todo, least, dict(rows.dtypes)["id"])
    size = F.octet_length("raw").cast("long")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop")))
    all_gone = size >= least
    full = copied.select("id", size.alias("n_bytes"), F.when(all_gone, whole).otherwise(F.array().cast(SPANS)).alias("spans"),
                         F.when(all_gone, F.lit("").cast("binary")).otherwise(F.col("raw")).alias("kept"))
    return rest.unionByName(full)
