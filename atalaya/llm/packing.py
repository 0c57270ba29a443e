"""Best-fit packing by exact complements.

Documents become token pieces of at most `capacity`; the plan needs only how many pieces have each
length. It opens a sequence with the longest length left and looks for one, two or three lengths that
fill the gap exactly; only when none do, it takes the longest that fits and looks again. A pattern is
used as often as the counts allow. Both the table of counts and the plan are bounded by the capacity,
whatever the number of documents; pieces take their places in parallel, by their rank in their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from atalaya.llm.common import stored

CACHE = 300_000
RARE_SPACE = re.compile(r"[^\S \n]")


def encoder(ranks_path: str, pattern: str, added: dict[str, int] | None = None) -> Callable[[str], bytes]:
    """Text to little-endian 32-bit ids of a byte-level BPE.

    Wherever the text has one of the `added` tokens, its id stands; what is between is encoded for itself.

    Its pattern never joins what stands before a single space to what follows, so such a text is cut
    there and words seen before come from a bounded cache. Other texts are encoded whole.
    """
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(ranks_path, "rb"))}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = lambda text: array("I", encode(text)).tobytes()

    class Words(dict):
        def __missing__(self, word: str) -> bytes:
            ids = whole(" " + word)
            if len(self) < CACHE and len(word) < 40:
                self[word] = ids
            return ids

    words = Words()

    def plain(text: str) -> bytes:
        if "  " in text or "\n \n" in text or text.endswith(" ") or RARE_SPACE.search(text):
            return whole(text)
        head, *rest = text.split(" ")
        return whole(head) + b"".join([words[word] for word in rest])

    if not added:
        return plain
    # Longest first, so that none hides another that starts with it.
    ids = {token: array("I", [number]).tobytes() for token, number in sorted(added.items(), key=lambda x: -len(x[0]))}
    some = re.compile(f"({'|'.join(map(re.escape, ids))})")

    def run(text: str) -> bytes:
        parts = some.split(text)
        return plain(text) if len(parts) == 1 else b"".join([ids[x] if k % 2 else plain(x) for k, x in enumerate(parts) if x])

    return run


def pieces(docs: DataFrame, ranks_path: str, pattern: str, added: dict[str, int] | None, capacity: int, end_id: int,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(`id`, `piece`, `start`, `length`, `ids_crc32`, `task`, `rank`): rank counts a task's pieces of one length."""
    schema = "id long, piece int, start long, length long, ids_crc32 long, task long, rank long"
    names = [field.split()[0] for field in schema.split(", ")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, task = encoder(ranks_path, pattern, added), array("I", [end_id]).tobytes(), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py()) + end
                total = len(ids) // 4
                cut = (total - 1) % capacity + 1
                start = 0
                for piece in range(-(-total // capacity)):
                    out.append((doc_id, piece, start, cut - start, zlib.crc32(ids[4 * start:4 * cut]), task, int(ranks[cut - start])))
                    ranks[cut - start] += 1
                    start, cut = cut, cut + capacity
            columns = zip(*out) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "piece" else pa.int64())
                                              for n, c in zip(names, columns)], names)

    return rows.mapInArrow(run, schema)


def fill_exactly(gap: int, have: np.ndarray, dead: dict[int, set[int]]) -> tuple[int, ...]:
    """One, two or three available lengths whose sum is `gap`, longest first; () if there are none.

    Counts only fall, so a gap found to have no pair or triple is never searched again (`dead`).
    """
    if have[gap]:
        return (gap,)
    pair = _pair(gap, gap - 1, have) if gap not in dead[2] else None
    if pair:
        return pair
    dead[2].add(gap)
    if gap not in dead[3]:
        for x in np.flatnonzero(have[:gap - 1])[::-1].tolist():
            if 3 * x < gap:
                break
            have[x] -= 1
            pair = _pair(gap - x, x, have)
            have[x] += 1
            if pair:
                return (x, *pair)
        dead[3].add(gap)
    return ()


def _pair(total: int, most: int, have: np.ndarray) -> tuple[int, int] | None:
    """The available pair with sum `total`, no longer than `most`, whose longer part is longest."""
    low, high = (total + 1) // 2, min(most, total - 1)
    if high < low:
        return None
    longer = have[low:high + 1]
    shorter = have[total - high:total - low + 1][::-1]
    found = (longer > 0) & (shorter > 0)
    if 2 * low == total and have[low] < 2:
        found[0] = False
    at = np.flatnonzero(found)
    return (low + int(at[-1]), total - low - int(at[-1])) if len(at) else None


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths in one sequence, how many sequences) that use every piece once."""
    have = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        have[length] = count
    plan: list[tuple[list[int], int]] = []
    dead: dict[int, set[int]] = {2: set(), 3: set()}
    for longest in range(capacity, 0, -1):
        while have[longest]:
            pattern, gap = [longest], capacity - longest
            have[longest] -= 1
            while gap:
                take = fill_exactly(gap, have, dead)
                if not take:
                    fits = np.flatnonzero(have[:gap + 1])
                    if not len(fits):
                        break
                    take = (int(fits[-1]),)
                for length in take:
                    have[length] -= 1
                    gap -= length
                pattern += take
            uses = Counter(pattern)
            more = min(int(have[length]) // k for length, k in uses.items())
            for length, k in uses.items():
                have[length] -= more * k
            plan.append((pattern, more + 1))
    return plan


def slots(plan: list[tuple[list[int], int]], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted starts (length and first rank in one number), the sequence of each start and the offset in it."""
    used, base, rows = np.zeros(capacity + 1, np.int64), 0, []
    for pattern, count in plan:
        offset = 0
        for length in pattern:
            rows.append((length << 44 | int(used[length]), base, offset))
            used[length] += count
            offset += length
        base += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Add `sequence_id` and `offset` to the rows of `pieces`."""
    cut = stored(cut, "pieces")
    counts = stored(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # At most `capacity` rows reach the driver.
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    starts, bases, offsets = slots(plan_sequences(by_length, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
                    .select("task", "length", "before"), "before")
    ranked = cut.join(before, ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            own = batch.column("length").to_numpy() << 44 | rank
            at = np.searchsorted(starts, own, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(bases[at] + own - starts[at]), pa.array(offsets[at])],
                ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, added: dict[str, int] | None = None,
                   capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `capacity` tokens.

    A null text is empty: one piece that holds only `end_id`. A document longer than the capacity is
    cut into full pieces after a first one that may be shorter. Rows that repeat are packed each for
    itself; a null id stays null. Other columns are left out. An empty table gives no rows.
    """
    return pack(pieces(docs, ranks_path, pattern, added, capacity, end_id, id_col, text_col), capacity)
