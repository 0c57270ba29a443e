"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has 64 bits; texts link at `BITS` = 3 or fewer differing bits. Put the bits on a ring of
four segments: of any pair that links, some segment starts a chain on which l consecutive segments
differ in at most floor(3 l / 4) bits, for every l, so its first segment is equal. The other 48 bits
form a second ring with the same law. The two equal segments (28 bits) are the key that brings a pair
together; the other budgets of both chains then prune it before its full distance is counted.

Only distinct fingerprints are compared. Keys that few of them share are joined pair by pair. Keys
that many share, such as those of thousands of near copies, are compared in square blocks of bounded
size, each of which returns a spanning forest of its links and not the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from atalaya.llm.common import stored
from atalaya.llm.components import components

BITS = 3
SEED = 42
PIECE = 1 << 16
INNER = (1 << 48) - 1


def fingerprint(raw: bytes, width: int = 3) -> int:
    """SimHash of a text's shingles, as a signed number; zero if it has no word."""
    words = raw.lower().split()  # for bytes: A-Z, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < width:
        words, width = [b" ".join(words)], 1
    total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, PIECE):  # a text of any length takes the memory of one piece
        part = words[start:min(start + PIECE, total) + width - 1]
        shingles = map(b" ".join, zip(*[part[k:] for k in range(width)]))
        digests = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        bits = np.unpackbits(digests.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<i8")[0])


def sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(`id`, `h`, `fp`): the row's id, a hash of its exact text and its fingerprint. Null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(raw.as_py(), width) for raw in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(fps, pa.int64())],
                                             ["id", "h", "fp"])

    return rows.mapInArrow(run, "id long, h long, fp long")


def _ring(x: str, slot: str) -> tuple[str, str]:
    """`x` turned so that outer segment slot/4 comes first, and its last 48 bits turned by inner segment slot%4."""
    turn, inner = f"(16 * cast({slot} div 4 as int))", f"(12 * cast({slot} % 4 as int))"
    ring = f"(shiftleft({x}, {turn}) | shiftrightunsigned({x}, 64 - {turn}))"
    rest = f"({ring} & {INNER}L)"
    return ring, f"((shiftleft({rest}, {inner}) | shiftrightunsigned({rest}, 48 - {inner})) & {INNER}L)"


def keyed(fps: DataFrame) -> DataFrame:
    """(`slot`, `key`, `fp`): the 16 keys of each fingerprint."""
    ring, inner = _ring("fp", "slot")
    key = f"shiftleft(slot, 28) | shiftleft(shiftrightunsigned({ring}, 48), 12) | shiftrightunsigned({inner}, 36)"
    return (fps.select("fp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("slot"))
            .withColumn("key", F.expr(key)))


def _within_budgets(x: str) -> str:
    """Chains of 2 and 3 segments from the key's segments differ in at most 1 and 2 bits, on both rings."""
    ring, inner = _ring(x, "slot")
    return " and ".join([f"bit_count(shiftrightunsigned({ring}, 32)) <= 1", f"bit_count(shiftrightunsigned({ring}, 16)) <= 2",
                         f"bit_count(shiftrightunsigned({inner}, 24)) <= 1", f"bit_count(shiftrightunsigned({inner}, 12)) <= 2"])


def link_block(left: np.ndarray, right: np.ndarray, rows: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of fingerprints (uint64), compared in strips."""
    both = np.unique(np.concatenate([left, right]))
    label = np.arange(len(both))
    at, to = np.searchsorted(both, left), np.searchsorted(both, right)
    forest: list[tuple[int, int]] = []
    for start in range(0, len(left), rows):
        near = np.bitwise_count(left[start:start + rows, None] ^ right[None, :]) <= BITS
        i, j = np.nonzero(near)
        i, j = at[start + i], to[j]
        while len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            if not len(i):
                break
            # Hang each larger label on one smaller neighbour; what is left apart goes round again.
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            _, first = np.unique(high, return_index=True)
            forest += zip(both[i[first]].tolist(), both[j[first]].tolist())
            parent = np.arange(len(both))
            parent[high[first]] = low[first]
            while not np.array_equal(parent, parent[parent]):
                parent = parent[parent]
            label = parent[label]
    return forest


def near_links(fps: DataFrame, few: int = 64, block: int = 2048) -> DataFrame:
    """Links (`a`, `b`) that connect exactly the distinct fingerprints `fp` within `BITS` of each other."""
    keys = keyed(fps)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(stored(shared, "counts"), "key"), "shared")

    some = shared.where(F.col("n") <= few)
    left, right = some.select("key", "slot", F.col("fp").alias("a")), some.select("key", F.col("fp").alias("b"))
    pairs = (left.join(right, "key").where("a < b").where(_within_budgets("(a ^ b)"))
             .where(f"bit_count(a ^ b) <= {BITS}").select("a", "b"))

    many = (shared.where(F.col("n") > few).withColumn("blocks", F.ceil(F.col("n") / block))
            .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp"))

    def compare(group: pa.Table) -> pa.Table:
        own, i = group.column("own").to_numpy(), group.column("i").to_numpy()
        fp = group.column("fp").to_numpy().view(np.uint64)
        right = fp[own == group.column("j").to_numpy()]
        forest = np.array(link_block(fp[own == i], right), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": forest[:, 0], "b": forest[:, 1]})

    blocks = many.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
    return pairs.unionByName(blocks)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row per row of `docs`: `id`, `h` (hash of the exact text), `fp` and `component_id`.

    The component is the smallest id reachable over links, the row's own included. Rows without an id
    take part and may connect others, but give no id; a component of such rows only has a null one.
    Texts without a word have fingerprint zero and link like any other. An empty table gives no rows.
    """
    signed = stored(sign(docs, id_col, text_col, width), "signed")
    fps = stored(signed.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    linked = components(near_links(fps.select("fp")))
    rooted = stored(fps.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
                    .withColumn("root", F.coalesce("root", "fp")), "rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
    classes = stored(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    return signed.join(classes, "fp").select("id", "h", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
