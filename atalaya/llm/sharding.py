"""Sharding by a k-d tree over metadata, cut at weighted medians until leaves reach their bytes.

Every node is cut along its widest dimension (language, source, size), at the place that halves its
bytes. Equal texts share all coordinates, so they lie side by side along every dimension. The place
is found by counting bytes in bins, on all nodes of a level at once, and refining the bin in which the
median falls. A cut that can balance at the edge of a group of equal texts leaves the group whole;
only a group too large for that is cut inside, by a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from atalaya.llm.common import stored

DIGITS = 16  # bits refined per pass
PASSES = 6  # 16 bits of coordinate, 32 of text hash, 48 of id hash
DIMENSIONS = ["lang_at", "source_at", "size_at"]


def points(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(`id`, `size`, `crc`, coordinates from 0 to 65535, `group`, `tail`). Of equal texts the least language and source hold.

    A null text has no bytes; the size is the bytes plus one. Null languages and sources are a value of their own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    at = lambda c: F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0"))), 48)
    rows = stored(docs.select(F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("h"), at("lang").alias("l"),
                              at("source").alias("s")), "rows")
    groups = stored(rows.groupBy("h", "size").agg(F.min("l").alias("lang_at"), F.min("s").alias("source_at")), "groups")
    size_at = F.least(F.lit(65535), (F.log2(F.col("size")) * 2048)).cast("long")
    return stored(rows.drop("l", "s").join(groups, ["h", "size"]).select(
        "id", "size", "crc", "lang_at", "source_at", size_at.alias("size_at"),
        F.shiftrightunsigned(F.xxhash64(F.lit(7), "h", "size"), 32).alias("group"),
        F.shiftrightunsigned(F.xxhash64(F.lit(9), "id", "h"), 16).alias("tail")), "points")


def _digit(at: Column, k: int) -> Column:
    """Digit k of the position (coordinate, group, tail) along a dimension."""
    word, shift = [(at, 0), (F.col("group"), 16), (F.col("group"), 0), (F.col("tail"), 32), (F.col("tail"), 16), (F.col("tail"), 0)][k]
    return F.shiftrightunsigned(word, shift).bitwiseAND(F.lit((1 << DIGITS) - 1))


def _case(node: Column, values: dict[int, object]) -> Column:
    out = F.lit(None)
    for key, value in values.items():
        out = F.when(node == key, value).otherwise(out)
    return out


def cuts(level: DataFrame, tolerance: float) -> dict[int, tuple[str, tuple[int, ...]]]:
    """For each `node`: the dimension and the digits of the first position of its right half.

    What reaches the driver is a few rows per node. A node has its widest dimension's spread measured
    in bytes-weighted variance, so a value that a few rows hold doesn't decide.
    """
    spread = level.groupBy("node").agg(F.sum("size").alias("bytes"), *[
        (F.sum(F.col("size") * F.col(d).cast("double") ** 2) / F.sum("size")
         - (F.sum(F.col("size") * F.col(d).cast("double")) / F.sum("size")) ** 2).alias(d) for d in DIMENSIONS]).collect()
    total = {r["node"]: r["bytes"] for r in spread}
    along = {r["node"]: max(DIMENSIONS, key=lambda d: (r[d], d)) for r in spread}
    prefix: dict[int, tuple[int, ...]] = {node: () for node in total}
    before = dict.fromkeys(total, 0)
    done: dict[int, tuple[str, tuple[int, ...]]] = {}
    at = F.coalesce(*[F.when(F.col("node").isin([n for n, d in along.items() if d == name] or [-1]), F.col(name)) for name in DIMENSIONS])
    for k in range(PASSES):
        todo = [node for node in total if node not in done]
        if not todo:
            break
        inside = F.col("node").isin(todo)
        for j in range(k):
            inside &= _digit(at, j) == _case(F.col("node"), {n: F.lit(prefix[n][j]) for n in todo})
        bins = level.where(inside).groupBy("node", _digit(at, k).alias("digit")).agg(F.sum("size").alias("bytes"))
        run = Window.partitionBy("node").orderBy("digit")
        half = _case(F.col("node"), {n: F.lit(total[n] / 2 - before[n]) for n in todo})
        found = (bins.withColumn("upto", F.sum("bytes").over(run)).where((F.col("upto") >= half) & (F.col("upto") - F.col("bytes") < half))
                 .collect())
        for r in found:
            node, low, high = r["node"], before[r["node"]] + r["upto"] - r["bytes"], before[r["node"]] + r["upto"]
            nearest = min(total[node] / 2 - low, high - total[node] / 2)
            if nearest <= tolerance * total[node] or k == PASSES - 1:
                edge = r["digit"] + (high - total[node] / 2 < total[node] / 2 - low)
                done[node] = (along[node], (*prefix[node], edge))
            else:
                prefix[node], before[node] = (*prefix[node], r["digit"]), low
    return done


def _right(dimension: str, digits: tuple[int, ...]) -> Column:
    """Is the row at or behind the position? Digits compare from the first one on."""
    out = F.lit(True)
    for k in reversed(range(len(digits))):
        own = _digit(F.col(dimension), k)
        out = (own > digits[k]) | ((own == digits[k]) & out) if k < len(digits) - 1 else own >= digits[k]
    return out


def shard(docs: DataFrame, levels: int = 4, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text",
          buckets: int = 256) -> DataFrame:
    """(`id`, `size`, `crc`, `shard`, `slot`): 2 ** `levels` shards of nearly equal bytes, slots gapless from 0.

    Each cut misses the half of its node by at most `tolerance` of the node's bytes where rows allow.
    Rows without an id are dealt by their text alone, repeated rows stay together; an empty table gives no rows.
    """
    rows = points(docs, id_col, text_col)
    node: Column = F.lit(0)
    for _ in range(levels):
        found = cuts(rows.withColumn("node", node), tolerance)
        right = F.lit(0)
        for key, (dimension, digits) in found.items():
            right = F.when((node == key) & _right(dimension, digits), F.lit(1)).otherwise(right)
        rows = stored(rows.withColumn("node", (node * 2 + right).cast("int")), "tree")
        node = F.col("node")
    # Slots: hashed buckets of each shard are numbered side by side.
    placed = rows.withColumn("bucket", F.pmod(F.xxhash64("id", "tail"), F.lit(buckets)))
    counts = placed.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("node", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")), "starts")
    own = Window.partitionBy("node", "bucket").orderBy("id", "tail")
    return (placed.withColumn("place", F.row_number().over(own)).join(F.broadcast(starts), ["node", "bucket"])
            .select("id", "size", "crc", F.col("node").alias("shard"), (F.col("start") + F.col("place") - 1).alias("slot")))
