"""Exact deduplication: two passes over a Bloom filter, so that only possibly repeated rows shuffle.

Pass one sets `PROBES` slots per text and notes the slots that more than one row hit. Pass two
streams the rows again: a row with a slot that nobody else hit is certainly unique and goes straight
to the result; all others are stored, grouped by the SHA-256 of their text and joined to their group.
False positives of the filter are groups of one row, so the result is exact at any load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from atalaya.llm.common import ascii_lower, stored

PROBES = 2
RESULT = ["keep_id", "group_size", "kept", "text_sha256"]


def _slot(digest: Column, probe: int, slots: int) -> Column:
    """Each probe has its own stretch of the filter, so one row never hits a slot twice."""
    stretch = slots // PROBES
    return F.pmod(F.xxhash64(F.lit(probe), digest), F.lit(stretch)) + F.lit(probe * stretch)


def repeated_slots(digests: DataFrame, slots: int) -> DataFrame:
    """Words of 64 slots (`word`, `mask`) with a bit for each slot that two or more rows hit."""
    hit = digests.select(F.explode(F.array(*[_slot(F.col("digest"), p, slots) for p in range(PROBES)])).alias("slot"))
    often = hit.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).where("hits > 1")
    return (often.groupBy(F.expr("shiftright(slot, 6)").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None, filter_words: int = 1 << 22) -> DataFrame:
    """Every row with `keep_id`, `group_size`, `kept` and `text_sha256`; `carry` names the columns to keep.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts
    the row with the largest id stays; among rows that also share the id, and among rows without any
    id, exactly one stays (`kept` is true for one row of each group). A null id is smaller than any
    other. Columns of the input that bear a result name are replaced. An empty table gives no rows.

    The broadcast filter has at most `filter_words` rows of 16 bytes (64 MiB by default), whatever
    the input; beyond its load more rows take the shuffled path, with the same result.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in RESULT]
    slots = filter_words * 64
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(id_col).alias("id"),
                       ascii_lower(F.col(text_col)).alias("norm"))
    digests = rows.select(F.xxhash64("norm").alias("digest"))
    words = stored(repeated_slots(digests, slots), "bloom")

    probed = rows.withColumn("digest", F.xxhash64("norm"))
    maybe = F.lit(True)
    for probe in range(PROBES):
        side = words.select(F.col("word").alias(f"word{probe}"), F.col("mask").alias(f"mask{probe}"))
        slot = _slot(F.col("digest"), probe, slots)
        probed = (probed.withColumn(f"slot{probe}", slot)
                  .join(F.broadcast(side), F.expr(f"shiftright(slot{probe}, 6) = word{probe}"), "left"))
        maybe &= F.expr(f"coalesce(mask{probe}, 0L) & shiftleft(1L, cast(slot{probe} & 63 as int)) != 0")
    probed = probed.withColumn("maybe", maybe)

    sha = F.sha2(F.col("norm").cast("binary"), 256)
    again = stored(probed.where("maybe").select("row", "id", sha.alias("sha"), F.monotonically_increasing_id().alias("rid")),
                   "repeats")
    groups = stored(again.groupBy("sha").agg(F.max(F.struct("id", "rid")).alias("top"), F.count(F.lit(1)).alias("n")),
                    "groups")
    # Both sides are files, so each gets its own exchange and a group of any size can be split.
    judged = again.join(groups, "sha").select(
        "row", F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("top.rid")).alias("kept"), F.col("sha").alias("text_sha256"))
    alone = probed.where(~F.col("maybe")).select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        sha.alias("text_sha256"))
    return alone.unionByName(judged).select("row.*", *RESULT)
