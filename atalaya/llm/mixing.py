"""Mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

A token budget enters at the root. Siblings share it by weight; one whose subtree holds less than
its share gives the shortage back to its siblings, and only what a whole subtree lacks reaches its
parent's siblings. Each leaf turns its budget into whole epochs plus a prefix of one more epoch in a
seeded order. Budgets are whole numbers throughout, so every engine computes the same ones.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from atalaya.llm.common import stored

NONE = "(none)"
WORDS = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3


def domain_of(source: Column) -> Column:
    """The test tables name no domain: four of them, by the first digit of the source's MD5."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(NONE)).cast("binary")), 1, 1)
    return F.when(digit < "4", "d0").when(digit < "8", "d1").when(digit < "c", "d2").otherwise("d3")


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Weight of the node whose path is `levels`; 1 unless the map of weights names the path."""
    out = F.lit(1).cast("long")
    for path, weight in weights.items():
        if len(path) == len(levels):
            same = F.lit(True)
            for level, name in zip(levels, path):
                same &= (F.col(level) == name) | F.lit(name == "*")
            out = F.when(same, F.lit(int(weight)).cast("long")).otherwise(out)
    return out


def share_out(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Split `given`, which all siblings carry, by `weight` under `cap`; adds `alloc`.

    Siblings are saturated in the order of cap per weight. What the saturated ones leave is divided
    by weight among the others (rounded down). A sibling group has one row per child of one node.
    """
    siblings = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = siblings.orderBy(F.col("cap").cast("double") / F.col("weight").cast("double"), F.col(name))
    big = "decimal(38,0)"
    return (nodes
            .withColumn("caps", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast(big))
            .withColumn("rest", (F.sum("weight").over(siblings)
                                 - F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))).cast(big))
            .withColumn("full", F.expr("weight * (given - caps) >= cap * rest"))
            .withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(F.lit(0))).over(siblings))
            .withColumn("open", F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("weight"))).over(siblings))
            .withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(
                F.expr(f"cast(cast(weight as {big}) * cast(left as {big}) div cast(open as {big}) as bigint)")))
            .drop("caps", "rest", "full", "left", "open"))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple[str, ...], int],
                 budget: Column, max_epochs: int) -> DataFrame:
    """Leaves (`levels`, `tokens`) with `alloc`. `budget` is an expression over `total`, all tokens there are."""
    leaves = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    above = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    given = above.select(budget.cast("long").alias("given")).withColumn("root", F.lit(0))
    for depth in range(1, len(levels) + 1):
        path, parents = list(levels[:depth]), list(levels[:depth - 1])
        nodes = leaves.groupBy(*path).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("root", F.lit(0)).withColumn("weight", _weight(path, weights))
        shared = share_out(nodes.join(given, ["root", *parents]), parents, path[-1])
        given = shared.select("root", *path, F.col("alloc").alias("given"))
    return shared.select(*levels, "tokens", "alloc")


def mix_sources(docs: DataFrame, weights: Mapping[tuple[str, ...], int], share: tuple[int, int] = (3, 5),
                max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """The selected rows: the `carry` columns plus `mix_domain`, `mix_lang`, `mix_source`, `mix_epoch`, `mix_tokens`.

    `weights` maps a path such as `("d0",)` or `("*", "en")` to a whole number; other nodes weigh 1.
    The budget is `share` of all tokens (words between white space). A null language or source is the
    node `(none)`; a null text has no tokens; a leaf without tokens selects nothing. Rows that share
    an id (null ids included) share their place in the seeded order: they are taken or left together.
    A row comes back once per epoch that selects it. Input columns with a result's name are replaced.
    """
    levels = ["mix_domain", "mix_lang", "mix_source"]
    result = [*levels, "mix_epoch", "mix_tokens"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in result]
    label = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                       F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"),
                       domain_of(F.col("source")).alias("mix_domain"), label("lang").alias("mix_lang"),
                       label("source").alias("mix_source"),
                       F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS)).cast("long").alias("mix_tokens"))
    counted = stored(rows.drop("row"), "tokens")
    leaves = counted.groupBy(*levels).agg(F.sum("mix_tokens").alias("tokens"))
    budget = F.expr(f"total * {int(share[0])} div {int(share[1])}")
    leaves = leaf_budgets(stored(leaves, "leaves"), levels, weights, budget, max_epochs)
    leaves = stored(leaves.where("tokens > 0").select(
        *levels, F.expr("alloc div tokens").alias("epochs"), F.expr("alloc % tokens").alias("part")), "budgets")

    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("key")).cast("binary"))
    # Where the prefix of the last epoch ends: first the stretch of the order, then the place inside it.
    placed = counted.join(leaves, levels).withColumn("u", place).withColumn("stretch", F.substring("u", 1, BUCKET_DIGITS))
    sums = placed.groupBy(*levels, "stretch").agg(F.sum("mix_tokens").alias("n"), F.first("part").alias("part"))
    run = Window.partitionBy(*levels).orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    ends = stored(sums.withColumn("upto", F.sum("n").over(run)).where("part > 0 and upto > part and upto - n <= part")
                  .select(*levels, "stretch", (F.col("upto") - F.col("n")).alias("before")), "ends")
    inside = Window.partitionBy(*levels).orderBy("u").rangeBetween(Window.unboundedPreceding, 0)
    fits = (placed.join(ends, [*levels, "stretch"])
            .withColumn("upto", F.col("before") + F.sum("mix_tokens").over(inside))
            .where("upto <= part").groupBy(*levels).agg(F.max("u").alias("last")))
    cuts = stored(leaves.join(ends, levels, "left").join(fits, levels, "left")
                  .select(*levels, "epochs", F.coalesce("last", "stretch").alias("cut")), "cuts")
    taken = F.col("epochs") + F.when(place <= F.col("cut"), 1).otherwise(0)
    return (rows.join(cuts, levels).withColumn("taken", taken).where("taken > 0")
            .withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)))
            .select("row.*", *result))
