"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouping and a join on files, so links never meet on the driver and the links of a
hub can be split. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from atalaya.llm.common import stored


def _is_forest_of_stars(links: DataFrame) -> bool:
    ends = (links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    bad = ends.groupBy("n").agg(F.sum("up").alias("ups"), F.max("down").alias("top"))
    return bad.where("ups > 1 or (ups = 1 and top = 1)").limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(`node`, `root`) for every linked node but the roots; `links` has the columns `a` and `b`.

    The root is the smallest node reachable. Links from a node to itself and links with a null end
    count for nothing.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                   "links")
    while not _is_forest_of_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
                       "large")
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        # Small star: u and its smaller neighbours go to the smallest of them.
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
