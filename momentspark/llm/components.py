"""Connected components of a table of links, by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """`links` (a, b) to (node, component): the smallest node that links reach, for every node of a link.

    Each round is a few joins and a table written to the shared folder, so that lineage stays short. Rounds
    needed grow with the square of the logarithm of the number of nodes. Self links, repeated links and either
    direction are allowed; nulls are ignored. The state is never larger than the links.
    """
    stars = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _mark(stars)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(large.groupBy("u").agg(F.min("v").alias("v"))).distinct()
        new = scratch.write(small, "stars")
        scratch.drop(stars)
        scratch.drop(large)
        stars, before = new, seen
        seen = _mark(stars)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(stars: DataFrame) -> tuple:
    """The number of links and a sum over them that no reordering changes."""
    row = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
