"""Connected components of a link table by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, remove_scratch


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """One star step: every node's larger (or smaller) neighbours move to the least of its neighbourhood."""
    if larger:
        seen = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("hub"), F.least("a", "low").alias("low"))
    joined = seen.join(least, F.col("a") == F.col("hub"))
    if larger:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("hub").alias("a"), F.col("low").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to (node, root), one row for each node that has a link to another; root is the least node reached.

    Nulls and self links are dropped, repeated links count once, no links give no rows. Each round is written to the
    shared folder; rounds grow with the logarithm of the longest chain.
    """
    pairs = durable(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        following = durable(_star(_star(pairs, True), False))
        remove_scratch(pairs)
        pairs = following
