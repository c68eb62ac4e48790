"""Connected components by alternating large and small stars, as joins on distributed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearbrook.llm.shared import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a and b); root is the smallest node that it reaches.

    Each round is a few joins whose rows are at most twice the edges; its result is written to the shared
    folder. The least of a node's neighbours is found by a grouped minimum, which is combined before the
    shuffle, so a node with very many edges costs no more than others. It ends when a round changes nothing: after the square of the
    logarithm of the nodes at most, in practice after a few rounds.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, last = staged(pairs, "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # Small stars: u > v holds for every pair of the large stars.
        large = staged(large.distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        pairs = staged(small.distinct(), "small-star")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = state
