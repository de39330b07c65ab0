"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardbook.session import settle


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the smallest node reachable; nodes without a link are not listed.

    Large and small stars alternate until the links no longer change. Each
    round is written to the shared folder, so the plan stays short and a lost
    executor costs one round. Smallest neighbours are found with map-side
    combining, so a node with very many links is no single group.
    """
    pairs = settle(links.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links")
    state = None
    while True:
        both = pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # Larger neighbours are hung under the smallest one.
        large = settle(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi != lo").distinct(), "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("s"))
        pairs = settle(small.select("s.hi", "s.lo").where("hi != lo").distinct(), "small-star")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)
