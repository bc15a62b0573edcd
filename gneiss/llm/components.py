"""Connected components of a link table by alternating stars, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of one type -> (node, component): every linked node and the smallest node that it reaches.

    Large stars tie each node's larger neighbours to its smallest one, small stars its smaller neighbours; both only move
    links, so their number never grows, and the rounds needed grow with the logarithm of a component's diameter. Smallest
    neighbours are aggregated before the shuffle, so a node with very many links costs no task more than others.
    """
    links = settle(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links")
    while True:
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        after = settle(small.where("a != b").distinct(), "links")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(links)
        links = after
        if same:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
