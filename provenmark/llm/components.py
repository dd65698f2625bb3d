"""Connected components of a table of links, by alternating large and small stars on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links(a, b) to (node, root): the smallest node of each component, for every node with a link.

    Every round writes its links to the shared folder; nothing comes to the driver but whether it is done. A node with very
    many links is a row of an aggregate and one side of a join, never a group in one task.
    """
    links = links.where(F.col("a") != F.col("b"))
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where((F.col("b") > F.col("a")) & (F.col("b") != F.col("m"))).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        links = cut(small.distinct())
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether every node has one parent, and no parent has one: then parents are the roots."""
    up = links.select(F.col("b").alias("a")).distinct()
    return links.join(up, "a", "left_semi").isEmpty() and links.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
