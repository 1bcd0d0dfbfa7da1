"""Connected components of links between long ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.llm import shared


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b): root is the least node it reaches. Self-links and nulls count for nothing.

    Each round points nodes to the least of their neighbours, first from the
    larger ones' side and then from the smaller ones', until no link changes;
    rounds are tables in the shared folder. Joins are merge joins by hint, since
    the size of a file of links says little about their number.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = shared.written(links, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).hint("merge").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.hint("merge").join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        links = shared.written(small.where(F.col("a") != F.col("b")).distinct(), "links")
