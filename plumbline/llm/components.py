"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import scratch_folder


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``: root is the smallest node it is joined to.

    Large-star and small-star steps alternate: every node's neighbours that are larger than it, and
    then all that are not, are linked to its smallest neighbour.  The links turn into stars in a
    number of rounds that grows with the logarithm of the longest path.  Each round is written to a
    table in the shared folder, which cuts the lineage and outlives executors.  A node with very
    many links meets them in a join that adaptive execution can split, never in one list.
    """
    spark = links.sparkSession
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = stored(links)
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))
        large, _ = stored(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("root"))
        small = large.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
        small = small.union(least.select("a", F.col("root").alias("b"))).distinct()
        links, now = stored(small)
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def stored(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and a fingerprint of their set."""
    folder = scratch_folder(links.sparkSession, "links")
    links.write.parquet(folder)
    table = links.sparkSession.read.schema(links.schema).parquet(folder)
    mixed = F.xxhash64("a", "b")
    return table, tuple(table.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first())
