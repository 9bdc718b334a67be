"""Connected components by alternating stars: no vertex's neighbours are ever gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all vertices of the edges (columns a, b, bigint); root is the smallest
    vertex of the component.

    Large-star and small-star steps alternate until nothing changes; each step is a grouped
    minimum and a join, and each round is written to the shared folder.
    """
    pairs = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        mark = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if mark == before or not mark.n:
            break
        before = mark
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    roots = pairs.select(F.col("v").alias("u"), "v").distinct()
    return pairs.union(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
