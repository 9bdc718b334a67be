"""Reproducible row numbers without a global or a hot window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS = 1024


def spread_ranks(rows: DataFrame, group: list[str], tie: list[str], buckets: Column, name: str = "rank") -> DataFrame:
    """Adds the rank (from 0) of each row inside its group, in the order of (hash of tie, tie).

    `buckets` is the number of parts that the hash range of a group is cut into: a part is one
    window partition, so a hot group is numbered by many tasks. The order, and so the rank, does
    not depend on that number. Rows equal in all of `tie` are interchangeable.
    """
    unit = F.xxhash64(*tie).cast("double") / F.lit(2.0 ** 64) + F.lit(0.5)
    rows = rows.withColumn("_h", F.xxhash64(*tie)).withColumn(
        "_part", F.least(F.floor(unit * buckets), buckets - 1).cast("long"))
    counts = rows.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    inside = Window.partitionBy(*group, "_part").orderBy("_h", *tie)
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1)
    return ranked.join(starts, same).withColumn(name, F.col("_in") + F.col("_before")).drop(
        "_h", "_part", "_in", "_p", "_before", *[f"_g_{g}" for g in group])
