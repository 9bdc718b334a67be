"""Residue-level structure features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators.joins import by_size, near_by_octree, near_in_groups


def _mean_in_groups(df: DataFrame, value, pos, structure, reach, out) -> DataFrame:
    """Means of small structures, by a window over each."""
    near = W.partitionBy(structure).orderBy(pos).rangeBetween(-reach, reach)
    return df.withColumn(out, F.avg(value).over(near))


def _mean_by_shifts(df: DataFrame, value, pos, structure, reach, out) -> DataFrame:
    """Means of structures of any size, none of which is one window: an aggregate per (structure, position),
    so that repeated positions collapse, and `2*reach+1` shifted copies of it joined by equality."""
    spots = df.groupBy(structure, pos).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    shifts = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    near = spots.select(structure, "_s", "_n", F.col(pos).alias("_p"), shifts.alias("_d")).select(
        structure, (F.col("_p") + F.col("_d")).alias(pos), "_s", "_n"
    )
    means = near.groupBy(structure, pos).agg(F.try_divide(F.sum("_s"), F.sum("_n")).alias(out))
    return df.join(means, [structure, pos])


def position_window_mean(df: DataFrame, value="bfactor", pos="pos", structure="structure_id", reach=5, out="window_mean") -> DataFrame:
    """Mean over residues whose position lies within `reach`; gaps in numbering are allowed.

    Rows without a structure or position are left out. Small structures are dealt once and are a window
    each; only structures of more rows are copied.
    """
    known = df.filter(F.col(structure).isNotNull() & F.col(pos).isNotNull())
    small, large = by_size(known, structure)
    means = _mean_in_groups(small, value, pos, structure, reach, out)
    return means if large is None else means.unionByName(_mean_by_shifts(large, value, pos, structure, reach, out))


def structure_features(atoms: DataFrame, radius=5.0) -> DataFrame:
    """Confidence, windowed confidence and neighbour count for each residue, one row for each row of `atoms`
    with a structure and a position; the count is NULL without coordinates.

    Rows of small structures are dealt once, for the window and the neighbours.
    """
    ca = atoms.select("structure_id", "pos", "x", "y", "z", "bfactor").filter(F.col("structure_id").isNotNull() & F.col("pos").isNotNull())
    small, large = by_size(ca, "structure_id")
    window = ("bfactor", "pos", "structure_id", 5, "window_mean")
    out = near_in_groups(_mean_in_groups(small, *window), radius)
    if large is not None:
        windowed = _mean_by_shifts(large, *window)
        # as near_in_groups has it: no count without a finite coordinate
        known = sum((F.col(c).cast("double") * 0 for c in "xyz"), F.lit(0.0)) == 0
        out = out.unionByName(near_by_octree(windowed.filter(known), radius)).unionByName(
            windowed.filter(~F.coalesce(known, F.lit(False))).withColumn("neighbors", F.lit(None).cast("bigint")))
    return out.select("structure_id", "pos", "bfactor", "window_mean", "neighbors")
