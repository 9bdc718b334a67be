"""Evaluation report of a prediction table, and external validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.families import gene_family
from helixframe.operators import joins, metrics, resampling, splitting


def long_predictions(preds: DataFrame) -> DataFrame:
    """Each row once per (split, raw/calibrated)."""
    return preds.select(
        "split", F.col("y_true").alias("y"),
        F.explode(F.array(
            F.struct(F.lit("raw").alias("variant"), F.col("p_raw").alias("p")),
            F.struct(F.lit("calibrated").alias("variant"), F.col("p_calibrated").alias("p")),
        )).alias("e"),
    ).select("split", "y", "e.variant", "e.p")


def evaluate_predictions(preds: DataFrame, threshold=0.5, replicates=1000, seed=42) -> dict[str, DataFrame]:
    """All evaluation tables, lazily, keyed by name."""
    long = long_predictions(preds)
    keys = ["split", "variant"]
    headline = (
        metrics.ranking_metrics(long, "y", "p", keys)
        .join(metrics.confusion_metrics(long, "y", "p", threshold, keys).drop("n_pos"), keys)
        .join(metrics.brier_logloss(long, "y", "p", keys), keys)
    )
    return {
        "metrics": headline,
        "bootstrap": resampling.bootstrap_metrics(long, "y", "p", keys, replicates, seed, threshold),
        "reliability": metrics.reliability_bins(long, "y", "p", groups=keys),
        "decomposition": metrics.brier_decomposition(long, "y", "p", groups=keys),
        "operating_points": metrics.operating_points(long, "y", "p", groups=keys),
    }


def external_slices(preds: DataFrame, train: DataFrame) -> DataFrame:
    """External rows with the family-holdout flag, once per slice they belong to."""
    flagged = joins.join_holdout_flag(preds, train, gene_family)
    return splitting.expand_slices(flagged, {"full": True, "family_holdout": F.col("family_holdout")})


def external_calibration(preds: DataFrame, n_bins=15) -> DataFrame:
    """ECE and Brier parts per slice and per raw/calibrated score."""
    sliced = splitting.expand_slices(preds, {"full": True, "family_holdout": F.col("family_holdout")})
    long = sliced.select(
        "slice", F.col("label").alias("y"),
        F.explode(F.array(
            F.struct(F.lit("raw").alias("variant"), F.col("p_raw").alias("p")),
            F.struct(F.lit("calibrated").alias("variant"), F.col("p_calibrated").alias("p")),
        )).alias("e"),
    ).select("slice", "y", "e.variant", "e.p")
    keys = ["slice", "variant"]
    counts = long.groupBy(*keys).agg(F.count_if(F.col("y") == 1).alias("n_pos"))
    return metrics.brier_decomposition(long, "y", "p", n_bins, "quantile", keys).join(counts, keys)
