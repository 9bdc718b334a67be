"""Attribution tables (one row per key, one column per feature) and metric reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.cleaning import filter_confident_errors


def attribution_ranking(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean absolute attribution per feature, ranked. One wide aggregate, then a small unpivot."""
    wide = df.agg(*[F.avg(F.abs(F.col(f"`{f}`"))).alias(f) for f in features])
    long = wide.unpivot([], list(features), "feature", "mean_abs")
    # features are columns, so this window is bounded by the table width
    ranked = F.row_number().over(_by_size())
    return long.withColumn("rank", ranked)


def _by_size():
    from pyspark.sql import Window as W

    return W.partitionBy(F.lit(0)).orderBy(F.col("mean_abs").desc(), "feature")


def top_features(features: Sequence[str], k=3):
    """Array of the k (feature, value) pairs with the largest magnitude in a row."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("value")) for f in features])

    def larger(a, b):
        x, y = F.abs(a["value"]), F.abs(b["value"])
        return (
            F.when(x > y, -1).when(x < y, 1)
            .when(a["feature"] < b["feature"], -1).when(a["feature"] > b["feature"], 1).otherwise(0)
        )

    return F.slice(F.array_sort(pairs, larger), 1, k)


def topk_per_row(df: DataFrame, key: str, features: Sequence[str], k=3) -> DataFrame:
    picked = df.select(key, F.posexplode(top_features(features, k)).alias("i", "t"))
    return picked.select(
        key, (F.col("i") + 1).alias("rank"), F.col("t.feature").alias("feature"), F.col("t.value").alias("value")
    )


def explained_errors(attributions, predictions, features, key="variant_key", y="y", p="p") -> DataFrame:
    """Confident errors with their type and three leading features."""
    errors = filter_confident_errors(predictions, y, p)
    joined = errors.join(attributions.select(key, *[F.col(f"`{f}`") for f in features]), key)
    tops = joined.withColumn("_t", top_features(features, 3))
    return tops.select(
        *[c for c in errors.columns],
        *[
            e
            for i in range(3)
            for e in (
                F.get("_t", F.lit(i))["feature"].alias(f"top{i + 1}_feature"),
                F.get("_t", F.lit(i))["value"].alias(f"top{i + 1}_value"),
            )
        ],
    )


def attribution_top_counts(explained: DataFrame, error_type="false_negative", k=6) -> DataFrame:
    return (
        explained.filter(F.col("error_type") == error_type)
        .groupBy("top1_feature").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "top1_feature").limit(k)
    )


def attribution_join(attributions, predictions, features, key="variant_key", y="y", p="p", above=0.95, k=5):
    """Leading k features of every confidently called positive, in long form."""
    sure = predictions.filter((F.col(y) == 1) & (F.col(p) > above))
    joined = sure.select(key, y, p).join(attributions, key)
    return topk_per_row(joined, key, features, k)


def topk_global(df: DataFrame, by: str, k: int, tiebreak: str) -> DataFrame:
    """First k rows by a descending column with their rank number."""
    from pyspark.sql import Window as W

    top = df.orderBy(F.col(by).desc_nulls_last(), tiebreak).limit(k)
    return top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col(by).desc_nulls_last(), tiebreak)))


def metric_report_merge(calibration: DataFrame, bootstrap: DataFrame, limit=0.01) -> DataFrame:
    """Calibration and bootstrap metrics per (phase, eval_set) with the ECE change of the second
    phase against the first and a verdict."""
    both = calibration.join(bootstrap, ["phase", "eval_set"])
    base = calibration.filter(F.col("phase") == "phase1").select("eval_set", F.col("ece").alias("_base"))
    out = both.join(base, "eval_set", "left").withColumn("delta_ece", F.col("ece") - F.col("_base"))
    return out.drop("_base").withColumn(
        "verdict", F.when(F.col("delta_ece") > limit, "worse").otherwise("ok")
    )


def stack_deltas(tables: Sequence[tuple[str, str, DataFrame]]) -> DataFrame:
    """(comparison, test name, table) triples stacked under common column names."""
    out = None
    for comparison, test, t in tables:
        rows = t.select(
            F.lit(comparison).alias("comparison"), "metric", "delta", "ci_lo", "ci_hi", "p_value",
            F.lit(test).alias("test"), F.col("n_samples").alias("n"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def metric_drift_check(current: DataFrame, stored: DataFrame, on: Sequence[str], value="value", tol=1e-3) -> DataFrame:
    pair = current.select(*on, F.col(value).alias("current")).join(
        stored.select(*on, F.col(value).alias("stored")), list(on), "full"
    )
    gap = F.abs(F.col("current") - F.col("stored"))
    return pair.withColumn("drift", gap).withColumn("within", F.coalesce(gap < tol, F.lit(False)))
