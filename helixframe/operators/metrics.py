"""Binary-classifier metrics as grouped aggregations over distinct-score cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.constants import MIN_SLICE_ROWS, N_BINS, OPERATING_TARGETS, THRESHOLD_GRID
from helixframe.functions.scores import clip_prob, log_loss_term
from helixframe.operators.ordered import CELLS_PER_WINDOW, block_cuts, exact_quantiles, running_sums, with_block
from helixframe.session import small_side


def score_cells(df: DataFrame, y: str, score: str, groups: Sequence[str] = (), count: str | None = None) -> DataFrame:
    """One row per (group, distinct score): `score, pos, neg`. Hot scores combine map-side. A row stands
    for as many as its column `count` says."""
    n = F.lit(1) if count is None else F.col(count)
    return (
        df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
        .groupBy(*groups, F.col(score).cast("double").alias("score"))
        .agg(
            F.sum(n * F.col(y).cast("bigint")).alias("pos"),
            F.sum(n * (1 - F.col(y).cast("bigint"))).alias("neg"),
        )
    )


def curve_cells(df, y, score, groups=(), splits=None, count=None) -> DataFrame:
    """Cells with counts at or above each score: `tp, fp, pos_total, neg_total`."""
    cells = score_cells(df, y, score, groups, count)
    run = running_sums(cells, "score", ["pos", "neg"], groups, descending=True, splits=splits)
    return run.withColumn("tp", F.col("pos_before") + F.col("pos")).withColumn(
        "fp", F.col("neg_before") + F.col("neg")
    )


def _auc_terms() -> list[Column]:
    pos, neg = F.col("pos"), F.col("neg")
    return [
        F.sum(pos * (F.col("neg_total") - F.col("neg_before") - neg / 2)).alias("_u"),
        F.sum(pos * (F.col("tp") / (F.col("tp") + F.col("fp")))).alias("_ap"),
        F.max("pos_total").alias("_p"),
        F.max("neg_total").alias("_q"),
    ]


def ranking_metrics(df, y="y", score="p", groups=(), splits=None, count=None) -> DataFrame:
    """Mann-Whitney AUC with ties and step-wise average precision, one row per group.

    Both are NULL for single-class groups. `count` names a column of how many rows a row stands for.
    """
    return _ranking_of(curve_cells(df, y, score, groups, splits, count), groups)


def _ranking_of(curve: DataFrame, groups: Sequence[str]) -> DataFrame:
    agg = curve.groupBy(*groups).agg(*_auc_terms())
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    return agg.select(
        *groups,
        (F.col("_p") + F.col("_q")).alias("n"),
        F.col("_p").alias("n_pos"),
        F.when(both, F.col("_u") / (F.col("_p") * F.col("_q"))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("_p")).alias("pr_auc"),
    )


def ranking_in_blocks(df, y="y", score="p", groups=(), limit: int = CELLS_PER_WINDOW) -> DataFrame:
    """`ranking_metrics` where scores hardly repeat, so that cells are about as many as rows.

    Rows are dealt once, by group and block of scores; cells and running sums are made in the block, from the
    counts of the blocks above. A score that fills blocks is one by itself and combines map-side. `df` is
    read several times and should be a written table.
    """
    groups = list(groups)
    rows = df.select(*groups, F.col(y).cast("bigint").alias("_y"), F.col(score).cast("double").alias("score")).filter(
        F.col("score").isNotNull() & F.col("_y").isNotNull())
    splits, hot = block_cuts(rows, "score", limit)
    if not splits:
        return ranking_metrics(rows, "_y", "score", groups)
    keys = [*groups, "_block"]
    rows = with_block(rows, "score", splits)
    is_hot = F.col("score").isin(*hot) if hot else F.lit(False)
    counts = [F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")]
    inside = W.partitionBy(*keys).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    dealt = rows.filter(~is_hot).repartition(*keys).groupBy(*keys, "score").agg(*counts)
    cells = dealt.withColumns({f"_{m}_in": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in ("pos", "neg")})
    if hot:
        alone = rows.filter(is_hot).groupBy(*keys, "score").agg(*counts)
        cells = cells.unionByName(alone.withColumns({f"_{m}_in": F.lit(0).cast("bigint") for m in ("pos", "neg")}))
    whole = W.partitionBy(*(groups or [F.lit(0)]))
    above = whole.orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys).agg(F.sum("_y").alias("_pos"), F.sum(1 - F.col("_y")).alias("_neg")).select(
        *keys, *[F.coalesce(F.sum(f"_{m}").over(above), F.lit(0)).alias(f"_{m}_off") for m in ("pos", "neg")],
        *[F.sum(f"_{m}").over(whole).alias(f"{m}_total") for m in ("pos", "neg")])
    curve = cells.join(small_side(totals), keys).withColumns({f"{m}_before": F.col(f"_{m}_in") + F.col(f"_{m}_off") for m in ("pos", "neg")})
    return _ranking_of(curve.withColumns({"tp": F.col("pos_before") + F.col("pos"), "fp": F.col("neg_before") + F.col("neg")}), groups)


def roc_auc(df, y="y", score="p", groups=(), splits=None) -> DataFrame:
    return ranking_metrics(df, y, score, groups, splits).select(*groups, "n", "n_pos", "roc_auc")


def average_precision(df, y="y", score="p", groups=(), splits=None) -> DataFrame:
    return ranking_metrics(df, y, score, groups, splits).select(*groups, "n", "n_pos", "pr_auc")


def rate(a: Column, b: Column) -> Column:
    """a / b with 0 for an empty denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def matthews(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    d = [c.cast("double") for c in (tp, fp, fn, tn)]
    tp, fp, fn, tn = d
    return rate(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))


def confusion_metrics(df, y="y", score="p", threshold=0.5, groups=()) -> DataFrame:
    """Counts and threshold metrics in one aggregate."""
    call = clip_prob(F.col(score)) >= threshold
    yes = F.col(y) == 1
    counts = df.groupBy(*groups).agg(
        F.count_if(yes & call).alias("tp"),
        F.count_if(~yes & call).alias("fp"),
        F.count_if(yes & ~call).alias("fn"),
        F.count_if(~yes & ~call).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall, specificity = rate(tp, tp + fn), rate(tn, tn + fp)
    return counts.select(
        *groups,
        F.lit(float(threshold)).alias("threshold"),
        "tn", "fp", "fn", "tp",
        rate(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        rate(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        rate(2 * tp, 2 * tp + fp + fn).alias("f1"),
        matthews(tp, fp, fn, tn).alias("mcc"),
        (tp + tn + fp + fn).alias("support"),
        (tp + fn).alias("n_pos"),
        (tn + fp).alias("n_neg"),
    )


def brier_logloss(df, y="y", score="p", groups=()) -> DataFrame:
    p = clip_prob(F.col(score))
    return df.groupBy(*groups).agg(
        F.avg((p - F.col(y)) ** 2).alias("brier_loss"),
        F.avg(log_loss_term(F.col(y), F.col(score))).alias("log_loss"),
    )


def roc_points(df, y="y", score="p", groups=(), splits=None) -> DataFrame:
    run = curve_cells(df, y, score, groups, splits)
    return run.select(
        *groups,
        F.col("score").alias("threshold"),
        rate(F.col("fp"), F.col("neg_total")).alias("fpr"),
        rate(F.col("tp"), F.col("pos_total")).alias("tpr"),
    )


def pr_points(df, y="y", score="p", groups=(), splits=None) -> DataFrame:
    run = curve_cells(df, y, score, groups, splits)
    return run.select(
        *groups,
        F.col("score").alias("threshold"),
        rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        rate(F.col("tp"), F.col("pos_total")).alias("recall"),
    )


def threshold_grid(low=THRESHOLD_GRID[0], high=THRESHOLD_GRID[1], steps=THRESHOLD_GRID[2]):
    step = (high - low) / (steps - 1)
    return [low + i * step for i in range(steps - 1)] + [high]


def threshold_sweep(df, y="y", score="p", grid=None, groups=()) -> DataFrame:
    """F1, precision and recall at each grid threshold.

    Rows are counted once into len(grid)+1 buckets; the thresholds only meet that small table.
    """
    grid = threshold_grid() if grid is None else list(grid)
    cut = Bucketizer(splits=[-math.inf, *grid, math.inf], inputCol="_s", outputCol="_bucket")
    shaped = df.filter(F.col(score).isNotNull()).withColumn("_s", F.col(score).cast("double"))
    buckets = (
        cut.transform(shaped)
        .groupBy(*groups, "_bucket")
        .agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))
        .groupBy(*groups)
        .agg(F.collect_list(F.struct("_bucket", "pos", "neg")).alias("counts"))
        .select(*groups, "counts", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "threshold"))
    )

    def above(field):
        kept = F.filter("counts", lambda c: c["_bucket"] > F.col("i"))
        return F.aggregate(kept, F.lit(0).cast("bigint"), lambda acc, c: acc + c[field])

    everyone = F.aggregate("counts", F.lit(0).cast("bigint"), lambda acc, c: acc + c["pos"])
    counted = buckets.select(
        *groups, "threshold", above("pos").alias("tp"), above("neg").alias("fp"), everyone.alias("p")
    )
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("p")
    return counted.select(
        *groups,
        "threshold",
        rate(2 * tp, tp + fp + p).alias("f1"),
        rate(tp, tp + fp).alias("precision"),
        rate(tp, p).alias("recall"),
    )


def best_threshold(df, y="y", score="p", grid=None, groups=()) -> DataFrame:
    """First threshold with the highest F1."""
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold")))
    return (
        threshold_sweep(df, y, score, grid, groups)
        .groupBy(*groups)
        .agg(best.alias("best"))
        .select(*groups, F.col("best.threshold").alias("threshold"), F.col("best.f1").alias("f1"))
    )


def operating_points(df, y="y", score="p", targets=OPERATING_TARGETS, groups=()) -> DataFrame:
    """Best precision under each recall target and best recall under each precision target."""
    points = pr_points(df, y, score, groups)
    aggs, names = [], []
    for bound, goal in (("recall", "precision"), ("precision", "recall")):
        for t in targets:
            key = F.struct(F.col(goal).alias("goal"), (-F.col("threshold")).alias("low"))
            pick = F.max_by(
                F.struct("threshold", "precision", "recall"), F.when(F.col(bound) >= t, key)
            )
            names.append(f"{bound}>={t:.2f}")
            aggs.append(pick.alias(f"_{len(names)}"))
    wide = points.groupBy(*groups).agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("constraint"), F.col(f"_{i + 1}").alias("at"))
            for i, n in enumerate(names)
        ]
    )
    return wide.select(*groups, F.explode(rows).alias("r")).select(
        *groups,
        "r.constraint",
        F.col("r.at.threshold").alias("threshold"),
        F.col("r.at.precision").alias("precision"),
        F.col("r.at.recall").alias("recall"),
        F.col("r.at").isNotNull().alias("achieved"),
    )


def even_grid(n_bins: int) -> list[float]:
    """0, 1/n, ..., 1 as multiples of the step (the usual floating-point linear grid)."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def probability_cells(df, y, score, groups) -> DataFrame:
    cells = score_cells(df.withColumn("_p", clip_prob(F.col(score))), y, "_p", groups)
    return cells.withColumn("n", F.col("pos") + F.col("neg"))


def reliability_bins(df, y="y", score="p", n_bins=N_BINS, strategy="quantile", groups=()) -> DataFrame:
    """Calibration curve per group: edges, count, mean probability, positive rate, gap.

    Quantile edges come from the same cells as the bins; empty bins are left out.
    """
    groups = list(groups)
    if not groups:
        keyed = df.withColumn("_all", F.lit(1))
        return reliability_bins(keyed, y, score, n_bins, strategy, ["_all"]).drop("_all")
    cells = probability_cells(df, y, score, groups)
    if strategy == "quantile":
        inner = even_grid(n_bins)[1:-1]
        edges = exact_quantiles(cells, "score", inner, groups, cells=cells).select(
            *groups,
            F.array(F.lit(0.0), *[F.col(f"q{i}") for i in range(n_bins - 1)], F.lit(1.0)).alias("edges"),
        )
        cells = cells.join(edges, groups)
    else:
        cells = cells.withColumn("edges", F.array(*[F.lit(e) for e in even_grid(n_bins)]))
    inside = F.slice("edges", 2, n_bins - 1)
    binned = cells.withColumn("bin", F.size(F.filter(inside, lambda e: e <= F.col("score"))))
    bins = binned.groupBy(*groups, "bin").agg(
        F.first("edges").alias("edges"),
        F.sum("n").alias("count"),
        F.sum(F.col("score") * F.col("n")).alias("_sp"),
        F.sum("pos").alias("_pos"),
    )
    mean_p, rate_y = F.col("_sp") / F.col("count"), F.col("_pos") / F.col("count")
    return bins.select(
        *groups,
        "bin",
        F.get("edges", F.col("bin")).alias("edge_low"),
        F.get("edges", F.col("bin") + 1).alias("edge_high"),
        "count",
        mean_p.alias("mean_predicted_prob"),
        rate_y.alias("fraction_positive"),
        F.abs(mean_p - rate_y).alias("gap"),
    )


def brier_decomposition(df, y="y", score="p", n_bins=N_BINS, strategy="quantile", groups=()) -> DataFrame:
    """Murphy parts, ECE, MCE and the recomposition residual, one row per group."""
    groups = list(groups)
    if not groups:
        keyed = df.withColumn("_all", F.lit(1))
        return brier_decomposition(keyed, y, score, n_bins, strategy, ["_all"]).drop("_all")
    overall = probability_cells(df, y, score, groups).groupBy(*groups).agg(
        F.sum("n").alias("n"),
        (F.sum("pos") / F.sum("n")).alias("_ybar"),
        (
            F.sum(F.col("pos") * (1 - F.col("score")) ** 2 + F.col("neg") * F.col("score") ** 2)
            / F.sum("n")
        ).alias("brier"),
    )
    bins = reliability_bins(df, y, score, n_bins, strategy, groups).join(overall, groups)
    w = F.col("count") / F.col("n")
    parts = bins.groupBy(*groups).agg(
        F.max("n").alias("n"),
        F.max("_ybar").alias("_ybar"),
        F.max("brier").alias("brier"),
        F.sum(w * F.col("gap") ** 2).alias("reliability"),
        F.sum(w * (F.col("fraction_positive") - F.col("_ybar")) ** 2).alias("resolution"),
        F.sum(w * F.col("gap")).alias("ece"),
        F.max("gap").alias("mce"),
    )
    return parts.withColumn("uncertainty", F.col("_ybar") * (1 - F.col("_ybar"))).select(
        *groups, "n", "brier", "reliability", "resolution", "uncertainty", "ece", "mce",
        (F.col("brier") - (F.col("reliability") - F.col("resolution") + F.col("uncertainty"))).alias(
            "residual"
        ),
    )


def guarded_ranking(df, y="y", score="p", groups=(), min_rows=MIN_SLICE_ROWS) -> DataFrame:
    """Ranking metrics per slice; small or single-class slices keep counts and carry a note."""
    m = ranking_metrics(df, y, score, groups)
    ok = (F.col("n") >= min_rows) & (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return m.select(
        *groups, "n", "n_pos",
        F.when(ok, F.col("roc_auc")).alias("roc_auc"),
        F.when(ok, F.col("pr_auc")).alias("pr_auc"),
        F.when(ok, "").otherwise("too few or single-class").alias("note"),
    )
