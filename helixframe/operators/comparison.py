"""Comparing scores: DeLong, Holm, rank fusion, slices, coverage, error strata."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.constants import CLASS_NAMES, Z_95
from helixframe.functions.residues import aa_class
from helixframe.functions.scores import two_sided_normal, two_sided_student
from helixframe.operators.metrics import guarded_ranking, ranking_in_blocks, ranking_metrics, rate
from helixframe.operators.ordered import exact_quantiles, mid_ranks, ordinal_ranks, running_sums
from helixframe.operators.resampling import bootstrap_metrics, paired_bootstrap_delta
from helixframe.session import cut_lineage


def _placements(cells: DataFrame, score: str, name: str, groups) -> DataFrame:
    """Per distinct score: share of negatives below (for positives) and positives below."""
    per = cells.groupBy(*groups, F.col(score).alias(f"_{name}")).agg(
        F.sum(F.col("n") * F.col("y")).alias("pos"), F.sum(F.col("n") * (1 - F.col("y"))).alias("neg")
    )
    run = running_sums(per, f"_{name}", ["pos", "neg"], groups)
    return run.select(
        *groups, f"_{name}",
        F.try_divide(F.col("neg_before") + F.col("neg") / 2, F.col("neg_total")).alias(f"v01_{name}"),
        (1 - F.try_divide(F.col("pos_before") + F.col("pos") / 2, F.col("pos_total"))).alias(f"v10_{name}"),
    )


def delong_test(df, y="y", score_a="p_a", score_b="p_b", groups=(), with_pvalue=True) -> DataFrame:
    """Paired DeLong test of AUC(a) - AUC(b), one row per group.

    The placement values depend on the distinct scores only, and the variance of their
    difference needs sums over distinct (label, a, b) cells, so no row-level ranking is made.
    """
    groups = list(groups)
    cells = (
        df.filter(F.col(score_a).isNotNull() & F.col(score_b).isNotNull())
        .groupBy(*groups, F.col(y).cast("bigint").alias("y"),
                 F.col(score_a).cast("double").alias("a"), F.col(score_b).cast("double").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    both = cells = cut_lineage(cells)  # three passes over the cells, one over the rows
    for name in ("a", "b"):
        place = _placements(cells, name, name, groups).withColumnsRenamed({g: f"_g{i}" for i, g in enumerate(groups)})
        on = F.col(name) == F.col(f"_{name}")
        for i, g in enumerate(groups):
            on = on & (F.col(g) == F.col(f"_g{i}"))
        both = both.join(place, on).drop(f"_{name}", *[f"_g{i}" for i in range(len(groups))])
    yes = F.col("y") == 1
    w = F.col("n")
    d01, d10 = F.col("v01_a") - F.col("v01_b"), F.col("v10_a") - F.col("v10_b")

    def total(cond, value):
        return F.sum(F.when(cond, value))

    s = both.groupBy(*groups).agg(
        total(yes, w).alias("m"), total(~yes, w).alias("k"),
        total(yes, w * F.col("v01_a")).alias("a1"), total(yes, w * F.col("v01_b")).alias("b1"),
        total(yes, w * d01).alias("d1"), total(yes, w * d01 * d01).alias("dd1"),
        total(~yes, w * d10).alias("d0"), total(~yes, w * d10 * d10).alias("dd0"),
    )

    def var(sx, sxx, n):
        return F.try_divide(F.col(sxx) - F.col(sx) * F.col(sx) / F.col(n), F.col(n) - 1)

    out = s.select(
        *groups,
        (F.col("a1") / F.col("m")).alias("auc1"),
        (F.col("b1") / F.col("m")).alias("auc2"),
        (F.col("a1") / F.col("m") - F.col("b1") / F.col("m")).alias("delta"),
        (var("d1", "dd1", "m") / F.col("m") + var("d0", "dd0", "k") / F.col("k")).alias("_v"),
    )
    ok = F.col("_v") > 1e-18
    out = out.withColumn("delta_se", F.when(ok, F.sqrt("_v")).otherwise(0.0)).withColumns(
        {
            "delta_ci_lo": F.col("delta") - Z_95 * F.col("delta_se"),
            "delta_ci_hi": F.col("delta") + Z_95 * F.col("delta_se"),
            "z": F.when(ok, F.try_divide(F.col("delta"), F.col("delta_se"))),
        }
    ).drop("_v")
    return out.withColumn("p_value", two_sided_normal(F.col("z"))) if with_pvalue else out


def holm_adjust(df: DataFrame, p="p_value", metric="metric", order: Sequence[str] = (), out="p_holm") -> DataFrame:
    """Step-down adjustment inside each metric family."""
    family = W.partitionBy(metric)
    place = F.row_number().over(family.orderBy(p, *order))
    m = F.count(F.lit(1)).over(family)
    return (
        df.withColumn("_step", (m - place + 1) * F.col(p))
        .withColumn(
            out,
            F.least(F.lit(1.0), F.max("_step").over(
                family.orderBy(p, *order).rowsBetween(W.unboundedPreceding, 0))),
        )
        .drop("_step")
    )


def pairwise_tests(
    df, pairs: Sequence[tuple[str, str]], y="y", replicates=1000, seed=42, placeholders: Sequence[tuple[str, str, str]] = ()
) -> DataFrame:
    """One DeLong row and one paired-bootstrap row per score pair, Holm-adjusted per metric.

    Rows must carry every score of a pair. `placeholders` are (a, b, reason) pairs that cannot be
    run and are kept as rows with a status.
    """
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                     F.col(a).cast("double").alias("p_a"), F.col(b).cast("double").alias("p_b"))
            for a, b in pairs
        ]
    )
    long = df.select(y, F.explode(rows).alias("r")).select(y, "r.*")
    keys = ["model_a", "model_b"]
    roc = delong_test(long, y, groups=keys).select(
        *keys, F.lit("roc_auc").alias("metric"), F.col("auc1").alias("estimate_a"), F.col("auc2").alias("estimate_b"),
        "delta", F.col("delta_ci_lo").alias("ci_lo"), F.col("delta_ci_hi").alias("ci_hi"), "p_value",
    )
    pr = paired_bootstrap_delta(
        long, y, groups=keys, replicates=replicates, seed=seed, metrics=("pr_auc",), alternative="two-sided-complement"
    ).select(*keys, "metric", "estimate_a", "estimate_b", "delta", "ci_lo", "ci_hi", "p_value")
    out = holm_adjust(roc.unionByName(pr), order=keys).withColumn("status", F.lit("computed"))
    if placeholders:
        missing = df.sparkSession.createDataFrame(list(placeholders), "model_a string, model_b string, status string")
        names = F.explode(F.array(F.lit("roc_auc"), F.lit("pr_auc"))).alias("metric")
        out = out.unionByName(
            missing.select("model_a", "model_b", names, F.concat(F.lit("not-computed: "), "status").alias("status")),
            allowMissingColumns=True,
        )
    return out


def rank_pct(df: DataFrame, score: str, out: str, groups=()) -> DataFrame:
    """Average rank divided by the number of scored rows; NULL stays NULL."""
    ranked = mid_ranks(df, score, groups, "_rk")
    return ranked.withColumn(out, F.col("_rk") / F.col("_rk_n")).drop("_rk", "_rk_n")


def rank_neutral(df: DataFrame, score: str, key: str, out: str, groups=()) -> DataFrame:
    """Ordinal rank scaled to [0, 1]; unscored rows sit at 0.5."""
    ranked = ordinal_ranks(df, score, key, groups, "_rk")
    scaled = F.col("_rk") / F.greatest(F.col("_rk_n") - 1, F.lit(1))
    return ranked.withColumn(out, F.coalesce(scaled, F.lit(0.5))).drop("_rk", "_rk_n")


def fuse(first, second, alpha):
    """Alpha weighs the second score."""
    return (1.0 - alpha) * first + alpha * second


def alpha_grid(steps=41):
    return [i / (steps - 1) for i in range(steps)]


def fusion_sweep(ranked: DataFrame, y="y", first="r1", second="r2", alphas=None) -> DataFrame:
    """AUC and average precision of the fused rank for each alpha. `ranked` is read several times and should
    be a written table."""
    alphas = alpha_grid() if alphas is None else alphas
    weights = F.array(*[F.lit(float(a)) for a in alphas])
    rows = ranked.select(y, first, second, F.posexplode(weights).alias("_at", "alpha")).select(
        "_at", y, fuse(F.col(first), F.col(second), F.col("alpha")).alias("fused")
    )
    found = ranking_in_blocks(rows, y, "fused", ["_at"])  # a double as a group would be dealt again for its zeros
    return found.select(F.get(weights, F.col("_at")).alias("alpha"), "n", "n_pos", "roc_auc", "pr_auc")


def best_alpha(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.max_by("alpha", F.struct("pr_auc", -F.col("alpha"))).alias("alpha"))


def rank_fusion(df, key, y="y", first="p", second="s", second_higher_is_positive=False, tune="val", test="test") -> DataFrame:
    """Tune alpha on one split by average precision, report four models on the other."""
    sign = F.col(second) if second_higher_is_positive else -F.col(second)
    rows = df.filter(F.col("split").isin(tune, test)).withColumn("_s2", sign)
    ranked = rank_neutral(rank_neutral(rows, first, key, "r1", ["split"]), "_s2", key, "r2", ["split"])
    # ranks feed the sweep, the tuned model and the median: compute them once
    ranked = cut_lineage(ranked.select("split", y, first, "_s2", "r1", "r2"))
    sweep = fusion_sweep(ranked.filter(F.col("split") == tune), y)
    alpha = float(best_alpha(sweep).first()[0])
    held = ranked.filter(F.col("split") == test)
    middle = exact_quantiles(held, "_s2", [0.5]).first()["q0"]
    models = F.array(
        F.struct(F.lit("first").alias("model"), F.col(first).cast("double").alias("v"), F.lit(None).cast("double").alias("alpha")),
        F.struct(F.lit("second").alias("model"), F.coalesce(F.col("_s2"), F.lit(middle)).cast("double").alias("v"), F.lit(None).cast("double").alias("alpha")),
        F.struct(F.lit("fusion_uniform").alias("model"), fuse(F.col("r1"), F.col("r2"), 0.5).alias("v"), F.lit(0.5).alias("alpha")),
        F.struct(F.lit("fusion_tuned").alias("model"), fuse(F.col("r1"), F.col("r2"), alpha).alias("v"), F.lit(alpha).alias("alpha")),
    )
    long = held.select(y, F.explode(models).alias("m")).select(y, "m.model", "m.v", "m.alpha")
    scored = ranking_metrics(long, y, "v", ["model"])
    return scored.join(long.groupBy("model").agg(F.max("alpha").alias("alpha")), "model")


def scale01(df: DataFrame, score: str, groups=(), out="scaled") -> DataFrame:
    """Min-max scaling inside each group; a constant group becomes 0."""
    span = df.groupBy(*groups).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    joined = df.join(span, list(groups) if groups else F.lit(True))
    value = F.try_divide(F.col(score) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return joined.withColumn(
        out, F.when(F.col(score).isNotNull(), F.coalesce(value, F.lit(0.0)))
    ).drop("_lo", "_hi")


def long_scores(df: DataFrame, keep: Sequence[str], scores: Sequence[str], name="score_name", value="score") -> DataFrame:
    return df.select(*keep, *[F.col(s).cast("double").alias(s) for s in scores]).unpivot(
        list(keep), list(scores), name, value
    )


def grouped_scores(long: DataFrame, groups: Sequence[str], y="y", score="score", replicates=0, seed=42) -> DataFrame:
    """Guarded AUC/AP and coverage per group of a long score table, with bootstrap intervals
    when `replicates` > 0."""
    groups = list(groups)
    if replicates:
        long = cut_lineage(long.select(*groups, y, score))
    cover = long.groupBy(*groups).agg(F.avg(F.col(score).isNotNull().cast("double")).alias("coverage"))
    out = guarded_ranking(long, y, score, groups).join(cover, groups, "right")
    out = out.withColumns(
        {
            "n": F.coalesce("n", F.lit(0)), "n_pos": F.coalesce("n_pos", F.lit(0)),
            "note": F.coalesce("note", F.lit("too few or single-class")),
        }
    )
    if replicates:
        scaled = scale01(long.filter(F.col(score).isNotNull()), score, groups, "_scaled")
        boot = bootstrap_metrics(scaled, y, "_scaled", groups, replicates, seed)
        wide = boot.groupBy(*groups).agg(
            *[
                F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}")
                for m in ("roc_auc", "pr_auc") for c in ("ci_lo", "ci_hi")
            ]
        )
        out = out.join(wide, groups, "left")
        for m in ("roc_auc", "pr_auc"):
            for c in ("ci_lo", "ci_hi"):
                out = out.withColumn(f"{m}_{c}", F.when(F.col("note") == "", F.col(f"{m}_{c}")))
    return out


def matched_coverage(df: DataFrame, y: str, scores: Sequence[str], anchor: str, **more) -> DataFrame:
    """All scores on the rows that `anchor` covers."""
    rows = df.filter(F.col(anchor).isNotNull())
    return grouped_scores(long_scores(rows, [y], scores), ["score_name"], y, **more)


def matched_coverage_tests(df: DataFrame, reference: str, others: Sequence[str], anchor: str, **more) -> DataFrame:
    """The reference score against each other one, paired (DeLong, bootstrap of the average
    precision, Holm), on the rows that `anchor` covers."""
    return pairwise_tests(df.filter(F.col(anchor).isNotNull()), [(reference, o) for o in others], **more)


def intersection_subset(df: DataFrame, y: str, scores: Sequence[str], **more) -> DataFrame:
    """All scores on the rows every score covers, with coverage before the cut."""
    rows = df
    for s in scores:
        rows = rows.filter(F.col(s).isNotNull())
    before = df.agg(
        F.count(F.lit(1)).alias("n_all"), *[F.count(s).alias(f"_c{i}") for i, s in enumerate(scores)]
    )
    shares = before.select(
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("score_name"), (F.col(f"_c{i}") / F.col("n_all")).alias("own_coverage"), "n_all")
            for i, s in enumerate(scores)
        ])).alias("r")
    ).select("r.*")
    inside = grouped_scores(long_scores(rows, [y], scores), ["score_name"], y, **more).drop("coverage")
    return inside.join(F.broadcast(shares), "score_name").withColumn(
        "common_coverage", F.col("n") / F.col("n_all")
    ).drop("n_all")


def with_errors(df: DataFrame, y="y", p="p", threshold=0.5) -> DataFrame:
    call = F.col(p) >= threshold
    return df.withColumns(
        {
            "is_fn": ((F.col(y) == 1) & ~call).cast("int"),
            "is_fp": ((F.col(y) == 0) & call).cast("int"),
            "confident_error": (F.abs(F.col(p) - F.col(y)) > 0.5).cast("int"),
        }
    )


def errors_by_group(df, group, y="y", p="p", threshold=0.5, k=10) -> DataFrame:
    """Largest k groups: size, positives, AUC, miss and false-alarm rates."""
    rows = with_errors(df, y, p, threshold)
    stats = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("n_pos"),
        F.sum("is_fn").alias("_fn"), F.sum("is_fp").alias("_fp"),
    )
    top = stats.orderBy(F.col("n").desc(), group).limit(k)
    auc = ranking_metrics(rows.join(F.broadcast(top.select(group)), group, "left_semi"), y, p, [group])
    return top.join(auc.select(group, "roc_auc"), group).select(
        group, "n", "n_pos", "roc_auc",
        rate(F.col("_fn"), F.col("n_pos")).alias("fn_rate"),
        rate(F.col("_fp"), F.col("n") - F.col("n_pos")).alias("fp_rate"),
    )


def errors_by_class_pair(df, ref="ref_aa", alt="alt_aa", y="y", p="p", threshold=0.5) -> DataFrame:
    """Miss rate of positives for each of the 36 residue-class pairs; empty cells are kept."""
    rows = with_errors(df.filter(F.col(y) == 1), y, p, threshold)
    cells = rows.select(aa_class(F.col(ref)).alias("ref_class"), aa_class(F.col(alt)).alias("alt_class"), "is_fn")
    stats = cells.groupBy("ref_class", "alt_class").agg(
        F.count(F.lit(1)).alias("n"), F.avg("is_fn").alias("fn_rate")
    )
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    grid = df.sparkSession.range(1).select(F.explode(names).alias("ref_class")).select(
        "ref_class", F.explode(names).alias("alt_class")
    )
    return grid.join(stats, ["ref_class", "alt_class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def errors_by_quintile(df, value, y="y", p="p", parts=5) -> DataFrame:
    """Confident errors per equal-count bin of a feature; bins are right-closed, the first
    includes its lower edge."""
    rows = with_errors(df, y, p)
    edges = exact_quantiles(df, value, [i / parts for i in range(parts + 1)]).first()
    inner = [edges[f"q{i}"] for i in range(1, parts)]
    at = F.lit(0)
    for e in inner:
        at = at + (F.col(value) > F.lit(e)).cast("int")
    binned = rows.filter(F.col(value).isNotNull()).withColumn("bin", F.concat(F.lit("Q"), (at + 1).cast("string")))
    wrong = F.col("confident_error") == 1
    stats = binned.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("n_pos"),
        F.count_if(wrong & (F.col(y) == 1)).alias("confident_fn"),
        F.count_if(wrong & (F.col(y) == 0)).alias("confident_fp"),
    )
    return stats.withColumns(
        {
            "fn_rate": rate(F.col("confident_fn"), F.col("n_pos")),
            "fp_rate": rate(F.col("confident_fp"), F.col("n") - F.col("n_pos")),
        }
    )


def spearman_table(df: DataFrame, score: str, partners: Sequence[str], min_rows=100) -> DataFrame:
    """Spearman rho of one score with many columns over pairwise complete rows, with its two-sided
    p-value (Student's t with n - 2 degrees of freedom)."""
    shaped = df.select(F.col(score).cast("double").alias("_s"), *[F.col(c).cast("double").alias(c) for c in partners])
    long = shaped.unpivot(["_s"], list(partners), "partner", "value").filter(
        F.col("_s").isNotNull() & F.col("value").isNotNull()
    )
    cells = cut_lineage(long.groupBy("partner", "_s", "value").agg(F.count(F.lit(1)).alias("n")))

    def ranks(column, out):
        per = cells.groupBy("partner", F.col(column).alias(f"_{out}")).agg(F.sum("n").alias("n"))
        run = running_sums(per, f"_{out}", ["n"], ["partner"])
        return run.select(
            F.col("partner").alias(f"_p{out}"), f"_{out}",
            (F.col("n_before") + (F.col("n") + 1) / 2 - (F.col("n_total") + 1) / 2).alias(out),
        )

    x, y = ranks("_s", "rx"), ranks("value", "ry")
    both = cells.join(x, (F.col("partner") == F.col("_prx")) & (F.col("_s") == F.col("_rx"))).join(
        y, (F.col("partner") == F.col("_pry")) & (F.col("value") == F.col("_ry"))
    )
    w = F.col("n")
    sums = both.groupBy("partner").agg(
        F.sum("n").alias("n"),
        F.sum(w * F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(w * F.col("rx") ** 2).alias("xx"),
        F.sum(w * F.col("ry") ** 2).alias("yy"),
    )
    rho = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    out = sums.filter(F.col("n") >= min_rows).select("partner", "n", F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0)).alias("spearman_rho"))
    return out.withColumn("p_value", two_sided_student(F.col("spearman_rho") * F.col("spearman_rho"), F.col("n") - 2))
