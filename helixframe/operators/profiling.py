"""Data quality tables: one wide aggregate per pass, then a small unpivot."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.operators.ordered import column_quantiles, exact_quantiles, to_long
from helixframe.session import cut_lineage

NUMERIC = {"byte", "tinyint", "short", "smallint", "integer", "int", "long", "bigint", "float", "double", "decimal"}


def numeric_columns(df: DataFrame, with_bool=False, exclude: Sequence[str] = ()) -> list[str]:
    kinds = NUMERIC | ({"boolean"} if with_bool else set())
    return [
        f.name for f in df.schema.fields
        if f.dataType.typeName().split("(")[0] in kinds and f.name not in exclude
    ]


def column_table(columns: Sequence[str], fields: dict[str, list[Column]]) -> Column:
    """Array of structs (one per column) to explode a one-row wide aggregate to long form."""
    return F.array(
        *[
            F.struct(F.lit(c).alias("column"), *[fields[name][i].alias(name) for name in fields])
            for i, c in enumerate(columns)
        ]
    )


def _stack(wide: DataFrame, columns, fields) -> DataFrame:
    return wide.select(F.explode(column_table(columns, fields)).alias("r")).select("r.*")


def check_duplicates(df: DataFrame, key="variant_key", position=("chr", "pos"), top=10) -> dict[str, DataFrame]:
    """`summary` (one row), `keys` (top repeated keys) and `positions` (top crowded positions)."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    repeated = per_key.filter(F.col("n") > 1)
    # distinct keys per position: collapse (position, key) first so a hot position stays small
    per_pos = (
        df.select(*position, key).distinct().groupBy(*position)
        .agg(F.count(key).alias("unique_variants"))
        .filter(F.col("unique_variants") > 1)
    )
    a = repeated.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"),
        F.count(F.lit(1)).alias("duplicate_keys"),
    )
    b = per_pos.agg(F.count(F.lit(1)).alias("near_duplicate_positions"))
    return {
        "summary": a.join(b, F.lit(True)),
        "keys": repeated.orderBy(F.col("n").desc(), key).limit(top),
        "positions": per_pos.orderBy(F.col("unique_variants").desc(), *position).limit(top),
    }


def check_label_integrity(df: DataFrame, key="variant_key", label="label") -> DataFrame:
    """Missing labels, invalid labels, keys carrying more than one label; one row."""
    per_key = df.groupBy(key).agg(
        F.count_if(F.col(label).isNull()).alias("missing"),
        F.count_if(~F.col(label).isin(0, 1)).alias("invalid"),
        F.min(label).alias("low"),
        F.max(label).alias("high"),
    )
    return per_key.agg(
        F.sum("missing").alias("missing_labels"),
        F.sum("invalid").alias("invalid_labels"),
        F.count_if(F.col("low") < F.col("high")).alias("keys_with_both_labels"),
    )


def missing_pct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(columns)]
    )
    gap = [F.col("_n") - F.col(f"_c{i}") for i in range(len(columns))]
    return _stack(
        wide, columns,
        {"missing_count": gap, "missing_pct": [F.try_divide(g * 100.0, F.col("_n")) for g in gap]},
    )


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approximate=False) -> DataFrame:
    """Per column: type, missing count and share, distinct values, all-null and constant flags.

    The exact distinct counts come from one long (column, value) aggregation, which combines
    map-side; `approximate=True` keeps a single pass with sketches.
    """
    columns = list(columns or df.columns)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if approximate:
        wide = df.agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(columns)],
            *[F.approx_count_distinct(F.col(f"`{c}`")).alias(f"_d{i}") for i, c in enumerate(columns)],
        )
        index = range(len(columns))
        long = _stack(
            wide, columns,
            {
                "rows": [F.col("_n") for _ in index],
                "present": [F.col(f"_c{i}") for i in index],
                "distinct_values": [F.col(f"_d{i}") for i in index],
            },
        )
    else:
        text = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
        cells = text.unpivot([], columns, "column", "value").groupBy("column", "value").agg(
            F.count(F.lit(1)).alias("n")
        )
        long = cells.groupBy("column").agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("present"),
            F.count("value").alias("distinct_values"),
        )
    type_of = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(types[c]))])
    gap = F.col("rows") - F.col("present")
    return long.select(
        "column",
        F.try_element_at(type_of, F.col("column")).alias("dtype"),
        gap.alias("missing_count"),
        F.round(gap * 100.0 / F.col("rows"), 4).alias("missing_pct"),
        "distinct_values",
        (F.col("distinct_values") <= 1).alias("zero_variance"),
        (gap == F.col("rows")).alias("all_null"),
        (gap * 100.0 / F.col("rows") > 80.0).alias("high_missing"),
    )


def dead_columns(df: DataFrame, columns=None) -> list[str]:
    """All-null and constant columns, by one aggregate of minima and maxima; one row reaches the
    driver. Columns without an order are compared by their text."""
    columns = list(columns or df.columns)
    if not columns:
        return []
    plain = ("array", "map", "struct", "variant")

    def shaped(c):
        col = F.col(f"`{c}`")
        return F.to_json(F.struct(col)) if df.schema[c].dataType.typeName() in plain else col

    row = df.agg(*[
        (F.min(shaped(c)).isNull() | (F.min(shaped(c)) == F.max(shaped(c)))).alias(str(i)) for i, c in enumerate(columns)
    ]).first()
    return [c for i, c in enumerate(columns) if row[i]]


def drop_dead_columns(df: DataFrame, columns=None) -> DataFrame:
    return df.drop(*dead_columns(df, columns))


def columns_missing_over(df: DataFrame, limit_pct: float, columns: Sequence[str]) -> list[str]:
    rows = missing_pct(df, columns).filter(F.col("missing_pct") > limit_pct).select("column").collect()
    found = {r[0] for r in rows}
    return [c for c in columns if c in found]


def missingness_policy(df: DataFrame, columns: Sequence[str], warn=50.0, drop=80.0) -> DataFrame:
    """Action per column: `keep`, `warn` or `drop`."""
    return missing_pct(df, columns).select(
        "column",
        F.round("missing_pct", 4).alias("missing_pct"),
        F.when(F.col("missing_pct") > drop, "drop")
        .when(F.col("missing_pct") > warn, "warn")
        .otherwise("keep")
        .alias("action"),
    )


def apply_missingness_policy(df: DataFrame, columns: Sequence[str], drop=80.0) -> DataFrame:
    return df.drop(*columns_missing_over(df, drop, columns))


def profile_outliers(df: DataFrame, columns: Sequence[str], spread=5.0, groups=()) -> DataFrame:
    """Moments, quartiles, and the share outside quartile -/+ spread * IQR, per column."""
    long = to_long(df, columns, groups).filter(F.col("value").isNotNull())
    keys = [*groups, "column"]
    cells = cut_lineage(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n")))
    quart = exact_quantiles(cells, "value", [0.25, 0.75], keys, cells=cells).select(
        *keys, F.col("q0").alias("q1"), F.col("q1").alias("q3")
    )
    bounded = cells.join(quart, keys).withColumn("iqr", F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - spread * F.col("iqr"), F.col("q3") + spread * F.col("iqr")
    outside = (F.col("value") < low) | (F.col("value") > high)
    n, v = F.col("n").cast("double"), F.col("value")
    moments = cells.groupBy(*keys).agg(
        F.sum("n").alias("count_non_null"), (F.sum(n * v) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
    )
    spreads = cells.join(moments.select(*keys, "mean"), keys).groupBy(*keys).agg(
        F.sqrt(F.try_divide(F.sum(n * (v - F.col("mean")) ** 2), F.sum(n) - 1)).alias("std"))
    moments = moments.join(spreads, keys)
    out = bounded.groupBy(*keys).agg(
        F.max("q1").alias("q1"), F.max("q3").alias("q3"), F.max("iqr").alias("iqr"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count"),
    )
    return moments.join(out, keys).withColumns(
        {
            "lower_bound": low,
            "upper_bound": high,
            "outlier_pct": F.round(F.col("outlier_count") / F.col("count_non_null") * 100.0, 4),
        }
    )


def check_class_balance(df: DataFrame, label="label") -> DataFrame:
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos")
    )
    ratio = F.try_divide(F.col("n_pos").cast("double"), F.col("n_neg"))
    severe = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    skewed = (ratio < 1 / 3) | (ratio > 3)
    return counts.select(
        "n_neg", "n_pos",
        F.when(~severe, F.round(ratio, 6)).alias("ratio"),
        (severe | F.coalesce(skewed, F.lit(False))).alias("warning"),
    )


def group_counts(df: DataFrame, group="gene", label="label") -> DataFrame:
    return df.filter(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
        F.avg(F.col(label).cast("double")).alias("positive_ratio"),
    )


def profile_groups(df: DataFrame, group="gene", label="label") -> DataFrame:
    """Distinct groups, singletons, and single-class groups; one row."""
    return group_counts(df, group, label).agg(
        F.count(F.lit(1)).alias("unique_groups"),
        F.count_if(F.col("n") == 1).alias("single_row_groups"),
        F.count_if((F.col("n_pos") > 0) & (F.col("n_neg") == 0)).alias("only_positive_groups"),
        F.count_if((F.col("n_neg") > 0) & (F.col("n_pos") == 0)).alias("only_negative_groups"),
    )


def group_stats_topk(df: DataFrame, group="gene", label="label", k=20) -> DataFrame:
    return (
        group_counts(df, group, label).orderBy(F.col("n").desc(), group).limit(k)
        .select(group, "n", "positive_ratio")
    )


def pairwise_sums(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """n, sums, squares and products of every column pair over rows where both are present.

    One matrix product per Arrow batch: with m the presence mask and x the values (0 where
    missing), the sums of all pairs are entries of m'm, x'm, (x*x)'m and x'x. Each task returns
    a single row, a second round adds the task rows up in parallel.
    """
    k = len(columns)
    shaped = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    # any fixed shift keeps r unchanged; the means keep the sums well conditioned
    centre = [v or 0.0 for v in shaped.agg(*[F.avg(f"v{i}") for i in range(k)]).first()]
    upper = [(i, j) for i in range(k) for j in range(i + 1, k)]
    left, right = [i for i, _ in upper], [j for _, j in upper]

    def products(batches):
        total = np.zeros((6, len(upper)))
        for pdf in batches:
            x = pdf.to_numpy(float) - np.array(centre)
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            m = m.astype(float)
            xm, qm = x.T @ m, (x * x).T @ m
            total += np.stack([
                (m.T @ m)[left, right], xm[left, right], xm[right, left],
                qm[left, right], qm[right, left], (x.T @ x)[left, right],
            ])
        yield pd.DataFrame({"sums": [total.ravel()]})

    def add(batches):
        total = np.zeros(6 * len(upper))
        for pdf in batches:
            for row in pdf["sums"]:
                total += row
        yield pd.DataFrame({"sums": [total]})

    schema = "sums array<double>"
    per_task = shaped.mapInPandas(products, schema)
    added = per_task.repartition(df.sparkSession.sparkContext.defaultParallelism).mapInPandas(add, schema)
    cells = added.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    pair, which = F.col("at") % len(upper), F.floor(F.col("at") / len(upper))
    names = ("n", "x", "y", "xx", "yy", "xy")
    return cells.groupBy(pair.alias("pair")).agg(
        *[F.max(F.when(which == s, F.col("value"))).alias(n) for s, n in enumerate(names)]
    )


def correlation_pairs(
    df: DataFrame, columns: Sequence[str], threshold: float | None = 0.95
) -> DataFrame:
    """Pearson r of every column pair over rows where both are present.

    Constant columns give no row. `suggest_drop` names the column with more missing values, else
    the later name.
    """
    columns = list(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    names = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2")) for a, b in pairs])
    r = pearson(*[F.col(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    out = pairwise_sums(df, columns).select(
        F.get(names, F.col("pair").cast("int")).alias("p"), r.alias("correlation")
    ).select("p.*", "correlation").filter(F.col("correlation").isNotNull())
    if threshold is not None:
        out = out.filter(F.abs("correlation") > threshold)
    miss = missing_pct(df, columns).select("column", F.round("missing_pct", 4).alias("m"))
    for i in ("1", "2"):
        named = miss.select(F.col("column").alias(f"feature_{i}"), F.col("m").alias(f"feature_{i}_missing_pct"))
        out = out.join(F.broadcast(named), f"feature_{i}")
    m1, m2 = F.col("feature_1_missing_pct"), F.col("feature_2_missing_pct")
    later = F.greatest("feature_1", "feature_2")
    return out.select(
        "feature_1", "feature_2", "correlation", m1, m2,
        F.when(m1 > m2, F.col("feature_1")).when(m2 > m1, F.col("feature_2")).otherwise(later).alias("suggest_drop"),
    )


def pearson(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson r from sums, NULL for a constant side."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    tiny = 1e-9
    usable = (n > 1) & (vx > tiny * F.greatest(sxx, F.lit(1e-300))) & (vy > tiny * F.greatest(syy, F.lit(1e-300)))
    return F.when(usable, (sxy - sx * sy / n) / F.sqrt(vx * vy))


def _rank_of(name: str, table) -> int | None:
    return next((rank for part, rank in table if part in name.lower()), None)


def _loser(a: str, b: str, miss_a: float, miss_b: float) -> tuple[str, str]:
    if miss_a != miss_b:
        return (a if miss_a > miss_b else b), "higher missing"
    for table, why in ((K.CONSERVATION_RANK, "conservation priority"), (K.SUBSTITUTION_RANK, "substitution priority")):
        ra, rb = _rank_of(a, table), _rank_of(b, table)
        if ra is not None and rb is not None and ra != rb:
            return (b if ra < rb else a), why
    return max(a, b), "deterministic fallback"


def correlated_drops(df: DataFrame, columns: Sequence[str], threshold=0.95) -> list[tuple[str, str, float, str]]:
    """(dropped, kept, r, reason). Pairs are computed on Spark; the greedy walk is over column
    names only."""
    pairs = correlation_pairs(df, columns, threshold).collect()
    pairs.sort(key=lambda r: (-round(abs(r["correlation"]), 9), r["feature_1"], r["feature_2"]))
    gone: set[str] = set()
    out = []
    for r in pairs:
        a, b = r["feature_1"], r["feature_2"]
        if a in gone or b in gone:
            continue
        lose, why = _loser(a, b, r["feature_1_missing_pct"], r["feature_2_missing_pct"])
        gone.add(lose)
        out.append((lose, b if lose == a else a, r["correlation"], why))
    return out


def drop_correlated(df: DataFrame, columns: Sequence[str], threshold=0.95) -> DataFrame:
    return df.drop(*[d[0] for d in correlated_drops(df, columns, threshold)])


def impute_with_flags(
    df: DataFrame, columns: Sequence[str], max_missing=20.0, flags=K.IMPUTE_FLAG_COLUMNS, fit_on=None
) -> DataFrame:
    """Drop columns over the limit; fill numbers with the exact median and text with the mode
    (lowest on ties); add `is_imputed_*` for listed columns that had gaps.

    Statistics are fitted on `fit_on` (default: the same table). Only column-sized statistics
    reach the driver.
    """
    base = df if fit_on is None else fit_on
    share = {r["column"]: r["missing_pct"] for r in missing_pct(base, columns).collect()}
    over = [c for c in columns if (share[c] or 0.0) > max_missing]
    gaps = [c for c in columns if c not in over and (share[c] or 0.0) > 0]
    numeric = [c for c in gaps if c in numeric_columns(df)]
    text = [c for c in gaps if c not in numeric]
    fills: dict[str, object] = {c: 0.0 for c in numeric} | {c: "UNKNOWN" for c in text}
    if numeric:
        for r in column_quantiles(base, numeric, [0.5]).collect():
            fills[r["column"]] = r["q0"]
    if text:
        cells = (
            base.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in text])
            .unpivot([], text, "column", "value").filter("value is not null")
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        top = cells.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
        fills |= {r["column"]: r["value"] for r in top.collect()}
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {c: F.coalesce(F.col(f"`{c}`"), F.lit(fills[c]).cast("double" if c in numeric else types[c])) for c in gaps}
    marks = {f"is_imputed_{c}": F.col(f"`{c}`").isNull() for c in gaps if c in flags}
    kept = [c for c in df.columns if c not in over]
    return df.select(
        *[(new[c].alias(c) if c in new else F.col(f"`{c}`")) for c in kept],
        *[e.alias(n) for n, e in marks.items()],
    )


def normal_name(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum())


def circular_feature_check(names: DataFrame, column="column", banned=K.BANNED_PREDICTORS) -> DataFrame:
    """Column names containing a banned predictor once both are reduced to letters and digits."""
    bare = F.regexp_replace(F.lower(F.col(column)), "[^a-z0-9]", "")
    hit = F.lit(None).cast("string")
    for b in reversed(banned):
        hit = F.when(bare.contains(normal_name(b)), F.lit(b)).otherwise(hit)
    return names.withColumn("predictor", hit).filter(F.col("predictor").isNotNull())


def dataset_summary(df: DataFrame, label="label") -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label) == 1).alias("n_pos"),
        F.count_if(F.col(label) == 0).alias("n_neg"),
        F.max(F.lit(0)).alias("_z"),
        *[F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)],
    )
    fewest = F.least(*[F.col(f"_c{i}") for i in range(len(df.columns))]) if len(df.columns) > 1 else F.col("_c0")
    return counts.select(
        "n_rows",
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        "n_pos", "n_neg",
        F.round(F.try_divide(F.col("n_pos").cast("double"), F.col("n_neg")), 6).alias("ratio"),
        F.round((F.col("n_rows") - fewest) * 100.0 / F.col("n_rows"), 6).alias("max_missing_pct"),
    )


def af_summary(df: DataFrame, af="AF") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(af) > K.COMMON_AF).alias("common"),
        F.count_if(F.col(af) <= K.COMMON_AF).alias("rare"),
        F.coalesce(F.avg(af), F.lit(0.0)).alias("mean_af"),
    )


def chromosome_order(c: Column) -> Column:
    """1..22, then X, Y, then other names."""
    return F.coalesce(
        c.try_cast("int"), F.when(c == "X", 23).when(c == "Y", 24), F.lit(25)
    )


def value_counts_sorted(df: DataFrame, column="chr") -> DataFrame:
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", chromosome_order(F.col(column))).orderBy("position", column)


def score_coverage_by_class(df: DataFrame, score="score", label="label") -> DataFrame:
    counts = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(score).alias("n_present"),
        F.count_if(F.col(score).isNull()).alias("n_imputed"),
        F.avg(score).alias("score_mean"),
    )
    median = exact_quantiles(df, score, [0.5], [label]).select(label, F.col("q0").alias("score_median"))
    return counts.join(median, label, "left")


def class_feature_means(df: DataFrame, columns: Sequence[str], label="label") -> DataFrame:
    long = to_long(df, columns, [label])
    means = long.groupBy(label, "column").agg(F.avg("value").alias("mean"))
    medians = column_quantiles(df, columns, [0.5], [label]).select(
        label, "column", F.col("q0").alias("median")
    )
    return means.join(medians, [label, "column"], "left")


def class_histogram(df: DataFrame, value: str, label="label", bins=60) -> DataFrame:
    """Density histogram per class over that class's own range, empty bins included; the last bin is
    closed. A class of one value has bins of no width, and all its rows in the middle one."""
    rows = df.filter(F.col(value).isNotNull()).select(label, F.col(value).cast("double").alias("v"))
    span = rows.groupBy(label).agg(
        F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("total")
    )
    width = (F.col("high") - F.col("low")) / bins
    at = F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(bins - 1)).cast("int")
    placed = rows.join(span, label).withColumn("bin", F.when(width > 0, at).otherwise(bins // 2))
    counts = placed.groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"))
    every = span.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [label, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0))).select(
        label, "bin", "n",
        (F.col("low") + F.col("bin") * width).alias("edge_low"),
        F.try_divide(F.col("n"), F.col("total") * width).alias("density"),
    )


def class_boxplot_stats(df: DataFrame, value: str, label="label") -> DataFrame:
    """Five-number summary of log1p(value) per class."""
    shaped = df.withColumn("_v", F.log1p(F.col(value).cast("double")))
    return exact_quantiles(shaped, "_v", [0.0, 0.25, 0.5, 0.75, 1.0], [label]).select(
        label, "n", F.col("q0").alias("low"), F.col("q1").alias("q1"), F.col("q2").alias("median"),
        F.col("q3").alias("q3"), F.col("q4").alias("high"),
    )


def pivot_flag_by_class(df: DataFrame, flag: str, label="label") -> DataFrame:
    counts = df.groupBy(label).pivot(flag, [False, True]).count().na.fill(0, ["false", "true"])
    total = F.col("false") + F.col("true")
    return counts.select(
        label,
        F.col("false").alias("n_false"), F.col("true").alias("n_true"),
        (F.col("false") / total * 100.0).alias("pct_false"),
        (F.col("true") / total * 100.0).alias("pct_true"),
    )


def critical_issue_gate(df: DataFrame, columns: Sequence[str], key="variant_key", label="label") -> DataFrame:
    """One row per violated critical check; empty when the table is sound."""
    labels = check_label_integrity(df, key, label)
    bad = labels.select(
        F.lit("label_integrity").alias("check"),
        (F.col("missing_labels") + F.col("invalid_labels")).alias("n"),
    )
    both = labels.select(F.lit("conflicting_keys").alias("check"), F.col("keys_with_both_labels").alias("n"))
    empty = missing_pct(df, columns).agg(
        F.count_if(F.col("missing_pct") >= 100.0).alias("n")
    ).select(F.lit("all_null_columns").alias("check"), "n")
    return bad.unionByName(both).unionByName(empty).filter(F.col("n") > 0)
