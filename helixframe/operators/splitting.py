"""Group splits, samples, set algebra on keys, leakage checks. All draws are hash orders."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.operators.ordered import hash_order, hash_ranks
from helixframe.session import cut_lineage


def assign_groups(df: DataFrame, group: str, train=0.70, val=0.15, test=0.15, seed=42) -> DataFrame:
    """Distinct groups with their split. Ratios are shares of *groups*, as counts rounded down
    for validation and test."""
    if abs(train + val + test - 1.0) > 1e-6 or min(train, val, test) <= 0:
        raise ValueError("split ratios must be positive and sum to 1")
    # the distinct groups are ranked from a written table, so what made `df` runs once for them
    ranked = hash_ranks(cut_lineage(df.select(group).distinct()), group, seed)
    n, r = F.col("hash_rank_n"), F.col("hash_rank")
    n_train = F.floor(F.lit(train) * n)
    n_val = F.floor(F.lit(val / (val + test)) * (n - n_train))
    return ranked.select(
        group,
        F.when(r <= n_train, "train").when(r <= n_train + n_val, "val").otherwise("test").alias("split"),
    )


def group_split(df: DataFrame, group: str, train=0.70, val=0.15, test=0.15, seed=42) -> DataFrame:
    """Every row with its split; all rows of a group land together."""
    return df.join(assign_groups(df, group, train, val, test, seed), group)


def split_summary(df: DataFrame, group: str, label="label") -> DataFrame:
    """Rows, groups, classes and positive share per split."""
    per_group = df.groupBy("split", group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")
    )
    return per_group.groupBy("split").agg(
        F.sum("n").alias("n_rows"),
        F.count(group).alias("n_groups"),
        F.sum("p").alias("n_pos"),
        (F.sum("n") - F.sum("p")).alias("n_neg"),
        (F.sum("p") / F.sum("n")).alias("ratio"),
    )


def _union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


SPLITS = ("train", "val", "test")


def group_facts(df: DataFrame, group: str, label="label", **more) -> DataFrame:
    """One written row per group: in which splits it is, rows and label sums of each split, and the
    aggregates in `more`. Every check below is derived from it, so `df` is read once."""
    y = F.col(label).cast("double")
    return cut_lineage(df.groupBy(group).agg(
        *[F.bool_or(F.col("split") == s).alias(s) for s in SPLITS],
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(F.col("split") == s, y)).alias(f"y_{s}") for s in SPLITS],
        *[F.count(F.when(F.col("split") == s, y)).alias(f"n_{s}") for s in SPLITS],
        F.sum(y).alias("y_all"), F.count(y).alias("n_all"),
        *[e.alias(name) for name, e in more.items()],
    ))


def overlaps() -> list:
    """Counts of groups seen in both of each pair of splits."""
    return [F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]


def label_shares() -> list:
    """Positive share per split and overall, from group facts."""
    return [F.try_divide(F.sum(f"y_{s}"), F.sum(f"n_{s}")).alias(f"share_{s}") for s in (*SPLITS, "all")]


def _checks(row: DataFrame, checks: dict) -> DataFrame:
    """Check table from one row of facts."""
    each = F.array(*[F.struct(F.lit(name).alias("check"), n.cast("bigint").alias("n")) for name, n in checks.items()])
    return row.select(F.explode(each).alias("c")).select(
        "c.check", "c.n", F.when(F.col("c.n") == 0, "pass").otherwise("fail").alias("status"))


def validate_split(original: DataFrame, split: DataFrame, group: str, label="label") -> DataFrame:
    """Check table: zero group overlap, rows preserved, label share within the limit."""
    facts = group_facts(split, group, label)
    row = facts.agg(*overlaps(), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *label_shares()).join(
        original.agg(F.count(F.lit(1)).alias("before")), F.lit(True))
    far = {
        f"{s}_label_ratio": F.coalesce(
            (F.abs(F.coalesce(F.col(f"share_{s}"), F.lit(0.0)) - F.col("share_all")) > K.LABEL_GAP_LIMIT).cast("int"), F.lit(0))
        for s in SPLITS
    }
    pairs = {f"{p}_overlap": F.col(p) for p in ("train_val", "train_test", "val_test")}
    return _checks(row, pairs | {"row_total": F.abs(F.col("before") - F.col("rows"))} | far)


def stratified_sample(df: DataFrame, k: int, key: str, label="label", seed=42) -> DataFrame:
    """k rows per label in seeded hash order.

    Labels are counted first; the rows whose hash lies below a bound that leaves a little more
    than k of a label are the only ones that move and are ranked. Where chance leaves fewer than
    k, all rows are ranked.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col(label).eqNullSafe(F.lit(value)), min(1.0, (k + 6 * k**0.5 + 20) / n)).otherwise(share)
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 2.0**32
    near = cut_lineage(df.withColumn("_h", hash_order(F.col(key), seed)).filter(place < share))
    kept = {r[0]: r[1] for r in near.groupBy(label).count().collect()}
    if any(kept.get(value, 0) < min(k, n) for value, n in sizes.items()):
        return hash_ranks(df, key, seed, [label]).filter(F.col("hash_rank") <= k).drop("hash_rank", "hash_rank_n")
    order = W.partitionBy(label).orderBy("_h", key)
    return near.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_h", "_r")


def group_subsample(df: DataFrame, group: str, fraction: float, seed=42, ranked: DataFrame | None = None) -> DataFrame:
    """All rows of a seeded share of the groups (at least one group, counts rounded half-even). `ranked` holds
    the `hash_ranks` of the groups where they are written already."""
    if fraction >= 1.0:
        return df
    if ranked is None:
        ranked = hash_ranks(df.select(group).distinct(), group, seed)
    kept = ranked.filter(
        F.col("hash_rank") <= F.greatest(F.lit(1.0), F.bround(F.lit(float(fraction)) * F.col("hash_rank_n")))
    )
    return df.join(kept.select(group), group, "left_semi")


def union_by_name(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def expand_slices(df: DataFrame, slices: dict[str, object], out="slice") -> DataFrame:
    """Each row once per slice whose condition it meets; `True` means every row."""
    names = [
        F.lit(name) if cond is True else F.when(cond, F.lit(name)) for name, cond in slices.items()
    ]
    return df.withColumn(out, F.explode(F.array_compact(F.array(*names))))


def intersect_keys(tables: Sequence[DataFrame], key="variant_key") -> DataFrame:
    """Keys present in every table: one union and one aggregate instead of a join chain."""
    tagged = [t.select(key).withColumn("_t", F.lit(i)) for i, t in enumerate(tables)]
    flags = [F.bool_or(F.col("_t") == i).alias(f"_f{i}") for i in range(len(tables))]
    both = reduce(lambda a, b: a & b, [F.col(f"_f{i}") for i in range(len(tables))])
    return _union(tagged).groupBy(key).agg(*flags).filter(both).select(key)


def except_keys(left: DataFrame, right: DataFrame, key="variant_key") -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def distinct_families(df: DataFrame, family_of, gene="gene") -> DataFrame:
    return df.select(family_of(F.col(gene)).alias("family")).distinct()


def score_split_integrity(splits: DataFrame, scores: DataFrame, key="variant_key") -> DataFrame:
    """Per score split: keys outside their own split, keys inside another split, coverage.

    Both inputs carry `split`. One aggregate per key holds the membership of both sides.
    """
    names = ("train", "val", "test")
    rows = splits.select(key, "split", F.lit(False).alias("_scored")).unionByName(
        scores.select(key, "split", F.lit(True).alias("_scored"))
    )
    flags = rows.groupBy(key).agg(
        *[F.bool_or((F.col("split") == s) & ~F.col("_scored")).alias(f"in_{s}") for s in names],
        *[F.bool_or((F.col("split") == s) & F.col("_scored")).alias(f"scored_{s}") for s in names],
    )
    aggs = []
    for s in names:
        other = reduce(lambda a, b: a | b, [F.col(f"in_{o}") for o in names if o != s])
        aggs.append(
            F.struct(
                F.lit(s).alias("split"),
                F.count_if(F.col(f"scored_{s}")).alias("n_scored"),
                F.count_if(F.col(f"in_{s}")).alias("n_split"),
                F.count_if(F.col(f"scored_{s}") & ~F.col(f"in_{s}")).alias("n_outside"),
                F.count_if(F.col(f"scored_{s}") & other).alias("n_cross_split"),
            ).alias(f"_{s}")
        )
    wide = flags.agg(*aggs)
    return wide.select(F.explode(F.array(*[f"_{s}" for s in names])).alias("r")).select(
        "r.*", F.try_divide(F.col("r.n_scored").cast("double"), F.col("r.n_split")).alias("coverage")
    )


BANNED_MODEL_COLUMNS = ("is_common", "chr", "ref", "alt")
REQUIRED_SCORE_COLUMNS = ("num__esm2_llr", "num__is_imputed_esm2_llr")


def leakage_gate(
    split: DataFrame,
    manifest: DataFrame,
    family_of,
    scores: DataFrame | None = None,
    required: Sequence[str] = (),
    gene="gene",
    label="label",
    key="variant_key",
) -> DataFrame:
    """Check table (check, n, status) over a split table and the encoded feature names."""
    name = F.col("feature")
    have = F.count_distinct(F.when(name.isin(*required), name)) if required else F.lit(0)
    names = manifest.agg(
        F.count_if(name.isin(*BANNED_MODEL_COLUMNS)).alias("banned"),
        F.count_if(name.startswith("chr_") | name.startswith("is_common_")).alias("banned_hot"),
        have.alias("have"),
    )
    unknown = F.count_if((F.col("split") == "train") & (F.col("ref_aa").isNull() | F.col("alt_aa").isNull()))
    genes = group_facts(split, gene, label, unknown=unknown)
    families = genes.withColumn("_family", family_of(F.col(gene).cast("string"))).groupBy("_family").agg(
        F.bool_or("train").alias("train"), F.bool_or("test").alias("test"))
    row = genes.agg(F.sum("unknown").alias("unknown"), *overlaps(), *label_shares()).join(
        families.agg(F.count_if(F.col("train") & F.col("test")).alias("families")), F.lit(True)).join(names, F.lit(True))
    a, b, c = (F.col(f"share_{s}") for s in SPLITS)
    worst = F.greatest(F.abs(a - b), F.abs(a - c), F.abs(b - c))
    checks = {
        "banned_features": F.col("banned"), "banned_one_hot": F.col("banned_hot"),
        "missense_only": F.coalesce("unknown", F.lit(0)), "gene_overlap": F.col("train_test"),
        "family_overlap": F.col("families"), "label_balance": (worst > K.LABEL_GAP_LIMIT).cast("int"),
    }
    if required:
        checks["required_features"] = F.lit(len(required)) - F.col("have")
    if scores is not None:
        row = row.join(score_split_integrity(split, scores, key).agg(
            F.sum("n_outside").alias("outside"), F.sum("n_cross_split").alias("crossed")), F.lit(True))
        checks |= {"score_keys_outside": F.col("outside"), "score_keys_crossed": F.col("crossed")}
    return _checks(row, checks)
