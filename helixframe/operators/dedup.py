"""One row per key. "First" always means an explicit order; hot keys combine map-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


UNORDERED_TYPES = ("map", "variant", "interval")


def _ordered(kind) -> bool:
    name = kind.typeName()
    if name == "array":
        return _ordered(kind.elementType)
    return all(_ordered(f.dataType) for f in kind.fields) if name == "struct" else name not in UNORDERED_TYPES


def _first_row(df: DataFrame, keys: Sequence[str], order: Sequence, **more) -> DataFrame:
    """Keys, the aggregates in `more` and the columns of the first row.

    One struct with the order in front is compared and kept, so no column is carried twice; rows that
    the order leaves equal are told apart by their other columns. Types without an order (maps)
    cannot be in it and stay outside.
    """
    place = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    inside = {o: f"_o{i}" for i, o in enumerate(order) if isinstance(o, str)}
    rest = [f.name for f in df.schema.fields if f.name not in keys]
    if all(_ordered(df.schema[c].dataType) for c in rest):
        first = F.min(F.struct(*place, *[c for c in rest if c not in inside]))
    else:
        first, inside = F.min_by(F.struct(*rest), F.struct(*place)), {}
    picked = df.groupBy(*keys).agg(first.alias("_row"), *[e.alias(name) for name, e in more.items()])
    return picked.select(*keys, *more, *[F.col("_row")[inside.get(c, c)].alias(c) for c in rest])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key. An aggregate, not a window, so one hot key never fills one task."""
    return _first_row(df, keys, order).select(*df.columns)


def dedup_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.sum("n").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (F.sum("n") - F.count(F.lit(1))).alias("duplicates_removed"),
    )


def conflicting_keys(df: DataFrame, key="variant_key", label="label") -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.min(label).alias("_low"), F.max(label).alias("_high"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("_low") < F.col("_high"))
        .select(key, "n")
    )


def drop_conflicting_keys(df: DataFrame, key="variant_key", label="label") -> DataFrame:
    return df.join(conflicting_keys(df, key, label), key, "left_anti")


def resolve_keys(df: DataFrame, order: Sequence, key="variant_key", label="label") -> DataFrame:
    """Drop conflicting keys and keep the first row of the others, in a single shuffle."""
    firsts = _first_row(df, [key], order, _low=F.min(label), _high=F.max(label))
    return firsts.filter(F.col("_low").eqNullSafe(F.col("_high"))).select(*df.columns)


def most_constrained(df: DataFrame, tiebreak: Sequence[str], gene="gene", bound="oe_lof_upper"):
    """One row per gene with the lowest bound, missing bounds last."""
    return keep_first(df, [gene], [F.col(bound).isNull(), F.col(bound), *tiebreak])


def collapse_transcripts(
    df: DataFrame, order: Sequence[str], key="variant_key", any_true: Sequence[str] = ()
) -> DataFrame:
    """Per key the first usable value of every column; `any_true` columns are or-ed."""
    place = F.struct(*order)
    aggs = []
    for field in df.schema.fields:
        name = field.name
        if name == key or name in order:
            continue
        c = F.col(f"`{name}`")
        if name in any_true:
            aggs.append(F.bool_or(F.coalesce(c, F.lit(False))).alias(name))
            continue
        usable = c.isNotNull()
        if field.dataType.typeName() == "string":
            usable = usable & (F.trim(c) != "")
        # min_by ignores rows whose ordering value is NULL
        aggs.append(F.min_by(c, F.when(usable, place)).alias(name))
    return df.groupBy(key).agg(*aggs)


def aggregate_isoforms(df: DataFrame, order: Sequence[str], key="variant_key", score="score") -> DataFrame:
    """Min, max, mean and first score per key over scored isoforms; unscored keys are absent."""
    return (
        df.filter(F.col(score).isNotNull())
        .groupBy(key)
        .agg(
            F.min(score).alias("score_min"),
            F.max(score).alias("score_max"),
            F.avg(score).alias("score_mean"),
            F.min_by(score, F.struct(*order)).alias("score_first"),
        )
    )
