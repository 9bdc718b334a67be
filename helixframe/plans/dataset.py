"""Dataset build: labels, annotation, frequency, gene features, split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.functions.families import gene_family
from helixframe.operators import cleaning, dedup, joins, profiling, splitting
from helixframe.session import computed_once, cut_lineage


def merge_sources(labels, annotation, freq, order: Sequence, annotation_order: Sequence = (), freq_order: Sequence = ()) -> DataFrame:
    """Conflict-free labelled rows, inner-joined to annotation, left-joined to frequencies.

    Labels are resolved in one aggregate; the side tables are reduced to one row per key by the
    same kind of aggregate, so every join is one-to-one. The result is written once for the steps
    that follow; a merge without any row raises.
    """
    resolved = dedup.resolve_keys(labels, order)
    merged = joins.join_inner_validated(resolved, annotation, order=annotation_order, drop=K.ID_COLUMNS[1:8], validate=False)
    keep = [c for c in ("variant_key", "AF", "AF_popmax", "AN", "AC", "log_AF", "is_common") if c in freq.columns]
    order = list(freq_order) or [c for c in keep if c != "variant_key"]
    if all(isinstance(o, str) for o in order):
        freq = freq.select(*dict.fromkeys([*keep, *order]))
    out = joins.join_left_defaults(merged, dedup.keep_first(freq, ["variant_key"], order).select(*keep))
    out = cut_lineage(out.withColumn("has_annotation", F.lit(True)))
    if out.isEmpty():
        raise ValueError("no labelled key is annotated")
    return out


def split_by_family(df: DataFrame, gene="gene", seed=42, **ratios) -> DataFrame:
    tagged = computed_once(df, {"family": gene_family(F.col(gene))})
    return splitting.group_split(tagged, "family", seed=seed, **ratios)


def add_gene_features(split: DataFrame, constraint: DataFrame) -> DataFrame:
    """Gene metrics for every split with medians fitted on train only."""
    train = split.filter(F.col("split") == "train")
    medians = joins.constraint_medians(train, constraint)
    return joins.join_gene_impute(split, constraint, medians)


def strict_version(df: DataFrame, **more) -> DataFrame:
    return cleaning.filter_strict_rows(df, **more)


def balanced_version(df: DataFrame, columns: Sequence[str], fit_on=None) -> DataFrame:
    rows = cleaning.filter_review_quality(df, min_stars=1)
    return profiling.impute_with_flags(rows, columns, fit_on=fit_on)
