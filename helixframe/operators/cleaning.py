"""Row filters and label cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.functions import text as T
from helixframe.functions.variants import canonical_variant, variant_key
from helixframe.session import computed_once


def require_columns(df: DataFrame, names: Sequence[str], table: str = "table") -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks required columns: {missing}")
    return df


def _or_null(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def filter_variant_type(df: DataFrame, column="Type", target=K.VARIANT_TYPE) -> DataFrame:
    return df.filter(T.norm_text(F.col(column)) == target)


def filter_consequence_adaptive(
    df: DataFrame,
    column="MolecularConsequence",
    target=K.CONSEQUENCE,
    min_ratio=K.CONSEQUENCE_MIN_RATIO,
) -> DataFrame:
    """Keep rows listing the target consequence, unless the column is absent or mostly empty.

    The fill ratio is one small aggregate; it decides the plan, so the row pass stays a plain
    filter.
    """
    if column not in df.columns:
        return df
    ratio = df.agg(F.avg((~T.blank(F.col(column))).cast("double"))).first()[0]
    if ratio is None or ratio < min_ratio:
        return df
    return df.filter(T.has_consequence(F.col(column), target))


def filter_significance(df: DataFrame, column="ClinicalSignificance") -> DataFrame:
    """Kept significances only, rewritten to their canonical spelling."""
    return df.withColumn(column, T.canonical_label(F.col(column))).filter(F.col(column).isNotNull())


def filter_review_quality(df: DataFrame, strict=False, min_stars=1, column="review_stars") -> DataFrame:
    return df.filter(F.col(column) >= (2 if strict else min_stars))


def filter_chromosomes(df: DataFrame, column="chr", allowed=K.ALLOWED_CHROMOSOMES) -> DataFrame:
    return df.filter(F.col(column).isin(*allowed))


def filter_required_snv(df: DataFrame) -> DataFrame:
    return df.filter(
        F.col("pos").isNotNull()
        & (F.length("ref") == 1)
        & (F.length("alt") == 1)
        & ~T.blank(F.col("gene"))
    )


def standardize_rows(df: DataFrame) -> DataFrame:
    """Preferred VCF-style columns with fallback to the legacy ones."""
    pos = F.coalesce(T.to_number(_or_null(df, "PositionVCF")), T.to_number(_or_null(df, "Start")))

    def allele(first, second):
        preferred = T.norm_allele(_or_null(df, first))
        return F.when(preferred != "", preferred).otherwise(T.norm_allele(_or_null(df, second)))

    return computed_once(
        df,
        {
            "chr": T.norm_chrom(F.col("Chromosome")),
            "pos": pos.cast("bigint"),
            "ref": allele("ReferenceAlleleVCF", "ReferenceAllele"),
            "alt": allele("AlternateAlleleVCF", "AlternateAllele"),
            "gene": F.trim(F.coalesce(F.col("GeneSymbol"), F.lit(""))),
        },
    )


def clean_labels(df: DataFrame, strict=False, order: Sequence[str] = ()) -> DataFrame:
    """Raw label table to cleaned rows (keys may still repeat; see `dedup.resolve_keys`)."""
    require_columns(df, ["Type", "ClinicalSignificance", "Chromosome", "GeneSymbol"], "labels")
    rows = filter_consequence_adaptive(filter_variant_type(df))
    rows = filter_significance(rows)
    rows = rows.withColumns(
        {
            "label": T.binary_label(F.col("ClinicalSignificance")),
            "review_stars": T.review_stars(_or_null(df, "ReviewStatus")),
        }
    ).filter(F.col("label").isNotNull())
    rows = filter_review_quality(rows, strict)
    rows = filter_required_snv(filter_chromosomes(standardize_rows(rows)))
    return rows.select(
        "chr", "pos", "ref", "alt", "gene", "label", "review_stars",
        variant_key(F.col("chr"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant_key"),
        "ClinicalSignificance",
        _or_null(df, "MolecularConsequence").alias("MolecularConsequence"),
        _or_null(df, "PhenotypeIDS").alias("PhenotypeIDS"),
        *order,
    )


def filter_missense_only(df: DataFrame, ref="ref_aa", alt="alt_aa") -> DataFrame:
    return df.filter(F.col(ref).isNotNull() & F.col(alt).isNotNull())


def missense_filter_report(df: DataFrame, ref="ref_aa", alt="alt_aa", label="label") -> DataFrame:
    """Rows and classes before and after the residue filter, one row."""
    keep = F.col(ref).isNotNull() & F.col(alt).isNotNull()
    pos, neg = F.col(label) == 1, F.col(label) == 0
    counts = df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(keep).alias("rows_after"),
        F.count_if(pos).alias("positive_before"),
        F.count_if(pos & keep).alias("positive_after"),
        F.count_if(neg).alias("negative_before"),
        F.count_if(neg & keep).alias("negative_after"),
    )

    def dropped(name):
        before, after = F.col(f"{name}_before"), F.col(f"{name}_after")
        return F.round((before - after) / F.greatest(before, F.lit(1)) * 100.0, 4)

    return counts.withColumns(
        {
            "rows_dropped": F.col("rows_before") - F.col("rows_after"),
            "positive_dropped_pct": dropped("positive"),
            "negative_dropped_pct": dropped("negative"),
        }
    )


def label_external(df: DataFrame) -> DataFrame:
    """External de-novo table: missense rows of known phenotype, canonical key, label.

    Unmappable rows are dropped. Phenotype names are matched with their exact case.
    """
    phenotype = F.trim(F.coalesce(F.col("PrimaryPhenotype"), F.lit("")))
    label = F.when(phenotype.isin(*K.AFFECTED_PHENOTYPES), 1).when(
        phenotype.isin(*K.CONTROL_PHENOTYPES), 0
    )
    parts = canonical_variant(F.col("Chr"), F.col("Position"), change=F.col("Variant"))
    return (
        df.filter(F.lower("FunctionClass").isin(*K.MISSENSE_CLASSES))
        .withColumn("label", label.cast("tinyint"))
        .filter(F.col("label").isNotNull())
        .withColumns(parts)
        .filter(F.col("variant_key").isNotNull())
        .withColumnsRenamed({"Gene": "gene", "StudyName": "study", "PrimaryPhenotype": "phenotype"})
    )


def filter_strict_rows(
    df: DataFrame, conservation=K.CONSERVATION_COLUMNS, others=None, min_stars=2, max_missing=3
) -> DataFrame:
    """Well-reviewed rows, complete conservation columns, at most three other gaps."""
    zero = [c for c in conservation if c in df.columns]
    if others is None:
        others = [c for c in df.columns if c not in zero and c not in K.ID_COLUMNS]
    rows = df.filter(F.col("review_stars") >= min_stars)
    for c in zero:
        rows = rows.filter(F.col(f"`{c}`").isNotNull())
    gaps = F.lit(0)
    for c in others:
        gaps = gaps + F.col(f"`{c}`").isNull().cast("int")
    return rows.filter(gaps <= max_missing)


def filter_confident_errors(df: DataFrame, y="y", p="p", margin=0.5) -> DataFrame:
    return df.filter(F.abs(F.col(p) - F.col(y)) > margin).withColumn(
        "error_type", F.when(F.col(y) == 0, "false_positive").otherwise("false_negative")
    )
