"""Residues, lookup tables, sequences, nested consequence records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.functions.text import first_token
from helixframe.session import small_side


def literal_map(pairs) -> Column:
    cells = []
    for key, value in pairs:
        cells += [F.lit(key), F.lit(value)]
    return F.create_map(*cells)


def norm_aa(c: Column) -> Column:
    """One- or three-letter residue to one letter, NULL when it is not one of the twenty."""
    text = F.replace(F.upper(first_token(c)), F.lit("*"), F.lit(""))
    return F.when(text.isin(*K.RESIDUES), text).otherwise(
        F.try_element_at(literal_map(K.THREE_LETTER), text)
    )


def aa_class(c: Column) -> Column:
    return F.try_element_at(literal_map(K.RESIDUE_CLASS), c)


def _inline_table(spark: SparkSession, rows, names: Sequence[str]) -> DataFrame:
    """Small constant table as a local relation of the plan."""
    cells = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t({', '.join(f'`{n}`' for n in names)})")


def property_table(spark: SparkSession) -> DataFrame:
    """20 rows, one per residue."""
    return _inline_table(spark, K.RESIDUE_PROPERTIES, ("residue", *K.PROPERTY_NAMES))


def matrix_table(spark: SparkSession) -> DataFrame:
    """400 rows: ordered residue pair, BLOSUM62 score, Grantham distance."""
    blosum = K.triangle_pairs(K.BLOSUM62_TRIANGLE)
    grantham = K.triangle_pairs(K.GRANTHAM_TRIANGLE, diagonal=0)
    rows = [(r, a, float(blosum[r, a]), float(grantham[r, a])) for r, a in sorted(blosum)]
    return _inline_table(spark, rows, ("m_ref", "m_alt", "blosum", "grantham"))


def add_aa_properties(df: DataFrame, ref: str = "ref_aa", alt: str = "alt_aa") -> DataFrame:
    """Six properties for each side. The lookup has exactly 20 rows, so it is broadcast."""
    table = property_table(df.sparkSession)
    for side, column in (("ref", ref), ("alt", alt)):
        named = table.select(
            F.col("residue").alias(f"_{side}"),
            *[F.col(p).alias(f"{p}_{side}") for p in K.PROPERTY_NAMES],
        )
        df = df.join(F.broadcast(named), df[column] == named[f"_{side}"], "left").drop(f"_{side}")
    return df


def add_aa_deltas(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"{p}_change": F.col(f"{p}_alt") - F.col(f"{p}_ref") for p in ("polarity", "volume", "charge")}
    )


def fill_matrices(
    df: DataFrame,
    ref: str = "ref_aa",
    alt: str = "alt_aa",
    blosum: str = "BLOSUM62_score",
    grantham: str = "Grantham_distance",
    matrix: DataFrame | None = None,
) -> DataFrame:
    """Fill missing substitution scores from the 400-cell table; stated values are kept."""
    table = F.broadcast(matrix_table(df.sparkSession)) if matrix is None else small_side(matrix)
    out = df.join(
        table, (df[ref] == table["m_ref"]) & (df[alt] == table["m_alt"]), "left"
    )
    current = {c: F.col(c) if c in df.columns else F.lit(None) for c in (blosum, grantham)}
    return out.withColumns(
        {
            blosum: F.coalesce(current[blosum].cast("double"), F.col("blosum")),
            grantham: F.coalesce(current[grantham].cast("double"), F.col("grantham")),
        }
    ).drop("m_ref", "m_alt", "blosum", "grantham")


def _is_missense(t: Column) -> Column:
    return F.coalesce(F.array_contains(t["consequence_terms"], K.CONSEQUENCE), F.lit(False))


def pick_any_missense(records: Column) -> Column:
    return F.get(F.filter(records, _is_missense), F.lit(0))


def pick_missense(records: Column) -> Column:
    """First missense record, preferring the canonical transcript."""
    canonical = F.filter(
        records, lambda t: F.coalesce(t["canonical"] == 1, F.lit(False)) & _is_missense(t)
    )
    return F.coalesce(F.get(canonical, F.lit(0)), pick_any_missense(records))


def residue_pair(amino_acids: Column) -> tuple[Column, Column]:
    """`R/H` to two upper-case residues, NULL unless there are exactly two parts."""
    parts = F.split(amino_acids, "/")
    two = F.size(parts) == 2
    return (
        F.when(two, F.upper(F.trim(F.get(parts, F.lit(0))))),
        F.when(two, F.upper(F.trim(F.get(parts, F.lit(1))))),
    )


def consequence_features(df: DataFrame, records: str = "transcript_consequences") -> DataFrame:
    """Chosen missense record -> residues, conservation, matrices, properties, defaults, flags."""
    # inline() emits the chosen record as plain columns, so the nested text is parsed only once
    chosen = df.select("variant_key", F.inline(F.slice(F.filter(F.col(records), _is_missense), 1, 1)))
    ref, alt = residue_pair(F.col("amino_acids"))
    fields = {}
    for source, target in K.CONSEQUENCE_FIELDS:
        number = F.col(f"`{source}`").cast("string").try_cast("double")
        fields[target] = F.when(~F.isnan(number), number)
    rows = chosen.select(
        "variant_key",
        ref.alias("ref_aa"),
        alt.alias("alt_aa"),
        *[e.alias(name) for name, e in fields.items()],
    ).filter(F.col("ref_aa").isin(*K.RESIDUES) & F.col("alt_aa").isin(*K.RESIDUES))
    enriched = add_aa_deltas(add_aa_properties(fill_matrices(rows)))
    return enriched.withColumns(
        {name: F.lit(value) for name, value in K.CONSEQUENCE_DEFAULTS}
        | {name: F.lit(0) for name in K.CONSEQUENCE_FLAGS}
    )


def llr(p_ref: Column, p_alt: Column) -> Column:
    floor = F.lit(K.PROB_EPSILON)
    return F.ln(F.greatest(p_alt, floor)) - F.ln(F.greatest(p_ref, floor))


def sequence_window(seq: Column, pos: Column, width: int = K.WINDOW_RESIDUES) -> dict[str, Column]:
    """Residues around a 1-based position, at most `width` of them, and the re-based position."""
    length = F.length(seq)
    left = F.greatest(F.lit(0), pos - 1 - width // 2)
    start = F.greatest(F.lit(0), F.least(length, left + width) - width)
    long = length > width
    return {
        "window": F.when(long, F.substring(seq, (start + 1).cast("int"), F.lit(width))).otherwise(seq),
        "window_pos": F.when(long, pos - start).otherwise(pos).cast("bigint"),
    }


def score_skip_reason(seq: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Why a row cannot be scored, NULL when it can."""
    here = F.substring(seq, pos.cast("int"), F.lit(1))
    return (
        F.when(F.coalesce(seq, F.lit("")) == "", "no_seq")
        .when(pos.isNull() | (pos < 1) | (pos > F.length(seq)), "bad_pos")
        .when(ref.isNull() | (here != ref), "ref_mismatch")
        .when(~ref.isin(*K.RESIDUES) | alt.isNull() | ~alt.isin(*K.RESIDUES), "non_canonical_aa")
    )
