"""Cell-level text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.constants import (
    ALLELE_NULL_TOKENS,
    CELL_NULL_TOKENS,
    CHROM_NULL_TOKENS,
    CONSEQUENCE,
    NEGATIVE_LABELS,
    POSITIVE_LABELS,
)


def blank(c: Column) -> Column:
    """True for NULL and whitespace-only text."""
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def norm_text(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def norm_allele(c: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(up.isin(*ALLELE_NULL_TOKENS), F.lit("")).otherwise(up)


def norm_chrom(c: Column) -> Column:
    """Bare chromosome name; NULL for missing tokens and numbers outside 1..22."""
    text = F.trim(c.cast("string"))
    body = F.upper(F.when(F.lower(F.substring(text, 1, 3)) == "chr", F.substring(text, 4, 1 << 30)).otherwise(text))
    number = body.try_cast("bigint")
    return (
        F.when(text.isNull() | (text == "") | F.upper(text).isin(*CHROM_NULL_TOKENS), F.lit(None))
        .when(body == "23", F.lit("X"))
        .when(body == "24", F.lit("Y"))
        .when(body.rlike(r"^[0-9]+$"), F.when(number.between(1, 22), number.cast("string")))
        .otherwise(body)
    )


def norm_chrom_external(c: Column) -> Column:
    """Looser rule for external tables: M/MT unified, no range check, missing -> ''."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    body = F.upper(F.regexp_replace(text, r"^(chr|CHR)", ""))
    return (
        F.when((text == "") | (F.lower(text) == "nan"), F.lit(""))
        .when(body.isin("M", "MT"), F.lit("MT"))
        .otherwise(body)
    )


def first_token(c: Column) -> Column:
    """First ';' then ',' token of a packed cell, NULL for missing spellings."""
    text = F.trim(c.cast("string"))
    head = F.trim(F.substring_index(F.trim(F.substring_index(text, ";", 1)), ",", 1))
    keep = ~text.isin(*CELL_NULL_TOKENS) & ~head.isin(*CELL_NULL_TOKENS)
    return F.when(keep, head)


def _number(text: Column) -> Column:
    """Text as a double; non-numbers and NaN become NULL.

    A cast that fails raises inside, which costs more than the cast. Words are told by their first
    letter: of them, only spellings of infinity are numbers.
    """
    head = F.upper(F.substring(text, 1, 1))
    word = head.between("A", "Z") & (head != "I")
    number = F.when(~word, text.try_cast("double"))
    return F.when(~F.isnan(number), number)


def as_numeric(c: Column) -> Column:
    """First token as a double; non-numbers and NaN become NULL."""
    return _number(first_token(c))


def to_number(c: Column) -> Column:
    """Whole cell as a double; non-numbers and NaN become NULL."""
    return _number(F.trim(c.cast("string")))


def review_stars(c: Column) -> Column:
    """Review-status text to 0..4 stars."""
    t = norm_text(c)
    provided = t.contains("criteria provided")
    several = t.contains("multiple submitters")
    return (
        F.when(t.contains("practice guideline"), 4)
        .when(t.contains("reviewed by expert panel"), 3)
        .when(several & t.contains("no conflicts") & provided, 2)
        .when(
            provided
            & (t.contains("single submitter") | t.contains("conflicting interpretations") | several),
            1,
        )
        .otherwise(0)
        .cast("tinyint")
    )


def _lookup(c: Column, pairs) -> Column:
    """Literal-map lookup: the input expression is evaluated once, however many keys there are."""
    cells = [F.lit(x) for pair in pairs for x in pair]
    return F.try_element_at(F.create_map(*cells), c)


def canonical_label(c: Column, labels=POSITIVE_LABELS + NEGATIVE_LABELS) -> Column:
    """Kept significance in its canonical spelling, NULL for anything else."""
    return _lookup(norm_text(c), [(name.lower(), name) for name in labels])


def binary_label(c: Column, positive=POSITIVE_LABELS, negative=NEGATIVE_LABELS) -> Column:
    pairs = [(n.lower(), 1) for n in positive] + [(n.lower(), 0) for n in negative]
    return _lookup(norm_text(c), pairs).cast("tinyint")


def has_consequence(c: Column, target: str = CONSEQUENCE) -> Column:
    """Membership of one term in a comma-separated list."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike(rf"(^|,\s*){target}(\s*,|$)")


def secondary_structure(c: Column) -> Column:
    """First H, E or C of a packed prediction string."""
    return F.nullif(F.regexp_extract(F.upper(first_token(c)), "([HEC])", 1), F.lit(""))


def domain_present(c: Column) -> Column:
    return F.coalesce(F.trim(first_token(c)) != "", F.lit(False))


def packed_scores(c: Column, smallest: bool = False) -> Column:
    """Largest (or smallest) of ';'-packed numbers. '.' parts are skipped, a bad part gives NULL."""
    parts = F.filter(F.split(c, ";"), lambda x: ~x.isin(".", ""))
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    value = F.array_min(numbers) if smallest else F.array_max(numbers)
    return F.when(~F.exists(numbers, lambda x: x.isNull()), value)
