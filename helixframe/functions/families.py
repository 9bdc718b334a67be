"""Paralog family of a gene symbol."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.constants import SPLIT_FAMILIES, STRATA_FAMILIES


def gene_family(symbol: Column, patterns=SPLIT_FAMILIES) -> Column:
    """First matching prefix family, else the symbol without trailing digits; NULL -> ''."""
    g = F.upper(symbol)
    stripped = F.regexp_replace(g, r"\d+$", "")
    out = F.when(g.isNull(), F.lit(""))
    for pattern, family in patterns:
        value = F.lit(family) if family else F.regexp_extract(g, pattern, 1)
        out = out.when(g.rlike(pattern), value)
    return out.otherwise(F.when(stripped != "", stripped).otherwise(g))


def strata_family(symbol: Column) -> Column:
    """The coarser list used for error strata and learning curves."""
    return gene_family(symbol, STRATA_FAMILIES)
