"""Row keys, substitution tokens, INFO cells, allele frequency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.constants import AF_EPSILON, COMMON_AF, POPULATIONS
from helixframe.functions.text import norm_chrom_external

BASES = ("A", "C", "G", "T")


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """`chr:pos:ref:alt`, NULL when any part is missing or empty."""
    parts = [p.cast("string") for p in (chrom, pos, ref, alt)]
    present = F.lit(True)
    for p in parts:
        present = present & p.isNotNull() & (p != "")
    return F.when(present, F.concat_ws(":", *parts))


def split_key(key: Column) -> dict[str, Column]:
    parts = F.split(key, ":", 4)
    return {
        "chr": F.get(parts, F.lit(0)),
        "pos": F.get(parts, F.lit(1)).try_cast("bigint"),
        "ref": F.get(parts, F.lit(2)),
        "alt": F.get(parts, F.lit(3)),
    }


def parse_change(token: Column) -> dict[str, Column]:
    """`"G>A"` to upper-case ref and alt, NULL when the token is not one substitution."""
    pattern = r"^([ACGTacgt])\s*>\s*([ACGTacgt])$"
    text = F.trim(token)
    return {
        "ref": F.nullif(F.upper(F.regexp_extract(text, pattern, 1)), F.lit("")),
        "alt": F.nullif(F.upper(F.regexp_extract(text, pattern, 2)), F.lit("")),
    }


def canonical_variant(
    chrom: Column,
    pos: Column,
    ref: Column | None = None,
    alt: Column | None = None,
    change: Column | None = None,
) -> dict[str, Column]:
    """Canonical chr/pos/ref/alt/variant_key of a single-base substitution.

    All columns are NULL for rows that cannot be resolved. Explicit alleles win over `change`
    row by row when both of them are present.
    """
    null = F.lit(None).cast("string")
    ref = null if ref is None else ref
    alt = null if alt is None else alt
    parsed = parse_change(null if change is None else change)
    explicit = ref.isNotNull() & alt.isNotNull()
    r = F.when(explicit, F.upper(F.trim(ref))).otherwise(parsed["ref"])
    a = F.when(explicit, F.upper(F.trim(alt))).otherwise(parsed["alt"])
    c = norm_chrom_external(chrom)
    p = F.trim(pos.cast("string")).try_cast("bigint")
    ok = (c != "") & p.isNotNull() & r.isin(*BASES) & a.isin(*BASES) & (r != a)
    return {
        "chr": F.when(ok, c),
        "pos": F.when(ok, p),
        "ref": F.when(ok, r),
        "alt": F.when(ok, a),
        "variant_key": F.when(ok, F.concat_ws(":", c, p.cast("string"), r, a)),
    }


def log_af(af: Column) -> Column:
    return F.log10(F.coalesce(af, F.lit(0.0)) + F.lit(AF_EPSILON))


def is_common(af: Column) -> Column:
    return F.coalesce(af > COMMON_AF, F.lit(False))


def info_map(info: Column) -> Column:
    """INFO cell to map<string,string>; flags map to NULL and the first of repeated keys wins.

    Keys are unique in a well-formed record, which takes the plain `str_to_map` branch.
    """
    entries = F.split(info, ";")
    names = F.transform(entries, lambda e: F.split(e, "=", 2)[0])
    firsts = F.filter(entries, lambda e, i: F.array_position(names, F.split(e, "=", 2)[0]) == i + 1)
    repaired = F.map_from_entries(
        F.transform(
            firsts,
            lambda e: F.struct(
                F.split(e, "=", 2)[0].alias("key"), F.get(F.split(e, "=", 2), F.lit(1)).alias("value")
            ),
        )
    )
    unique = F.size(F.array_distinct(names)) == F.size(names)
    return F.when(unique, F.str_to_map(info, F.lit(";"), F.lit("="))).otherwise(repaired)


def info_values(info: Column, key) -> Column:
    """List of an INFO field, NULL for an absent, empty or '.' cell. `key` is a name or column."""
    raw = F.trim(F.try_element_at(info, F.lit(key) if isinstance(key, str) else key))
    return F.when(~raw.isin("", "."), F.split(raw, ","))


def _number(c: Column) -> Column:
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def info_alt_value(info: Column, key, index: Column) -> Column:
    """Element of a per-allele INFO list; a one-element list serves every allele."""
    values = info_values(info, key)
    single = F.when(F.size(values) == 1, F.get(values, F.lit(0)))
    return _number(F.when(index < F.size(values), F.get(values, index.cast("int"))).otherwise(single))


def info_scalar(info: Column, key) -> Column:
    return _number(F.get(info_values(info, key), F.lit(0)))


def af_popmax(info: Column, index: Column) -> Column:
    """Stated popmax, else the largest population AF, taking AC/AN where AF is absent.

    The populations are an array that one lambda runs over, which keeps the generated code small.
    """
    names = F.array(*[F.lit(p) for p in POPULATIONS])

    def either(field, read):
        return lambda pop: F.coalesce(
            read(F.concat(F.lit(field), pop)), read(F.concat(F.lit(field), F.lower(pop)))
        )

    af = either("AF_", lambda k: info_alt_value(info, k, index))
    ac = either("AC_", lambda k: info_alt_value(info, k, index))
    an = either("AN_", lambda k: info_scalar(info, k))

    def best(pop):
        total = an(pop)
        return F.coalesce(af(pop), F.when(total > 0, F.try_divide(ac(pop), total)))

    return F.coalesce(
        info_alt_value(info, "AF_popmax", index),
        info_alt_value(info, "popmax_AF", index),
        F.array_max(F.transform(names, best)),
    )
