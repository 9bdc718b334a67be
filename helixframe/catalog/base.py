"""Registry and stand-in tables.

The given tables are not genomic, so each role of the library (raw labels, annotation, allele
frequencies, predictions, ...) is derived from them row by row with plain expressions that read
the same in Spark SQL and in the checking engine. Every derived table grows with its base table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.session import spread, tune

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

TAB = "chr(9)"


def text(expr: str) -> str:
    return f"cast({expr} as string)"


def base(n: str) -> str:
    return f"substr('ACGT', cast(({n}) % 4 as int) + 1, 1)"


def residue(n: str) -> str:
    return f"substr('ARNDCQEGHILKMFPSTWYV', cast(({n}) % 20 as int) + 1, 1)"


REF, ALT = base("l_linenumber"), base("l_linenumber + 1")
KEY = f"{text('l_orderkey % 22 + 1')} || ':' || {text('l_orderkey * 10 + l_linenumber')} || ':' || {REF} || ':' || {ALT}"
RID = " || '-' || ".join(
    text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(round(l_extendedprice * 100) as bigint)")
)
N = text("l_partkey")
GENE = (
    f"case l_partkey % 16 when 0 then 'KRTAP' || {N} when 1 then 'KRT' || {N} when 2 then 'HLA-' || {N} "
    f"when 3 then 'znf' || {N} when 4 then 'SLC' || {text('l_partkey % 30 + 1')} || 'A' || {N} "
    f"when 5 then 'CDH' || {N} when 6 then 'PCDHB' || {N} when 7 then 'OR' || {text('l_partkey % 14 + 1')} || 'A' || {N} "
    f"when 8 then 'RPL' || {N} when 9 then 'MT-ND' || {N} when 10 then 'FOXA' || {N} when 11 then 'KCNQ' || {N} "
    f"when 12 then 'COL' || {N} || 'A1' when 13 then 'DNAH' || {N} when 14 then 'MYH' || {N} else 'GENE' || {N} || 'B' end"
)
Y = "case when l_returnflag = 'R' then 1 else 0 end"
P1 = f"cast((l_orderkey * 31 + l_linenumber * 17 + l_suppkey * 7) % 1000 + 150 * ({Y}) as double) / 1150e0"
P2 = f"cast((l_partkey * 13 + l_linenumber * 29 + l_orderkey * 3) % 997 + 90 * ({Y}) as double) / 1087e0"
SCORE = f"case when l_suppkey % 9 = 0 then null else cast((l_partkey * 7 + l_orderkey * 11) % 400 - 40 * ({Y}) as double) / 40e0 - 5e0 end"
SPLIT = "case when l_partkey % 20 < 14 then 'train' when l_partkey % 20 < 17 then 'val' else 'test' end"

# role -> (base table, {column: expression}, optional filter)
ROLES: dict[str, tuple[str, dict[str, str], str | None]] = {
    # raw label table, everything text
    "lab": ("lineitem", {
        "Type": "case l_orderkey % 7 when 0 then ' Single Nucleotide Variant' when 1 then 'Deletion' when 2 then null else 'single nucleotide variant' end",
        "MolecularConsequence": "case when l_partkey % 11 = 0 then null when l_partkey % 3 = 0 then 'synonymous_variant, Missense_Variant' when l_partkey % 3 = 1 then 'missense_variant' else 'nonsense,missense_variant_like' end",
        "ClinicalSignificance": "case when l_returnflag = 'R' then (case when l_linenumber % 2 = 0 then ' pathogenic' else 'Likely Pathogenic' end) when l_returnflag = 'A' then (case when l_linenumber % 2 = 0 then 'Benign' else 'likely benign ' end) when l_linenumber % 3 = 0 then 'Uncertain significance' else 'BENIGN' end",
        "ReviewStatus": "case l_suppkey % 7 when 0 then 'practice guideline' when 1 then 'reviewed by expert panel' when 2 then 'criteria provided, multiple submitters, no conflicts' when 3 then ' Criteria provided, single submitter' when 4 then 'criteria provided, conflicting interpretations' when 5 then null else 'no assertion provided' end",
        "Chromosome": f"case when l_orderkey % 31 = 0 then 'NA' when l_orderkey % 31 = 1 then ' ' when l_orderkey % 31 = 2 then null when l_orderkey % 31 = 3 then 'chrM' when l_orderkey % 31 = 4 then 'x' when l_orderkey % 31 = 5 then 'Chr0' || {text('l_orderkey % 9 + 1')} when l_orderkey % 2 = 0 then 'chr' || {text('l_orderkey % 27')} else {text('l_orderkey % 27')} end",
        "PositionVCF": f"case when l_orderkey % 5 = 0 then null when l_orderkey % 5 = 1 then 'na' else {text('l_orderkey * 10 + l_linenumber')} end",
        "Start": f"case when l_orderkey % 25 = 0 then null else {text('l_orderkey * 10 + l_linenumber')} end",
        "ReferenceAlleleVCF": f"case when l_linenumber = 1 then '-' when l_linenumber = 2 then null when l_linenumber = 7 then 'acg' else ' ' || lower({REF}) end",
        "ReferenceAllele": f"case when l_partkey % 23 = 0 then 'none' else {REF} end",
        "AlternateAlleleVCF": f"case when l_linenumber = 3 then '.' else {ALT} end",
        "AlternateAllele": f"lower({ALT})",
        "GeneSymbol": f"case when l_partkey % 37 = 0 then null when l_partkey % 37 = 1 then '  ' else ' ' || {GENE} end",
        "PhenotypeIDS": f"'MONDO:' || {N}",
        "o1": "l_shipdate", "rid": RID,
    }, None),
    # cleaned, keyed rows with features (keys repeat)
    "var": ("lineitem", {
        "variant_key": KEY, "rid": RID, "o1": "l_shipdate",
        "chr": text("l_orderkey % 22 + 1"), "pos": "l_orderkey * 10 + l_linenumber", "ref": REF, "alt": ALT,
        "gene": GENE, "supp": f"'Supplier#' || lpad({text('l_suppkey')}, 9, '0')",
        "label": Y, "review_stars": "cast(l_suppkey % 4 as int)",
        "ref_aa": f"case when l_suppkey % 17 = 0 then null else {residue('l_partkey')} end",
        "alt_aa": f"case when l_suppkey % 19 = 0 then null else {residue('l_orderkey + l_linenumber * 3')} end",
        "phyloP100way_vertebrate": "case when l_partkey % 13 = 0 then null else l_discount * 10e0 - 3e-1 end",
        "phastCons100way_vertebrate": "case when l_partkey % 7 = 0 then null else l_tax * 12e0 end",
        "GERP++_RS": "l_quantity / 8e0",
        "Grantham_distance": "cast(case when l_orderkey % 4 = 0 then null else l_quantity * 3e0 end as double)",
        "quantity": "l_quantity", "price": "l_extendedprice", "price2": "l_extendedprice * 2e0 + l_linenumber",
        "AC": "cast(l_partkey % 90 as double)",
        "sparse": "case when l_partkey % 20 = 0 then l_tax else null end",
        "empty": "cast(null as double)", "constant": "1",
        "domain": "case when l_suppkey % 5 = 0 then null when l_suppkey % 5 = 1 then 'kinase' else 'zinc' end",
        "has_domain": "l_suppkey % 5 > 1",
    }, None),
    # annotation text rows, several per key
    "ann": ("lineitem", {
        "variant_key": KEY, "rid": RID, "o1": "l_shipdate",
        "aaref": f"case l_suppkey % 6 when 0 then '.' when 1 then 'Ala' when 2 then lower({residue('l_partkey')}) when 3 then {residue('l_partkey')} || ';' || {residue('l_partkey + 1')} when 4 then '*' else {residue('l_partkey')} end",
        "aaalt": f"case when l_partkey % 12 = 0 then 'X' when l_partkey % 12 = 1 then null else {residue('l_orderkey')} end",
        "cons_text": f"case l_partkey % 6 when 0 then '.' when 1 then '' when 2 then {text('l_partkey % 50')} || ',7' when 3 then ' ' || {text('l_linenumber')} || '.5;.;2' when 4 then 'bad' else {text('l_partkey % 90')} end",
        "packed": f"case l_suppkey % 7 when 0 then '.' when 1 then '0.' || {text('l_linenumber')} || ';0.25;.' when 2 then 'x;0.3' when 3 then null when 4 then ';' when 5 then '0.9' else '-1.5;0.' || {text('l_partkey % 9')} end",
        "ss_text": "case l_suppkey % 5 when 0 then 'xxe' when 1 then 'cch;h' when 2 then '.' when 3 then 'zz' else null end",
        "domain_text": "case l_suppkey % 4 when 0 then 'PF1;PF2' when 1 then '.' when 2 then ' ' else null end",
        "cons": "case when l_partkey % 3 = 0 then null else l_discount end",
        "note": "case when l_partkey % 4 = 0 then ' ' when l_partkey % 4 = 1 then null else l_linestatus end",
        "flag": "case when l_partkey % 5 = 0 then null else l_tax > 5e-2 end",
    }, "l_suppkey % 10 < 8"),
    # allele frequencies, keys repeat, half of the labelled keys absent
    "af": ("lineitem", {
        "variant_key": KEY, "rid": RID, "o1": "l_shipdate",
        "AF": "case when l_partkey % 10 = 0 then null when l_partkey % 10 = 2 then 1e-2 else cast(l_partkey % 200 as double) / 8000e0 end",
        "AF_AFR": "case when l_suppkey % 3 = 0 then null else cast(l_suppkey % 50 as double) / 1000e0 end",
        "AF_EAS": "case when l_suppkey % 4 = 0 then null else cast(l_partkey % 70 as double) / 2000e0 end",
        "AN": "case when l_partkey % 6 = 0 then null else cast(l_partkey % 900 as double) end",
        "AC": "cast(l_partkey % 40 as double)",
    }, "l_partkey % 2 = 0"),
    # predictions, one row per key
    "pred": ("lineitem", {
        "key": RID, "gene": GENE, "split": SPLIT, "y": Y, "p": P1, "p2": P2, "s": SCORE,
        "ref_aa": f"case when l_suppkey % 17 = 0 then null else {residue('l_partkey')} end",
        "alt_aa": residue("l_orderkey + l_linenumber * 3"),
        "cons": "case when l_partkey % 13 = 0 then null else l_discount * 10e0 + l_tax end",
        "review_stars": "cast(l_suppkey % 4 as int)",
        "family_holdout": "l_partkey % 3 = 0",
    }, None),
    # gene-level metrics, one or two rows per gene
    "gene": ("supplier", {
        "gene": "s_name", "pLI": "s_acctbal / 10000e0",
        "oe_lof_upper": "case when s_suppkey % 5 = 0 then null else cast(s_nationkey as double) / 25e0 end",
        "mis_z": "case when s_suppkey % 6 = 0 then null else s_acctbal / 3000e0 - 1e0 end",
        "oe_mis_upper": "cast(s_suppkey % 11 as double) / 10e0", "lof_z": "cast(s_nationkey as double) / 5e0 - 2e0",
    }, "s_suppkey % 4 <> 3"),
    # attributions, one column per feature
    "attr": ("lineitem", {
        "key": RID,
        "f_disc": "l_discount - 5e-2", "f_tax": "4e-2 - l_tax", "f_qty": "(l_quantity - 25e0) / 250e0",
        "f_price": "(l_extendedprice - 38000e0) / 400000e0", "f_line": "cast(l_linenumber - 4 as double) / 40e0",
        "f_supp": "cast(l_suppkey % 21 - 10 as double) / 150e0",
    }, None),
}

# the same rows without gaps, for operators that read a whole table
ROLES["annall"] = (*ROLES["ann"][:2], None)
ROLES["afall"] = (*ROLES["af"][:2], None)
ROLES["geneall"] = (*ROLES["gene"][:2], None)


def role_sql(name: str) -> str:
    table, exprs, where = ROLES[name]
    cols = ", ".join(f'{e} AS "{c}"' for c, e in exprs.items())
    return f"(SELECT {cols} FROM {table}" + (f" WHERE {where})" if where else ")")


SPREAD_KEYS = {
    "lineitem": ("l_orderkey", "l_partkey", "l_linenumber"), "orders": ("o_orderkey",), "events": ("event_id",), "documents": ("doc_id",),
}


class Tables:
    """Given tables and derived roles of one scale-factor folder, read lazily by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in ROLES:
            table, exprs, where = ROLES[name]
            df = getattr(self, table)
            df = df.filter(where) if where else df
            return df.selectExpr(*[f"{e} as `{c}`" for c, e in exprs.items()])
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df, SPREAD_KEYS[name]) if name in SPREAD_KEYS else df


def expand(sql: str) -> str:
    """Replace @role by its derivation."""
    for name in sorted(ROLES, key=len, reverse=True):
        sql = sql.replace(f"@{name}", role_sql(name))
    return sql


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, None if sql is None else expand(sql))
        return fn

    return register


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Round every double column; results are compared by value."""
    kinds = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(
        *[
            (F.round(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0)).alias(c) if c in kinds else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def R(expr: str, digits: int = 8) -> str:
    return f"(round(cast({expr} as double), {digits}) + 0e0)"


def values(rows) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        return repr(float(v)) + "e0" if isinstance(v, float) else (str(v) if isinstance(v, int) else "'" + v + "'")

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def in_list(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


PROPS_SQL = f"(SELECT * FROM (VALUES {values(K.RESIDUE_PROPERTIES)}) q(residue, {', '.join(K.PROPERTY_NAMES)}))"
_B, _G = K.triangle_pairs(K.BLOSUM62_TRIANGLE), K.triangle_pairs(K.GRANTHAM_TRIANGLE, 0)
MATRIX_SQL = f"(SELECT * FROM (VALUES {values([(r, a, float(_B[r, a]), float(_G[r, a])) for r, a in sorted(_B)])}) q(m_ref, m_alt, blosum, grantham))"


def clean_sql(c: str) -> str:
    return f"lower(trim(coalesce({c}, '')))"


def family_sql(g: str, patterns) -> str:
    arms = " ".join(
        f"WHEN regexp_matches(upper({g}), '{p}') THEN " + (f"'{f}'" if f else f"regexp_extract(upper({g}), '{p}', 1)")
        for p, f in patterns
    )
    bare = f"regexp_replace(upper({g}), '\\d+$', '')"
    return f"(CASE WHEN {g} IS NULL THEN '' {arms} WHEN {bare} <> '' THEN {bare} ELSE upper({g}) END)"


def ranking_sql(src: str, y: str, p: str, groups: str = "") -> str:
    """AUC and AP of `src` by distinct-score prefix sums; `groups` is a comma list."""
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""(SELECT {g}cast(any_value(tot_p) + any_value(tot_n) AS BIGINT) n, cast(any_value(tot_p) AS BIGINT) n_pos,
      CASE WHEN any_value(tot_p) > 0 AND any_value(tot_n) > 0 THEN sum(pos * (tot_n - fp + neg / 2.0)) / (any_value(tot_p) * any_value(tot_n)) - 0 END roc_auc_raw,
      CASE WHEN any_value(tot_p) > 0 AND any_value(tot_n) > 0 THEN sum(pos * (tp / (tp + fp))) / any_value(tot_p) END pr_auc_raw
    FROM (SELECT *, cast(sum(pos) OVER w AS DOUBLE) tp, cast(sum(neg) OVER w AS DOUBLE) fp,
            cast(sum(pos) OVER ({part}) AS DOUBLE) tot_p, cast(sum(neg) OVER ({part}) AS DOUBLE) tot_n
          FROM (SELECT {g}{p} AS sc, cast(count(*) FILTER ({y} = 1) AS DOUBLE) pos, cast(count(*) FILTER ({y} = 0) AS DOUBLE) neg
                FROM {src} WHERE {p} IS NOT NULL GROUP BY {g}sc) c
          WINDOW w AS ({part}ORDER BY sc DESC)) GROUPED {by})""".replace(" GROUPED", "")
