"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.catalog.base import MATRIX_SQL, PROPS_SQL, R, clean_sql, family_sql, in_list, query, rounded
from helixframe.functions import families, residues, scores, text, variants
from helixframe.operators import comparison
from helixframe.plans import training
from helixframe.sources import readers

C = F.col


@query("variant_key_build", """
    SELECT rid, CASE WHEN chr IS NOT NULL AND pos IS NOT NULL AND ra <> '' AND aa <> ''
      THEN chr || ':' || cast(pos AS VARCHAR) || ':' || ra || ':' || aa END AS variant_key
    FROM (SELECT rid, "Chromosome" chr, try_cast("Start" AS BIGINT) pos, "ReferenceAllele" ra, "AlternateAllele" aa FROM @lab)""")
def _(t):
    return t.lab.select("rid", variants.variant_key(
        C("Chromosome"), C("Start").try_cast("bigint"), C("ReferenceAllele"), C("AlternateAllele")).alias("variant_key"))


@query("variant_key_split", """
    SELECT rid, split_part(variant_key, ':', 1) chr, try_cast(split_part(variant_key, ':', 2) AS BIGINT) pos,
      split_part(variant_key, ':', 3) ref, split_part(variant_key, ':', 4) alt FROM @var""")
def _(t):
    parts = variants.split_key(C("variant_key"))
    return t.var.select("rid", *[e.alias(n) for n, e in parts.items()])


NORM_CHROM_SQL = f"""
    SELECT rid, CASE WHEN raw IS NULL OR trim(raw) = '' OR upper(trim(raw)) IN {in_list(K.CHROM_NULL_TOKENS)} THEN NULL
      WHEN b = '23' THEN 'X' WHEN b = '24' THEN 'Y'
      WHEN regexp_full_match(b, '[0-9]+') THEN (CASE WHEN cast(b AS BIGINT) BETWEEN 1 AND 22 THEN cast(cast(b AS BIGINT) AS VARCHAR) END)
      ELSE b END AS chr
    FROM (SELECT rid, "Chromosome" raw, upper(regexp_replace(trim("Chromosome"), '^chr', '', 'i')) b FROM @lab)"""


@query("norm_chrom", NORM_CHROM_SQL)
def _(t):
    return t.lab.select("rid", text.norm_chrom(C("Chromosome")).alias("chr"))


@query("norm_chrom_external", """
    SELECT rid, CASE WHEN raw = '' OR lower(raw) = 'nan' THEN '' WHEN b IN ('M', 'MT') THEN 'MT' ELSE b END AS chr
    FROM (SELECT rid, trim(coalesce("Chromosome", '')) raw, upper(regexp_replace(trim(coalesce("Chromosome", '')), '^(chr|CHR)', '')) b FROM @lab)""")
def _(t):
    return t.lab.select("rid", text.norm_chrom_external(C("Chromosome")).alias("chr"))


@query("norm_text", """SELECT rid, lower(trim(coalesce("ClinicalSignificance", ''))) sig, lower(trim(coalesce("ReviewStatus", ''))) status FROM @lab""")
def _(t):
    return t.lab.select("rid", text.norm_text(C("ClinicalSignificance")).alias("sig"), text.norm_text(C("ReviewStatus")).alias("status"))


def allele_sql(c: str) -> str:
    u = f"upper(trim(coalesce({c}, '')))"
    return f"CASE WHEN {u} IN ('', 'NA', 'NAN', 'NONE', 'NULL', '.', '-') THEN '' ELSE {u} END"


@query("norm_allele", f"""SELECT rid, {allele_sql('"ReferenceAlleleVCF"')} ref_vcf, {allele_sql('"ReferenceAllele"')} ref_raw FROM @lab""")
def _(t):
    return t.lab.select("rid", text.norm_allele(C("ReferenceAlleleVCF")).alias("ref_vcf"), text.norm_allele(C("ReferenceAllele")).alias("ref_raw"))


@query("prefer_coalesce", f"""
    SELECT rid, cast(coalesce(try_cast("PositionVCF" AS DOUBLE), try_cast("Start" AS DOUBLE)) AS BIGINT) pos,
      coalesce(nullif({allele_sql('"ReferenceAlleleVCF"')}, ''), {allele_sql('"ReferenceAllele"')}) ref,
      coalesce(nullif({allele_sql('"AlternateAlleleVCF"')}, ''), {allele_sql('"AlternateAllele"')}) alt FROM @lab""")
def _(t):
    from helixframe.operators.cleaning import standardize_rows

    return standardize_rows(t.lab).select("rid", "pos", "ref", "alt")


STARS_SQL = """CASE WHEN s LIKE '%practice guideline%' THEN 4 WHEN s LIKE '%reviewed by expert panel%' THEN 3
      WHEN s LIKE '%multiple submitters%' AND s LIKE '%no conflicts%' AND s LIKE '%criteria provided%' THEN 2
      WHEN s LIKE '%criteria provided%' AND (s LIKE '%single submitter%' OR s LIKE '%conflicting interpretations%' OR s LIKE '%multiple submitters%') THEN 1
      ELSE 0 END"""


@query("review_stars", f"""SELECT rid, cast({STARS_SQL} AS TINYINT) stars FROM (SELECT rid, {clean_sql('"ReviewStatus"')} s FROM @lab)""")
def _(t):
    return t.lab.select("rid", text.review_stars(C("ReviewStatus")).alias("stars"))


@query("label_map", f"""SELECT rid, cast(CASE WHEN s IN ('pathogenic', 'likely pathogenic') THEN 1 WHEN s IN ('benign', 'likely benign') THEN 0 END AS TINYINT) AS label
    FROM (SELECT rid, {clean_sql('"ClinicalSignificance"')} s FROM @lab)""")
def _(t):
    return t.lab.select("rid", text.binary_label(C("ClinicalSignificance")).alias("label"))


NULLS = in_list(K.CELL_NULL_TOKENS)


def token_sql(c: str) -> str:
    head = f"trim(split_part(trim(split_part(trim({c}), ';', 1)), ',', 1))"
    return f"CASE WHEN trim({c}) IN {NULLS} OR {head} IN {NULLS} THEN NULL ELSE {head} END"


@query("first_token", f"SELECT rid, {token_sql('cons_text')} cons, {token_sql('packed')} packed, {token_sql('domain_text')} domain_token FROM @annall")
def _(t):
    return t.annall.select("rid", text.first_token(C("cons_text")).alias("cons"), text.first_token(C("packed")).alias("packed"),
                        text.first_token(C("domain_text")).alias("domain_token"))


@query("as_numeric", f"SELECT rid, try_cast({token_sql('cons_text')} AS DOUBLE) cons, try_cast({token_sql('packed')} AS DOUBLE) packed FROM @annall")
def _(t):
    return t.annall.select("rid", text.as_numeric(C("cons_text")).alias("cons"), text.as_numeric(C("packed")).alias("packed"))


THREE_SQL = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.THREE_LETTER) + " END"


def aa_sql(c: str) -> str:
    return f"(SELECT CASE WHEN x IN {in_list(K.RESIDUES)} THEN x ELSE {THREE_SQL} END FROM (SELECT replace(upper({token_sql(c)}), '*', '') x))"


@query("norm_aa", f"SELECT rid, {aa_sql('aaref')} ref_aa, {aa_sql('aaalt')} alt_aa FROM @annall")
def _(t):
    return t.annall.select("rid", residues.norm_aa(C("aaref")).alias("ref_aa"), residues.norm_aa(C("aaalt")).alias("alt_aa"))


PROP_COLS = ", ".join(f'r."{p}" AS "{p}_ref", a."{p}" AS "{p}_alt"' for p in K.PROPERTY_NAMES)


@query("aa_properties", f"""SELECT v.rid, v.ref_aa, v.alt_aa, {PROP_COLS} FROM @var v
    LEFT JOIN {PROPS_SQL} r ON v.ref_aa = r.residue LEFT JOIN {PROPS_SQL} a ON v.alt_aa = a.residue""")
def _(t):
    return residues.add_aa_properties(t.var.select("rid", "ref_aa", "alt_aa"))


@query("aa_deltas", f"""SELECT v.rid, {R('a.polarity - r.polarity')} polarity_change, {R('a.volume - r.volume')} volume_change,
      {R('a.charge - r.charge')} charge_change FROM @var v
    LEFT JOIN {PROPS_SQL} r ON v.ref_aa = r.residue LEFT JOIN {PROPS_SQL} a ON v.alt_aa = a.residue""")
def _(t):
    full = residues.add_aa_deltas(residues.add_aa_properties(t.var.select("rid", "ref_aa", "alt_aa")))
    return rounded(full.select("rid", "polarity_change", "volume_change", "charge_change"))


@query("substitution_matrix_fill", f"""SELECT v.rid, m.blosum AS "BLOSUM62_score", coalesce(v."Grantham_distance", m.grantham) AS "Grantham_distance"
    FROM @var v LEFT JOIN {MATRIX_SQL} m ON v.ref_aa = m.m_ref AND v.alt_aa = m.m_alt""")
def _(t):
    return residues.fill_matrices(t.var.select("rid", "ref_aa", "alt_aa", "Grantham_distance")).select(
        "rid", "BLOSUM62_score", "Grantham_distance")


@query("ss_code_extract", f"SELECT rid, nullif(regexp_extract(upper({token_sql('ss_text')}), '([HEC])', 1), '') ss FROM @annall")
def _(t):
    return t.annall.select("rid", text.secondary_structure(C("ss_text")).alias("ss"))


@query("domain_present", f"SELECT rid, coalesce({token_sql('domain_text')} <> '', false) present FROM @annall")
def _(t):
    return t.annall.select("rid", text.domain_present(C("domain_text")).alias("present"))


@query("log_af", f'SELECT rid, {R("""log10(coalesce("AF", 0e0) + 1e-8)""")} log_af FROM @afall')
def _(t):
    return rounded(t.afall.select("rid", variants.log_af(C("AF")).alias("log_af")))


@query("is_common", 'SELECT rid, coalesce("AF" > 1e-2, false) common FROM @afall')
def _(t):
    return t.afall.select("rid", variants.is_common(C("AF")).alias("common"))


# INFO text derived from orders: per-allele lists, single values, flags, '.', repeated keys
INFO = (
    "case o_orderkey % 6 when 0 then 'AF=' || cast(o_custkey % 90 as string) || 'e-3,0.' || cast(o_custkey % 7 as string) || ';AC=' || cast(o_custkey as string) || ',7;AN=' || cast(o_orderkey % 500 as string) "
    "when 1 then 'DB;AF=0.0' || cast(o_custkey % 9 as string) || ';AN=.;AF_popmax=0.' || cast(o_custkey % 5 as string) "
    "when 2 then 'AN=100;AF=.;AC_NFE=' || cast(o_custkey % 50 as string) || ';AN_NFE=100;AF_eas=0.0' || cast(o_custkey % 8 as string) "
    "when 3 then 'AC=' || cast(o_custkey % 30 as string) || ';popmax_AF=2e-' || cast(o_custkey % 4 as string) || ';AN=50;AF=x' "
    "when 4 then 'AF=0.5;AF=0.9;AC_AFR=3;AN_AFR=0;AF_SAS=0.1,0.2,0.3' else 'DB;FLAG' end"
)
ALTS = "case when o_orderkey % 4 = 0 then 'C,t' when o_orderkey % 4 = 3 then 'A,G,TT' else 'G' end"
INFO_FIELDS = ("AF", "AC", "AN", "AF_popmax", "popmax_AF")


def info_list_sql(key: str) -> str:
    raw = f"trim(regexp_extract(info, '(^|;){key}=([^;]*)', 2))"
    return f"(CASE WHEN {raw} IN ('', '.') THEN NULL ELSE string_split({raw}, ',') END)"


def info_alt_sql(key: str) -> str:
    v = info_list_sql(key)
    return f"(CASE WHEN allele < len({v}) THEN try_cast({v}[allele + 1] AS DOUBLE) WHEN len({v}) = 1 THEN try_cast({v}[1] AS DOUBLE) END)"


def info_one_sql(key: str) -> str:
    return f"try_cast({info_list_sql(key)}[1] AS DOUBLE)"


RECORDS_SQL = f"(SELECT o_orderkey, info, alt, cast(allele AS INTEGER) allele FROM (SELECT o_orderkey, {INFO} info, unnest(string_split({ALTS}, ',')) alt, generate_subscripts(string_split({ALTS}, ','), 1) - 1 allele FROM orders))"
POPMAX_SQL = "coalesce(" + info_alt_sql("AF_popmax") + ", " + info_alt_sql("popmax_AF") + ", greatest(" + ", ".join(
    f"coalesce({info_alt_sql('AF_' + p)}, {info_alt_sql('AF_' + p.lower())}, CASE WHEN coalesce({info_one_sql('AN_' + p)}, {info_one_sql('AN_' + p.lower())}) > 0 THEN coalesce({info_alt_sql('AC_' + p)}, {info_alt_sql('AC_' + p.lower())}) / coalesce({info_one_sql('AN_' + p)}, {info_one_sql('AN_' + p.lower())}) END)"
    for p in K.POPULATIONS) + "))"


def info_records(t):
    return t.orders.selectExpr("o_orderkey", f"{INFO} as info", f"posexplode(split({ALTS}, ',')) as (allele, alt)")


@query("info_alt_value", f"""SELECT o_orderkey, allele, {info_alt_sql('AF')} af, {info_alt_sql('AC')} ac, {info_one_sql('AN')} an FROM {RECORDS_SQL}""")
def _(t):
    m = info_records(t).withColumn("m", variants.info_map(C("info")))
    return m.select("o_orderkey", "allele", variants.info_alt_value(C("m"), "AF", C("allele")).alias("af"),
                    variants.info_alt_value(C("m"), "AC", C("allele")).alias("ac"), variants.info_scalar(C("m"), "AN").alias("an"))


@query("af_popmax", f"SELECT o_orderkey, allele, {R(POPMAX_SQL)} popmax FROM {RECORDS_SQL}")
def _(t):
    m = info_records(t).withColumn("m", variants.info_map(C("info")))
    return rounded(m.select("o_orderkey", "allele", variants.af_popmax(C("m"), C("allele")).alias("popmax")))


@query("af_popmax_table", 'SELECT rid, greatest("AF_AFR", "AF_EAS") popmax FROM @afall')
def _(t):
    return t.afall.select("rid", readers.af_popmax_table(t.afall).alias("popmax"))


CHANGE = "case l_linenumber when 1 then 'G>A' when 2 then ' c > t ' when 3 then 'A>AT' when 4 then null when 5 then 'G-A' when 6 then 'T>t' else substr('ACGT', cast(l_partkey % 4 as int) + 1, 1) || '>' || substr('ACGT', cast(l_suppkey % 4 as int) + 1, 1) end"


def change_rows(t):
    return t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{CHANGE} as change",
                                 "case when l_suppkey % 8 = 0 then 'nan' else 'chr' || cast(l_suppkey as string) end as chrom",
                                 "case when l_partkey % 9 = 0 then 'x1' else cast(l_partkey as string) end as pos",
                                 "case when l_orderkey % 3 = 0 then 'g' end as r", "case when l_orderkey % 6 = 0 then 'T' end as a")


CHANGE_SQL = f"(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {CHANGE} AS change, case when l_suppkey % 8 = 0 then 'nan' else 'chr' || cast(l_suppkey as string) end AS chrom, case when l_partkey % 9 = 0 then 'x1' else cast(l_partkey as string) end AS pos, case when l_orderkey % 3 = 0 then 'g' end AS r, case when l_orderkey % 6 = 0 then 'T' end AS a FROM lineitem)"
SUB = r"'^([ACGT])\s*>\s*([ACGT])$'"


@query("parse_change", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, nullif(upper(regexp_extract(trim(change), {SUB}, 1, 'i')), '') ref,
      nullif(upper(regexp_extract(trim(change), {SUB}, 2, 'i')), '') alt FROM {CHANGE_SQL}""")
def _(t):
    return change_rows(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                 *[e.alias(n) for n, e in variants.parse_change(C("change")).items()])


@query("canonical_variant", f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ok THEN chr END chr, CASE WHEN ok THEN p END pos, CASE WHEN ok THEN r END ref,
      CASE WHEN ok THEN a END alt, CASE WHEN ok THEN chr || ':' || cast(p AS VARCHAR) || ':' || r || ':' || a END variant_key
    FROM (SELECT *, coalesce(chr <> '' AND p IS NOT NULL AND r <> a AND r IN ('A','C','G','T') AND a IN ('A','C','G','T'), false) ok
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN chrom = 'nan' THEN '' ELSE upper(substr(chrom, 4)) END chr, try_cast(pos AS BIGINT) p,
        CASE WHEN r IS NOT NULL AND a IS NOT NULL THEN upper(r) ELSE nullif(upper(regexp_extract(trim(change), {SUB}, 1, 'i')), '') END r,
        CASE WHEN r IS NOT NULL AND a IS NOT NULL THEN upper(a) ELSE nullif(upper(regexp_extract(trim(change), {SUB}, 2, 'i')), '') END a FROM {CHANGE_SQL}))""")
def _(t):
    cols = variants.canonical_variant(C("chrom"), C("pos"), C("r"), C("a"), C("change"))
    return change_rows(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[e.alias(n) for n, e in cols.items()])


@query("gene_family", f"SELECT rid, gene, {family_sql('gene', K.SPLIT_FAMILIES)} family FROM @var")
def _(t):
    return t.var.select("rid", "gene", families.gene_family(C("gene")).alias("family"))


@query("gene_family_analysis", f"""SELECT rid, gene, {family_sql('gene', K.STRATA_FAMILIES)} family FROM (SELECT rid, "GeneSymbol" gene FROM @lab)""")
def _(t):
    return t.lab.select("rid", C("GeneSymbol").alias("gene"), families.strata_family(C("GeneSymbol")).alias("family"))


def packed_sql(fn: str) -> str:
    parts = "list_filter(string_split(packed, ';'), lambda x: x NOT IN ('.', ''))"
    return f"CASE WHEN len({parts}) = len(list_filter({parts}, lambda x: try_cast(x AS DOUBLE) IS NOT NULL)) THEN list_{fn}(list_transform({parts}, lambda x: try_cast(x AS DOUBLE))) END"


@query("packed_score_reduce", f"SELECT rid, {packed_sql('max')} score_max, {packed_sql('min')} score_min FROM @annall")
def _(t):
    return t.annall.select("rid", text.packed_scores(C("packed")).alias("score_max"), text.packed_scores(C("packed"), smallest=True).alias("score_min"))


# Nested consequence text derived from lineitem: up to three records per row
def record(i: int) -> str:
    n = f"(l_partkey + {i} * l_linenumber)"
    return (
        f"'{{\"transcript_id\":\"T' || cast({n} as string) || '\",\"canonical\":' || cast({n} % 2 as string) || ',\"consequence_terms\":[' || "
        f"case when {n} % 3 = 0 then '\"intron_variant\"' when {n} % 3 = 1 then '\"missense_variant\"' else '\"splice\",\"missense_variant\"' end || "
        f"'],\"amino_acids\":\"' || case when {n} % 7 = 0 then 'R' when {n} % 7 = 1 then 'X/H' else lower(substr('ARNDCQEGHILKMFPSTWYV', cast({n} % 20 as int) + 1, 1)) || '/' || "
        f"substr('ARNDCQEGHILKMFPSTWYV', cast(({n} + l_suppkey) % 20 as int) + 1, 1) end || '\",\"protein_start\":' || cast({n} % 400 as string) || "
        f"',\"sift_score\":0.' || cast({n} % 100 as string) || ',\"phylop100way_vertebrate\":\"' || case when {n} % 5 = 0 then 'invalid_field' else cast({n} % 9 as string) || '.5' end || '\"}}'"
    )


JSON = f"case when l_linenumber = 7 then '[]' when l_linenumber = 6 then null else '[' || {record(0)} || ',' || {record(1)} || ',' || {record(2)} || ']' end"
JSON_SQL = f"(SELECT {{rid}} variant_key, json_extract(j, '$[*]') recs FROM (SELECT *, {JSON} j FROM lineitem))"


def consequences(t):
    from helixframe.catalog.base import RID

    return readers.parse_annotation_json(t.lineitem.selectExpr(f"{RID} as variant_key", f"{JSON} as json"))


from helixframe.catalog.base import RID  # noqa: E402

RECS_SQL = JSON_SQL.replace("{rid}", RID)
HAS_MIS = "list_contains(CAST(json_extract_string(x, '$.consequence_terms[*]') AS VARCHAR[]), 'missense_variant')"
ANY_MIS = f"list_filter(recs, lambda x: {HAS_MIS})[1]"
CANON_MIS = f"coalesce(list_filter(recs, lambda x: CAST(json_extract_string(x, '$.canonical') AS INT) = 1 AND {HAS_MIS})[1], {ANY_MIS})"


def chosen_sql(expr: str) -> str:
    return f"""SELECT variant_key, json_extract_string(c, '$.transcript_id') transcript_id, json_extract_string(c, '$.amino_acids') amino_acids,
      cast(json_extract_string(c, '$.protein_start') AS INTEGER) protein_start FROM (SELECT variant_key, {expr} c FROM {RECS_SQL})"""


def chosen(df, expr):
    return df.withColumn("c", expr).select("variant_key", *[C(f"c.{f}").alias(f) for f in ("transcript_id", "amino_acids", "protein_start")])


@query("pick_missense_consequence", chosen_sql(CANON_MIS))
def _(t):
    return chosen(consequences(t), residues.pick_missense(C("transcript_consequences")))


@query("pick_any_missense", chosen_sql(ANY_MIS))
def _(t):
    return chosen(consequences(t), residues.pick_any_missense(C("transcript_consequences")))


FEATURE_DEFAULTS = ", ".join([f"{v}e0 AS \"{n}\"" for n, v in K.CONSEQUENCE_DEFAULTS] + [f'0 AS "{n}"' for n in K.CONSEQUENCE_FLAGS])
CONS_COLS = ", ".join(
    f"try_cast(json_extract_string(c, '$.\"{s}\"') AS DOUBLE) AS \"{d}\"" for s, d in K.CONSEQUENCE_FIELDS)


@query("consequence_features", f"""
    SELECT f.* EXCLUDE (blosum, grantham), blosum AS "BLOSUM62_score", grantham AS "Grantham_distance", {FEATURE_DEFAULTS} FROM (
      SELECT p.*, m.blosum, m.grantham, {PROP_COLS}, {R('a.polarity - r.polarity')} polarity_change, {R('a.volume - r.volume')} volume_change, {R('a.charge - r.charge')} charge_change
      FROM (SELECT variant_key, upper(trim(split_part(aa, '/', 1))) ref_aa, upper(trim(split_part(aa, '/', 2))) alt_aa, {CONS_COLS}
            FROM (SELECT variant_key, c, json_extract_string(c, '$.amino_acids') aa FROM (SELECT variant_key, {ANY_MIS} c FROM {RECS_SQL})) WHERE len(string_split(aa, '/')) = 2) p
      JOIN {MATRIX_SQL} m ON p.ref_aa = m.m_ref AND p.alt_aa = m.m_alt JOIN {PROPS_SQL} r ON p.ref_aa = r.residue JOIN {PROPS_SQL} a ON p.alt_aa = a.residue) f""")
def _(t):
    return rounded(residues.consequence_features(consequences(t)))


@query("llr_from_probs", f"SELECT key, {R('ln(greatest(p2, 1e-12)) - ln(greatest(p, 1e-12))')} llr FROM @pred")
def _(t):
    return rounded(t.pred.select("key", residues.llr(C("p"), C("p2")).alias("llr")))


# whole document text stands for a sequence, a position comes from the id
SEQ_SQL = "(SELECT doc_id, text AS seq, length(text) AS n, cast(CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 13 = 1 THEN 0 WHEN doc_id % 13 = 2 THEN length(text) + 5 ELSE doc_id * 37 % length(text) + 1 END AS BIGINT) AS pos FROM documents)"


def sequences(t):
    return t.documents.selectExpr("doc_id", "text as seq", "length(text) as n",
                                  "cast(case when doc_id % 13 = 0 then null when doc_id % 13 = 1 then 0 when doc_id % 13 = 2 then length(text) + 5 else doc_id * 37 % length(text) + 1 end as bigint) as pos")


START_SQL = "greatest(0, least(n, greatest(0, pos - 1 - 511) + 1022) - 1022)"


@query("sequence_window", f"""SELECT doc_id, CASE WHEN n <= 1022 THEN seq ELSE substr(seq, {START_SQL} + 1, 1022) END AS "window",
      cast(CASE WHEN n <= 1022 THEN pos ELSE pos - {START_SQL} END AS BIGINT) AS window_pos FROM {SEQ_SQL}""")
def _(t):
    rows = sequences(t)
    return rows.select("doc_id", *[e.alias(n) for n, e in residues.sequence_window(C("seq"), C("pos")).items()])


@query("score_skip_reason", f"""SELECT doc_id, CASE WHEN s = '' THEN 'no_seq' WHEN pos IS NULL OR pos < 1 OR pos > length(s) THEN 'bad_pos' WHEN ra IS NULL OR substr(s, pos, 1) <> ra THEN 'ref_mismatch'
      WHEN ra NOT IN {in_list(K.RESIDUES)} OR aa IS NULL OR aa NOT IN {in_list(K.RESIDUES)} THEN 'non_canonical_aa' END reason
    FROM (SELECT doc_id, pos, CASE WHEN doc_id % 11 = 0 THEN '' ELSE seq END s, CASE WHEN doc_id % 5 = 0 THEN 'Q' ELSE substr(seq, greatest(pos, 1), 1) END ra, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 'A' END aa FROM {SEQ_SQL})""")
def _(t):
    rows = sequences(t).selectExpr(
        "doc_id", "pos", "case when doc_id % 11 = 0 then '' else seq end as s",
        "case when doc_id % 5 = 0 then 'Q' else substr(seq, cast(greatest(pos, 1) as int), 1) end as ra",
        "case when doc_id % 7 = 0 then null else 'A' end as aa")
    return rows.select("doc_id", residues.score_skip_reason(C("s"), C("pos"), C("ra"), C("aa")).alias("reason"))


CLASS_CASE = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.RESIDUE_CLASS) + " END"


@query("aa_class", f"SELECT key, {CLASS_CASE.format(c='ref_aa')} ref_class, {CLASS_CASE.format(c='alt_aa')} alt_class FROM @pred")
def _(t):
    return t.pred.select("key", residues.aa_class(C("ref_aa")).alias("ref_class"), residues.aa_class(C("alt_aa")).alias("alt_class"))


@query("null_flags", """SELECT v.rid, cast(a.cons IS NULL AS INT) is_imputed_cons, cast(a.note IS NULL AS INT) is_imputed_note
    FROM @var v LEFT JOIN @ann a ON v.rid = a.rid""")
def _(t):
    joined = t.var.select("rid").join(t.ann.select("rid", "cons", "note"), "rid", "left")
    return joined.select("rid", *[scores.missing_flag(C(c)).alias(f"is_imputed_{c}") for c in ("cons", "note")])


@query("clip_prob", "SELECT key, least(greatest(p * 2e0 - 5e-1, 1e-12), 1e0 - 1e-12) clipped FROM @pred")
def _(t):
    return t.pred.select("key", scores.clip_prob(C("p") * 2 - 0.5).alias("clipped"))


@query("orient_score", f"""SELECT key, {R('-s')} oriented, {R('(-s - lo) / (hi - lo)')} scaled
    FROM @pred, (SELECT min(-s) lo, max(-s) hi FROM @pred)""")
def _(t):
    flipped = t.pred.select("key", scores.orient(C("s"), higher_is_positive=False).alias("oriented"))
    return rounded(comparison.scale01(flipped, "oriented"))


MODEL_INPUT = "case when l_partkey % 9 = 0 then cast('inf' as double) when l_partkey % 9 = 1 then null else l_tax * 100 end"


@query("clean_model_inputs", f"""
    SELECT key, cast({R('coalesce(CASE WHEN isinf(x) THEN NULL ELSE x END, med)', 4)} AS DOUBLE) x, cast(b AS TINYINT) b, coalesce(d, 'MISSING') d
    FROM (SELECT {RID} AS key, {MODEL_INPUT} AS x, l_discount > 5e-2 AS b, case when l_suppkey % 5 = 0 then null else l_linestatus end AS d FROM lineitem),
      (SELECT quantile_cont(l_tax * 100, 0.5) med FROM lineitem WHERE l_partkey % 9 > 1)""")
def _(t):
    rows = t.lineitem.selectExpr(f"{RID} as key", f"{MODEL_INPUT} as x", "l_discount > 5e-2 as b",
                                 "case when l_suppkey % 5 = 0 then null else l_linestatus end as d")
    medians = training.train_medians(rows.selectExpr("x"), ["x"])
    return rounded(training.clean_model_inputs(rows, ["x", "b"], ["d"], medians), 4)
