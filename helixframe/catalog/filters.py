"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.catalog.base import R, clean_sql, in_list, query, ranking_sql, rounded
from helixframe.catalog.scalars import NORM_CHROM_SQL, STARS_SQL, SUB, allele_sql
from helixframe.functions import text
from helixframe.operators import cleaning, dedup, metrics

C = F.col


@query("filter_variant_type", f"""SELECT rid, "Type" FROM @lab WHERE {clean_sql('"Type"')} = 'single nucleotide variant'""")
def _(t):
    return cleaning.filter_variant_type(t.lab).select("rid", "Type")


@query("filter_consequence_adaptive", """
    SELECT rid, "MolecularConsequence" FROM @lab, (SELECT avg(CASE WHEN trim(coalesce("MolecularConsequence", '')) <> '' THEN 1.0 ELSE 0.0 END) ratio FROM @lab)
    WHERE ratio < 0.1 OR list_contains(list_transform(string_split(lower("MolecularConsequence"), ','), lambda x: trim(x)), 'missense_variant')""")
def _(t):
    return cleaning.filter_consequence_adaptive(t.lab).select("rid", "MolecularConsequence")


@query("filter_significance", f"""SELECT rid, CASE s WHEN 'pathogenic' THEN 'Pathogenic' WHEN 'likely pathogenic' THEN 'Likely pathogenic' WHEN 'benign' THEN 'Benign' ELSE 'Likely benign' END AS "ClinicalSignificance"
    FROM (SELECT rid, {clean_sql('"ClinicalSignificance"')} s FROM @lab) WHERE s IN ('pathogenic', 'likely pathogenic', 'benign', 'likely benign')""")
def _(t):
    return cleaning.filter_significance(t.lab).select("rid", "ClinicalSignificance")


@query("filter_review_quality", f"""SELECT rid, cast(stars AS TINYINT) review_stars, stars >= 2 AS strict FROM (SELECT rid, {STARS_SQL} stars FROM (SELECT rid, {clean_sql('"ReviewStatus"')} s FROM @lab)) WHERE stars >= 1""")
def _(t):
    rows = t.lab.select("rid", text.review_stars(C("ReviewStatus")).alias("review_stars"))
    strict = cleaning.filter_review_quality(rows, strict=True).withColumn("strict", F.lit(True))
    rest = cleaning.filter_review_quality(rows).filter(C("review_stars") < 2).withColumn("strict", F.lit(False))
    return strict.unionByName(rest)


@query("filter_chromosomes", f"SELECT rid, chr FROM ({NORM_CHROM_SQL}) WHERE chr IN {in_list(K.ALLOWED_CHROMOSOMES)}")
def _(t):
    return cleaning.filter_chromosomes(t.lab.select("rid", text.norm_chrom(C("Chromosome")).alias("chr")))


STANDARD_SQL = f"""(SELECT *, cast(coalesce(try_cast("PositionVCF" AS DOUBLE), try_cast("Start" AS DOUBLE)) AS BIGINT) pos,
      coalesce(nullif({allele_sql('"ReferenceAlleleVCF"')}, ''), {allele_sql('"ReferenceAllele"')}) ref,
      coalesce(nullif({allele_sql('"AlternateAlleleVCF"')}, ''), {allele_sql('"AlternateAllele"')}) alt, trim(coalesce("GeneSymbol", '')) gene FROM @lab)"""


@query("filter_required_snv", f"SELECT rid, pos, ref, alt, gene FROM {STANDARD_SQL} WHERE pos IS NOT NULL AND length(ref) = 1 AND length(alt) = 1 AND gene <> ''")
def _(t):
    return cleaning.filter_required_snv(cleaning.standardize_rows(t.lab)).select("rid", "pos", "ref", "alt", "gene")


CLEAN_SQL = f"""(SELECT * FROM (
    SELECT c.chr, pos, ref, alt, gene, rid, o1, "MolecularConsequence", "PhenotypeIDS",
      cast(CASE WHEN sig LIKE '%pathogenic' THEN 1 ELSE 0 END AS TINYINT) AS label, cast({STARS_SQL} AS TINYINT) review_stars,
      CASE sig WHEN 'pathogenic' THEN 'Pathogenic' WHEN 'likely pathogenic' THEN 'Likely pathogenic' WHEN 'benign' THEN 'Benign' ELSE 'Likely benign' END AS "ClinicalSignificance",
      c.chr || ':' || cast(pos AS VARCHAR) || ':' || ref || ':' || alt AS variant_key
    FROM (SELECT *, {clean_sql('"ClinicalSignificance"')} sig, {clean_sql('"ReviewStatus"')} s FROM {STANDARD_SQL}) JOIN ({NORM_CHROM_SQL}) c USING (rid)
    WHERE {clean_sql('"Type"')} = 'single nucleotide variant' AND sig IN ('pathogenic', 'likely pathogenic', 'benign', 'likely benign')
      AND list_contains(list_transform(string_split(lower("MolecularConsequence"), ','), lambda x: trim(x)), 'missense_variant')
      AND c.chr IN {in_list(K.ALLOWED_CHROMOSOMES)} AND pos IS NOT NULL AND length(ref) = 1 AND length(alt) = 1 AND gene <> '') WHERE review_stars >= 1)"""


@query("clean_labels", f"""WITH c AS (SELECT * FROM {CLEAN_SQL}), k AS (SELECT variant_key FROM c GROUP BY 1 HAVING min(label) = max(label))
    SELECT chr, pos, ref, alt, gene, label, review_stars, variant_key, "ClinicalSignificance", "MolecularConsequence", "PhenotypeIDS"
    FROM (SELECT *, row_number() OVER (PARTITION BY variant_key ORDER BY o1, rid) rn FROM c WHERE variant_key IN (SELECT variant_key FROM k)) WHERE rn = 1""")
def _(t):
    rows = cleaning.clean_labels(t.lab, order=["o1", "rid"])
    return dedup.resolve_keys(rows, ["o1", "rid"]).drop("o1", "rid")


@query("filter_missense_only", """
    SELECT count(*) rows_before, count(*) FILTER (k) rows_after, count(*) FILTER (label = 1) positive_before, count(*) FILTER (label = 1 AND k) positive_after,
      count(*) FILTER (label = 0) negative_before, count(*) FILTER (label = 0 AND k) negative_after, count(*) FILTER (NOT k) rows_dropped,
      round(count(*) FILTER (label = 1 AND NOT k) * 100.0 / greatest(count(*) FILTER (label = 1), 1), 4) positive_dropped_pct,
      round(count(*) FILTER (label = 0 AND NOT k) * 100.0 / greatest(count(*) FILTER (label = 0), 1), 4) negative_dropped_pct
    FROM (SELECT label, ref_aa IS NOT NULL AND alt_aa IS NOT NULL k FROM @var)""")
def _(t):
    return cleaning.missense_filter_report(t.var)


PHENO = "case l_suppkey % 6 when 0 then ' autism' when 1 then 'control' when 2 then 'Autism' when 3 then 'unaffectedSibling' when 4 then null else 'epilepsy' end"
DENOVO = {
    "FunctionClass": "case l_linenumber % 4 when 0 then 'Missense' when 1 then 'missense-near-splice' when 2 then 'synonymous' else 'missense' end",
    "PrimaryPhenotype": PHENO,
    "Chr": "case when l_partkey % 30 = 0 then null else cast(l_partkey % 24 as string) end",
    "Position": "cast(l_orderkey * 10 + l_linenumber as string)",
    "Variant": "case when l_suppkey % 13 = 0 then 'del' else substr('ACGT', cast(l_partkey % 4 as int) + 1, 1) || '>' || substr('ACGT', cast(l_orderkey % 4 as int) + 1, 1) end",
    "Gene": "'G' || cast(l_partkey as string)", "StudyName": "'S' || l_linestatus",
}
DENOVO_SQL = "(SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in DENOVO.items()) + " FROM lineitem)"
DENOVO_ROWS = f"""(SELECT upper(trim("Chr")) || ':' || "Position" || ':' || substr("Variant", 1, 1) || ':' || substr("Variant", 3, 1) AS variant_key,
      upper(trim("Chr")) chr, cast("Position" AS BIGINT) pos, substr("Variant", 1, 1) ref, substr("Variant", 3, 1) alt, "Gene" gene,
      cast(CASE WHEN trim("PrimaryPhenotype") IN {in_list(K.AFFECTED_PHENOTYPES)} THEN 1 ELSE 0 END AS TINYINT) AS label, "StudyName" study, "PrimaryPhenotype" phenotype
    FROM {DENOVO_SQL} WHERE lower("FunctionClass") IN {in_list(K.MISSENSE_CLASSES)} AND trim("PrimaryPhenotype") IN {in_list(K.AFFECTED_PHENOTYPES + K.CONTROL_PHENOTYPES)}
      AND "Chr" IS NOT NULL AND regexp_full_match("Variant", '[ACGT]>[ACGT]') AND substr("Variant", 1, 1) <> substr("Variant", 3, 1))"""
DENOVO_OUT = ["variant_key", "chr", "pos", "ref", "alt", "gene", "label", "study", "phenotype"]


def denovo(t):
    return t.lineitem.selectExpr(*[f"{e} as `{c}`" for c, e in DENOVO.items()])


@query("filter_denovo_label", f"SELECT * FROM {DENOVO_ROWS}")
def _(t):
    return cleaning.label_external(denovo(t)).select(*DENOVO_OUT)


@query("filter_strict_rows", """SELECT rid, review_stars FROM @var WHERE review_stars >= 2 AND "phyloP100way_vertebrate" IS NOT NULL AND "phastCons100way_vertebrate" IS NOT NULL AND "GERP++_RS" IS NOT NULL
    AND cast("Grantham_distance" IS NULL AS INT) + cast(ref_aa IS NULL AS INT) + cast(alt_aa IS NULL AS INT) + cast(sparse IS NULL AS INT) + cast(domain IS NULL AS INT) <= 3""")
def _(t):
    return cleaning.filter_strict_rows(t.var, others=["Grantham_distance", "ref_aa", "alt_aa", "sparse", "domain"]).select("rid", "review_stars")


@query("filter_confident_errors", f"SELECT key, y, {R('p')} p, CASE WHEN y = 0 THEN 'false_positive' ELSE 'false_negative' END error_type FROM @pred WHERE abs(p - y) > 5e-1")
def _(t):
    return rounded(cleaning.filter_confident_errors(t.pred).select("key", "y", "p", "error_type"))


@query("slice_guard", f"""SELECT slice, n, n_pos, CASE WHEN n >= 20 AND n_pos > 0 AND n_pos < n THEN {R('roc_auc_raw')} END roc_auc, CASE WHEN n >= 20 AND n_pos > 0 AND n_pos < n THEN {R('pr_auc_raw')} END pr_auc,
      CASE WHEN n >= 20 AND n_pos > 0 AND n_pos < n THEN '' ELSE 'too few or single-class' END note
    FROM {ranking_sql("(SELECT 'd' || cast(o_orderkey % 1000 AS VARCHAR) AS slice, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END y, o_totalprice p FROM orders WHERE o_orderkey % 1000 > 0 OR o_orderstatus = 'F')", 'y', 'p', 'slice')}""")
def _(t):
    rows = t.orders.filter("o_orderkey % 1000 > 0 or o_orderstatus = 'F'").selectExpr(
        "'d' || cast(o_orderkey % 1000 as string) as slice", "case when o_orderstatus = 'F' then 1 else 0 end as y", "o_totalprice as p")
    return rounded(metrics.guarded_ranking(rows, groups=["slice"]))
