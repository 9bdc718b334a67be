"""Group splits, samples and leakage checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.catalog.base import R, family_sql, query, rounded
from helixframe.catalog.filters import CLEAN_SQL
from helixframe.functions.families import gene_family
from helixframe.functions.variants import is_common, log_af
from helixframe.operators import cleaning, splitting
from helixframe.plans import dataset

C = F.col


def ranked_groups(src: str, g: str, seed: int = 42) -> str:
    return f"(SELECT {g} AS grp, row_number() OVER (ORDER BY md5('{seed}:' || cast({g} AS VARCHAR)), {g}) r, count(*) OVER () n FROM (SELECT DISTINCT {g} FROM {src}))"


def split_sql(src: str, g: str, seed: int = 42) -> str:
    return f"(SELECT grp, CASE WHEN r <= floor(0.7e0 * n) THEN 'train' WHEN r <= floor(0.7e0 * n) + floor(0.5e0 * (n - floor(0.7e0 * n))) THEN 'val' ELSE 'test' END AS split FROM {ranked_groups(src, g, seed)})"


@query("group_split", f"SELECT v.rid, v.gene, s.split FROM @var v JOIN {split_sql('@var', 'gene')} s ON v.gene = s.grp")
def _(t):
    return splitting.group_split(t.var.select("rid", "gene"), "gene").select("rid", "gene", "split")


FAM = family_sql("gene", K.SPLIT_FAMILIES)
MERGED_SQL = f"""(WITH c AS (SELECT * FROM {CLEAN_SQL}), k AS (SELECT variant_key FROM c GROUP BY 1 HAVING min(label) = max(label)),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant_key ORDER BY o1, rid) rn FROM c WHERE variant_key IN (SELECT variant_key FROM k)) WHERE rn = 1)
    SELECT variant_key, gene, label, {FAM} family, freq FROM (SELECT u.*, coalesce(f.ac, 0) freq FROM u SEMI JOIN @ann a ON split_part(u.variant_key, ':', 2) = split_part(a.variant_key, ':', 2)
      LEFT JOIN (SELECT split_part(variant_key, ':', 2) pk, first("AC" ORDER BY o1, rid) ac FROM @af GROUP BY 1) f ON split_part(u.variant_key, ':', 2) = f.pk))"""


def by_position(df):
    """Side tables of the stand-in share the position with the cleaned labels."""
    return df.withColumn("variant_key", F.split("variant_key", ":")[1])


def merged(t):
    labels = cleaning.clean_labels(t.lab, order=["o1", "rid"])
    keyed = labels.withColumnsRenamed({"variant_key": "full_key"}).withColumn("variant_key", C("pos").cast("string"))
    ann = by_position(t.ann).select("variant_key", C("o1").alias("a1"), C("rid").alias("a2"), "cons", "flag")
    af = by_position(t.af).select("variant_key", "AF", "AF_AFR", "AN", "AC", "o1", "rid")
    freq = af.select("variant_key", "AF", C("AF_AFR").alias("AF_popmax"), "AN", "AC", log_af(C("AF")).alias("log_AF"),
                     is_common(C("AF")).alias("is_common"), "o1", "rid")
    return dataset.merge_sources(keyed, ann, freq, ["o1", "rid"], ["a1", "a2"], ["o1", "rid"]).withColumn("variant_key", C("full_key"))


@query("split_summary", f"""WITH m AS MATERIALIZED (SELECT * FROM {MERGED_SQL}) SELECT split, count(*) n_rows, count(DISTINCT family) n_groups, count(*) FILTER (label = 1) n_pos, count(*) FILTER (label = 0) n_neg, {R('avg(label)')} ratio
    FROM m JOIN {split_sql('m', 'family')} s ON m.family = s.grp GROUP BY split""")
def _(t):
    return rounded(splitting.split_summary(dataset.split_by_family(merged(t)), "family"))


@query("validate_split", f"""WITH m AS MATERIALIZED (SELECT v.label, v.gene, s.split FROM @var v JOIN {split_sql('@var', 'gene')} s ON v.gene = s.grp),
      o AS (SELECT avg(label) r FROM @var)
    SELECT "check", cast(n AS BIGINT) n, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END status FROM (
      SELECT 'train_val_overlap' AS "check", count(*) n FROM (SELECT gene FROM m WHERE split = 'train' INTERSECT SELECT gene FROM m WHERE split = 'val')
      UNION ALL SELECT 'train_test_overlap', count(*) FROM (SELECT gene FROM m WHERE split = 'train' INTERSECT SELECT gene FROM m WHERE split = 'test')
      UNION ALL SELECT 'val_test_overlap', count(*) FROM (SELECT gene FROM m WHERE split = 'val' INTERSECT SELECT gene FROM m WHERE split = 'test')
      UNION ALL SELECT 'row_total', abs((SELECT count(*) FROM @var) - (SELECT count(*) FROM m))
      UNION ALL SELECT split || '_label_ratio', cast(abs(avg(label) - any_value(r)) > 0.08 AS INT) FROM m, o GROUP BY split)""")
def _(t):
    rows = t.var.select("rid", "gene", "label")
    return splitting.validate_split(rows, splitting.group_split(rows, "gene"), "gene")


@query("stratified_sample", "SELECT rid, label FROM (SELECT rid, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || rid), rid) rn FROM @var) WHERE rn <= 1000")
def _(t):
    return splitting.stratified_sample(t.var.select("rid", "label"), 1000, "rid")


@query("group_subsample", f"SELECT rid, gene FROM @var WHERE gene IN (SELECT grp FROM {ranked_groups('@var', 'gene', 7)} WHERE r <= greatest(1, round_even(0.25 * n, 0)))")
def _(t):
    return splitting.group_subsample(t.var.select("rid", "gene"), "gene", 0.25, seed=7).select("rid", "gene")


MANIFEST = "case l_partkey % 7 when 0 then 'num__esm2_llr' when 1 then 'num__is_imputed_esm2_llr' when 2 then 'chr' when 3 then 'chr_' || cast(l_suppkey as string) when 4 then 'is_common_1' else 'num__f' || cast(l_linenumber as string) end"


@query("leakage_gate", f"""WITH s AS MATERIALIZED (SELECT key AS variant_key, gene, y AS label, split, ref_aa, alt_aa, {FAM} fam FROM @pred), m AS (SELECT DISTINCT {MANIFEST} AS feature FROM lineitem),
      g AS (SELECT avg(label) FILTER (split = 'train') a, avg(label) FILTER (split = 'val') b, avg(label) FILTER (split = 'test') c FROM s),
      sc AS MATERIALIZED (SELECT key, CASE WHEN y = 1 AND review_stars = 2 THEN 'val' ELSE split END split FROM @pred WHERE s IS NOT NULL)
    SELECT "check", cast(n AS BIGINT) n, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END status FROM (
      SELECT 'banned_features' AS "check", count(*) n FROM m WHERE feature IN ('is_common', 'chr', 'ref', 'alt')
      UNION ALL SELECT 'banned_one_hot', count(*) FROM m WHERE starts_with(feature, 'chr_') OR starts_with(feature, 'is_common_')
      UNION ALL SELECT 'missense_only', count(*) FROM s WHERE split = 'train' AND (ref_aa IS NULL OR alt_aa IS NULL)
      UNION ALL SELECT 'gene_overlap', count(*) FROM (SELECT gene FROM s WHERE split = 'train' INTERSECT SELECT gene FROM s WHERE split = 'test')
      UNION ALL SELECT 'family_overlap', count(*) FROM (SELECT fam FROM s WHERE split = 'train' INTERSECT SELECT fam FROM s WHERE split = 'test')
      UNION ALL SELECT 'label_balance', cast(greatest(abs(a - b), abs(a - c), abs(b - c)) > 0.08 AS INT) FROM g
      UNION ALL SELECT 'required_features', 2 - count(*) FROM m WHERE feature IN ('num__esm2_llr', 'num__is_imputed_esm2_llr')
      UNION ALL SELECT 'score_keys_outside', count(*) FROM sc JOIN s ON sc.key = s.variant_key WHERE sc.split <> s.split
      UNION ALL SELECT 'score_keys_crossed', count(*) FROM sc JOIN s ON sc.key = s.variant_key WHERE sc.split <> s.split)""")
def _(t):
    split = t.pred.select(C("key").alias("variant_key"), "gene", C("y").alias("label"), "split", "ref_aa", "alt_aa")
    scores = t.pred.filter("s is not null").selectExpr("key as variant_key", "case when y = 1 and review_stars = 2 then 'val' else split end as split")
    manifest = t.lineitem.selectExpr(f"{MANIFEST} as feature").distinct()
    return splitting.leakage_gate(split, manifest, gene_family, scores, splitting.REQUIRED_SCORE_COLUMNS)


@query("score_split_integrity", f"""WITH s AS (SELECT key, split FROM @pred), sc AS (SELECT key, CASE WHEN y = 1 AND review_stars = 2 THEN 'val' ELSE split END split FROM @pred WHERE s IS NOT NULL)
    SELECT x.split, count(sc.key) n_scored, any_value(x.n) n_split, count(*) FILTER (sc.split <> s.split) n_outside, count(*) FILTER (sc.split <> s.split) n_cross_split, {R('count(sc.key) / any_value(x.n)')} coverage
    FROM (SELECT split, count(*) n FROM s GROUP BY 1) x JOIN sc ON sc.split = x.split JOIN s ON s.key = sc.key GROUP BY x.split""")
def _(t):
    scores = t.pred.filter("s is not null").selectExpr("key as variant_key", "case when y = 1 and review_stars = 2 then 'val' else split end as split")
    return rounded(splitting.score_split_integrity(t.pred.select(C("key").alias("variant_key"), "split"), scores))
