"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.catalog.base import R, family_sql, query, rounded
from helixframe.functions.families import gene_family
from helixframe.operators import dedup, joins

C = F.col
# one row per key, first in (date, row id) order
UVAR = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY variant_key ORDER BY o1, rid) rn FROM @var) WHERE rn = 1)"
UAF = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY variant_key ORDER BY o1, rid) rn FROM @af) WHERE rn = 1)"
UANN = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY variant_key ORDER BY o1, rid) rn FROM @ann) WHERE rn = 1)"


def uvar(t, *cols):
    keep = {"variant_key", "o1", "rid", *cols}
    return dedup.keep_first(t.var.select(*[c for c in t.var.columns if c in keep]), ["variant_key"], ["o1", "rid"])


def first_of(df):
    return dedup.keep_first(df, ["variant_key"], ["o1", "rid"])


@query("join_inner_validated", f"""SELECT v.variant_key, v.label, v.gene, a.cons, a.flag FROM {UVAR} v JOIN {UANN} a USING (variant_key)""")
def _(t):
    out = joins.join_inner_validated(
        uvar(t, "label", "gene"), t.ann.select("variant_key", C("o1").alias("a1"), C("rid").alias("a2"), "cons", "flag"), order=[C("a1"), C("a2")])
    return out.select("variant_key", "label", "gene", "cons", "flag")


@query("join_inner_report", f"""SELECT sum(l)::BIGINT n_left, sum(r)::BIGINT n_right, count(*) FILTER (l > 1) n_left_repeated, count(*) FILTER (r > 1) n_right_repeated,
      sum(CASE WHEN l > 0 AND r > 0 THEN l ELSE 0 END)::BIGINT n_matched, sum(CASE WHEN r = 0 THEN l ELSE 0 END)::BIGINT n_filtered
    FROM (SELECT k, sum(l) l, sum(r) r FROM (SELECT variant_key k, 1 l, 0 r FROM @var UNION ALL SELECT variant_key, 0, 1 FROM @ann) GROUP BY k)""")
def _(t):
    return joins.join_report(t.var, t.ann)



@query("join_left_defaults", f"""SELECT v.variant_key, CASE WHEN a.variant_key IS NULL THEN 0 ELSE {R('a."AF"')} END AS "AF", CASE WHEN a.variant_key IS NULL THEN -8 ELSE {R('log10(coalesce(a."AF", 0) + 1e-8)')} END log_af,
      coalesce(a."AF" > 1e-2, false) is_common, coalesce(a."AN", 0) AS "AN", coalesce(a."AC", 0) AS "AC" FROM {UVAR} v LEFT JOIN {UAF} a USING (variant_key)""")
def _(t):
    from helixframe.functions.variants import is_common, log_af

    freq = first_of(t.af).select("variant_key", "AF", log_af(C("AF")).alias("log_AF"), is_common(C("AF")).alias("is_common"), "AN", "AC")
    out = joins.join_left_defaults(uvar(t), freq)
    return rounded(out.select("variant_key", "AF", C("log_AF").alias("log_af"), "is_common", "AN", "AC"))


UGENE = "(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY oe_lof_upper NULLS LAST, \"pLI\") rn FROM @gene) WHERE rn = 1)"
MED = "(SELECT " + ", ".join(f'quantile_cont("{c}", 0.5) AS "m_{c}"' for c in K.CONSTRAINT_COLUMNS) + f" FROM @var v JOIN {UGENE} g ON v.supp = g.gene)"
IMPUTED = ", ".join(R(f'coalesce(g."{c}", m."m_{c}")') + f' AS "{c}"' for c in K.CONSTRAINT_COLUMNS)


def genes(t):
    return dedup.most_constrained(t.gene, ["pLI"])


@query("join_gene_impute", f"SELECT v.rid, {IMPUTED}, cast(g.gene IS NULL AS INT) is_imputed_constraint FROM @var v LEFT JOIN {UGENE} g ON v.supp = g.gene, {MED} m")
def _(t):
    rows = t.var.select("rid", C("supp").alias("gene"))
    return rounded(joins.join_gene_impute(rows, genes(t))).drop("gene")


@query("join_split_coverage", f"""SELECT count(*) n_total, count(*) FILTER (a.variant_key IS NOT NULL) n_matched, count(*) FILTER (a.variant_key IS NULL) n_unmatched,
      {R('count(*) FILTER (a.variant_key IS NOT NULL) / count(*)')} coverage FROM @var v LEFT JOIN {UANN} a USING (variant_key)""")
def _(t):
    return rounded(joins.coverage_report(t.var, t.ann))


@query("join_split_matched", f"SELECT v.rid, a.cons, v.\"AC\" FROM @var v JOIN {UANN} a USING (variant_key)")
def _(t):
    matched, _ = joins.join_split_coverage(t.var.select("variant_key", "rid", "AC"), first_of(t.ann))
    return matched.select("rid", "cons", "AC")


@query("join_split_unmatched", "SELECT rid FROM @var WHERE variant_key NOT IN (SELECT variant_key FROM @ann)")
def _(t):
    return joins.join_split_coverage(t.var.select("variant_key", "rid"), t.ann)[1].select("rid")


@query("join_semi_keys", 'SELECT rid, "AF" FROM @af WHERE variant_key IN (SELECT variant_key FROM @ann)')
def _(t):
    return joins.join_semi_keys(t.af, t.ann).select("rid", "AF")


@query("join_anti_cache_miss", "SELECT DISTINCT variant_key FROM @var WHERE variant_key NOT IN (SELECT variant_key FROM @af)")
def _(t):
    return joins.join_anti_cache_miss(t.var.select("variant_key").distinct(), t.af)


MED_T = MED.replace("ON v.supp = g.gene", "ON v.supp = g.gene WHERE v.\"AC\" < 63")
IMPUTED_T = IMPUTED


@query("medians_table", f"""SELECT CASE WHEN v."AC" < 63 THEN 'train' ELSE 'rest' END AS part, v.rid, {IMPUTED_T}, cast(g.gene IS NULL AS INT) is_imputed_constraint FROM @var v LEFT JOIN {UGENE} g ON v.supp = g.gene, {MED_T} m""")
def _(t):
    rows = t.var.select("rid", C("supp").alias("gene"), F.when(C("AC") < 63, "train").otherwise("rest").alias("part"))
    medians = joins.constraint_medians(rows.filter("part = 'train'"), genes(t))
    return rounded(joins.join_gene_impute(rows, genes(t), medians)).drop("gene")


@query("join_score_flag", "SELECT v.rid, p.s AS score, cast(p.s IS NULL AS INT) is_imputed_score FROM @var v LEFT JOIN @pred p ON v.rid = p.key AND p.split = 'train'")
def _(t):
    scores = t.pred.filter("split = 'train'").select(C("key").alias("rid"), C("s").alias("score"))
    return joins.join_score_flag(t.var.select("rid"), scores, "rid")


@query("join_paired_predictions", f"SELECT a.key, a.y, {R('a.p')} p_a, {R('b.p2')} p_b FROM @pred a JOIN @pred b ON a.key = b.key AND b.split = 'test' WHERE a.family_holdout")
def _(t):
    a = t.pred.filter("family_holdout")
    b = t.pred.filter("split = 'test'").select("key", C("p2").alias("p"))
    return rounded(joins.join_paired_predictions(a, b, "key", ["y"]))


@query("join_multi_left", f"SELECT v.rid, v.label, {R('p.s')} s, {R('q.p2')} p2 FROM @var v LEFT JOIN @pred p ON v.rid = p.key AND p.split = 'val' LEFT JOIN @pred q ON v.rid = q.key AND q.family_holdout")
def _(t):
    a = t.pred.filter("split = 'val'").select(C("key").alias("rid"), "s")
    b = t.pred.filter("family_holdout").select(C("key").alias("rid"), "p2")
    return rounded(joins.join_multi_left(t.var.select("rid", "label"), a, b, key="rid"))


@query("join_best_match", f"""SELECT variant_key, cons, arid FROM (
      SELECT v.variant_key, a.cons, a.rid arid, row_number() OVER (PARTITION BY v.variant_key ORDER BY CASE WHEN a.note = v.domain OR a.flag THEN 0 ELSE 1 END, a.o1 NULLS FIRST, a.rid NULLS FIRST) rn
      FROM {UVAR} v LEFT JOIN @ann a USING (variant_key)) WHERE rn = 1""")
def _(t):
    right = t.ann.select("variant_key", C("rid").alias("arid"), C("o1").alias("a1"), "cons", "note", "flag")
    out = joins.join_best_match(uvar(t, "domain"), right, ["variant_key"],
                                (C("note") == C("domain")) | C("flag"), ["a1", "arid"])
    return out.select("variant_key", "cons", "arid")


@query("join_holdout_flag", f"""SELECT key, gene, {family_sql('gene', K.SPLIT_FAMILIES)} NOT IN (SELECT DISTINCT {family_sql('gene', K.SPLIT_FAMILIES)} FROM @pred WHERE split = 'train') family_holdout FROM @pred WHERE split = 'test'""")
def _(t):
    p = t.pred.select("key", "gene", "split")
    return joins.join_holdout_flag(p.filter("split = 'test'"), p.filter("split = 'train'"), gene_family).select("key", "gene", "family_holdout")


@query("join_cascade_sources", f"""SELECT w.variant_key, CASE WHEN f.variant_key IS NOT NULL THEN 'freq' WHEN a.variant_key IS NOT NULL THEN 'annotation' END AS source,
      CASE WHEN f.variant_key IS NOT NULL THEN f."AC" WHEN a.variant_key IS NOT NULL THEN a.cons END AS value
    FROM (SELECT DISTINCT variant_key FROM @var) w LEFT JOIN {UAF} f USING (variant_key) LEFT JOIN {UANN} a USING (variant_key)""")
def _(t):
    a = first_of(t.af).select("variant_key", C("AC").alias("value"))
    b = first_of(t.ann).select("variant_key", C("cons").alias("value"))
    return joins.join_cascade_sources(t.var, [("freq", a), ("annotation", b)])


@query("join_gene_backfill", f"""SELECT variant_key, gene FROM (SELECT w.variant_key, coalesce(p.gene, s.note) gene FROM (SELECT DISTINCT variant_key FROM @var) w
      LEFT JOIN (SELECT variant_key, gene FROM {UVAR} WHERE review_stars = 3) p USING (variant_key) LEFT JOIN {UANN} s USING (variant_key)) WHERE gene IS NOT NULL""")
def _(t):
    primary = uvar(t, "gene", "review_stars").filter("review_stars = 3")
    secondary = first_of(t.ann).select("variant_key", C("note").alias("gene"))
    return joins.join_gene_backfill(t.var.select("variant_key").distinct(), primary, secondary)


@query("join_gene_lookup_from_rows", """SELECT gene, first("phyloP100way_vertebrate" ORDER BY o1, rid) FILTER ("phyloP100way_vertebrate" IS NOT NULL) AS phylo, first(sparse ORDER BY o1, rid) FILTER (sparse IS NOT NULL) AS sparse
    FROM @var WHERE "phyloP100way_vertebrate" IS NOT NULL OR sparse IS NOT NULL GROUP BY gene""")
def _(t):
    rows = t.var.withColumnRenamed("phyloP100way_vertebrate", "phylo")
    return joins.gene_lookup_from_rows(rows, ["phylo", "sparse"], ["o1", "rid"])


# coordinates on a half-unit lattice inside structures named by supplier
POINTS = {
    "structure_id": "cast(l_suppkey as string)", "pos": "l_orderkey * 10 + l_linenumber",
    "x": "cast(l_partkey % 61 as double) / 2e0", "y": "cast(l_orderkey % 53 as double) / 2e0", "z": "cast((l_linenumber * 7 + l_partkey) % 47 as double) / 2e0",
}
POINTS_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, e in POINTS.items()) + ", row_number() OVER () AS i FROM lineitem)"


def points(t):
    return t.lineitem.selectExpr(*[f"{e} as {c}" for c, e in POINTS.items()])


@query("join_within_radius", f"""WITH p AS MATERIALIZED (SELECT * FROM {POINTS_SQL})
    SELECT a.structure_id, a.pos, count(*) - 1 AS neighbors FROM p a JOIN p b ON a.structure_id = b.structure_id
      AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 25 GROUP BY a.structure_id, a.pos, a.i""")
def _(t):
    return joins.count_within_radius(points(t))
