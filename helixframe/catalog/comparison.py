"""Model comparison, slices, error strata, attributions, reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.catalog.base import R, family_sql, query, ranking_sql, rounded
from helixframe.catalog.evaluation import CLIP, boot_sql, brier_sql, delta_sql
from helixframe.catalog.ranking import FEATURES, LONG_ATTR
from helixframe.catalog.scalars import CLASS_CASE
from helixframe.functions.families import strata_family
from helixframe.functions.scores import ERFC_STEP, ERFC_TERMS
from helixframe.operators import attributions, comparison, metrics, resampling, splitting
from helixframe.session import cut_lineage

C = F.col


def delong_sql(src: str, y: str, a: str, b: str, groups: str = "") -> str:
    """Row-level DeLong by three mid-rank passes per score."""
    g = f"{groups}, " if groups else ""

    def mid(c, extra=""):
        part = ", ".join(x for x in (groups, extra) if x)
        inner = ", ".join(x for x in (groups, extra, c) if x)
        over = f"PARTITION BY {part} " if part else ""
        return f"(rank() OVER ({over}ORDER BY {c}) + (count(*) OVER (PARTITION BY {inner}) - 1) / 2e0)"

    part = f"PARTITION BY {groups}" if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    return f"""(SELECT *, auc1 - auc2 delta, sqrt(v) se FROM (SELECT {g}avg(v1) FILTER (yy = 1) auc1, avg(v2) FILTER (yy = 1) auc2,
        var_samp(v1 - v2) FILTER (yy = 1) / count(*) FILTER (yy = 1) + var_samp(v1 - v2) FILTER (yy = 0) / count(*) FILTER (yy = 0) v FROM (
          SELECT {g}yy, CASE WHEN yy = 1 THEN (za - ca) / k ELSE 1 - (za - ca) / m END v1, CASE WHEN yy = 1 THEN (zb - cb) / k ELSE 1 - (zb - cb) / m END v2 FROM (
            SELECT {g}yy, {mid('a')} za, {mid('a', 'yy')} ca, {mid('b')} zb, {mid('b', 'yy')} cb, count(*) FILTER (yy = 1) OVER ({part}) m, count(*) FILTER (yy = 0) OVER ({part}) k
            FROM (SELECT {g}{y} yy, {a} a, {b} b FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))) {by}))"""


DELONG_OUT = f"{R('auc1')} auc1, {R('auc2')} auc2, {R('delta')} delta, {R('se')} delta_se, {R('delta - 1.959964e0 * se')} delta_ci_lo, {R('delta + 1.959964e0 * se')} delta_ci_hi, {R('delta / se', 6)} z"


@query("delong_test", f"SELECT split, {DELONG_OUT} FROM {delong_sql('@pred', 'y', 'p', 's', 'split')}")
def _(t):
    out = comparison.delong_test(t.pred, score_a="p", score_b="s", groups=["split"], with_pvalue=False)
    return rounded(out.withColumn("z", F.round("z", 6)))


RANKED2 = """(SELECT key, y, split, p, -s s2, (row_number() OVER (PARTITION BY split ORDER BY p, md5('0:' || key), key) - 1) / greatest(count(*) OVER (PARTITION BY split) - 1, 1) r1,
      CASE WHEN s IS NULL THEN 5e-1 ELSE (row_number() OVER (PARTITION BY split, s IS NULL ORDER BY -s, md5('0:' || key), key) - 1) / greatest(count(s) OVER (PARTITION BY split) - 1, 1) END r2 FROM @pred WHERE split <> 'train')"""
SWEEP = ranking_sql("(SELECT alpha, y, (1e0 - alpha) * r1 + alpha * r2 fused FROM rk, (SELECT unnest(range(41)) / 40e0 alpha) WHERE split = 'val')", "y", "fused", "alpha")


@query("rank_fusion_sweep", f"WITH rk AS MATERIALIZED (SELECT * FROM {RANKED2}) SELECT alpha, n, n_pos, {R('roc_auc_raw')} roc_auc, {R('pr_auc_raw')} pr_auc FROM {SWEEP}")
def _(t):
    rows = t.pred.filter("split = 'val'").withColumn("_s2", -C("s"))
    ranked = comparison.rank_neutral(comparison.rank_neutral(rows, "p", "key", "r1"), "_s2", "key", "r2")
    out = comparison.fusion_sweep(cut_lineage(ranked.select("y", "r1", "r2")))
    return out.withColumns({c: F.round(c, 8) + F.lit(0.0) for c in ("roc_auc", "pr_auc")})


@query("rank_fusion", f"""WITH rk AS MATERIALIZED (SELECT * FROM {RANKED2}), best AS MATERIALIZED (SELECT alpha ba FROM {SWEEP} ORDER BY pr_auc_raw DESC, alpha LIMIT 1), te AS MATERIALIZED (SELECT * FROM rk WHERE split = 'test'), md AS (SELECT quantile_cont(s2, 0.5) med FROM te),
      long AS MATERIALIZED (SELECT 'first' model, y, p v FROM te UNION ALL SELECT 'second', y, coalesce(s2, med) FROM te, md UNION ALL SELECT 'fusion_uniform', y, (1e0 - 5e-1) * r1 + 5e-1 * r2 FROM te UNION ALL SELECT 'fusion_tuned', y, (1e0 - ba) * r1 + ba * r2 FROM te, best)
    SELECT model, n, n_pos, {R('roc_auc_raw')} roc_auc, {R('pr_auc_raw')} pr_auc, CASE model WHEN 'fusion_uniform' THEN 5e-1 WHEN 'fusion_tuned' THEN (SELECT ba FROM best) END alpha FROM {ranking_sql('long', 'y', 'v', 'model')}""")
def _(t):
    return rounded(comparison.rank_fusion(t.pred, "key"))


REPS = 1000


def grouped_sql(src: str, groups: str, extra: str = "") -> str:
    """Guarded metrics, coverage and bootstrap bounds of a long (groups, y, score) table."""
    ok = "m.n >= 20 AND m.n_pos > 0 AND m.n_pos < m.n"
    scaled = f"(SELECT *, {CLIP.format(p='(score - lo) / (hi - lo)')} sc01 FROM (SELECT *, min(score) OVER (PARTITION BY {groups}) lo, max(score) OVER (PARTITION BY {groups}) hi FROM {src} WHERE score IS NOT NULL))"
    bounds = ", ".join(f"{R(f'quantile_cont({m}, {q})', 7)} {m}_{c}" for m in ("roc_auc", "pr_auc") for q, c in ((0.025, "ci_lo"), (0.975, "ci_hi")))
    bcols = ", ".join(f"CASE WHEN {ok} THEN b.{m}_{c} END {m}_{c}" for m in ("roc_auc", "pr_auc") for c in ("ci_lo", "ci_hi"))
    return f"""SELECT {groups}, m.n, m.n_pos, CASE WHEN {ok} THEN {R('m.roc_auc_raw', 7)} END roc_auc, CASE WHEN {ok} THEN {R('m.pr_auc_raw', 7)} END pr_auc, CASE WHEN {ok} THEN '' ELSE 'too few or single-class' END note,
      {R('c.coverage', 7)} coverage, {bcols}{extra} FROM {ranking_sql(src, 'y', 'score', groups)} m JOIN (SELECT {groups}, count(score) / count(*) coverage FROM {src} GROUP BY {groups}) c USING ({groups})
      LEFT JOIN (SELECT {groups}, {bounds} FROM {boot_sql(scaled, 'y', {'p': 'sc01'}, groups, REPS)} GROUP BY {groups}) b USING ({groups})"""


SLICED = "(SELECT 'full' AS slice, * FROM @pred WHERE split = 'test' UNION ALL SELECT 'holdout', * FROM @pred WHERE split = 'test' AND family_holdout)"


@query("score_comparison", f"""WITH f AS MATERIALIZED (SELECT *, CASE WHEN s IS NOT NULL THEN ((rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0) / count(p) OVER () + (rank() OVER (ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY s) - 1) / 2e0) / count(s) OVER ()) / 2 END fusion FROM @pred WHERE split = 'test'),
    l AS MATERIALIZED (SELECT slice, score_name, y, CASE score_name WHEN 'p' THEN p WHEN 's' THEN s ELSE fusion END score FROM (SELECT 'full' AS slice, * FROM f UNION ALL SELECT 'holdout', * FROM f WHERE family_holdout), (SELECT unnest(['p', 's', 'fusion']) score_name)) {grouped_sql('l', 'slice, score_name')}""")
def _(t):
    rows = t.pred.filter("split = 'test'").select("y", "p", "s", "family_holdout")
    ranked = comparison.rank_pct(comparison.rank_pct(rows, "p", "_a"), "s", "_b").withColumn("fusion", (C("_a") + C("_b")) / 2)
    sliced = splitting.expand_slices(ranked, {"full": True, "holdout": C("family_holdout")})
    long = comparison.long_scores(sliced, ["slice", "y"], ["p", "s", "fusion"])
    return rounded(comparison.grouped_scores(long, ["slice", "score_name"], replicates=REPS), 7)


META = (("p2", "Second model", 2016, "curated"), ("s", "Sequence score", 2021, "unsupervised"), ("cons", "Conservation", 2005, "alignment"))
META_SQL = "(SELECT * FROM (VALUES " + ", ".join(str(m) for m in META) + ") q(baseline, display_name, year, training_data))"


@query("baseline_slices", f"""WITH l AS MATERIALIZED (SELECT slice, baseline, y, CASE baseline WHEN 'p2' THEN p2 WHEN 's' THEN -s ELSE cons END score FROM
      (SELECT 'internal_test' AS slice, * FROM @pred WHERE split = 'test' UNION ALL SELECT 'external', * FROM @pred WHERE split = 'val' UNION ALL SELECT 'external_holdout', * FROM @pred WHERE split = 'val' AND family_holdout), (SELECT unnest(['p2', 's', 'cons']) baseline))
    SELECT g.*, display_name, year, training_data FROM ({grouped_sql('l', 'baseline, slice')}) g JOIN {META_SQL} USING (baseline)""")
def _(t):
    rows = t.pred.filter("split <> 'train'").select("y", "split", "family_holdout", "p2", (-C("s")).alias("s"), "cons")
    sliced = splitting.expand_slices(rows, {
        "internal_test": C("split") == "test", "external": C("split") == "val", "external_holdout": (C("split") == "val") & C("family_holdout")})
    long = comparison.long_scores(sliced, ["slice", "y"], ["p2", "s", "cons"], "baseline")
    out = rounded(comparison.grouped_scores(long, ["baseline", "slice"], replicates=REPS), 7)
    meta = t.spark.createDataFrame(list(META), "baseline string, display_name string, year int, training_data string")
    return out.join(F.broadcast(meta), "baseline")


@query("matched_coverage", f"""WITH l AS MATERIALIZED (SELECT score_name, y, CASE score_name WHEN 'p' THEN p WHEN 'p2' THEN p2 ELSE s END score FROM @pred, (SELECT unnest(['p', 'p2', 's']) score_name) WHERE split = 'test' AND s IS NOT NULL) {grouped_sql('l', 'score_name')}""")
def _(t):
    return rounded(comparison.matched_coverage(t.pred.filter("split = 'test'"), "y", ["p", "p2", "s"], "s", replicates=REPS), 7)


@query("intersection_subset", f"""WITH l AS MATERIALIZED (SELECT score_name, y, CASE score_name WHEN 'p' THEN p WHEN 'cons' THEN cons ELSE s END score FROM @pred, (SELECT unnest(['p', 'cons', 's']) score_name) WHERE split = 'test' AND s IS NOT NULL AND cons IS NOT NULL),
    o AS (SELECT 'p' score_name, count(p) / count(*) own, count(*) na FROM @pred WHERE split = 'test' UNION ALL SELECT 'cons', count(cons) / count(*), count(*) FROM @pred WHERE split = 'test' UNION ALL SELECT 's', count(s) / count(*), count(*) FROM @pred WHERE split = 'test')
    SELECT g.* EXCLUDE (coverage), {R('own', 7)} own_coverage, {R('g.n / na', 7)} common_coverage FROM ({grouped_sql('l', 'score_name')}) g JOIN o USING (score_name)""")
def _(t):
    return rounded(comparison.intersection_subset(t.pred.filter("split = 'test'"), "y", ["p", "cons", "s"], replicates=REPS), 7)


PAIRS = [("p", "p2"), ("p", "s"), ("p2", "s")]
PAIR_ROWS = "(" + " UNION ALL ".join(f"SELECT '{a}' model_a, '{b}' model_b, y, {a} pa, {b} pb FROM @pred WHERE split = 'test' AND s IS NOT NULL" for a, b in PAIRS) + ")"


def tail_sql(z: str) -> str:
    """Two-sided normal tail of an expression, by the rule of `functions.scores.erfc`."""
    x, h = f"(abs({z}) / {math.sqrt(2.0)!r})", ERFC_STEP
    terms = " + ".join(f"{math.exp(-((k + 0.5) * h) ** 2)!r} / ({x} * {x} + {((k + 0.5) * h) ** 2!r})" for k in range(ERFC_TERMS))
    return f"({2.0 * h / math.pi!r} * {x} * exp(-{x} * {x}) * ({terms}) + CASE WHEN {x} < {math.pi / h!r} THEN 2e0 / (1 + exp({2.0 * math.pi / h!r} * {x})) ELSE 0 END)"


def pairwise_sql(rows: str, pairs: int) -> str:
    """DeLong and paired bootstrap rows with Holm adjustment per metric."""
    both = f"""SELECT model_a, model_b, 'roc_auc' metric, auc1 estimate_a, auc2 estimate_b, delta, delta - 1.959964e0 * se ci_lo, delta + 1.959964e0 * se ci_hi, {tail_sql('delta / se')} p_value FROM {delong_sql(rows, 'y', 'pa', 'pb', 'model_a, model_b')}
      UNION ALL BY NAME SELECT model_a, model_b, metric, estimate_a, estimate_b, delta, ci_lo, ci_hi, p_value FROM ({delta_sql(rows, 'y', 'pa', 'pb', 'model_a, model_b', 'two-sided-complement', REPS, ('pr_auc',))})"""
    numbers = ", ".join(f"{R(c, 7)} {c}" for c in ("estimate_a", "estimate_b", "delta", "ci_lo", "ci_hi", "p_value"))
    return f"""SELECT model_a, model_b, metric, {numbers}, {R('least(1.0, max(step) OVER (PARTITION BY metric ORDER BY p_value, model_a, model_b ROWS UNBOUNDED PRECEDING))', 7)} p_holm, 'computed' AS status
      FROM (SELECT *, ({pairs + 1} - row_number() OVER (PARTITION BY metric ORDER BY p_value, model_a, model_b)) * p_value step FROM ({both}))"""


@query("pairwise_tests", f"""{pairwise_sql(PAIR_ROWS, 3)} UNION ALL BY NAME
    SELECT 'p' model_a, 'external' model_b, unnest(['roc_auc', 'pr_auc']) metric, 'not-computed: no scores for this table' AS status""")
def _(t):
    rows = t.pred.filter("split = 'test' and s is not null")
    return rounded(comparison.pairwise_tests(rows, PAIRS, replicates=REPS, placeholders=[("p", "external", "no scores for this table")]), 7)


def pair_rows(pairs) -> str:
    return "(" + " UNION ALL ".join(f"SELECT '{a}' model_a, '{b}' model_b, y, {a} pa, {b} pb FROM @pred WHERE split = 'test' AND s IS NOT NULL" for a, b in pairs) + ")"


# the reference score against the others on the rows that one of them covers
@query("matched_coverage_tests", pairwise_sql(pair_rows([("p", "p2"), ("p", "s")]), 2))
def _(t):
    return rounded(comparison.matched_coverage_tests(t.pred.filter("split = 'test'"), "p", ["p2", "s"], "s", replicates=REPS), 7)


# the same table without the normal-tail p-values of the DeLong rows
@query("pairwise_tests_estimates", f"""SELECT model_a, model_b, 'roc_auc' metric, {R('auc1', 7)} estimate_a, {R('auc2', 7)} estimate_b, {R('delta', 7)} delta, {R('delta - 1.959964e0 * se', 7)} ci_lo, {R('delta + 1.959964e0 * se', 7)} ci_hi, NULL AS p_value, NULL AS p_holm FROM {delong_sql(PAIR_ROWS, 'y', 'pa', 'pb', 'model_a, model_b')}
    UNION ALL BY NAME SELECT * EXCLUDE step, {R('least(1.0, max(step) OVER (ORDER BY p_value, model_a, model_b ROWS UNBOUNDED PRECEDING))', 7)} p_holm FROM (SELECT model_a, model_b, metric, estimate_a, estimate_b, delta, ci_lo, ci_hi, p_value, (4 - row_number() OVER (ORDER BY p_value, model_a, model_b)) * p_value step
      FROM ({delta_sql(PAIR_ROWS, 'y', 'pa', 'pb', 'model_a, model_b', 'two-sided-complement', REPS, ('pr_auc',))}))""")
def _(t):
    out = comparison.pairwise_tests(t.pred.filter("split = 'test' and s is not null"), PAIRS, replicates=REPS)
    checked = F.col("metric") == "pr_auc"
    return rounded(out.withColumns({c: F.when(checked, C(c)) for c in ("p_value", "p_holm")}).drop("status"), 7)


FAM = family_sql("gene", K.STRATA_FAMILIES)
ERR = f"(SELECT *, {FAM} fam FROM @pred WHERE split = 'test')"


@query("errors_by_group", f"""SELECT t.fam, t.n, t.n_pos, {R('a.roc_auc_raw')} roc_auc, {R('fn / greatest(n1, 1)')} fn_rate, {R('fp / greatest(n0, 1)')} fp_rate FROM (
      SELECT fam, count(*) n, count(*) FILTER (y = 1) n_pos, count(*) FILTER (y = 1) n1, count(*) FILTER (y = 0) n0, count(*) FILTER (y = 1 AND p < 0.5) fn, count(*) FILTER (y = 0 AND p >= 0.5) fp FROM {ERR} GROUP BY fam ORDER BY n DESC, fam LIMIT 10) t
    JOIN {ranking_sql(ERR, 'y', 'p', 'fam')} a ON a.fam = t.fam""")
def _(t):
    rows = t.pred.filter("split = 'test'").withColumn("fam", strata_family(C("gene")))
    return rounded(comparison.errors_by_group(rows, "fam"))


@query("errors_by_class_pair", f"""SELECT a.c ref_class, b.c alt_class, count(x.fn) n, {R('avg(x.fn)')} fn_rate FROM (SELECT unnest({list(K.CLASS_NAMES)}) c) a CROSS JOIN (SELECT unnest({list(K.CLASS_NAMES)}) c) b
    LEFT JOIN (SELECT {CLASS_CASE.format(c='ref_aa')} rc, {CLASS_CASE.format(c='alt_aa')} ac, CASE WHEN p < 0.5 THEN 1 ELSE 0 END fn FROM @pred WHERE y = 1) x ON x.rc = a.c AND x.ac = b.c GROUP BY 1, 2""")
def _(t):
    return rounded(comparison.errors_by_class_pair(t.pred))


@query("errors_by_quintile", f"""SELECT bin, count(*) n, count(*) FILTER (y = 1) n_pos, count(*) FILTER (y = 1 AND p < 0.5) confident_fn, count(*) FILTER (y = 0 AND p > 0.5) confident_fp,
      {R('count(*) FILTER (y = 1 AND p < 0.5) / greatest(count(*) FILTER (y = 1), 1)')} fn_rate, {R('count(*) FILTER (y = 0 AND p > 0.5) / greatest(count(*) FILTER (y = 0), 1)')} fp_rate FROM (
      SELECT y, p, 'Q' || cast(1 + cast(cons > q[1] AS INT) + cast(cons > q[2] AS INT) + cast(cons > q[3] AS INT) + cast(cons > q[4] AS INT) AS VARCHAR) bin FROM @pred, (SELECT quantile_cont(cons, [0.2, 0.4, 0.6, 0.8]) q FROM @pred) WHERE cons IS NOT NULL) GROUP BY bin""")
def _(t):
    return rounded(comparison.errors_by_quintile(t.pred, "cons"))


@query("attribution_ranking", f"SELECT feature, {R('avg(abs(value))')} mean_abs, cast(row_number() OVER (ORDER BY avg(abs(value)) DESC, feature) AS INTEGER) AS rank FROM {LONG_ATTR} GROUP BY feature")
def _(t):
    return rounded(attributions.attribution_ranking(t.attr, FEATURES))


TOP3 = f"(SELECT key, max(CASE WHEN rn = 1 THEN feature END) f1, max(CASE WHEN rn = 2 THEN feature END) f2, max(CASE WHEN rn = 3 THEN feature END) f3, max(CASE WHEN rn = 1 THEN value END) v1, max(CASE WHEN rn = 2 THEN value END) v2, max(CASE WHEN rn = 3 THEN value END) v3 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(value) DESC, feature) rn FROM {LONG_ATTR}) GROUP BY key)"


@query("explained_errors", f"""SELECT e.key, e.y, {R('e.p')} p, CASE WHEN e.y = 0 THEN 'false_positive' ELSE 'false_negative' END error_type, f1 top1_feature, v1 top1_value, f2 top2_feature, v2 top2_value, f3 top3_feature, v3 top3_value
    FROM @pred e JOIN {TOP3} USING (key) WHERE abs(e.p - e.y) > 0.5 AND e.split = 'test'""")
def _(t):
    out = attributions.explained_errors(t.attr, t.pred.filter("split = 'test'").select("key", "y", "p"), FEATURES, "key")
    return out.withColumn("p", F.round("p", 8) + F.lit(0.0))


@query("attribution_top_counts", f"SELECT f1 top1_feature, count(*) n FROM @pred e JOIN {TOP3} USING (key) WHERE abs(e.p - e.y) > 0.5 AND e.y = 1 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 6")
def _(t):
    return attributions.attribution_top_counts(attributions.explained_errors(t.attr, t.pred.select("key", "y", "p"), FEATURES, "key"))


@query("attribution_join", f"SELECT key, cast(rn AS INTEGER) AS rank, feature, value FROM (SELECT a.*, row_number() OVER (PARTITION BY a.key ORDER BY abs(value) DESC, feature) rn FROM {LONG_ATTR} a JOIN @pred e ON e.key = a.key WHERE e.y = 1 AND e.p > 0.95) WHERE rn <= 5")
def _(t):
    return attributions.attribution_join(t.attr, t.pred.select("key", "y", "p"), FEATURES, "key")


PHASED = "(SELECT 'phase1' phase, split eval_set, y, p, 'phase1' || split pk FROM @pred WHERE split <> 'train' UNION ALL SELECT 'phase2', split, y, p2, 'phase2' || split FROM @pred WHERE split <> 'train')"


@query("metric_report_merge", f"""WITH c AS MATERIALIZED (SELECT split_part(pk, 'e', 1) || '' x, pk, ece, mce FROM {brier_sql(PHASED, 'y', 'p', 'pk')}), b AS MATERIALIZED (SELECT pk, avg(roc_auc) r, avg(pr_auc) q, avg(brier_loss) br FROM {boot_sql(PHASED, 'y', {'p': CLIP.format(p='p')}, 'pk', REPS)} GROUP BY pk),
      m AS (SELECT substr(pk, 1, 6) phase, substr(pk, 7) eval_set, ece, mce, r, q, br FROM c JOIN b USING (pk))
    SELECT m.phase, m.eval_set, {R('m.ece', 7)} ece, {R('m.mce', 7)} mce, {R('m.r', 7)} roc_auc, {R('m.q', 7)} pr_auc, {R('m.br', 7)} brier_loss, {R('m.ece - o.ece', 7)} delta_ece, CASE WHEN m.ece - o.ece > 0.01 THEN 'worse' ELSE 'ok' END verdict FROM m JOIN m o ON o.phase = 'phase1' AND o.eval_set = m.eval_set""")
def _(t):
    rows = t.pred.filter("split <> 'train'").selectExpr("split as eval_set", "y", "inline(array(struct('phase1' as phase, p as p), struct('phase2' as phase, p2 as p)))")
    keys = ["phase", "eval_set"]
    cal = metrics.brier_decomposition(rows, groups=keys).select(*keys, "ece", "mce")
    boot = resampling.bootstrap_metrics(rows, groups=keys, replicates=REPS).groupBy(*keys).agg(
        *[F.max(F.when(C("metric") == m, C("mean"))).alias(m) for m in ("roc_auc", "pr_auc", "brier_loss")])
    return rounded(attributions.metric_report_merge(cal, boot), 7)


def stacked_sql(split: str, a: str, b: str, name: str, test: str, alt: str) -> str:
    src = f"(SELECT * FROM @pred WHERE split = '{split}')"
    return f"SELECT '{name}' comparison, metric, delta, ci_lo, ci_hi, p_value, '{test}' AS test, n_samples AS n FROM ({delta_sql(src, 'y', a, b, '', alt, REPS)})"


@query("metric_delta_stack", stacked_sql("test", "p", "p2", "full_vs_second", "paired bootstrap", "two-sided") + " UNION ALL " + stacked_sql("val", "p", "s", "full_vs_sequence", "paired bootstrap, one-sided", "greater"))
def _(t):
    a = resampling.paired_bootstrap_delta(t.pred.filter("split = 'test'"), score_a="p", score_b="p2", replicates=REPS)
    b = resampling.paired_bootstrap_delta(t.pred.filter("split = 'val'"), score_a="p", score_b="s", replicates=REPS, alternative="greater")
    return rounded(attributions.stack_deltas([("full_vs_second", "paired bootstrap", a), ("full_vs_sequence", "paired bootstrap, one-sided", b)]), 7)


@query("metric_drift_check", f"""SELECT split, {R('a.roc_auc_raw', 7)} AS "current", {R('b.roc_auc_raw', 7)} AS stored, {R('abs(a.roc_auc_raw - b.roc_auc_raw)', 7)} drift, abs(a.roc_auc_raw - b.roc_auc_raw) < 0.02 AS "within"
    FROM {ranking_sql('@pred', 'y', 'p', 'split')} a FULL JOIN {ranking_sql('(SELECT split, y, p FROM @pred WHERE NOT family_holdout)', 'y', 'p', 'split')} b USING (split)""")
def _(t):
    now = metrics.roc_auc(t.pred, groups=["split"]).select("split", C("roc_auc").alias("value"))
    old = metrics.roc_auc(t.pred.filter("not family_holdout"), groups=["split"]).select("split", C("roc_auc").alias("value"))
    return rounded(attributions.metric_drift_check(now, old, ["split"], tol=0.02), 7)
