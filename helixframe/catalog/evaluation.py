"""Classifier metrics, calibration, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalog.base import R, query, ranking_sql, rounded
from helixframe.operators import metrics, resampling
from helixframe.plans import evaluation as plan

C = F.col
REPS = 1000
PERMUTATIONS = 10_000
CLIP = "least(greatest({p}, 1e-12), 1e0 - 1e-12)"


@query("roc_auc", f"SELECT split, n, n_pos, {R('roc_auc_raw')} roc_auc FROM {ranking_sql('@pred', 'y', 'p', 'split')}")
def _(t):
    return rounded(metrics.roc_auc(t.pred, groups=["split"]))


@query("average_precision", f"SELECT split, n, n_pos, {R('pr_auc_raw')} pr_auc FROM {ranking_sql('@pred', 'y', 'p', 'split')}")
def _(t):
    return rounded(metrics.average_precision(t.pred, groups=["split"]))


@query("ranking_metrics_documents", f"SELECT n, n_pos, {R('roc_auc_raw')} roc_auc, {R('pr_auc_raw')} pr_auc FROM {ranking_sql('(SELECT l.quality y, cast(d.n_chars AS DOUBLE) p FROM documents d JOIN labels l USING (doc_id))', 'y', 'p')}")
def _(t):
    rows = t.documents.select("doc_id", C("n_chars").cast("double").alias("p")).join(t.labels.select("doc_id", C("quality").alias("y")), "doc_id")
    return rounded(metrics.ranking_metrics(rows))


CONF = "SELECT split, count(*) FILTER (y=1 AND p>=0.5) tp, count(*) FILTER (y=0 AND p>=0.5) fp, count(*) FILTER (y=1 AND p<0.5) fn, count(*) FILTER (y=0 AND p<0.5) tn FROM @pred GROUP BY split"


@query("confusion_metrics", f"""SELECT split, 5e-1 AS threshold, tn, fp, fn, tp, {R('(tp + tn) / (tp + tn + fp + fn)')} accuracy, {R('(tp / (tp + fn) + tn / (tn + fp)) / 2')} balanced_accuracy, {R('tp / (tp + fp)')} AS precision, {R('tp / (tp + fn)')} recall,
      {R('2 * tp / (2 * tp + fp + fn)')} f1, {R('(tp * tn - fp * fn) / sqrt(cast(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))')} mcc, tp + tn + fp + fn AS support, tp + fn AS n_pos, tn + fp AS n_neg FROM ({CONF})""")
def _(t):
    return rounded(metrics.confusion_metrics(t.pred, groups=["split"]))


@query("brier_logloss", f"SELECT split, {R('avg((c - y) ** 2)')} brier_loss, {R('avg(CASE WHEN y = 1 THEN -ln(c) ELSE -ln(1 - c) END)')} log_loss FROM (SELECT *, {CLIP.format(p='p')} c FROM @pred) GROUP BY split")
def _(t):
    return rounded(metrics.brier_logloss(t.pred, groups=["split"]))


CURVE = """(SELECT sc, cast(sum(pos) OVER w AS DOUBLE) tp, cast(sum(neg) OVER w AS DOUBLE) fp, cast(sum(pos) OVER () AS DOUBLE) tot_p, cast(sum(neg) OVER () AS DOUBLE) tot_n
      FROM (SELECT p sc, count(*) FILTER (y=1) pos, count(*) FILTER (y=0) neg FROM @pred GROUP BY 1) WINDOW w AS (ORDER BY sc DESC))"""


@query("roc_points", f"SELECT sc AS threshold, {R('fp / tot_n')} fpr, {R('tp / tot_p')} tpr FROM {CURVE}")
def _(t):
    out = metrics.roc_points(t.pred)
    return out.select("threshold", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("fpr", "tpr")])


@query("pr_points", f"SELECT sc AS threshold, {R('tp / (tp + fp)')} AS precision, {R('tp / tot_p')} recall FROM {CURVE}")
def _(t):
    out = metrics.pr_points(t.pred)
    return out.select("threshold", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("precision", "recall")])


GRID = "(SELECT unnest([" + ", ".join(f"{v!r}e0" for v in metrics.threshold_grid()) + "]) AS threshold)"
SWEEP = f"""(SELECT threshold, coalesce(2 * tp / (2 * tp + fp + p1 - tp), 0) f1, coalesce(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 0) AS precision, tp / p1 recall FROM (
      SELECT threshold, cast(count(*) FILTER (p >= threshold AND y = 1) AS DOUBLE) tp, cast(count(*) FILTER (p >= threshold AND y = 0) AS DOUBLE) fp, cast(count(*) FILTER (y = 1) AS DOUBLE) p1 FROM {GRID}, @pred GROUP BY threshold))"""


@query("threshold_sweep", f"SELECT {R('threshold')} AS threshold, {R('f1')} f1, {R('precision')} AS precision, {R('recall')} recall FROM {SWEEP}")
def _(t):
    return rounded(metrics.threshold_sweep(t.pred))


@query("best_threshold", f"SELECT {R('threshold')} AS threshold, {R('f1')} f1 FROM {SWEEP} s ORDER BY s.f1 DESC, s.threshold LIMIT 1")
def _(t):
    return rounded(metrics.best_threshold(t.pred))


def op_sql(bound: str, goal: str, target: float) -> str:
    pick = f"SELECT sc, tp / (tp + fp) AS precision, tp / tot_p AS recall FROM {CURVE}"
    return f"SELECT '{bound}>={target:.2f}' AS \"constraint\", max(sc) threshold, {R('max(precision)')} AS precision, {R('max(recall)')} recall, count(*) > 0 achieved FROM (SELECT * FROM ({pick}) WHERE {bound} >= {target}e0 ORDER BY {goal} DESC, sc LIMIT 1)"


@query("operating_points", " UNION ALL ".join(op_sql(b, g, x) for b, g in (("recall", "precision"), ("precision", "recall")) for x in (0.80, 0.90, 0.95, 0.99)))
def _(t):
    out = metrics.operating_points(t.pred)
    return out.withColumns({c: F.round(c, 8) + F.lit(0.0) for c in ("precision", "recall")})


def bins_sql(src: str, y: str, p: str, groups: str, n_bins=15, uniform=False) -> str:
    """Cells of `src` with bin statistics; `groups` is a comma list."""
    inner = "[" + ", ".join(f"{e!r}e0" for e in metrics.even_grid(n_bins)[1:-1]) + "]"
    edges = f"SELECT {groups}, {inner} inner_edges FROM {src} GROUP BY ALL" if uniform else f"SELECT {groups}, quantile_cont({CLIP.format(p=p)}, {inner}) inner_edges FROM {src} GROUP BY {groups}"
    return f"""(SELECT {groups}, bin, any_value(inner_edges) inner_edges, count(*) n, avg(c) mp, avg(yy) my FROM (
        SELECT {groups}, {y} yy, {CLIP.format(p=p)} c, inner_edges, cast(len(list_filter(inner_edges, lambda e: e <= {CLIP.format(p=p)})) AS INTEGER) bin FROM {src} JOIN ({edges}) USING ({groups})) GROUP BY {groups}, bin)"""


def bins_out(src, y, p, groups, **more) -> str:
    n_bins = more.get("n_bins", 15)
    return f"""SELECT {groups}, bin, {R('CASE WHEN bin = 0 THEN 0 ELSE inner_edges[bin] END')} edge_low, {R(f'CASE WHEN bin = {n_bins - 1} THEN 1 ELSE inner_edges[bin + 1] END')} edge_high,
      n AS "count", {R('mp')} mean_predicted_prob, {R('my')} fraction_positive, {R('abs(mp - my)')} gap FROM {bins_sql(src, y, p, groups, **more)}"""


@query("reliability_bins", bins_out("@pred", "y", "p", "split"))
def _(t):
    return rounded(metrics.reliability_bins(t.pred, groups=["split"]))


@query("reliability_bins_uniform", bins_out("(SELECT * FROM @pred WHERE true)", "y", "p", "split", n_bins=10, uniform=True))
def _(t):
    return rounded(metrics.reliability_bins(t.pred, n_bins=10, strategy="uniform", groups=["split"]))


def brier_sql(src: str, y: str, p: str, groups: str) -> str:
    return f"""(SELECT b.*, t.brier, t.n, t.yb, t.yb * (1 - t.yb) uncertainty FROM (
        SELECT {groups}, sum(n / tot * (mp - my) ** 2) reliability, sum(n / tot * (my - yb) ** 2) resolution, sum(n / tot * abs(mp - my)) ece, max(abs(mp - my)) mce
        FROM {bins_sql(src, y, p, groups)} JOIN (SELECT {groups}, avg({y}) yb, count(*) tot FROM {src} GROUP BY {groups}) USING ({groups}) GROUP BY {groups}) b
      JOIN (SELECT {groups}, avg(({CLIP.format(p=p)} - {y}) ** 2) brier, count(*) n, avg({y}) yb FROM {src} GROUP BY {groups}) t USING ({groups}))"""


BRIER_OUT = ", ".join(f"{R(c)} {c}" for c in ("brier", "reliability", "resolution", "uncertainty", "ece", "mce"))


@query("brier_decomposition", f"SELECT split, n, {BRIER_OUT}, {R('brier - (reliability - resolution + uncertainty)')} residual FROM {brier_sql('@pred', 'y', 'p', 'split')}")
def _(t):
    return rounded(metrics.brier_decomposition(t.pred, groups=["split"]))


EXT_LONG = """(SELECT slice, y, variant, CASE variant WHEN 'raw' THEN p ELSE p2 END pv, slice || variant sv FROM
      (SELECT 'full' AS slice, y, p, p2 FROM @pred WHERE split = 'test' UNION ALL SELECT 'family_holdout', y, p, p2 FROM @pred WHERE split = 'test' AND family_holdout), (SELECT unnest(['raw', 'calibrated']) variant))"""


@query("external_calibration", f"""SELECT s.slice, s.variant, s.n_pos, b.n, {BRIER_OUT}, {R('brier - (reliability - resolution + uncertainty)')} residual
    FROM {brier_sql(EXT_LONG, 'y', 'pv', 'sv')} b JOIN (SELECT sv, any_value(slice) slice, any_value(variant) variant, count(*) FILTER (y = 1) n_pos FROM {EXT_LONG} GROUP BY sv) s USING (sv)""")
def _(t):
    preds = t.pred.filter("split = 'test'").selectExpr("y as label", "p as p_raw", "p2 as p_calibrated", "family_holdout")
    return rounded(plan.external_calibration(preds))


# ---- resampling twins --------------------------------------------------------------------

def boot_sql(src: str, y: str, scores: dict[str, str], groups: str = "", reps: int = REPS, seed: int = 42) -> str:
    """Per-replicate metrics of the cell bootstrap, one row per (groups, track, rep)."""
    prime = resampling.PRIME
    g = f"{groups}, " if groups else ""
    names = ", ".join(f"s_{k}" for k in scores)
    defs = ", ".join(f"{e} AS s_{k}" for k, e in scores.items())
    present = " AND ".join(f"{e} IS NOT NULL" for e in scores.values())
    key = "concat_ws(':', cast(yy AS VARCHAR), " + ", ".join(f"cast(cast(round(s_{k} * 1e9) AS HUGEINT) AS VARCHAR) || '.' || cast(cast(round((s_{k} * 1e9 - round(s_{k} * 1e9)) * 1e7) AS BIGINT) AS VARCHAR)" for k in scores) + ")"

    def hexed(expr, start):
        return f"cast(('0x' || substr({expr}, {start}, 8)) AS BIGINT) % {prime}"

    coef = ", ".join(f"{hexed('md5(k)', s)} c{i}" for i, s in enumerate((1, 9, 17, 25))) + f", {hexed(chr(109) + 'd5(k || ' + repr(':e') + ')', 1)} c4"
    long = " UNION ALL ".join(f"SELECT {g}rep, yy, '{k}' AS track, s_{k} sc, w FROM wt" for k in scores)
    part = f"PARTITION BY {g}track, rep"
    return f"""(WITH cells AS (SELECT *, {hexed('d', 1)} h1, {hexed('d', 9)} h2 FROM (SELECT *, md5({key}) d FROM (
        SELECT {g}{names}, yy, count(*) n FROM (SELECT {g}{y} yy, {defs} FROM {src} WHERE {present}) GROUP BY ALL))),
      coef AS MATERIALIZED (SELECT rep, {coef} FROM (SELECT rep, '{seed}:' || cast(rep AS VARCHAR) k FROM (SELECT unnest(range({reps})) rep))),
      pois AS MATERIALIZED (SELECT n, k, sum(pm) OVER (PARTITION BY n ORDER BY k) cdf FROM (SELECT n, k, exp(k * ln(n) - n - lgamma(k + 1)) pm FROM (
        SELECT n, unnest(range(greatest(0, n - floor(12 * sqrt(n))::BIGINT - 40), n + floor(12 * sqrt(n))::BIGINT + 41)) k FROM (SELECT DISTINCT n FROM cells)))),
      draws AS (SELECT {g}rep, yy, {names}, n, ((((((((c0 * h1 + c1) % {prime}) * h1 + c2) % {prime}) * h1 + c3) % {prime}) + (c4 * h2) % {prime}) % {prime} + 5e-1) / {prime}e0 u FROM cells, coef),
      wt AS MATERIALIZED (SELECT d.* EXCLUDE (n, u), cast(p.k AS DOUBLE) w FROM draws d ASOF JOIN pois p ON d.n = p.n AND d.u <= p.cdf),
      lev AS (SELECT {g}track, rep, sc, coalesce(sum(w) FILTER (yy = 1), 0) pos, coalesce(sum(w) FILTER (yy = 0), 0) neg FROM ({long}) GROUP BY ALL),
      cum AS (SELECT *, sum(pos) OVER w tp, sum(neg) OVER w fp, sum(pos) OVER ({part}) tot_p, sum(neg) OVER ({part}) tot_n FROM lev WINDOW w AS ({part} ORDER BY sc DESC)),
      per AS (SELECT {g}track, rep, any_value(tot_p) pp, any_value(tot_n) nn, sum(pos * (tot_n - fp + neg / 2)) u, sum(CASE WHEN tp + fp > 0 THEN pos * tp / (tp + fp) ELSE 0 END) ap,
        sum(CASE WHEN sc >= 0.5 THEN pos ELSE 0 END) tp, sum(CASE WHEN sc >= 0.5 THEN neg ELSE 0 END) fp, sum(pos * (1 - sc) ** 2 + neg * sc ** 2) br FROM cum GROUP BY ALL)
    SELECT {g}track, rep, u / (pp * nn) roc_auc, ap / pp pr_auc, 2 * tp / (tp + fp + pp) f1, br / (pp + nn) brier_loss,
      CASE WHEN (tp + fp) * (nn - fp + pp - tp) > 0 THEN (tp * (nn - fp) - fp * (pp - tp)) / sqrt((tp + fp) * pp * nn * (nn - fp + pp - tp)) ELSE 0 END mcc,
      CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, tp / pp recall FROM per WHERE pp > 0 AND nn > 0)"""


def summary_sql(inner: str, keys: str, metrics_=resampling.METRICS, digits=7) -> str:
    return " UNION ALL ".join(
        f"""SELECT {keys}'{m}' metric, {R(f'avg({m})', digits)} mean, {R(f'quantile_cont({m}, 0.5)', digits)} median, {R(f'quantile_cont({m}, 0.025)', digits)} ci_lo, {R(f'quantile_cont({m}, 0.975)', digits)} ci_hi,
        {R(f'stddev_samp({m})', digits)} std, count({m}) n_effective FROM b {'GROUP BY ' + keys.rstrip(', ') if keys else ''}""" for m in metrics_)


@query("bootstrap_ci", f"WITH b AS MATERIALIZED (SELECT * FROM {boot_sql('@pred', 'y', {'p': CLIP.format(p='p')}, 'split')}) {summary_sql('b', 'split, ')}")
def _(t):
    return rounded(resampling.bootstrap_metrics(t.pred, groups=["split"], replicates=REPS), 7)


def delta_sql(src: str, y: str, a: str, b: str, groups: str = "", pvalue="two-sided", reps=REPS, metrics_=("roc_auc", "pr_auc")) -> str:
    g = f"{groups}, " if groups else ""
    by = f"GROUP BY {groups}" if groups else ""
    p = {"two-sided": "2 * least(avg(CASE WHEN d <= 0 THEN 1 ELSE 0 END), avg(CASE WHEN d >= 0 THEN 1 ELSE 0 END))", "greater": "avg(CASE WHEN d <= 0 THEN 1.0 ELSE 0.0 END)",
         "two-sided-complement": "2 * least(avg(CASE WHEN d >= 0 THEN 1 ELSE 0 END), 1 - avg(CASE WHEN d >= 0 THEN 1 ELSE 0 END))"}[pvalue]
    both = f"(SELECT * FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    boots = " UNION ALL ".join(
        f"""SELECT {g}'{m}' metric, {R('avg(d)', 7)} boot_mean_delta, {R('quantile_cont(d, 0.025)', 7)} ci_lo, {R('quantile_cont(d, 0.975)', 7)} ci_hi, {R(p, 7)} p_value, count(d) n_boot_used, {reps} - count(d) n_boot_skipped
        FROM (SELECT {g}rep, max(CASE WHEN track = 'a' THEN {m} END) - max(CASE WHEN track = 'b' THEN {m} END) d FROM bt GROUP BY ALL) {by}""" for m in metrics_)
    using = f"USING ({g}metric)"
    points = " UNION ALL ".join(
        f"SELECT {g}'{m}' metric, n n_samples, {R(f'x.{m}_raw', 7)} estimate_a, {R(f'z.{m}_raw', 7)} estimate_b, {R(f'x.{m}_raw - z.{m}_raw', 7)} delta FROM {ranking_sql(both, y, a, groups)} x JOIN (SELECT {g}roc_auc_raw, pr_auc_raw FROM {ranking_sql(both, y, b, groups)}) z {('USING (' + groups + ')') if groups else 'ON true'}" for m in metrics_)
    return f"WITH bt AS MATERIALIZED (SELECT * FROM {boot_sql(src, y, {'a': a, 'b': b}, groups, reps)}) SELECT * FROM ({points}) JOIN ({boots}) {using}"


@query("paired_bootstrap_delta", delta_sql("(SELECT * FROM @pred WHERE split = 'test')", "y", "p", "s"))
def _(t):
    return rounded(resampling.paired_bootstrap_delta(t.pred.filter("split = 'test'"), score_a="p", score_b="s", replicates=REPS), 7)


@query("paired_bootstrap_one_sided", delta_sql("(SELECT * FROM @pred WHERE split <> 'train')", "y", "p", "p2", "split", "greater"))
def _(t):
    rows = t.pred.filter("split <> 'train'")
    return rounded(resampling.paired_bootstrap_delta(rows, score_a="p", score_b="p2", groups=["split"], replicates=REPS, alternative="greater"), 7)


#: Depth of the splitting tree in SQL: enough for 1,024 distinct scores.
DEAL_DEPTH = 10


def permutation_sql(src: str, y: str, p: str, reps: int, seed=42) -> str:
    """The positives of every node of a binary tree over the distinct scores are split by hypergeometric draws,
    level by level; masses come from log-gamma."""
    prime = resampling.PRIME

    def hexed(expr, start):
        return f"cast(('0x' || substr({expr}, {start}, 8)) AS BIGINT) % {prime}"

    coef = ", ".join(f"{hexed('md5(k)', s)} c{i}" for i, s in enumerate((1, 9, 17, 25))) + f", {hexed(chr(109) + 'd5(k || ' + repr(':e') + ')', 1)} c4"
    ways = "lgamma({a} + 1) - lgamma({b} + 1) - lgamma({a} - {b} + 1)"
    parts = [f"""WITH c AS MATERIALIZED (SELECT v, count(*) n, cast(sum(yy) AS BIGINT) pos, row_number() OVER (ORDER BY v) - 1 i, cast(sum(count(*)) OVER (ORDER BY v) AS BIGINT) upto
        FROM (SELECT {p} v, {y} yy FROM {src} WHERE {p} IS NOT NULL AND {y} IS NOT NULL) GROUP BY v),
      tot AS MATERIALIZED (SELECT cast(sum(n) AS BIGINT) n, cast(sum(pos) AS BIGINT) m, count(*) d, sum(pos * (upto - n + (n + 1) / 2e0)) obs FROM c),
      pre AS MATERIALIZED (SELECT i, upto - n ahead FROM c UNION ALL SELECT d, n FROM tot),
      coef AS MATERIALIZED (SELECT rep, {coef} FROM (SELECT rep, '{seed}:' || cast(rep AS VARCHAR) k FROM (SELECT unnest(range({reps})) rep))),
      l0 AS (SELECT rep, 0::BIGINT k, m FROM coef, tot)"""]
    for d in range(DEAL_DEPTH):
        parts.append(f"""
      n{d} AS MATERIALIZED (SELECT k, b.ahead - a.ahead nl, e.ahead - b.ahead nr, {hexed(f"md5(cast({1 << d} + k AS VARCHAR))", 1)} h1, {hexed(f"md5(cast({1 << d} + k AS VARCHAR))", 9)} h2
        FROM (SELECT unnest(range({1 << d})) k), tot JOIN pre a ON a.i = (k * d) >> {d} JOIN pre b ON b.i = ((2 * k + 1) * d) >> {d + 1} JOIN pre e ON e.i = ((k + 1) * d) >> {d}),
      s{d} AS MATERIALIZED (SELECT rep, l.k, m, nl, nr, (((((((c0 * h1 + c1) % {prime}) * h1 + c2) % {prime}) * h1 + c3) % {prime} + (c4 * h2) % {prime}) % {prime} + 5e-1) / {prime} u
        FROM l{d} l JOIN n{d} USING (k) JOIN coef USING (rep) WHERE nl > 0 AND nr > 0 AND m > 0),
      w{d} AS (SELECT k, m, nl, nr, m * nl / cast(nl + nr AS DOUBLE) mu, sqrt(greatest(0, m * nl / cast(nl + nr AS DOUBLE) * nr / (nl + nr) * (nl + nr - m) / greatest(nl + nr - 1, 1))) sd FROM (SELECT DISTINCT k, m, nl, nr FROM s{d})),
      p{d} AS (SELECT k, m, x, exp({ways.format(a='nl', b='x')} + {ways.format(a='nr', b='(m - x)')} - ({ways.format(a='(nl + nr)', b='m')})) q
        FROM (SELECT *, unnest(range(cast(greatest(0, m - nr, floor(mu - 8 * sd - 12)) AS BIGINT), cast(least(m, nl, ceil(mu + 8 * sd + 12)) AS BIGINT) + 1)) x FROM w{d})),
      f{d} AS MATERIALIZED (SELECT k, m, x, sum(q) OVER (PARTITION BY k, m ORDER BY x) / sum(q) OVER (PARTITION BY k, m) c FROM p{d}),
      g{d} AS (SELECT s.rep, s.k, s.m, f.x FROM s{d} s ASOF JOIN f{d} f ON s.k = f.k AND s.m = f.m AND s.u <= f.c),
      l{d + 1} AS MATERIALIZED (SELECT rep, 2 * k k, x m FROM g{d} UNION ALL SELECT rep, 2 * k + 1, m - x FROM g{d}
        UNION ALL SELECT rep, CASE WHEN nl > 0 THEN 2 * k ELSE 2 * k + 1 END, m FROM l{d} JOIN n{d} USING (k) WHERE (nl = 0 OR nr = 0) AND m > 0)""")
    return ",".join(parts) + f""",
      r AS (SELECT rep, sum(l.m * (c.upto - c.n + (c.n + 1) / 2e0)) rs FROM l{DEAL_DEPTH} l, tot JOIN c ON c.i = (l.k * tot.d) >> {DEAL_DEPTH} GROUP BY rep)
    SELECT {R('any_value((obs - m * (m + 1) / 2e0) / (m * (n - m)))')} auc, {R('avg((rs - m * (m + 1) / 2e0) / (m * (n - m)))')} null_mean, {R('avg(CASE WHEN rs >= obs THEN 1 ELSE 0 END)')} p_value, count(*) n_permutations, any_value(n) n, any_value(m) n_pos FROM r, tot"""


# a nearly uninformative score, so that the p-value is not trivially zero
WEAK = "(SELECT *, cast((l_partkey * 7 + l_orderkey * 13) % 501 as double) + (CASE WHEN l_returnflag = 'R' AND l_suppkey % 50 = 0 THEN 60 ELSE 0 END) AS weak, {y} AS yv FROM lineitem)"
from helixframe.catalog.base import Y  # noqa: E402


@query("permutation_auc_test", permutation_sql(WEAK.format(y=Y), "yv", "weak", PERMUTATIONS))
def _(t):
    rows = t.lineitem.selectExpr(f"{Y} as y", "cast((l_partkey * 7 + l_orderkey * 13) % 501 as double) + (case when l_returnflag = 'R' and l_suppkey % 50 = 0 then 60 else 0 end) as p")
    return rounded(resampling.permutation_auc_test(rows, replicates=PERMUTATIONS))


def significance_sql(slices: dict[str, str]) -> str:
    arms = []
    for name, condition in slices.items():
        src = f"(SELECT * FROM {WEAK.format(y=Y)} WHERE {condition})"
        arms.append(f"""SELECT '{name}' AS slice, t.*, b.* FROM ({permutation_sql(src, 'yv', 'weak', PERMUTATIONS)}) t,
          (SELECT {R('quantile_cont(roc_auc, 0.025)', 6)} ci_lo, {R('quantile_cont(roc_auc, 0.975)', 6)} ci_hi, count(*) n_boot FROM {boot_sql(src, 'yv', {'p': 'weak'})}) b""")
    return " UNION ALL ".join(arms)


@query("auc_significance", significance_sql({"full": "true", "holdout": "l_partkey % 3 = 0"}))
def _(t):
    rows = t.lineitem.selectExpr(f"{Y} as y", "cast((l_partkey * 7 + l_orderkey * 13) % 501 as double) + (case when l_returnflag = 'R' and l_suppkey % 50 = 0 then 60 else 0 end) as p", "l_partkey % 3 = 0 as holdout")
    out = rounded(resampling.auc_significance(rows, {"full": True, "holdout": C("holdout")}, replicates=PERMUTATIONS, draws=REPS))
    return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in ("ci_lo", "ci_hi")})
