"""Model training, scoring, calibration and retraining studies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.catalog.base import R, query, rounded
from helixframe.catalog.evaluation import CLIP, brier_sql
from helixframe.operators import attributions, metrics
from helixframe.operators.ordered import running_sums
from helixframe.plans import explain, training
from helixframe.session import cut_lineage

C = F.col
#: The stand-in labels differ by a shift of six units of one measure: rows below 7 are negative, rows above
#: 50 positive, and between them nothing tells. So the best AUC is that of these three steps, and a sound fit
#: comes this close to it.
NEAR = 0.025
KNOWN = "case when {q} < 7e0 then 0 when {q} > 50e0 then 2 else 1 end"


def best_auc(rows, label: str, groups=()):
    """AUC that the three steps reach, one row for each group."""
    shaped = rows.withColumn("known", C("known").cast("double"))
    return metrics.ranking_metrics(shaped, label, "known", list(groups)).select(*groups, C("roc_auc").alias("best_auc"))


def near(auc: str = "roc_auc", best: str = "best_auc"):
    return F.coalesce(F.abs(C(auc) - C(best)) <= NEAR, F.lit(False))


@query("one_hot_min_frequency", """SELECT coalesce(gene, 'MISSING') AS level, count(*) n, CASE WHEN count(*) >= 25 THEN coalesce(gene, 'MISSING') ELSE '__infrequent__' END encoded
    FROM (SELECT case when l_suppkey % 7 = 0 then null else cast(l_partkey as string) end AS gene FROM lineitem) GROUP BY 1""")
def _(t):
    rows = t.lineitem.selectExpr("case when l_suppkey % 7 = 0 then null else cast(l_partkey as string) end as gene")
    return training.one_hot_levels(rows, "gene")


@query("class_weight", f"SELECT count(*) FILTER (label = 1) n_pos, count(*) FILTER (label = 0) n_neg, {R('count(*) FILTER (label = 0) / count(*) FILTER (label = 1)')} weight FROM @var")
def _(t):
    return rounded(training.class_weight(t.var))


def modelling(t):
    """Learnable rows: measures of the line, two categories, group split by part."""
    return t.lineitem.selectExpr(
        "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as variant_key",
        "case when l_returnflag = 'R' then 1 else 0 end as label",
        "case when l_partkey % 20 < 14 then 'train' when l_partkey % 20 < 17 then 'val' else 'test' end as split",
        "'part' || (l_partkey % 400) as family",
        "l_quantity + case when l_returnflag = 'R' then 6e0 else 0e0 end as quantity",
        "case when l_suppkey % 11 = 0 then null else l_extendedprice end as price",
        "l_discount as discount", "l_tax > 4e-2 as high_tax",
        "case when l_suppkey % 6 = 0 then null else 'c' || (l_suppkey % 8) end as category", "l_linestatus as status",
        KNOWN.format(q="(l_quantity + case when l_returnflag = 'R' then 6e0 else 0e0 end)") + " as known",
    )


#: Trees of each of the fits of a study at most. A model of the telling measure alone goes on improving for
#: hundreds of trees, as the rows that it settles are settled ever more surely.
STUDY = {"max_iter": 200}
#: Columns of `modelling` that are carried along and never model inputs.
CARRIED = ["family", "known"]


MODEL_SQL = """(SELECT split, quantity, discount, coalesce(price, med) price FROM (SELECT case when l_partkey % 20 < 14 then 'train' when l_partkey % 20 < 17 then 'val' else 'test' end AS split,
      l_quantity + case when l_returnflag = 'R' then 6e0 else 0e0 end AS quantity, l_discount AS discount, case when l_suppkey % 11 = 0 then null else l_extendedprice end AS price FROM lineitem),
      (SELECT quantile_cont(l_extendedprice, 0.5) med FROM lineitem WHERE l_suppkey % 11 <> 0 AND l_partkey % 20 < 14))"""
LEVELS_SQL = """(SELECT (SELECT count(DISTINCT e) FROM (SELECT CASE WHEN count(*) >= 25 THEN c ELSE '__infrequent__' END e FROM (SELECT case when l_suppkey % 6 = 0 then 'MISSING' else 'c' || cast(l_suppkey % 8 AS VARCHAR) end c FROM lineitem WHERE l_partkey % 20 < 14) GROUP BY c))
      + (SELECT count(DISTINCT l_linestatus) FROM lineitem WHERE l_partkey % 20 < 14) lv)"""


@query("feature_vectors", f"SELECT split, count(*) n, cast(4 + any_value(lv) AS INTEGER) width, 0::BIGINT n_nan, {R('avg(quantity)', 4)} mean_quantity, {R('avg(price)', 0)} mean_price, {R('avg(discount)', 5)} mean_discount FROM {MODEL_SQL}, {LEVELS_SQL} GROUP BY split")
def _(t):
    data = modelling(t)
    train = data.filter("split = 'train'")
    numeric, text = training.model_columns(data, {"split", *CARRIED})
    model = training.fit_features(train, numeric, text)
    from pyspark.ml.functions import vector_to_array

    at = {c: F.get(vector_to_array("features"), F.lit(i)) for i, c in enumerate(numeric)}
    v = vector_to_array("features")
    return model.transform(data).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.size(v)).alias("width"), F.count_if(F.exists(v, F.isnan)).alias("n_nan"),
        *[(F.round(F.avg(at[c]), d) + F.lit(0.0)).alias(f"mean_{c}") for c, d in (("quantity", 4), ("price", 0), ("discount", 5))])


MODEL_ROWS = """(SELECT cast(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS variant_key, case when l_returnflag = 'R' then 1 else 0 end AS label,
      case when l_partkey % 20 < 14 then 'train' when l_partkey % 20 < 17 then 'val' else 'test' end AS split, l_partkey % 400 AS family, l_suppkey,
      case when q < 7e0 then 0 when q > 50e0 then 2 else 1 end AS known FROM (SELECT *, l_quantity + case when l_returnflag = 'R' then 6e0 else 0e0 end AS q FROM lineitem))"""


# metrics of a fit depend on the library's random draws; what must hold of any sound fit is checked
@query("train_boosted_trees", f"""SELECT split, count(*) n, cast(sum(label) AS BIGINT) n_pos, true AS auc_near_best, true AS ap_above_chance, true AS calibrated_monotone, true AS in_range,
      true AS enough_trees, true AS patience_kept, true AS loss_recomputed
    FROM {MODEL_ROWS} WHERE split <> 'train' GROUP BY split""")
def _(t):
    data = modelling(t)
    fit = training.fit_scorer(data, keep=CARRIED)
    trees, preds = fit.trees, cut_lineage(fit.predictions)
    scores = metrics.ranking_metrics(preds, "y_true", "p_raw", ["split"]).join(best_auc(preds, "y_true", ["split"]), "split").select(
        "split", "n", "n_pos", near().alias("auc_near_best"), (C("pr_auc") > C("n_pos") / C("n")).alias("ap_above_chance"))
    steps = preds.groupBy("split", "p_raw").agg(F.min("p_calibrated").alias("low"), F.max("p_calibrated").alias("high"))
    before = F.lag("high").over(Window.partitionBy("split").orderBy("p_raw"))
    monotone = steps.withColumn("ok", (C("low") == C("high")) & (F.coalesce(before, C("low")) <= C("low"))).groupBy("split").agg(
        F.bool_and("ok").alias("calibrated_monotone"),
        F.bool_and(C("p_raw").between(0, 1) & C("low").between(0, 1)).alias("in_range"))
    # the reported loss of the best iteration, from the written scores of the validation rows
    weight = training.class_weight(data.filter("split = 'train'")).first()["weight"]
    w = F.when(C("y_true") == 1, weight).otherwise(1.0)
    loss = -2 * F.log(F.when(C("y_true") == 1, C("p_raw")).otherwise(1 - C("p_raw")))
    measured = preds.filter("split = 'val'").agg((F.sum(w * loss) / F.sum(w)).alias("loss"))
    least = trees.loss_table(t.spark).agg(F.min_by("val_loss", "iteration").alias("first"), F.max(F.when(C("is_best"), C("val_loss"))).alias("least"))
    agrees = measured.join(F.broadcast(least)).select((F.abs(C("loss") - C("least")) < 1e-6).alias("loss_recomputed"))
    return scores.join(monotone, "split").join(F.broadcast(agrees)).select(
        "*", F.lit(trees.n_grown >= 100).alias("enough_trees"),
        F.lit(trees.n_grown - trees.best_iteration >= training.DEFAULT_PARAMS["patience"] or trees.n_grown == training.DEFAULT_PARAMS["max_iter"]).alias("patience_kept"))


def hexed(at: int) -> str:
    return f"(('0x' || substr(md5('42:' || cast(trial AS VARCHAR)), {4 * at + 1}, 4))::BIGINT / 65535e0)"


@query("param_search", f"""SELECT 'trial' AS kind, cast(trial AS INTEGER) number, cast(3 + floor({hexed(0)} * 4.999e0) AS INTEGER) max_depth, round(2.5e-2 + {hexed(1)} * (12e-2 - 2.5e-2), 6) step_size,
      cast(1 + floor({hexed(2)} * 7.999e0) AS INTEGER) min_instances, round(72e-2 + {hexed(3)} * 28e-2, 6) subsample, round(65e-2 + {hexed(4)} * 35e-2, 6) feature_share,
      NULL::BIGINT AS n_trials, NULL::INTEGER AS n_trees, true AS sound
    FROM (SELECT unnest(range(40)) trial), (SELECT count(*) n FROM {MODEL_ROWS} WHERE split = 'val') WHERE n > 0
    UNION ALL SELECT 'rung', rung, NULL, NULL, NULL, NULL, NULL, n, trees, true FROM (VALUES (0, 20, 8), (1, 10, 16), (2, 5, 32), (3, 5, 64)) r(rung, n, trees)""")
def _(t):
    data = modelling(t)
    history = training.param_search(data, trials=40, keep=CARRIED)[1]
    val = data.filter("split = 'val'")
    bounds = val.agg(F.avg("label").alias("chance")).join(best_auc(val, "label"))
    numbers = [F.round(c, 6).alias(c) for c in ("step_size", "subsample", "feature_share")]
    # few shallow trees do not reach the best AUC, but no fit is better than it or worse than half of it
    fair = C("val_roc").between(0.5 + (C("best_auc") - 0.5) / 2, C("best_auc") + NEAR) & (C("val_pr") > C("chance")) & (C("best_iteration") <= C("n_trees"))
    trials = history.join(F.broadcast(bounds)).select(
        F.lit("trial").alias("kind"), C("trial").alias("number"), "max_depth", *numbers, "min_instances",
        F.lit(None).cast("long").alias("n_trials"), F.lit(None).cast("int").alias("n_trees"), F.coalesce(fair, F.lit(False)).alias("sound"))
    # trials that a rung dropped are no better in it than those that went on
    last = history.groupBy("rung").agg(F.count(F.lit(1)).alias("n_trials"), F.max("n_trees").alias("n_trees"), F.min("n_trees").alias("fewest"))
    ladder = last.select(
        F.lit("rung").alias("kind"), C("rung").alias("number"), *[F.lit(None).cast(k).alias(c) for c, k in (
            ("max_depth", "int"), ("step_size", "double"), ("min_instances", "int"), ("subsample", "double"), ("feature_share", "double"))],
        "n_trials", "n_trees", (C("fewest") == C("n_trees")).alias("sound"))
    return trials.unionByName(ladder)


# rows that the measure decides must be told by the model; the others have no right answer
@query("score_predictions", f"""SELECT variant_key, split, 'part' || family AS family, label AS y_true, true AS in_range, CASE known WHEN 0 THEN false WHEN 2 THEN true END AS called FROM {MODEL_ROWS} WHERE split <> 'train'""")
def _(t):
    out = training.train_and_score(modelling(t), keep=CARRIED)
    return out.select("variant_key", "split", "family", "y_true", (C("p_raw").between(0, 1) & C("p_calibrated").between(0, 1)).alias("in_range"),
                      F.when(C("known") != 1, C("p_raw") > 0.5).alias("called"))


# Isotonic fit by the max-min formula over all runs of distinct validation scores.
ISO = """iso_c AS MATERIALIZED (SELECT p x, row_number() OVER (ORDER BY p) i, sum(sum(y)) OVER (ORDER BY p) cy, sum(count(*)) OVER (ORDER BY p) cn, sum(y) sy, count(*) sn FROM @pred WHERE split = 'val' GROUP BY p),
      iso_m AS (SELECT j.i j, k.i k, min((k.cy - j.cy + j.sy) / (k.cn - j.cn + j.sn)) OVER (PARTITION BY j.i ORDER BY k.i DESC) m FROM iso_c j JOIN iso_c k ON k.i >= j.i),
      iso AS MATERIALIZED (SELECT c.x, max(m) g FROM iso_c c JOIN (SELECT k, max(m) OVER (PARTITION BY k) m FROM iso_m) q ON q.k = c.i GROUP BY c.x)"""
ISO_AT = "CASE WHEN lo.x IS NULL THEN hi.g WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.g ELSE lo.g + (hi.g - lo.g) * (s.p - lo.x) / (hi.x - lo.x) END"
ISO_JOIN = "ASOF LEFT JOIN iso lo ON s.p >= lo.x ASOF LEFT JOIN iso hi ON s.p <= hi.x"


@query("fit_isotonic", f"WITH {ISO} SELECT x AS score, {R('g', 6)} fitted FROM iso")
def _(t):
    val = t.pred.filter("split = 'val'")
    model = training.fit_isotonic(val)
    fitted = training.apply_isotonic(model, val.select("p").distinct(), out="fitted")
    return fitted.select(C("p").alias("score"), (F.round("fitted", 6) + F.lit(0.0)).alias("fitted"))


@query("apply_isotonic", f"WITH {ISO} SELECT s.key, s.y, {R(ISO_AT, 6)} p_calibrated FROM (SELECT * FROM @pred WHERE split = 'test') s {ISO_JOIN}")
def _(t):
    model = training.fit_isotonic(t.pred.filter("split = 'val'"))
    out = training.apply_isotonic(model, t.pred.filter("split = 'test'").select("key", "y", "p"))
    return rounded(out.drop("p"), 6)


# violations of monotonicity over the distinct scores: there must be none
@query("isotonic_monotone", "SELECT 0::BIGINT n_decreasing, 0::BIGINT n_outside, count(DISTINCT p) n_scores FROM @pred")
def _(t):
    model = training.fit_isotonic(t.pred.filter("split = 'val'"))
    out = training.apply_isotonic(model, t.pred.select("p").distinct())
    run = running_sums(out.withColumn("one", F.lit(1)), "p", ["one"]).select(
        (C("one_before")).alias("i"), "p_calibrated")
    prev = run.select((C("i") + 1).alias("i"), C("p_calibrated").alias("before"))
    both = run.join(prev, "i", "left")
    return both.agg(F.count_if(C("p_calibrated") < C("before") - 1e-12).alias("n_decreasing"),
                    F.count_if(~C("p_calibrated").between(0, 1)).alias("n_outside"), F.count(F.lit(1)).alias("n_scores"))


# Newton steps for the two coefficients; the slope carries the unit L2 term.
PLATT = """WITH RECURSIVE pc AS MATERIALIZED (SELECT p x, cast(y AS DOUBLE) y, cast(count(*) AS DOUBLE) n FROM @pred WHERE split = 'val' GROUP BY ALL),
      st AS (SELECT 0 i, cast(0 AS DOUBLE) a, cast(0 AS DOUBLE) b UNION ALL
        SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
          SELECT any_value(i) i, any_value(a) a, any_value(b) b, any_value(a) + sum(n * (q - y) * x) ga, sum(n * (q - y)) gb, 1 + sum(n * q * (1 - q) * x * x) haa, sum(n * q * (1 - q) * x) hab, sum(n * q * (1 - q)) hbb
          FROM (SELECT st.i, st.a, st.b, pc.*, 1 / (1 + exp(-(st.a * pc.x + st.b))) q FROM st, pc WHERE st.i < 12)) WHERE i IS NOT NULL),
      coef AS MATERIALIZED (SELECT a, b FROM st ORDER BY i DESC LIMIT 1)"""


@query("fit_platt", f"{PLATT} SELECT {R('a', 4)} slope, {R('b', 4)} intercept FROM coef")
def _(t):
    model = training.fit_platt(t.pred.filter("split = 'val'"))
    n = t.pred.filter("split = 'val'").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.select(F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept")), 4)


@query("apply_platt", f"{PLATT} SELECT y, count(*) n, {R('avg(1 / (1 + exp(-(a * p + b))))', 5)} mean_p, {R('max(1 / (1 + exp(-(a * p + b))))', 5)} max_p FROM @pred, coef WHERE split = 'test' GROUP BY y")
def _(t):
    model = training.fit_platt(t.pred.filter("split = 'val'"))
    out = training.apply_platt(model, t.pred.filter("split = 'test'").select("key", "y", "p"))
    return rounded(out.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("p_platt").alias("mean_p"), F.max("p_platt").alias("max_p")), 5)


CAL_LONG = f"(SELECT split, y, calibrator, split || calibrator sc, CASE calibrator WHEN 'raw' THEN s.p WHEN 'platt' THEN 1 / (1 + exp(-(a * s.p + b))) ELSE {ISO_AT} END pv FROM (SELECT * FROM @pred WHERE split <> 'train') s {ISO_JOIN}, coef, (SELECT unnest(['raw', 'platt', 'isotonic']) calibrator))"
CAL_OUT = ", ".join(f"{R(c, 4)} {c}" for c in ("brier", "reliability", "resolution", "uncertainty", "ece", "mce"))


@query("decomposition_table", f"""{PLATT}, {ISO}, cl AS MATERIALIZED (SELECT * FROM {CAL_LONG})
    SELECT l.calibrator, l.split, b.n, {CAL_OUT}, {R('l.loss', 4)} log_loss FROM {brier_sql('cl', 'y', 'pv', 'sc')} b
    JOIN (SELECT sc, any_value(split) split, any_value(calibrator) calibrator, avg(CASE WHEN y = 1 THEN -ln({CLIP.format(p='pv')}) ELSE -ln(1 - {CLIP.format(p='pv')}) END) loss FROM cl GROUP BY sc) l USING (sc)""")
def _(t):
    out = training.decomposition_table(t.pred.filter("split = 'val'").select("y", "p"), t.pred.filter("split = 'test'").select("y", "p"))
    return rounded(out.drop("residual"), 4)


GROUPS = {
    "quantity": ("quantity",), "price": ("price",), "discount": ("discount",), "tax_flag": ("high_tax",),
    "category": ("category",), "status": ("status",),
}
#: The one group that the labels depend on.
TELLING = "quantity"
GROUP_ROWS = "(SELECT unnest([" + ", ".join(f"'{g}'" for g in GROUPS) + "]) feature_group)"


def test_best(data):
    return best_auc(data.filter("split = 'test'"), "label")


@query("feature_ablation", f"""SELECT feature_group AS removed, 1 AS n_removed, metric, true AS full_near_best, true AS interval_holds_delta, feature_group = '{TELLING}' AS loses, true AS kept_near_full
    FROM {GROUP_ROWS}, (SELECT unnest(['roc_auc', 'pr_auc']) metric), (SELECT count(*) n FROM {MODEL_ROWS} WHERE split = 'test') WHERE n > 0""")
def _(t):
    data = cut_lineage(modelling(t))
    out = training.feature_ablation(data, GROUPS, replicates=1000, params=STUDY, keep=CARRIED)
    return out.join(F.broadcast(test_best(data))).select(
        "removed", "n_removed", "metric", ((C("metric") == "pr_auc") | near("full")).alias("full_near_best"),
        ((C("ci_lo") <= C("delta")) & (C("delta") <= C("ci_hi"))).alias("interval_holds_delta"), (C("delta") > 5e-2).alias("loses"),
        ((C("removed") == TELLING) | (F.abs("delta") <= NEAR)).alias("kept_near_full"))


@query("single_group_models", f"""SELECT feature_group, count(*) n, cast(sum(label) AS BIGINT) n_pos, feature_group = '{TELLING}' AS near_best, feature_group <> '{TELLING}' AS near_chance FROM {MODEL_ROWS}, {GROUP_ROWS} WHERE split = 'test' GROUP BY feature_group""")
def _(t):
    data = cut_lineage(modelling(t))
    out = training.single_group_models(data, GROUPS, params=STUDY, keep=CARRIED)
    return out.join(F.broadcast(test_best(data))).select(
        "feature_group", "n", "n_pos", near().alias("near_best"), (F.abs(C("roc_auc") - 0.5) < 2 * NEAR).alias("near_chance"))


FRACTIONS = (0.10, 0.25, 0.50, 0.75, 1.00)


@query("learning_curve", f"""SELECT split, fraction::DOUBLE fraction, count(*) n, cast(sum(label) AS BIGINT) n_pos, true AS auc_near_best FROM {MODEL_ROWS}, (SELECT unnest([0.1, 0.25, 0.5, 0.75, 1.0]) fraction)
    WHERE split <> 'train' GROUP BY ALL""")
def _(t):
    data = cut_lineage(modelling(t))
    out = training.learning_curve(data, FRACTIONS, params=STUDY, keep=CARRIED)
    return out.join(F.broadcast(best_auc(data, "label", ["split"])), "split").select("split", "fraction", "n", "n_pos", near().alias("auc_near_best"))


@query("strict_vs_balanced", f"""SELECT 'balanced' AS version, count(*) n, cast(sum(label) AS BIGINT) n_pos, true AS auc_near_best FROM {MODEL_ROWS} WHERE split = 'test'
    UNION ALL SELECT 'strict', count(*), cast(sum(label) AS BIGINT), true FROM {MODEL_ROWS} WHERE split = 'test' AND l_suppkey % 11 <> 0 AND l_suppkey % 6 <> 0""")
def _(t):
    data = cut_lineage(modelling(t))
    fit = training.fit_scorer(data, keep=CARRIED)
    test = data.filter("split = 'test'")
    versions = {"strict": test.filter("price is not null and category is not null"), "balanced": test}
    out = training.score_versions(fit.trees, fit.features, versions)
    best = [best_auc(rows, "label").withColumn("version", F.lit(name)) for name, rows in versions.items()]
    return out.join(best[0].unionByName(best[1]), "version").select("version", "n", "n_pos", near().alias("auc_near_best"))


# attributions of a fitted model: they add up for every row, and the measure that decides a row leads it
@query("tree_attributions", f"""SELECT variant_key, split, label AS y_true, true AS adds_up, CASE WHEN known <> 1 THEN 'num__quantity' END AS leading, CASE known WHEN 0 THEN -1 WHEN 2 THEN 1 END AS direction
    FROM {MODEL_ROWS} WHERE split <> 'train'""")
def _(t):
    fit = training.fit_scorer(modelling(t), keep=CARRIED, params=SMALL_FIT)
    rows, names = explained_rows(t, fit)
    total = sum((C(f"`{n}`") for n in names), C("base"))
    tops = attributions.top_features(names, 1)[0]
    decided = C("known") != 1
    return rows.select(
        "variant_key", "split", C("label").alias("y_true"), (F.abs(total - C("log_odds")) < 1e-6).alias("adds_up"),
        F.when(decided, tops["feature"]).alias("leading"), F.when(decided, F.signum(tops["value"]).cast("int")).alias("direction"))


#: A short fit: attributions hold for any ensemble.
SMALL_FIT = {"max_iter": 30, "max_depth": 4}


def explained_rows(t, fit):
    held = fit.features.transform(modelling(t).filter("split <> 'train'"))
    names = fit.features.manifest()
    return cut_lineage(explain.attributions(fit.trees.model, held, names, ["variant_key", "split", "known", "label"])), names
