"""Dedup, aggregation, profiling, data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.catalog.base import R, in_list, query, rounded
from helixframe.operators import dedup, profiling

C = F.col


@query("drop_conflicting_keys", """SELECT rid, label FROM @var WHERE variant_key NOT IN (SELECT variant_key FROM @var GROUP BY 1 HAVING min(label) < max(label))""")
def _(t):
    return dedup.drop_conflicting_keys(t.var.select("variant_key", "rid", "label")).select("rid", "label")


@query("conflicting_keys", "SELECT variant_key, count(*) n FROM @var GROUP BY 1 HAVING min(label) < max(label)")
def _(t):
    return dedup.conflicting_keys(t.var)


@query("dedup_keep_first", "SELECT variant_key, rid, label FROM (SELECT *, row_number() OVER (PARTITION BY variant_key ORDER BY o1, rid) rn FROM @var) WHERE rn = 1")
def _(t):
    return dedup.keep_first(t.var.select("variant_key", "rid", "label", "o1"), ["variant_key"], ["o1", "rid"]).drop("o1")


@query("dedup_report", "SELECT count(*) rows_before, count(DISTINCT variant_key) rows_after, count(*) - count(DISTINCT variant_key) duplicates_removed FROM @var")
def _(t):
    return dedup.dedup_report(t.var, ["variant_key"])


@query("dedup_most_constrained", """SELECT gene, oe_lof_upper, "pLI" FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY oe_lof_upper NULLS LAST, "pLI") rn
    FROM (SELECT s_nationkey AS gene, case when s_suppkey % 5 = 0 then null else cast(s_suppkey % 17 as double) end AS oe_lof_upper, s_acctbal AS "pLI" FROM supplier)) WHERE rn = 1""")
def _(t):
    rows = t.supplier.selectExpr("s_nationkey as gene", "case when s_suppkey % 5 = 0 then null else cast(s_suppkey % 17 as double) end as oe_lof_upper", "s_acctbal as pLI")
    return dedup.most_constrained(rows, ["pLI"])


def first_sql(c: str, usable: str) -> str:
    return f"first({c} ORDER BY o1, rid) FILTER ({usable}) AS {c}"


@query("collapse_transcripts", f"""SELECT variant_key, {first_sql('cons', 'cons IS NOT NULL')}, {first_sql('note', "note IS NOT NULL AND trim(note) <> ''")},
    {first_sql('aaref', "aaref IS NOT NULL AND trim(aaref) <> ''")}, bool_or(coalesce(flag, false)) flag FROM @annall GROUP BY variant_key""")
def _(t):
    rows = t.annall.select("variant_key", "o1", "rid", "cons", "note", "aaref", "flag")
    return dedup.collapse_transcripts(rows, ["o1", "rid"], any_true=["flag"])


@query("aggregate_isoforms", f"""SELECT variant_key, min(s) score_min, max(s) score_max, {R('avg(s)')} score_mean, first(s ORDER BY rid) score_first
    FROM (SELECT v.variant_key, v.rid, p.s FROM @var v JOIN @pred p ON v.rid = p.key) WHERE s IS NOT NULL GROUP BY 1""")
def _(t):
    from helixframe.catalog.base import KEY, RID, SCORE

    rows = t.lineitem.selectExpr(f"{KEY} as variant_key", f"{RID} as rid", f"{SCORE} as score")
    out = dedup.aggregate_isoforms(rows, ["rid"])
    return out.withColumn("score_mean", F.round("score_mean", 8) + F.lit(0.0))


@query("isoform_counts", "SELECT quantile_cont(n, 0.5) p50, quantile_cont(n, 0.95) p95 FROM (SELECT variant_key, count(*) n FROM @var GROUP BY 1)")
def _(t):
    from helixframe.operators.ordered import exact_quantiles

    counts = t.var.groupBy("variant_key").agg(F.count(F.lit(1)).alias("k"))
    return exact_quantiles(counts, "k", [0.5, 0.95]).select(C("q0").alias("p50"), C("q1").alias("p95"))


@query("check_duplicates", """SELECT cast(sum(n) FILTER (n > 1) AS BIGINT) duplicate_rows, count(*) FILTER (n > 1) duplicate_keys,
      (SELECT count(*) FROM (SELECT chr, pos FROM @var GROUP BY 1, 2 HAVING count(DISTINCT variant_key) > 1)) near_duplicate_positions
    FROM (SELECT variant_key, count(*) n FROM @var GROUP BY 1)""")
def _(t):
    return profiling.check_duplicates(t.var)["summary"]


@query("check_duplicates_top_keys", "SELECT variant_key, count(*) n FROM @var GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, variant_key LIMIT 10")
def _(t):
    return profiling.check_duplicates(t.var)["keys"]


@query("check_duplicates_positions", "SELECT l_linestatus, l_shipdate, count(DISTINCT l_partkey) unique_variants FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_partkey) > 1 ORDER BY 3 DESC, 1, 2 LIMIT 10")
def _(t):
    return profiling.check_duplicates(t.lineitem, "l_partkey", ("l_linestatus", "l_shipdate"))["positions"]


@query("check_label_integrity", """SELECT cast(sum(CASE WHEN l IS NULL THEN 1 ELSE 0 END) AS BIGINT) missing_labels, cast(sum(CASE WHEN l NOT IN (0, 1) THEN 1 ELSE 0 END) AS BIGINT) invalid_labels,
      (SELECT count(*) FROM (SELECT variant_key FROM (SELECT variant_key, case when review_stars = 0 and "AC" > 80 then null when "AC" = 7 then 2 else label end l FROM @var) GROUP BY 1 HAVING min(l) < max(l))) keys_with_both_labels
    FROM (SELECT variant_key, case when review_stars = 0 and "AC" > 80 then null when "AC" = 7 then 2 else label end l FROM @var)""")
def _(t):
    rows = t.var.selectExpr("variant_key", "case when review_stars = 0 and AC > 80 then null when AC = 7 then 2 else label end as label")
    return profiling.check_label_integrity(rows)


PROFILED = {"rid": "string", "label": "int", "domain": "string", "sparse": "double", "empty": "double", "constant": "int", "has_domain": "boolean", "quantity": "double"}


def profile_sql(c: str, kind: str) -> str:
    n, k = f'count(*) - count("{c}")', f'count(DISTINCT "{c}")'
    return (f"SELECT '{c}' AS \"column\", '{kind}' dtype, {n} missing_count, round(({n}) * 100.0 / count(*), 4) missing_pct, {k} distinct_values, {k} <= 1 zero_variance, "
            f"{n} = count(*) all_null, ({n}) * 100.0 / count(*) > 80 high_missing FROM @var")


@query("profile_columns", " UNION ALL ".join(profile_sql(c, k) for c, k in PROFILED.items()))
def _(t):
    return profiling.profile_columns(t.var.select(*PROFILED))


NUMS = ["quantity", "price", "sparse", "AC", "phyloP100way_vertebrate"]


def outlier_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(x) count_non_null, {R('avg(x)', 6)} mean, {R('stddev_samp(x)', 6)} std, min(x) min, max(x) max, {R('any_value(q1)', 6)} q1, {R('any_value(q3)', 6)} q3, {R('any_value(q3 - q1)', 6)} iqr,
      count(*) FILTER (x < q1 - 0.5 * (q3 - q1) OR x > q3 + 0.5 * (q3 - q1)) outlier_count, {R('any_value(q1 - 0.5 * (q3 - q1))', 6)} lower_bound, {R('any_value(q3 + 0.5 * (q3 - q1))', 6)} upper_bound,
      round(count(*) FILTER (x < q1 - 0.5 * (q3 - q1) OR x > q3 + 0.5 * (q3 - q1)) * 100.0 / count(x), 4) outlier_pct
    FROM (SELECT "{c}" x FROM @var), (SELECT quantile_cont("{c}", 0.25) q1, quantile_cont("{c}", 0.75) q3 FROM @var)"""


@query("profile_outliers", " UNION ALL ".join(outlier_sql(c) for c in NUMS))
def _(t):
    return rounded(profiling.profile_outliers(t.var, NUMS, spread=0.5), 6)


@query("check_class_balance", "SELECT count(*) FILTER (label = 0) n_neg, count(*) FILTER (label = 1) n_pos, round(count(*) FILTER (label = 1) / count(*) FILTER (label = 0), 6) ratio, count(*) FILTER (label = 1) / count(*) FILTER (label = 0) NOT BETWEEN 1/3 AND 3 AS warning FROM @var")
def _(t):
    return profiling.check_class_balance(t.var)


@query("profile_groups", """SELECT count(*) unique_groups, count(*) FILTER (n = 1) single_row_groups, count(*) FILTER (p = n) only_positive_groups, count(*) FILTER (p = 0) only_negative_groups
    FROM (SELECT cast(l_partkey AS VARCHAR) || l_linestatus || cast(l_quantity AS VARCHAR) g, count(*) n, count(*) FILTER (l_returnflag = 'R') p FROM lineitem GROUP BY 1)""")
def _(t):
    rows = t.lineitem.selectExpr("l_partkey || l_linestatus || l_quantity as gene", "case when l_returnflag = 'R' then 1 else 0 end as label")
    return profiling.profile_groups(rows)


@query("group_stats_topk", f"SELECT gene, count(*) n, {R('avg(label)')} positive_ratio FROM @var GROUP BY gene ORDER BY n DESC, gene LIMIT 20")
def _(t):
    return rounded(profiling.group_stats_topk(t.var))


CORR = ["quantity", "price", "price2", "AC", "phyloP100way_vertebrate", "sparse", "constant"]


def corr_sql(a: str, b: str) -> str:
    return f"""SELECT '{a}' feature_1, '{b}' feature_2, corr(x, y) r, round((n - count(x0)) * 100.0 / n, 4) m1, round((n - count(y0)) * 100.0 / n, 4) m2 FROM
      (SELECT cast("{a}" AS DOUBLE) x0, cast("{b}" AS DOUBLE) y0, CASE WHEN "{b}" IS NOT NULL THEN cast("{a}" AS DOUBLE) END x, CASE WHEN "{a}" IS NOT NULL THEN cast("{b}" AS DOUBLE) END y FROM @var), (SELECT count(*) n FROM @var) GROUP BY n"""


PAIRS_SQL = " UNION ALL ".join(corr_sql(a, b) for i, a in enumerate(CORR[:6]) for b in CORR[i + 1:6])


@query("correlation_pairs", f"""SELECT feature_1, feature_2, {R('r', 7)} correlation, m1 feature_1_missing_pct, m2 feature_2_missing_pct,
      CASE WHEN m1 > m2 THEN feature_1 WHEN m2 > m1 THEN feature_2 ELSE greatest(feature_1, feature_2) END suggest_drop FROM ({PAIRS_SQL})""")
def _(t):
    out = profiling.correlation_pairs(t.var, CORR, threshold=None)
    return out.withColumn("correlation", F.round("correlation", 7) + F.lit(0.0))


@query("correlation_pairs_high", f"""SELECT feature_1, feature_2, {R('r', 7)} correlation FROM ({PAIRS_SQL}) WHERE abs(r) > 0.8""")
def _(t):
    out = profiling.correlation_pairs(t.var, CORR, threshold=0.8)
    return out.select("feature_1", "feature_2", (F.round("correlation", 7) + F.lit(0.0)).alias("correlation"))


# price and price2 are the one highly correlated pair; both complete, so the later name goes
@query("drop_correlated_greedy", "SELECT unnest(['AC', 'constant', 'phyloP100way_vertebrate', 'price', 'quantity', 'sparse']) AS \"column\", (SELECT count(*) FROM @var) AS n_rows")
def _(t):
    kept = profiling.drop_correlated(t.var.select(*CORR), CORR)
    return kept.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.explode(F.array(*[F.lit(c) for c in kept.columns])).alias("column"), "n_rows")


@query("critical_issue_gate", """SELECT * FROM (SELECT 'conflicting_keys' AS "check", count(*) n FROM (SELECT variant_key FROM @var GROUP BY 1 HAVING min(label) < max(label))
    UNION ALL SELECT 'all_null_columns', cast((count("empty") = 0) AS INT) + cast((count(sparse) = 0) AS INT) + cast((count(rid) = 0) AS INT) FROM @var
    UNION ALL SELECT 'label_integrity', count(*) FROM @var WHERE label IS NULL OR label NOT IN (0, 1)) WHERE n > 0""")
def _(t):
    return profiling.critical_issue_gate(t.var, ["empty", "sparse", "rid"])


@query("drop_dead_columns", "SELECT rid, domain, sparse FROM @var")
def _(t):
    return profiling.drop_dead_columns(t.var.select("rid", "domain", "sparse", "empty", "constant"))


MISS = ["sparse", "empty", "domain", "quantity", "phyloP100way_vertebrate", "Grantham_distance"]


def miss_sql(c: str) -> str:
    pct = f'(count(*) - count("{c}")) * 100.0 / count(*)'
    return f"SELECT '{c}' AS \"column\", round({pct}, 4) missing_pct, CASE WHEN {pct} > 80 THEN 'drop' WHEN {pct} > 50 THEN 'warn' ELSE 'keep' END AS action FROM @var"


@query("missingness_policy", " UNION ALL ".join(miss_sql(c) for c in MISS))
def _(t):
    return profiling.missingness_policy(t.var, MISS)


@query("missingness_drop", "SELECT rid, domain, quantity FROM @var")
def _(t):
    return profiling.apply_missingness_policy(t.var.select("rid", "sparse", "empty", "domain", "quantity"), ["sparse", "empty", "domain", "quantity"])


@query("impute_with_flags", f"""SELECT rid, quantity, coalesce("phyloP100way_vertebrate", m.a) AS "phyloP100way_vertebrate", coalesce("phastCons100way_vertebrate", m.b) AS "phastCons100way_vertebrate", coalesce(domain, m.c) AS domain,
      "phyloP100way_vertebrate" IS NULL AS "is_imputed_phyloP100way_vertebrate", "phastCons100way_vertebrate" IS NULL AS "is_imputed_phastCons100way_vertebrate"
    FROM (SELECT *, case when label = 0 and "AC" > 75 then null else domain end AS d FROM @var) v,
      (SELECT quantile_cont("phyloP100way_vertebrate", 0.5) a, quantile_cont("phastCons100way_vertebrate", 0.5) b FROM @var) n,
      (SELECT n1.a, n1.b, d1.c FROM (SELECT quantile_cont("phyloP100way_vertebrate", 0.5) a, quantile_cont("phastCons100way_vertebrate", 0.5) b FROM @var) n1,
        (SELECT domain c FROM @var WHERE domain IS NOT NULL GROUP BY domain ORDER BY count(*) DESC, domain LIMIT 1) d1) m""")
def _(t):
    rows = t.var.select("rid", "quantity", "phyloP100way_vertebrate", "phastCons100way_vertebrate", "domain", "sparse")
    return profiling.impute_with_flags(rows, rows.columns[1:], max_missing=25.0)


NAMES_SQL = "(SELECT DISTINCT CASE l_partkey % 8 WHEN 0 THEN 'rev_el_' WHEN 1 THEN 'M-CAP' WHEN 2 THEN 'metaLR_' WHEN 3 THEN 'GERP_' WHEN 4 THEN 'vest4.' WHEN 5 THEN 'AF' ELSE 'x' END || cast(l_suppkey AS VARCHAR) AS \"column\" FROM lineitem)"
BAN = " ".join(f"WHEN contains(regexp_replace(lower(\"column\"), '[^a-z0-9]', '', 'g'), '{profiling.normal_name(b)}') THEN '{b}'" for b in K.BANNED_PREDICTORS)


@query("circular_feature_check", f"SELECT * FROM (SELECT \"column\", CASE {BAN} END predictor FROM {NAMES_SQL}) WHERE predictor IS NOT NULL")
def _(t):
    names = t.lineitem.selectExpr("case l_partkey % 8 when 0 then 'rev_el_' when 1 then 'M-CAP' when 2 then 'metaLR_' when 3 then 'GERP_' when 4 then 'vest4.' when 5 then 'AF' else 'x' end || l_suppkey as column").distinct()
    return profiling.circular_feature_check(names)


@query("dataset_summary", "SELECT count(*) n_rows, cast(4 AS BIGINT) n_columns, count(*) FILTER (label = 1) n_pos, count(*) FILTER (label = 0) n_neg, round(count(*) FILTER (label = 1) / count(*) FILTER (label = 0), 6) ratio, round((count(*) - count(sparse)) * 100.0 / count(*), 6) max_missing_pct FROM @var")
def _(t):
    return profiling.dataset_summary(t.var.select("rid", "label", "sparse", "domain"))


@query("af_summary", f"""SELECT count(*) total, count(*) FILTER ("AF" > 1e-2) common, count(*) FILTER ("AF" <= 1e-2) rare, {R('avg("AF")')} mean_af FROM @afall""")
def _(t):
    return rounded(profiling.af_summary(t.afall))


@query("value_counts_sorted", "SELECT chr, n, cast(coalesce(try_cast(chr AS INT), CASE chr WHEN 'X' THEN 23 WHEN 'Y' THEN 24 END, 25) AS INT) AS position FROM (SELECT case when pos % 5 = 0 then 'X' when pos % 7 = 0 then 'MT' else chr end chr, count(*) n FROM @var GROUP BY 1)")
def _(t):
    return profiling.value_counts_sorted(t.var.selectExpr("case when pos % 5 = 0 then 'X' when pos % 7 = 0 then 'MT' else chr end as chr"))


@query("score_coverage_by_class", f"SELECT y, count(*) n_rows, count(s) n_present, count(*) - count(s) n_imputed, {R('avg(s)')} score_mean, {R('quantile_cont(s, 0.5)')} score_median FROM @pred GROUP BY y")
def _(t):
    return rounded(profiling.score_coverage_by_class(t.pred, "s", "y"))


def class_mean_sql(c: str) -> str:
    return f"SELECT label, '{c}' AS \"column\", {R(f'avg({chr(34)}{c}{chr(34)})', 6)} mean, {R(f'quantile_cont({chr(34)}{c}{chr(34)}, 0.5)', 6)} median FROM @var GROUP BY label"


@query("class_feature_means", " UNION ALL ".join(class_mean_sql(c) for c in NUMS))
def _(t):
    return rounded(profiling.class_feature_means(t.var, NUMS), 6)


@query("class_histogram_density", f"""SELECT r.label, bin, coalesce(n, 0) n, {R('lo + bin * w', 6)} edge_low, {R('coalesce(n, 0) / (tot * w)')} density FROM
      (SELECT *, unnest(range(60))::INTEGER bin FROM (SELECT label, min(quantity * 1.01e0) lo, (max(quantity * 1.01e0) - min(quantity * 1.01e0)) / 60 w, count(*) tot FROM @var GROUP BY label)) r
      LEFT JOIN (SELECT label, bin, count(*) n FROM (SELECT label, cast(CASE WHEN w > 0 THEN least(floor((x - lo) / w), 59) ELSE 30 END AS INTEGER) bin FROM (SELECT label, quantity * 1.01e0 x FROM @var)
        JOIN (SELECT label, min(quantity * 1.01e0) lo, (max(quantity * 1.01e0) - min(quantity * 1.01e0)) / 60 w FROM @var GROUP BY label) USING (label)) GROUP BY label, bin) c USING (label, bin)""")
def _(t):
    out = profiling.class_histogram(t.var.selectExpr("label", "quantity * 1.01e0 as x"), "x")
    return rounded(out.withColumn("edge_low", F.round("edge_low", 6)))


@query("class_boxplot_stats", "SELECT label, count(*) n, " + ", ".join(f"{R(f'quantile_cont(ln(1 + {chr(34)}AC{chr(34)}), {q})')} {n}" for q, n in ((0, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (1, "high"))) + " FROM @var GROUP BY label")
def _(t):
    return rounded(profiling.class_boxplot_stats(t.var, "AC"))


@query("pivot_domain_by_class", f"""SELECT label, count(*) FILTER (NOT has_domain) n_false, count(*) FILTER (has_domain) n_true, {R('count(*) FILTER (NOT has_domain) * 100.0 / count(*)')} pct_false, {R('count(*) FILTER (has_domain) * 100.0 / count(*)')} pct_true FROM @var GROUP BY label""")
def _(t):
    return rounded(profiling.pivot_flag_by_class(t.var, "has_domain"))


#: The third partner is a weak one, so that its p-value is not zero: the score and a cycle of the rows.
SPEARMAN = (("cons", "cons"), ("p", "p"), ("stars", "cast(review_stars as double)"))
# the tail of the t density by Simpson's rule over 40 units, far beyond which it is nothing at these numbers of rows
STUDENT_SQL = """(SELECT partner, n, spearman_rho, exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi() * v) * 2 * (4e1 / 4e4) / 3
      * sum((CASE WHEN k = 0 OR k = 40000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + (t + k * 1e-3) * (t + k * 1e-3) / v, -(v + 1) / 2)) p_value
    FROM (SELECT *, cast(n - 2 AS DOUBLE) v, abs(spearman_rho) * sqrt((n - 2) / (1 - spearman_rho * spearman_rho)) t FROM {src}), (SELECT unnest(range(40001)) k) GROUP BY partner, n, spearman_rho, v, t)"""
RHO_SQL = "(" + " UNION ALL ".join(
    f"SELECT '{c}' partner, count(*) n, corr(rx, ry) spearman_rho FROM (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 rx, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 ry FROM (SELECT s, {e} x FROM @pred) WHERE s IS NOT NULL AND x IS NOT NULL)"
    for c, e in SPEARMAN) + ")"


@query("spearman_table", f"SELECT partner, n, {R('spearman_rho', 7)} spearman_rho, {R('p_value', 6)} p_value FROM {STUDENT_SQL.format(src=RHO_SQL)}")
def _(t):
    from helixframe.operators.comparison import spearman_table

    rows = t.pred.select("s", "cons", "p", C("review_stars").cast("double").alias("stars"))
    out = spearman_table(rows, "s", ["cons", "p", "stars"])
    return out.withColumns({"spearman_rho": F.round("spearman_rho", 7) + F.lit(0.0), "p_value": F.round("p_value", 6) + F.lit(0.0)})
