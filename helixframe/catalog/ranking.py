"""Windows, ranks, top-k, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.catalog.base import R, family_sql, query, rounded
from helixframe.functions.families import gene_family
from helixframe.operators import attributions, comparison, ordered, splitting, structure

C = F.col


@query("rank_mid", "SELECT key, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rank_mid FROM @pred".replace("2.0 AS", "2e0 AS"))
def _(t):
    return ordered.mid_ranks(t.pred.select("key", "p"), "p").select("key", "rank_mid")


@query("rank_pct_average", f"SELECT key, CASE WHEN s IS NOT NULL THEN {R('(rank() OVER (ORDER BY s NULLS LAST) + (count(*) OVER (PARTITION BY s) - 1) / 2e0) / count(s) OVER ()')} END pct FROM @pred")
def _(t):
    return rounded(comparison.rank_pct(t.pred.select("key", "s"), "s", "pct").select("key", "pct"))


@query("rank_ordinal_neutral", f"""SELECT key, CASE WHEN s IS NULL THEN 5e-1 ELSE {R('(row_number() OVER (PARTITION BY s IS NULL ORDER BY s, h, key) - 1) / cast(n - 1 AS DOUBLE)')} END r
    FROM (SELECT key, s, md5('0:' || key) h, count(s) OVER () n FROM @pred)""")
def _(t):
    return rounded(comparison.rank_neutral(t.pred.select("key", "s"), "s", "key", "r").select("key", "r"))


@query("position_window_mean", f"""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, {R('sum(l_quantity) OVER w / count(*) OVER w')} window_mean FROM lineitem
    WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")
def _(t):
    rows = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    out = structure.position_window_mean(rows, "l_quantity", "l_orderkey", "l_suppkey")
    return rounded(out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "window_mean"))


@query("running_max_adjust", f"""SELECT metric, part, {R('p')} p_value, {R('least(1.0, max(step) OVER (PARTITION BY metric ORDER BY p, part ROWS UNBOUNDED PRECEDING))')} p_holm FROM (
      SELECT metric, part, p, (count(*) OVER (PARTITION BY metric) - row_number() OVER (PARTITION BY metric ORDER BY p, part) + 1) * p step FROM (
        SELECT event_type metric, cast(user_id % 40 AS BIGINT) part, round(min(value) / 100e0, 10) p FROM events GROUP BY 1, 2))""")
def _(t):
    tests = t.events.groupBy(C("event_type").alias("metric"), (C("user_id") % 40).alias("part")).agg(
        F.round(F.min("value") / 100e0, 10).alias("p_value"))
    return rounded(comparison.holm_adjust(tests, order=["part"]))


FEATURES = ["f_disc", "f_tax", "f_qty", "f_price", "f_line", "f_supp"]
LONG_ATTR = "(" + " UNION ALL ".join(f"SELECT key, '{f}' feature, {f} AS value FROM @attr" for f in FEATURES) + ")"


@query("topk_per_row", f"SELECT key, cast(rn AS INTEGER) AS rank, feature, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY abs(value) DESC, feature) rn FROM {LONG_ATTR}) WHERE rn <= 3")
def _(t):
    return attributions.topk_per_row(t.attr, "key", FEATURES)


@query("topk_global", "SELECT o_orderkey, o_totalprice, cast(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return attributions.topk_global(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", 25, "o_orderkey")


@query("sort_nulls_last", "SELECT gene, oe_lof_upper, \"pLI\" FROM @geneall ORDER BY oe_lof_upper NULLS LAST, \"pLI\" DESC NULLS LAST, gene")
def _(t):
    return t.geneall.select("gene", "oe_lof_upper", "pLI").orderBy(
        C("oe_lof_upper").asc_nulls_last(), C("pLI").desc_nulls_last(), "gene")


@query("union_by_name", """SELECT DISTINCT variant_key, cons, "AC" FROM (SELECT variant_key, cons, NULL AS "AC" FROM @annall UNION ALL SELECT variant_key, NULL, "AC" FROM @afall)""")
def _(t):
    return splitting.union_by_name(t.annall.select("variant_key", "cons"), t.afall.select("AC", "variant_key")).dropDuplicates()


@query("expand_slices", "SELECT key, 'full' AS slice FROM @pred UNION ALL SELECT key, 'holdout' FROM @pred WHERE family_holdout UNION ALL SELECT key, 'scored' FROM @pred WHERE s IS NOT NULL")
def _(t):
    return splitting.expand_slices(t.pred, {"full": True, "holdout": C("family_holdout"), "scored": C("s").isNotNull()}).select("key", "slice")


@query("intersect_keys", "SELECT variant_key FROM @var INTERSECT SELECT variant_key FROM @af INTERSECT SELECT variant_key FROM @ann")
def _(t):
    return splitting.intersect_keys([t.var, t.af, t.ann])


@query("except_keys", "SELECT variant_key FROM @var EXCEPT SELECT variant_key FROM @ann")
def _(t):
    return splitting.except_keys(t.var, t.ann)


@query("distinct_families", f"SELECT DISTINCT {family_sql('gene', K.SPLIT_FAMILIES)} family FROM @var")
def _(t):
    return splitting.distinct_families(t.var, gene_family)
