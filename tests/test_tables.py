"""Joins, dedup, profiling, splitting, cleaning on tiny frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions.families import gene_family
from helixframe.operators import attributions, cleaning, comparison, dedup, joins, profiling, splitting, structure


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_conflicts_and_first_row(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 2), ("b", 1, 4), ("b", 1, 3), ("c", 0, 5)], "variant_key string, label int, o int")
    assert rows(dedup.resolve_keys(df, ["o"]), "variant_key") == [("b", 1, 3), ("c", 0, 5)]
    assert rows(dedup.drop_conflicting_keys(df).select("o"), "o") == [(3,), (4,), (5,)]
    assert dedup.dedup_report(df, ["variant_key"]).first().duplicates_removed == 2


def test_most_constrained_puts_missing_last(spark):
    df = spark.createDataFrame([("g", None, 0.1), ("g", 0.4, 0.2), ("g", 0.3, 0.9), ("h", None, 0.5)], "gene string, oe_lof_upper double, pLI double")
    assert rows(dedup.most_constrained(df, ["pLI"]), "gene") == [("g", 0.3, 0.9), ("h", None, 0.5)]


def test_collapse_takes_first_usable_value(spark):
    df = spark.createDataFrame([("k", 1, None, " ", False), ("k", 2, 2.0, "x", None), ("k", 3, 3.0, "y", True)], "variant_key string, o int, a double, t string, d boolean")
    assert rows(dedup.collapse_transcripts(df, ["o"], any_true=["d"]).select("a", "t", "d"), "a") == [(2.0, "x", True)]


def test_isoforms(spark):
    df = spark.createDataFrame([("A", -1.0, 1), ("A", -3.0, 2), ("B", 0.5, 3), ("C", 2.0, 4), ("D", None, 5)], "variant_key string, score double, o int")
    out = rows(dedup.aggregate_isoforms(df, ["o"]), "variant_key")
    assert out == [("A", -3.0, -1.0, -2.0, -1.0), ("B", 0.5, 0.5, 0.5, 0.5), ("C", 2.0, 2.0, 2.0, 2.0)]


def test_left_defaults_follow_the_match(spark):
    left = spark.createDataFrame([("a",), ("b",)], "variant_key string")
    freq = spark.createDataFrame([("a", None, None, None, -8.0, None)], "variant_key string, AF double, AN double, AC double, log_AF double, is_common boolean")
    out = {r.variant_key: r for r in joins.join_left_defaults(left, freq).collect()}
    assert out["a"].AF is None and out["a"].AN == 0 and out["a"].is_common is False
    assert (out["b"].AF, out["b"].log_AF, out["b"].AC) == (0.0, -8.0, 0.0)


def test_gene_impute_uses_given_medians(spark):
    constraint = spark.createDataFrame([("A", 0.1), ("B", 0.9)], "gene string, pLI double")
    train = spark.createDataFrame([("A", 1), ("B", 0), ("B", 1), ("Z", 1)], "gene string, label int")
    out = rows(joins.join_gene_impute(train, constraint).select("gene", "pLI", "is_imputed_constraint"), "gene", "pLI")
    assert out == [("A", 0.1, 0), ("B", 0.9, 0), ("B", 0.9, 0), ("Z", 0.9, 1)]
    medians = joins.constraint_medians(train.filter("label = 1"), constraint)
    other = spark.createDataFrame([("Q",)], "gene string")
    assert joins.join_gene_impute(other, constraint, medians).first().pLI == 0.5


def test_one_to_one_check(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    with pytest.raises(ValueError):
        joins.assert_one_to_one(df, "k", "t")
    with pytest.raises(ValueError):
        joins.assert_one_to_one(df.filter("k = 'x'"), "k", "t")


def test_radius_counts_match_brute_force(spark):
    rng = np.random.default_rng(1)
    pts = np.round(rng.random((120, 3)) * 16 - 8, 1)
    pts[:10] = pts[0]
    df = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(pts)], "structure_id string, pos int, x double, y double, z double")
    got = {r.pos: r.neighbors for r in joins.count_within_radius(df).collect()}
    d2 = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    assert [got[i] for i in range(120)] == list((d2 <= 25).sum(1) - 1)


def test_radius_counts_of_dense_cells_come_from_node_counts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    n = 3000
    pts = np.concatenate([rng.random((n * 9 // 20, 3)) * 4.9, rng.random((n * 9 // 20, 3)) * 4.9 + [5.0, 0, 0], rng.random((n // 10, 3)) * 60 - 30])
    pts[:5] = pts[0]
    df = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(pts)] + [("t", 0, 1.0, 1.0, 1.0), ("t", 1, None, 1.0, 1.0)], "structure_id string, pos int, x double, y double, z double")
    compared, join = [], joins.count_within_radius
    keep = joins.cut_lineage

    def watched(rows):
        written = keep(rows)
        if "kind" in written.columns:  # points that are compared, of the pairs of nodes of a level
            few = written.filter("kind = 'points'").agg(F.coalesce(F.sum(F.col("a_n") * F.col("b_n")), F.lit(0))).first()[0]
            compared.append(few)
        return written

    monkeypatch.setattr(joins, "cut_lineage", watched)
    monkeypatch.setattr(joins, "NODE_PAIRS", 64)
    got = {(r.structure_id, r.pos): r.neighbors for r in join(df).collect()}
    d2 = ((pts[:, None] - pts[None]) ** 2).sum(-1)
    want = (d2 <= 25).sum(1) - 1
    assert got.pop(("t", 0)) == 0 and len(got) == len(pts)
    assert [got["s", i] for i in range(len(pts))] == list(want)
    assert len(compared) > 2 and sum(compared) < 0.35 * (n * 0.9) ** 2 / 2


def test_position_window(spark):
    df = spark.createDataFrame([("s", 1, 95.0), ("s", 2, 80.0), ("s", 3, 60.0), ("s", 40, 7.0)], "structure_id string, pos int, bfactor double")
    out = {r.pos: r.window_mean for r in structure.position_window_mean(df).collect()}
    assert np.isclose(out[2], 78.3333333) and out[40] == 7.0


def test_correlation_matches_pairwise_complete_pearson(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=80)
    b = a + rng.normal(size=80) * 0.1
    data = [(float(x), None if i % 9 == 0 else float(y), 1.0) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(data, "a double, b double, c double")
    r = profiling.correlation_pairs(df, ["a", "b", "c"], None).collect()
    keep = np.arange(80) % 9 != 0
    assert len(r) == 1 and np.isclose(r[0].correlation, np.corrcoef(a[keep], b[keep])[0, 1])
    assert r[0].suggest_drop == "b"
    assert profiling.drop_correlated(df, ["a", "b", "c"], 0.9).columns == ["a", "c"]


def test_drop_order_prefers_priority():
    assert profiling._loser("phyloP_a", "GERP_b", 1.0, 1.0) == ("GERP_b", "conservation priority")
    assert profiling._loser("BLOSUM62", "Grantham", 0.0, 0.0) == ("BLOSUM62", "substitution priority")
    assert profiling._loser("x", "a", 0.0, 0.0) == ("x", "deterministic fallback")
    assert profiling._loser("a", "x", 5.0, 0.0) == ("a", "higher missing")


def test_impute_modes_medians_and_flags(spark):
    df = spark.createDataFrame([(1.0, "x", None), (None, "y", None), (3.0, None, 1.0), (4.0, "y", None), (5.0, "x", None)], "AF double, t string, mostly double")
    out = profiling.impute_with_flags(df, ["AF", "t", "mostly"])
    assert out.columns == ["AF", "t", "is_imputed_AF"]
    assert rows(out, "AF") == [(1.0, "x", False), (3.0, "x", False), (3.5, "y", True), (4.0, "y", False), (5.0, "x", False)]


def test_circular_names(spark):
    df = spark.createDataFrame([("REVEL_score",), ("m_cap_rank",), ("GERP",)], "column string")
    assert rows(profiling.circular_feature_check(df).select("predictor"), "predictor") == [("M-CAP",), ("REVEL",)]


def test_group_split_is_disjoint_and_stable(spark):
    df = spark.range(2000).select(F.concat(F.lit("G"), (F.col("id") % 97).cast("string"), F.lit("B")).alias("gene"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    out = splitting.group_split(df, "gene")
    per = {r["gene"]: r["n"] for r in out.groupBy("gene").agg(F.count_distinct("split").alias("n")).collect()}
    assert set(per.values()) == {1} and len(per) == 97 and out.count() == 2000
    sizes = {r.split: r.n_groups for r in splitting.split_summary(out, "gene").collect()}
    assert sizes == {"train": 67, "val": 15, "test": 15}
    again = splitting.group_split(df.repartition(5), "gene").groupBy("split").count()
    assert rows(again, "split") == rows(out.groupBy("split").count(), "split")
    assert {r.status for r in splitting.validate_split(df, out, "gene").collect() if "ratio" not in r.check} == {"pass"}
    with pytest.raises(ValueError):
        splitting.assign_groups(df, "gene", 0.5, 0.1, 0.1)


def test_sampling(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("label"))
    s = splitting.stratified_sample(df, 20, "k")
    assert {r["count"] for r in s.groupBy("label").count().collect()} == {20}
    assert splitting.group_subsample(df, "label", 0.1).select("label").distinct().count() == 1


def test_leakage_gate_finds_planted_problems(spark):
    split = spark.createDataFrame([("1", "FOXA1", 1, "train", "A", "R"), ("2", "FOXA2", 0, "test", "A", "R"), ("3", "ABC1", 0, "val", None, "R"), ("4", "XYZ1", 0, "train", None, "R")],
                                  "variant_key string, gene string, label int, split string, ref_aa string, alt_aa string")
    manifest = spark.createDataFrame([("num__x",), ("chr",), ("chr_1",)], "feature string")
    got = {r.check: (r.n, r.status) for r in splitting.leakage_gate(split, manifest, gene_family, required=["num__x", "num__y"]).collect()}
    assert got["banned_features"] == (1, "fail") and got["banned_one_hot"] == (1, "fail") and got["missense_only"] == (1, "fail")
    assert got["gene_overlap"] == (0, "pass") and got["family_overlap"] == (1, "fail") and got["required_features"] == (1, "fail")


def test_score_integrity(spark):
    split = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test")], "variant_key string, split string")
    scores = spark.createDataFrame([("a", "train"), ("c", "train"), ("z", "test")], "variant_key string, split string")
    out = {r.split: r for r in splitting.score_split_integrity(split, scores).collect()}
    assert (out["train"].n_outside, out["train"].n_cross_split) == (1, 1)
    assert (out["test"].n_outside, out["test"].n_cross_split, out["test"].coverage) == (1, 0, 1.0)


def test_adaptive_filter_is_skipped_when_mostly_empty(spark):
    df = spark.createDataFrame([("missense_variant",)] + [(None,)] * 20, "MolecularConsequence string")
    assert cleaning.filter_consequence_adaptive(df).count() == 21
    assert cleaning.filter_consequence_adaptive(df.limit(2)).count() == 1
    assert cleaning.filter_consequence_adaptive(df.withColumnRenamed("MolecularConsequence", "x")).count() == 21


def test_external_labels(spark):
    data = [("Missense", " autism", "chr1", "10", "G>A"), ("missense", "control", "1", "11", "G>A"), ("synonymous", "control", "1", "12", "G>A"),
            ("missense", "Autism", "1", "13", "G>A"), ("missense", "control", "1", "14", "del")]
    df = spark.createDataFrame([(*d, "G", "S") for d in data], "FunctionClass string, PrimaryPhenotype string, Chr string, Position string, Variant string, Gene string, StudyName string")
    assert rows(cleaning.label_external(df).select("variant_key", "label", "gene"), "variant_key") == [("1:10:G:A", 1, "G"), ("1:11:G:A", 0, "G")]


def test_quintiles_are_right_closed(spark):
    df = spark.createDataFrame([(1, 0.1, float(v)) for v in range(11)], "y int, p double, v double")
    got = {r.bin: r.n for r in comparison.errors_by_quintile(df, "v").collect()}
    assert got == {"Q1": 3, "Q2": 2, "Q3": 2, "Q4": 2, "Q5": 2}


def test_cascade_and_best_match(spark):
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "variant_key string")
    one = spark.createDataFrame([("a", 1)], "variant_key string, v int")
    two = spark.createDataFrame([("a", 2), ("b", 3)], "variant_key string, v int")
    out = joins.join_cascade_sources(want, [("one", one), ("two", two)]).select("variant_key", "source", "v")
    assert rows(out, "variant_key") == [("a", "one", 1), ("b", "two", 3), ("c", None, None)]
    right = spark.createDataFrame([("a", "X", 1), ("a", "Y", 2)], "variant_key string, aa string, o int")
    left = want.withColumn("ref", F.lit("Y"))
    best = joins.join_best_match(left, right, ["variant_key"], F.col("aa") == F.col("ref"), ["o"])
    assert rows(best.select("variant_key", "aa"), "variant_key") == [("a", "Y"), ("b", None), ("c", None)]


def test_top_features_and_report(spark):
    df = spark.createDataFrame([("k", 0.1, -0.5, 0.3)], "key string, a double, b double, c double")
    assert [(r.rank, r.feature) for r in attributions.topk_per_row(df, "key", ["a", "b", "c"], 2).collect()] == [(1, "b"), (2, "c")]
    cal = spark.createDataFrame([("phase1", "t", 0.01), ("phase2", "t", 0.05)], "phase string, eval_set string, ece double")
    boot = cal.select("phase", "eval_set", F.lit(0.9).alias("roc_auc"))
    out = {r.phase: r.verdict for r in attributions.metric_report_merge(cal, boot).collect()}
    assert out == {"phase1": "ok", "phase2": "worse"}


def test_validated_join_raises(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0), ("z", 4.0)], "k string, v double")
    one = left.dropDuplicates(["k"])
    with pytest.raises(ValueError, match="repeated"):
        joins.join_inner_validated(left, right, "k", ["v"])
    with pytest.raises(ValueError, match="repeated"):
        joins.join_inner_validated(one, right, "k")
    with pytest.raises(ValueError, match="matches"):
        joins.join_inner_validated(one.filter("k = 'a'"), right.filter("k = 'z'"), "k")
    assert rows(joins.join_inner_validated(one, right, "k", ["v"]).select("k", "v"), "k", "v") == [("a", 1.0), ("b", 2.0)]
    report = joins.join_report(left, right, "k").first()
    assert tuple(report) == (3, 4, 1, 1, 3, 0)
    assert joins.join_report(left, right.filter("k = 'b'"), "k").first()["n_filtered"] == 2


def test_dead_columns_and_stratified_fallback(spark):
    df = spark.createDataFrame([(1, None, "x", [1], i) for i in range(40)], "a int, b string, c string, d array<int>, e int")
    assert profiling.dead_columns(df) == ["a", "b", "c", "d"]
    few = spark.createDataFrame([(str(i), i % 2) for i in range(500)], "key string, label int")
    for k in (1, 5, 100, 250, 900):
        got = splitting.stratified_sample(few, k, "key").groupBy("label").count().collect()
        assert {r[0]: r[1] for r in got} == {0: min(k, 250), 1: min(k, 250)}


def test_structures_of_any_size_keep_one_row_for_each_atom(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(s, int(p), *map(float, xyz), float(b)) for s, n in (("a", 40), ("b", 300)) for p, xyz, b in
            zip(rng.integers(0, 60, n), np.round(rng.random((n, 3)) * 14, 1), rng.integers(0, 90, n))]
    rows += [rows[0], rows[0], rows[50], rows[50], ("a", 3, None, 1.0, 1.0, 5.0), ("b", 9, 1.0, float("nan"), 1.0, 7.0), (None, 1, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "structure_id string, pos int, x double, y double, z double, bfactor double")

    def want(s, p, x, y, z, b):
        mates = [r for r in rows if r[0] == s]
        mean = np.mean([r[5] for r in mates if abs(r[1] - p) <= 5])
        near = None if x is None or np.isnan(y) else sum((x - r[2]) ** 2 + (y - r[3]) ** 2 + (z - r[4]) ** 2 <= 25 for r in mates if r[2] is not None) - 1
        return s, p, b, round(float(mean), 8), near

    expect = sorted(map(str, (want(*r) for r in rows if r[0])))
    for most in (2048, 100, 1):  # all structures small, one large, all large
        monkeypatch.setattr(joins, "STRUCTURE_ROWS", most)
        got = structure.structure_features(df).collect()
        assert sorted(str((r[0], r[1], r[2], round(r[3], 8), r[4])) for r in got) == expect
        means = structure.position_window_mean(df).collect()
        assert sorted(round(r.window_mean, 8) for r in means) == sorted(round(r[3], 8) for r in got)
        counts = joins.count_within_radius(df).collect()
        assert sorted((r[0], r[1], r[2]) for r in counts) == sorted((r[0], r[1], r[4]) for r in got if r[4] is not None)


def test_small_structures_are_dealt_once(spark):
    df = spark.createDataFrame([("s", i, float(i), 0.0, 0.0, 1.0) for i in range(20)], "structure_id string, pos int, x double, y double, z double, bfactor double")
    for out in (structure.structure_features(df), structure.position_window_mean(df), joins.count_within_radius(df)):
        assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_key_parts_of_annotation_are_columns_first(spark):
    from helixframe.sources.readers import standardize_annotation

    rows = [("CHR7", " 5.0;9", "a,c", "t;."), ("chrchr1", "5", "A", "G"), ("ch", "5", "A", "G"), ("chr", "5", "A", "G"), (" cHrX ", "6;", "c ;g", " t,"), ("chr23", "7", "A", "."), ("chr1", ";5", "A", "G"), ("chr25", "5", "A", "G"), (None, "5", "A", "G")]
    df = spark.createDataFrame(rows, "`#chr` string, `pos(1-based)` string, ref string, alt string")
    out = standardize_annotation(df)
    assert sorted(r.variant_key for r in out.select("variant_key").collect()) == ["7:5:A:T", "CH:5:A:G", "CHR1:5:A:G", "X:6:C:T"]
    plan = out.select("variant_key")._jdf.queryExecution().optimizedPlan().toString()
    project = next(line for line in plan.splitlines() if "AS variant_key" in line)
    assert "regexp_replace" not in plan and "split(" not in plan and project.count("substring_index") == 0
