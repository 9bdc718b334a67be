import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from helixframe.plans import boosting, training

PARAMS = training.DEFAULT_PARAMS | {"max_depth": 3, "step_size": 0.3}


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(0, 12, 600), rng.integers(0, 2, 600), rng.integers(0, 2, 600), rng.integers(0, 5, 600)])
    y = rng.random(600) < 0.1 + 0.05 * x[:, 0] + 0.2 * x[:, 1] * (x[:, 3] > 2)
    rows = [(Vectors.dense(v.tolist()), float(label), i, 1, 1.0 + 0.7 * bool(label)) for i, (v, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "_label", "_part", "_n", "_w"])


def test_without_draws_the_trees_are_those_of_the_library(cells):
    grown = training.grow_trees(cells, PARAMS | {"subsample": 1.0}, 6, 3)
    same = GBTClassifier(labelCol="_label", weightCol="_w", maxIter=6, maxDepth=3, stepSize=0.3, seed=3).fit(cells)

    def scores(model):
        return [r[0] for r in model.transform(cells).select(vector_to_array("probability")[1]).collect()]

    assert np.allclose(scores(grown), scores(same), atol=1e-9)
    assert np.allclose(grown.evaluateEachIteration(cells), same.evaluateEachIteration(cells))


@pytest.mark.parametrize("params", [{"min_instances": 4, "feature_share": 0.6}, {"min_instances": 1}])
def test_trees_do_not_depend_on_tasks(cells, monkeypatch, params):
    p = PARAMS | {"max_depth": 2, "subsample": 0.7} | params
    one, lost = boosting.grow_stage(cells, cells, 4, p, 2, 5)
    monkeypatch.setattr(boosting, "INSTANCES_PER_TASK", 600)
    two, lost_too = boosting.grow_stage(cells, cells, 4, p, 2, 5)
    assert lost == lost_too and all(np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and np.array_equal(a.value, b.value) for a, b in zip(one, two))
    assert all(0 < t.stats[0, 0] < 600 and (t.feature >= 0).any() for t in one)
    more, _ = boosting.grow_stage(cells, cells, 4, p, 3, 5, one)
    whole, _ = boosting.grow_stage(cells, cells, 4, p, 3, 5)
    assert len(more) == 1 and np.array_equal(more[0].value, whole[2].value)  # a later round goes on from the trees so far


def test_jobs_of_a_fit_do_not_grow_with_its_trees(cells, spark):
    def jobs(n):
        context = spark.sparkContext
        context.setJobGroup(f"{n} trees", "")
        training.grow_to_best(cells, cells, [[i + 0.5 for i in range(12)]] * 4, {"max_iter": n, "max_depth": 2})
        found = len(context.statusTracker().getJobIdsForGroup(f"{n} trees"))
        context.setJobGroup("", "")
        return found

    assert 0 < jobs(30) <= jobs(3) + 2


def test_values_up_to_sixty_four_are_told_apart(spark):
    rows = spark.createDataFrame([(Vectors.dense([float(i % 56), float(i)]),) for i in range(560)], ["features"])
    few, many = training.bin_edges(rows)
    assert few == [i + 0.5 for i in range(55)]  # quantiles would put values that decide the label in one bin with others
    assert len(many) == training.BINS - 1


def test_a_curve_scores_cells_instead_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f"k{i}", ("train", "train", "val", "test")[i % 4], f"f{i % 9}", float(v), int(rng.random() < 0.1 + 0.08 * v)) for i, v in enumerate(rng.integers(0, 9, 1200))]
    data = spark.createDataFrame(rows, "variant_key string, split string, family string, x double, label int")
    params = {"max_depth": 2, "max_iter": 3}
    alone = training.ranking_metrics(training.train_and_score(data, params=params, keep=["family"]), "y_true", "p_raw", ["split"]).collect()
    monkeypatch.setattr(training, "score_rows", lambda *args: pytest.fail("a row was scored"))
    curve = training.learning_curve(data, [0.5, 1.0], params=params, keep=["family"]).collect()
    assert {(r.split, r.fraction, r.n) for r in curve} == {(s, f, 300) for s in ("val", "test") for f in (0.5, 1.0)}
    whole = {r.split: r for r in curve if r.fraction == 1.0}
    assert all(np.isclose(r.roc_auc, whole[r.split].roc_auc) and np.isclose(r.pr_auc, whole[r.split].pr_auc) for r in alone)


def test_an_ablation_scores_cells_and_counts_their_rows(spark, monkeypatch):
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 9, 1200), rng.integers(0, 4, 1200)
    rows = [(f"k{i % 900}", ("train", "train", "val", "test")[i % 4], float(v), float(w), int(rng.random() < 0.1 + 0.08 * v)) for i, (v, w) in enumerate(zip(a, b))]
    data = spark.createDataFrame(rows, "variant_key string, split string, a double, b double, label int")
    params = {"max_depth": 2, "max_iter": 3}
    test = training.train_and_score(data, params=params).filter("split = 'test'")
    alone = training.ranking_metrics(test, "y_true", "p_calibrated").first()
    monkeypatch.setattr(training, "score_rows", lambda *args: pytest.fail("a row was scored"))
    out = {(r.removed, r.metric): r for r in training.feature_ablation(data, {"a": ["a"], "b": ["b"]}, replicates=40, params=params).collect()}
    # a repeated key is no other row: keys are not joined
    assert alone.n == 300 and np.isclose(out["a", "roc_auc"].full, alone.roc_auc) and np.isclose(out["b", "pr_auc"].full, alone.pr_auc)
    assert out["a", "roc_auc"].delta > 0.1 > abs(out["b", "roc_auc"].delta)
    assert all(r.ci_lo <= r.delta <= r.ci_hi for r in out.values())
