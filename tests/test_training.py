import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from helixframe.plans import training


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.random((900, 3))
    y = (rng.random(900) < 1 / (1 + np.exp(-6 * (x[:, 0] - 0.5) - 3 * (x[:, 1] > 0.6)))).astype(int)
    data = [(f"k{i}", ("train", "train", "val")[i % 3], Vectors.dense(v.tolist()), int(label)) for i, (v, label) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, ["variant_key", "split", "features", "label"])


def test_patience_counts_trees_since_the_best():
    plateau = [1.0, 0.8, 0.7, *[0.75] * 79, 0.6, *[0.9] * 80]
    assert training.stopped_at(plateau, 80) == (83, True)  # 79 worse trees do not stop, a better one follows
    assert training.stopped_at([1.0, 0.8, 0.7, *[0.75] * 80, 0.6], 80) == (3, True)  # 80 do
    assert training.stopped_at([3.0, 2.0, 1.0], 80) == (3, False)
    creeping = [1.0 - 1e-6 * i for i in range(200)]
    assert training.stopped_at(creeping, 80) == (200, False)
    assert training.stopped_at(creeping, 80, 1e-3) == (1, True)


def test_rungs_halve_trials_and_double_trees():
    assert training.rungs(40, 64) == [(40, 8), (20, 16), (10, 32), (5, 64)]
    assert training.rungs(3, 64) == [(3, 8)] and training.rungs(9, 10) == [(9, 8), (5, 10)]


def test_longer_ensembles_begin_with_shorter_ones_and_prefixes_score_alike(rows):
    train, val = (training.boosting_rows(rows.filter(F.col("split") == s), "label", 1.5) for s in ("train", "val"))
    p = training.DEFAULT_PARAMS | {"max_depth": 2}
    short, long = training.grow_trees(train, p, 4, 7), training.grow_trees(train, p, 9, 7)
    assert short.toDebugString.split("\n", 1)[1] == training.prefix(long, 4).toDebugString.split("\n", 1)[1]

    def scores(model):
        return [r[0] for r in model.transform(val).select(vector_to_array("probability")[1]).collect()]

    assert np.allclose(scores(short), scores(training.prefix(long, 4)), atol=1e-12)
    losses = long.evaluateEachIteration(val)
    assert np.allclose(short.evaluateEachIteration(val), losses[:4])


def test_fit_does_not_depend_on_the_rounds_of_growth(rows, monkeypatch):
    train, val = (rows.filter(F.col("split") == s) for s in ("train", "val"))
    params = {"max_depth": 2, "max_iter": 24, "patience": 5, "step_size": 0.4}
    found = []
    for first in (1, 19):
        monkeypatch.setattr(training, "FIRST_TREES", first)
        found.append(training.train_boosted_trees(train, val, params=params))
    a, b = found
    assert a.best_iteration == b.best_iteration and a.stopped == b.stopped
    assert a.n_grown <= b.n_grown <= 24 and np.allclose(a.losses, b.losses[:a.n_grown])
    table = a.loss_table(rows.sparkSession).collect()
    assert [r.iteration for r in table if r.is_best] == [a.best_iteration] and len(table) == a.n_grown
    assert a.best_iteration == training.stopped_at(a.losses, 5, training.DEFAULT_PARAMS["tolerance"])[0]


def test_best_of_a_pruned_search_is_that_of_the_whole_one(rows, monkeypatch):
    flat = rows.select("variant_key", "split", "label", *[vector_to_array("features")[i].alias(f"x{i}") for i in range(3)])
    whole, every = training.param_search(flat, trials=6, search_trees=6, prune=False)
    monkeypatch.setattr(training, "rungs", lambda trials, most: [(trials, 3), (3, most)])
    best, history = training.param_search(flat, trials=6, search_trees=6)
    assert best == whole
    last = {r.trial: (r.rung, r.n_trees) for r in history.collect()}
    assert sorted(last.values()) == [(0, 3)] * 3 + [(1, 6)] * 3
    assert {r.trial: r.n_trees for r in every.collect()} == {i: 6 for i in range(6)}
    scores = {r.trial: r.val_pr for r in every.collect()}
    assert all(np.isclose(r.val_pr, scores[r.trial]) for r in history.collect() if r.rung == 1)


def test_cells_hold_every_row_and_the_model_takes_the_features_themselves(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 6, 4000), np.round(rng.random(4000), 2), rng.integers(0, 2, 4000)]).astype(float)
    y = (rng.random(4000) < 0.2 + 0.1 * x[:, 0]).astype(int)
    df = spark.createDataFrame([(Vectors.dense(v.tolist()), int(label)) for v, label in zip(x, y)], ["features", "label"])
    edges = training.bin_edges(df)
    assert edges[0] == [0.5, 1.5, 2.5, 3.5, 4.5] and edges[2] == [0.5] and 20 < len(edges[1]) < training.BINS
    held = training.boosting_cells(df, edges, "label", 3.0, False)
    assert held.count() < 1000 and held.agg(F.sum("_n")).first()[0] == 4000  # rows of equal bins are one cell
    weights = {r[0]: r[1] for r in held.groupBy("_label").agg(F.sum("_w")).collect()}
    assert np.isclose(weights[1.0], 3.0 * y.sum()) and np.isclose(weights[0.0], (1 - y).sum())
    rows = training.boosting_cells(df, edges, "label", 3.0, True)
    assert rows.count() == 4000  # a small table keeps an instance for each row
    monkeypatch.setattr(training, "FINE_SHARE", 400)
    cut = training.boosting_cells(df, edges, "label", 3.0, True)
    assert cut.count() < 1500 and cut.agg(F.max("_n")).first()[0] <= 10 and np.isclose(cut.agg(F.sum("_n")).first()[0], 4000)
    model = training.grow_trees(cut, training.DEFAULT_PARAMS | {"max_depth": 3}, 6, 1)
    lost = training.on_values(model, edges).evaluateEachIteration(training.boosting_rows(df, "label", 3.0))
    assert np.allclose(lost, model.evaluateEachIteration(held))  # every row goes the way of its cell


def test_fits_of_a_study_share_one_preparation(spark, monkeypatch):
    rng = np.random.default_rng(11)
    a, b, c = rng.integers(0, 9, 1500), rng.integers(0, 5, 1500), rng.integers(0, 3, 1500)
    y = (rng.random(1500) < 0.1 + 0.08 * a + 0.02 * b).astype(int)
    rows = [(f"k{i}", ("train", "train", "val", "test")[i % 4], float(p), float(q), f"c{r}", int(v)) for i, (p, q, r, v) in enumerate(zip(a, b, c, y))]
    data = spark.createDataFrame(rows, "variant_key string, split string, a double, b double, c string, label int")
    params = {"max_depth": 2, "max_iter": 4}
    prepared = training.prepare_rows(data)
    for drop in ([], ["a"], ["b", "c"]):  # the same fit as from the table without the columns
        shared, alone = ({r.variant_key: r.p_raw for r in f.predictions.collect()} for f in (
            training.fit_prepared(prepared, drop, params=params), training.fit_scorer(data, drop, params=params)))
        assert shared.keys() == alone.keys() and len(shared) == 750 and all(np.isclose(shared[k], alone[k]) for k in shared)
    fitted = []
    real = training.fit_features
    monkeypatch.setattr(training, "fit_features", lambda *args: fitted.append(1) or real(*args))
    table = training.single_group_models(data, {"a": ("a",), "c": ("c",)}, params=params).collect()
    assert len(fitted) == 1 and {r.feature_group for r in table} == {"a", "c"} and all(r.n == 375 for r in table)


def test_a_search_reads_cells(spark):
    x = [i % 10 for i in range(3000)]
    flat = spark.createDataFrame(
        [(f"k{i}", "train" if i % 3 else "val", float(v), int((i * 7919) % 100 < 10 * v)) for i, v in enumerate(x)],
        "variant_key string, split string, x double, label int")
    train, val = training.search_rows(flat, "variant_key", "label", ())
    assert train.count() == 2000 and val.count() <= 20 and val.agg(F.sum("_n")).first()[0] == 1000
