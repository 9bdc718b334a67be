from itertools import combinations
from math import factorial

import numpy as np
from pyspark.ml.linalg import Vectors

from helixframe.plans import explain, training


def expected(nodes, at, row, known):
    """Mean value of the subtree when only the known features decide, by training weight elsewhere."""
    node = nodes[at]
    if node["left"] < 0:
        return node["prediction"]
    left, right = node["left"], node["right"]
    if node["feature"] in known:
        return expected(nodes, left if row[node["feature"]] <= node["threshold"] else right, row, known)
    return sum(nodes[c]["weight"] * expected(nodes, c, row, known) for c in (left, right)) / node["weight"]


def enumerated(nodes, row, d):
    out = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for k in range(d):
            for known in combinations(others, k):
                out[i] += factorial(k) * factorial(d - k - 1) / factorial(d) * (expected(nodes, 0, row, {*known, i}) - expected(nodes, 0, row, set(known)))
    return out


def random_tree(rng, d, depth):
    nodes = {}

    def grow(level, weight):
        at = len(nodes)
        nodes[at] = {"prediction": float(rng.standard_normal()), "weight": weight, "left": -1, "right": -1, "feature": None, "threshold": None}
        if level < depth and rng.random() < 0.85:
            share = rng.uniform(0.1, 0.9)
            nodes[at] |= {"feature": int(rng.integers(d)), "threshold": float(rng.uniform(0.2, 0.8))}
            nodes[at]["left"] = grow(level + 1, weight * share)
            nodes[at]["right"] = grow(level + 1, weight * (1 - share))
        return at

    grow(0, 100.0)
    return nodes


def test_equals_enumeration_of_subsets():
    rng = np.random.default_rng(4)
    for d, depth in [(1, 2), (3, 3), (4, 5), (5, 4)]:
        for _ in range(6):
            nodes = random_tree(rng, d, depth)  # features repeat along paths
            leaves = list(explain.tree_leaves(nodes, 3.0))
            model = explain.Explainer([leaf for leaf in leaves if len(leaf.features)], 0.0)
            rows = rng.random((7, d))
            assert np.allclose(model(rows), [3.0 * enumerated(nodes, row, d) for row in rows])


def test_attributions_add_up_to_the_log_odds(spark):
    rng = np.random.default_rng(9)
    x = rng.random((600, 4))
    y = (rng.random(600) < 1 / (1 + np.exp(-8 * (x[:, 0] - 0.5) - 4 * x[:, 1] * x[:, 2]))).astype(int)
    df = spark.createDataFrame([(i, Vectors.dense(row.tolist()), int(label)) for i, (row, label) in enumerate(zip(x, y))], ["i", "features", "label"])
    fit = training.train_boosted_trees(df.filter("i % 3 > 0"), df.filter("i % 3 = 0"), params={"max_iter": 12, "max_depth": 3})
    names = ["a", "b", "c", "d"]
    rows = explain.attributions(fit.model, df, names, ["i"]).collect()
    assert len(rows) == 600
    assert max(abs(r.base + sum(r[n] for n in names) - r.log_odds) for r in rows) < 1e-9
    size = {n: np.mean([abs(r[n]) for r in rows]) for n in names}
    assert max(size, key=size.get) == "a" and size["d"] < size["a"] / 3
    scored = {r.i: r.p_raw for r in training.score_rows(fit, df).collect()}
    assert max(abs(1 / (1 + np.exp(-r.log_odds)) - scored[r.i]) for r in rows) < 1e-9


def test_one_hot_columns(spark):
    rng = np.random.default_rng(2)
    rows = [(f"k{i}", ("train", "val")[i % 3 == 0], "abc"[i % 3] if i % 7 else None, float(v), int(rng.random() < (0.9 if i % 3 == 1 else 0.2))) for i, v in enumerate(rng.random(300))]
    df = spark.createDataFrame(rows, "variant_key string, split string, c string, x double, label int")
    model = training.fit_features(df.filter("split = 'train'"), ["x"], ["c"])
    ready = model.transform(df)
    fit = training.train_boosted_trees(ready.filter("split = 'train'"), ready.filter("split = 'val'"), params={"max_iter": 6, "max_depth": 3})
    out = explain.attributions(fit.model, ready, model.manifest(), ["variant_key"]).collect()
    assert max(abs(r.base + sum(r[n] for n in model.manifest()) - r.log_odds) for r in out) < 1e-9
    size = {n: np.mean([abs(r[n]) for r in out]) for n in model.manifest()}
    assert max(size, key=size.get).startswith("cat__c_")


def test_tables_of_leaves_are_made_once_for_all_rows(monkeypatch):
    nodes = random_tree(np.random.default_rng(5), 4, 4)
    leaves = [leaf for leaf in explain.tree_leaves(nodes, 1.0) if len(leaf.features)]
    made, table = [], explain.Leaf.table
    monkeypatch.setattr(explain.Leaf, "table", lambda leaf: made.append(1) or table(leaf))
    rows = np.random.default_rng(6).random((50, 4))
    kept = explain.Explainer(leaves, 0.0)
    first = [kept(rows[low:low + 10]) for low in range(0, 50, 10)]
    assert len(made) == len(leaves)
    monkeypatch.setattr(explain, "TABLE_BYTES", 0)  # too large to keep
    assert np.array_equal(np.concatenate(first), explain.Explainer(leaves, 0.0)(rows))
