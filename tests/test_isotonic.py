import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import isotonic
from helixframe.plans import training


def brute(x, y, at):
    """Max-min formula over distinct scores, then linear interpolation."""
    xs = np.unique(x)
    w = np.array([(x == v).sum() for v in xs], dtype=float)
    s = np.array([y[x == v].sum() for v in xs], dtype=float)
    cw, cs = np.concatenate([[0], np.cumsum(w)]), np.concatenate([[0], np.cumsum(s)])
    n = len(xs)
    means = np.full((n, n), np.inf)
    for j in range(n):
        means[j, j:] = (cs[j + 1:] - cs[j]) / (cw[j + 1:] - cw[j])
    tail = np.minimum.accumulate(means[:, ::-1], axis=1)[:, ::-1]
    fit = np.array([tail[:i + 1, i].max() for i in range(n)])
    return np.interp(at, xs, fit)


@pytest.mark.parametrize("kind, limit", [("noise", 10**6), ("noise", 40), ("rising", 40), ("falling", 40), ("saw", 40), ("ties", 40), ("flat", 40)])
def test_equals_max_min_formula(spark, kind, limit):
    rng = np.random.default_rng(3)
    n = 500
    x = {"ties": rng.integers(0, 9, n) / 8.0, "saw": np.arange(n) / n}.get(kind, np.round(rng.random(n), 3))
    chance = {"rising": x, "falling": 1 - x, "saw": (np.arange(n) % 125) / 125, "flat": np.ones(n)}.get(kind, np.full(n, 0.4))
    y = (rng.random(n) < chance).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "p double, y int")
    model = isotonic.fit_isotonic(df, limit=limit)
    assert bool(model.splits) == (limit == 40 and len(np.unique(x)) > 40)
    steps = model.steps.orderBy("lo").collect()
    assert all(a.hi < b.lo and a.value <= b.value for a, b in zip(steps, steps[1:]))
    at = np.concatenate([np.unique(x), rng.random(200) * 1.4 - 0.2])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(at)] + [(-1, None), (-2, float(at[0]))], "i int, p double")
    got = {r.i: r.p_calibrated for r in isotonic.apply_isotonic(model, rows).collect()}
    assert len(got) == len(at) + 2 and got.pop(-1) is None and got.pop(-2) == got[0]
    assert np.allclose([got[i] for i in range(len(at))], brute(x, y, at), atol=1e-12)


def test_nearly_monotone_scores_stay_distributed(spark):
    n = 200_000
    df = spark.range(n).select(
        (F.col("id") / n).alias("p"), F.when(F.col("id") % 1000 < F.col("id") * 1000 / n, 1).otherwise(0).alias("y"))
    model = isotonic.fit_isotonic(df, limit=20_000)
    assert len(model.splits) > 10
    fitted = isotonic.apply_isotonic(model, df)
    gap = fitted.agg(F.max(F.abs(F.col("p") - F.col("p_calibrated"))).alias("g"), F.count("p_calibrated").alias("n")).first()
    assert gap.n == n and gap.g < 0.05
    straight = isotonic.fit_isotonic(df.withColumn("y", (F.col("p") > 0.5).cast("int")), limit=20_000)
    assert straight.steps.agg(F.min("value"), F.max("value"), F.count("*")).first()[:2] == (0.0, 1.0)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "p double, y int")
    model = training.fit_isotonic(empty)
    assert model.steps.count() == 0
    got = training.apply_isotonic(model, spark.createDataFrame([(0.5,)], "p double"))
    assert got.first().p_calibrated is None
