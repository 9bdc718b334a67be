"""Blocked order statistics against brute force, with blocks forced small and hot values."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import comparison, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 600
    # a third of the rows share one value
    v = np.where(np.arange(n) % 3 == 0, 0.5, np.round(rng.normal(size=n), 2))
    data = [(f"k{i}", "a" if i % 2 else "b", None if i % 50 == 7 else float(v[i])) for i in range(n)]
    return spark.createDataFrame(data, "key string, g string, v double"), data


def mid(values):
    order = sorted(values)
    return {x: (order.index(x) + 1 + len(order) - order[::-1].index(x)) / 2 for x in set(values)}


@pytest.mark.parametrize("splits", [[], [-0.5, 0.0, 0.5, 0.75]])
def test_mid_ranks(rows, splits):
    df, data = rows
    got = {r.key: r.rank_mid for r in ordered.mid_ranks(df, "v", ["g"], splits=splits).collect()}
    for g in "ab":
        expect = mid([v for _, h, v in data if h == g and v is not None])
        for k, h, v in data:
            if h == g:
                assert got[k] == (None if v is None else expect[v])


@pytest.mark.parametrize("limit", [10_000, 40])
def test_ordinal_ranks(rows, limit):
    df, data = rows
    got = {r.key: (r.rank_ordinal, r.rank_ordinal_n) for r in ordered.ordinal_ranks(df, "v", "key", limit=limit).collect()}
    present = [(v, hashlib.md5(f"0:{k}".encode()).hexdigest(), k) for k, _, v in data if v is not None]
    expect = {k: i for i, (_, _, k) in enumerate(sorted(present))}
    for k, _, v in data:
        assert got[k] == ((None, None) if v is None else (expect[k], len(present)))


@pytest.mark.parametrize("splits", [[], [-1.0, 0.5, 0.51]])
def test_exact_quantiles(rows, splits):
    df, data = rows
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    for r in ordered.exact_quantiles(df, "v", qs, ["g"], splits=splits).collect():
        x = [v for _, g, v in data if g == r.g and v is not None]
        assert r.n == len(x)
        assert np.allclose([r[f"q{i}"] for i in range(5)], np.quantile(x, qs))


def test_running_sums_descending_blocks(spark):
    cells = spark.range(100).select((F.col("id") / 10).alias("v"), F.col("id").alias("m"))
    a = {r.v: (r.m_before, r.m_total) for r in ordered.running_sums(cells, "v", ["m"], descending=True, splits=[2.0, 2.05, 7.3]).collect()}
    b = {r.v: (r.m_before, r.m_total) for r in ordered.running_sums(cells, "v", ["m"], descending=True, splits=[]).collect()}
    assert a == b and a[9.9] == (0, 4950)


def test_value_splits_bound_the_blocks(spark):
    cells = spark.range(5000).select((F.col("id") * 1.5).alias("v"))
    cuts = ordered.value_splits(cells, "v", limit=500)
    sizes = ordered.with_block(cells, "v", cuts).groupBy("_block").count().collect()
    assert len(cuts) >= 10 and max(r["count"] for r in sizes) <= 600


def test_hash_ranks_is_a_permutation_in_hash_order(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"))
    got = {r.k: r.hash_rank for r in ordered.hash_ranks(df, "k", 9).collect()}
    expect = sorted(got, key=lambda k: hashlib.md5(f"9:{k}".encode()).hexdigest())
    assert [got[k] for k in expect] == list(range(1, 501))


def test_medians_ignore_missing(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (None, 7.0), (10.0, None)], "a double, b double")
    r = ordered.medians_wide(df, ["a", "b"]).first()
    assert (r.a, r.b) == (2.0, 6.0)


def test_neutral_rank_and_holm(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", None), ("z", 3.0)], "k string, s double")
    assert {r.k: r.r for r in comparison.rank_neutral(df, "s", "k", "r").collect()} == {"x": 0.0, "y": 0.5, "z": 1.0}
    tests = spark.createDataFrame([("m", 0.01), ("m", 0.04), ("m", 0.03), ("n", 0.5)], "metric string, p_value double")
    got = {(r.metric, r.p_value): r.p_holm for r in comparison.holm_adjust(tests).collect()}
    assert np.allclose([got["m", 0.01], got["m", 0.03], got["m", 0.04], got["n", 0.5]], [0.03, 0.06, 0.06, 0.5])
