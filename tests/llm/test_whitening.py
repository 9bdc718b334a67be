import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import spectrum, whitening


def brute(vectors, k=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    d = (n * x - sums).astype(float) / n
    e, u = np.linalg.eigh(d.T @ d / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, ((n * x - sums) ** 2).sum(axis=1), (d @ u) / np.sqrt(e), e / np.trace(d.T @ d / n)


def check(spark, vectors, rows, dim, parts=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr(
        "*", "1 as component", "2 as n", "3 as _vector", "4 as v", "5 as i", "6 as _h", "7 as _part", "8 as rank", "9 as node", "10 as _id")
    got = {}
    for r in whitening.whiten_embeddings(df.repartition(parts)).collect():
        got.setdefault(r.vec_id, []).append(r)
    n, deviation, white, explained = brute(list(vectors.values()))
    assert set(got) == set(vectors)
    k = min(8, dim)
    signs = np.array([np.sign(next(r.whitened for r in got[next(iter(vectors))] if r.component == c + 1) * white[0, c]) for c in range(k)])
    for at, (key, _) in enumerate(vectors.items()):
        mine = sorted(got[key], key=lambda r: r.component)
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert {(r.n, r.deviation) for r in mine} == {(n, deviation[at] if deviation[at] < 2**63 else None)}
        assert np.allclose([r.whitened for r in mine], white[at] * signs, rtol=1e-8, atol=1e-8)
        assert np.allclose([r.explained for r in mine], explained, rtol=1e-9)
        assert all(0 <= r.identity_error < 1e-9 for r in mine)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((200, 12)) * np.arange(1, 13) + rng.standard_normal(12)
    vectors = {i: [float(np.float32(c)) for c in v] for i, v in enumerate(base)}
    bad = [(900, None), (901, []), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] + [0.0] * 11), (905, [1.0] * 5), (906, [3e38] * 12)]
    check(spark, vectors, list(vectors.items()) + bad, 12)


def test_large_entries_are_exact(spark):
    rng = np.random.default_rng(6)
    vectors = {i: [float(np.float32(c)) for c in v] for i, v in enumerate(rng.standard_normal((40, 3)) * [1e9, 3e5, 7e3])}
    check(spark, vectors, list(vectors.items()), 3)


def test_rank_repeats_and_empty(spark):
    def run(rows):
        return whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()

    assert run([]) == [] and run([(1, None)]) == [] and run([(1, [1.0, 2.0])]) == [] and run([(1, [1.0, 2.0])] * 4) == []
    flat = run([(i, [float(i), 2.0 * i, 5.0]) for i in range(6)] + [(None, [7.0, 14.0, 5.0])])
    assert {r.component for r in flat} == {1} and len(flat) == 7 and abs(flat[0].explained - 1) < 1e-12
    twice = run([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.5])])
    assert len(twice) == 8
    square = run([(i, list(map(float, p))) for i, p in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])])  # equal eigenvalues
    white = np.array([[r.whitened for r in square if r.component == c] for c in (1, 2)])
    assert np.allclose(white @ white.T / 4, np.eye(2))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10**6), st.floats(-3, 3))
def test_inertia_and_solve(n, seed, shift):
    rng = np.random.default_rng(seed)
    a = rng.integers(-3, 4, (n, n)).astype(float)
    a += a.T
    e = np.linalg.eigvalsh(a)
    if np.abs(e - shift).min() < 1e-9:
        return
    found = spectrum.factor(a, shift)
    assert found.positive == (e > shift).sum()
    b = rng.standard_normal(n)
    x = found.solve(b)
    assert np.allclose((a - shift * np.eye(n)) @ x, b, atol=1e-7 * max(1, np.abs(x).max()))


@pytest.mark.parametrize("values", [[5, 5, 5, 4, 4, 3, 2, 1, 1, 1], [1, 1 + 1e-9, 1 + 2e-9, 1, 1, 1, 1, 1, 1, 1], [1e12, 1, 1e-3], [2, 0, 0], [7.0] * 12, list(range(1, 65))])
def test_spectrum(values):
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    a = q @ np.diag(np.array(values, dtype=float)) @ q.T
    found = spectrum.leading(a, 8)
    want = [v for v in sorted(values, reverse=True) if v > 1e-13 * max(values)][:8]
    scale = max(values)
    assert np.allclose(found.values, want, atol=1e-13 * scale * len(values))
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(len(want)), atol=1e-12)
    assert np.allclose(a @ found.vectors, found.vectors * found.values, atol=1e-12 * scale)
    for number, (over, under, _) in enumerate(found.certificates, 1):
        assert over < number <= under
