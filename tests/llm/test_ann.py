import numpy as np
import pyarrow.parquet as pq
import pytest

from helixframe.llm import ann


def brute(ids, x, queries, k):
    x = np.asarray(x, dtype=np.float64)
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for i in queries:
        s = x @ x[i] / (norm * norm[i])
        order = sorted((-s[j], ids[j]) for j in range(len(ids)) if ids[j] != ids[i])[:k]
        out[ids[i]] = [(b, -a) for a, b in order]
    return out


def collected(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    return np.mean([len({x for x, _ in got[q]} & {x for x, _ in want[q]}) / len(want[q]) for q in want])


@pytest.mark.parametrize("clusters", [0, 20])
def test_recall_with_copies_and_many_groups(spark, monkeypatch, clusters):
    monkeypatch.setattr(ann, "GROUP_ROWS", 700)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 16)
    monkeypatch.setattr(ann, "LIST_ROWS", 100)
    rng = np.random.default_rng(clusters)
    x = rng.normal(size=(3000, 48))
    if clusters:
        x = x * 0.3 + rng.normal(size=(clusters, 48))[rng.integers(clusters, size=3000)]
    x[1000:2000] = x[5]  # a third of all rows is one vector
    x[2000:2010] = 3 * x[7]
    x = x.astype(np.float32)
    ids = list(range(3000))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as uid", "0 as list")
    got = collected(ann.nearest(df.repartition(5), df.vec_id % 50 == 0, 5))
    want = brute(ids, x, range(0, 3000, 50), 5)
    assert got.keys() == want.keys()
    assert recall(got, want) > 0.93
    for q, found in got.items():
        exact = brute(ids, x, [q], 2999)[q]
        score = dict(exact)
        assert all(abs(score[v] - s) < 1e-12 for v, s in found)
        assert found == sorted(found, key=lambda t: (-t[1], t[0]))
    assert got[1000] == [(v, pytest.approx(1.0)) for v in (5, 1001, 1002, 1003, 1004)]


def test_real_vectors(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    ids, x = t.column("vec_id").to_pylist(), t.column("embedding").to_pylist()
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = collected(ann.nearest(df, df.vec_id % 50 == 0, 5))
    assert recall(got, brute(ids, x, [i for i, v in enumerate(ids) if v % 50 == 0], 5)) > 0.95


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(ann.nearest(df, df.vec_id >= 0, 5))
    assert got == {0: [(1, 1.0), (2, 0.0)], 1: [(0, 1.0), (2, 0.0)], 2: [(0, 0.0), (1, 0.0)]}
    assert ann.nearest(df.limit(0), df.vec_id >= 0, 5).count() == 0
    one = df.where("vec_id = 0")
    assert ann.nearest(one, one.vec_id == 0, 5).count() == 0


def test_scan_without_test_is_exact():
    rng = np.random.default_rng(1)
    rows = ann.unit(rng.normal(size=(500, 40)))
    for q in ann.unit(rng.normal(size=(20, 40))):
        want = set(np.argsort(((rows - q) ** 2).sum(1))[:6])
        assert want <= set(ann.adaptive_scan(q, rows, [(0, 200), (200, 500)], 6, width=1e9))
