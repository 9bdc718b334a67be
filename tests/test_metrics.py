"""Metrics and resampling against small numpy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import comparison, metrics, resampling


def auc_ap(y, p, w=None):
    y, p = np.asarray(y), np.asarray(p)
    w = np.ones(len(y)) if w is None else w
    pos, neg = w * (y == 1), w * (y == 0)
    u = sum(pos[i] * (neg[p < p[i]].sum() + neg[p == p[i]].sum() / 2) for i in range(len(y)))
    ap = sum(pos[i] * pos[p >= p[i]].sum() / (w[p >= p[i]].sum() or 1) for i in range(len(y)) if w[i])
    return u / (pos.sum() * neg.sum()), ap / pos.sum()


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 400
    y = (rng.random(n) < 0.3).astype(int)
    p = np.clip(np.round(0.3 * y + 0.5 * rng.random(n), 2), 0, 1)
    p[::4] = 0.37  # a hot score
    q = np.round(rng.random(n), 3)
    df = spark.createDataFrame([(f"k{i}", int(y[i]), float(p[i]), float(q[i])) for i in range(n)], "key string, y int, p double, q double")
    return df, y, p, q


@pytest.mark.parametrize("splits", [[], [0.2, 0.37, 0.371, 0.6]])
def test_auc_and_ap(data, splits):
    df, y, p, _ = data
    r = metrics.ranking_metrics(df, splits=splits).first()
    assert np.allclose([r.roc_auc, r.pr_auc], auc_ap(y, p))
    assert (r.n, r.n_pos) == (400, y.sum())


def test_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, p double")
    r = metrics.ranking_metrics(df).first()
    assert r.roc_auc is None and r.pr_auc is None
    assert metrics.guarded_ranking(df).first().note == "too few or single-class"


def test_confusion_and_sweep_agree(data):
    df, y, p, _ = data
    c = metrics.confusion_metrics(df, threshold=0.5).first()
    assert (c.tp, c.fp) == (((p >= 0.5) & (y == 1)).sum(), ((p >= 0.5) & (y == 0)).sum())
    grid = [0.2, 0.37, 0.5, 0.9]
    got = {round(r.threshold, 3): r.recall for r in metrics.threshold_sweep(df, grid=grid).collect()}
    assert np.allclose([got[t] for t in grid], [((p >= t) & (y == 1)).sum() / y.sum() for t in grid])
    best = metrics.best_threshold(df, grid=grid).first()
    f1 = {t: 2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + y.sum()) for t in grid}
    assert np.isclose(best.f1, max(f1.values())) and best.threshold == max(sorted(f1, reverse=True)[::-1], key=lambda t: f1[t])


def test_operating_points_meet_targets(data):
    df = data[0]
    rows = {r.constraint: r for r in metrics.operating_points(df).collect()}
    assert len(rows) == 8
    for name, r in rows.items():
        bound, target = name.split(">=")
        assert not r.achieved or r[bound] >= float(target)
    assert rows["recall>=0.99"].achieved


@pytest.mark.parametrize("strategy", ["quantile", "uniform"])
def test_reliability_matches_numpy(data, strategy):
    df, y, p, _ = data
    edges = np.quantile(np.clip(p, 1e-12, 1 - 1e-12), np.linspace(0, 1, 11)) if strategy == "quantile" else np.linspace(0, 1, 11)
    idx = np.clip(np.digitize(np.clip(p, 1e-12, 1 - 1e-12), edges[1:-1]), 0, 9)
    bins = {r.bin: r for r in metrics.reliability_bins(df, n_bins=10, strategy=strategy).collect()}
    assert sum(r["count"] for r in bins.values()) == 400
    for b in set(idx):
        assert bins[b]["count"] == (idx == b).sum()
        assert np.isclose(bins[b].gap, abs(p[idx == b].mean() - y[idx == b].mean()), atol=1e-9)


def test_brier_parts_recompose(data):
    df, y, p, _ = data
    r = metrics.brier_decomposition(df).first()
    assert np.isclose(r.brier, ((p - y) ** 2).mean())
    assert np.isclose(r.residual, r.brier - (r.reliability - r.resolution + r.uncertainty))
    assert 0 <= r.ece <= r.mce <= 1


def test_bootstrap_blocks_do_not_change_results(data):
    df = data[0]
    args = dict(y="y", scores={"a": "p", "b": "q"}, replicates=12, seed=5)
    one = {(r.track, r.rep): r for r in resampling.replicate_metrics(df, **args).collect()}
    many = {(r.track, r.rep): r for r in resampling.replicate_metrics(df, **args, block_cells=40, salts=3).collect()}
    assert one.keys() == many.keys() and len(one) == 24
    for k in one:
        assert np.allclose([one[k][m] for m in resampling.METRICS], [many[k][m] for m in resampling.METRICS])


def test_bootstrap_replicate_equals_weighted_metric(data):
    """Weights drawn per cell, applied to rows by brute force."""
    df, y, p, _ = data
    coef = resampling.coefficients(5, 3)
    cells = (
        df.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n"))
        .withColumns(resampling.cell_hash(F.col("y").cast("string"), resampling.score_text(F.col("p")))).toPandas()
    )
    w = resampling._weights(cells, coef)
    got = {r.rep: r for r in resampling.replicate_metrics(df, "y", {"p": "p"}, replicates=3, seed=5).collect()}
    for rep in range(3):
        expect = auc_ap(cells.y.to_numpy(), cells.p.to_numpy(), w[:, rep])
        assert np.allclose([got[rep].roc_auc, got[rep].pr_auc], expect)


def test_poisson_draws_have_poisson_moments():
    u = (np.arange(20_000) + 0.5)[None, :] / 20_000
    for n in (1, 9, 400, 250_000):
        draws = resampling.poisson_draws(np.array([n]), u)
        assert abs(draws.mean() - n) < 0.01 * np.sqrt(n) + 0.01
        assert abs(draws.std() / np.sqrt(n) - 1) < 0.02


def test_interval_covers_the_point(data):
    df, y, p, _ = data
    rows = {r.metric: r for r in resampling.bootstrap_metrics(df, replicates=80).collect()}
    auc, ap = auc_ap(y, p)
    assert rows["roc_auc"].ci_lo < auc < rows["roc_auc"].ci_hi and rows["pr_auc"].ci_lo < ap < rows["pr_auc"].ci_hi
    again = {r.metric: r for r in resampling.bootstrap_metrics(df.repartition(7), replicates=80).collect()}
    assert np.isclose(again["roc_auc"].mean, rows["roc_auc"].mean)


def test_identical_scores_have_zero_delta(data):
    for r in resampling.paired_bootstrap_delta(data[0], score_a="p", score_b="p", replicates=20).collect():
        assert r.delta == r.ci_lo == r.ci_hi == 0 and r.p_value == 2.0


def test_permutation_detects_signal_and_null(data):
    df = data[0]
    strong = resampling.permutation_auc_test(df, replicates=60).first()
    null = resampling.permutation_auc_test(df, score="q", replicates=60).first()
    assert strong.p_value < 0.05 and strong.n_permutations == 60 and abs(strong.null_mean - 0.5) < 0.05
    assert null.p_value > 0.01


def test_delong_matches_row_level_placements(data):
    df, y, p, q = data

    def place(s):
        a, b = s[y == 1], s[y == 0]
        k = (a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])
        return k.mean(1), k.mean(0)

    (a1, a0), (b1, b0) = place(p), place(q)
    var = np.var(a1 - b1, ddof=1) / len(a1) + np.var(a0 - b0, ddof=1) / len(a0)
    r = comparison.delong_test(df, score_a="p", score_b="q").first()
    assert np.allclose([r.auc1, r.auc2, r.delta_se], [a1.mean(), b1.mean(), np.sqrt(var)])
    assert 0 <= r.p_value <= 1
    same = comparison.delong_test(df, score_a="p", score_b="p").first()
    assert same.delta == 0 and same.delta_se == 0 and same.z is None


def test_fusion_ends_of_the_grid(data):
    df = data[0]
    ranked = comparison.rank_neutral(comparison.rank_neutral(df, "p", "key", "r1"), "q", "key", "r2")
    sweep = {r.alpha: r.roc_auc for r in comparison.fusion_sweep(ranked, alphas=[0.0, 1.0]).collect()}
    only = {c: metrics.roc_auc(ranked, score=c).first().roc_auc for c in ("r1", "r2")}
    assert np.isclose(sweep[0.0], only["r1"]) and np.isclose(sweep[1.0], only["r2"])


def test_poisson_of_a_large_tie_is_exact():
    from math import exp, lgamma, log

    n = 250_000
    u = np.array([[0.01, 0.3, 0.5, 0.9, 0.999]])
    k = np.arange(n - 6000, n + 6001)
    cdf = np.cumsum([exp(i * log(n) - n - lgamma(i + 1)) for i in k.tolist()])
    want = k[0] + np.searchsorted(cdf, u[0])
    assert (resampling.poisson_draws(np.array([n]), u)[0] == want).all()


@pytest.mark.parametrize("left, right, m", [(5, 7, 4), (1, 9, 10), (30, 1, 3), (1000, 3000, 700), (200_000, 300_000, 90_000), (3, 10**7, 500)])
def test_split_is_the_inverse_of_the_hypergeometric_distribution(left, right, m):
    from math import comb, lgamma

    u = np.array([1e-9, 0.01, 0.2, 0.5, 0.77, 0.999, 1 - 1e-9])
    low, high = max(0, m - right), min(m, left)
    if left + right < 100:
        mass = np.array([comb(left, k) * comb(right, m - k) for k in range(low, high + 1)], dtype=float)
    else:
        def ways(a, b):
            return lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)

        center = m * left // (left + right)
        low, high = max(low, center - 4000), min(high, center + 4000)
        mass = np.exp([ways(left, k) + ways(right, m - k) - ways(left + right, m) for k in range(low, high + 1)])
    want = low + np.searchsorted(np.cumsum(mass) / mass.sum(), u)
    assert (resampling.split_counts(left, right, np.full(len(u), m), u) == want).all()


def test_permutations_do_not_depend_on_blocks_and_equal_shuffled_labels(data, monkeypatch):
    df, y, p, _ = data
    whole = resampling.permutation_auc_test(df, replicates=2000).first()
    monkeypatch.setattr(resampling, "DEAL_CELLS", 16)
    monkeypatch.setattr(resampling, "DEAL_TASKS", 3)
    cut = resampling.permutation_auc_test(df, replicates=2000).first()
    assert whole.n_permutations == cut.n_permutations == 2000
    assert (whole.p_value, round(whole.null_mean, 12)) == (cut.p_value, round(cut.null_mean, 12))
    assert abs(whole.null_mean - 0.5) < 4 * 0.3 / np.sqrt(len(y) * 2000 / 8)


def test_null_distribution_equals_that_of_shuffled_rows(spark):
    rng = np.random.default_rng(8)
    p, y = rng.integers(0, 7, 40) / 7.0, (rng.random(40) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, y int")
    order = np.argsort(p, kind="stable")
    mid = np.empty(40)
    for v in np.unique(p):
        mid[p == v] = np.flatnonzero(p[order] == v).mean() + 1
    shuffled = np.array([mid[rng.permutation(40)[:y.sum()]].sum() for _ in range(20000)])
    counts = df.groupBy("p").agg(F.count("*").alias("n")).orderBy("p").collect()
    ahead = np.cumsum([0] + [r.n for r in counts])
    rows = [(i, r.n, int(ahead[i]), float(ahead[i] + (r.n + 1) / 2)) for i, r in enumerate(counts)]
    cells = spark.createDataFrame(rows, "i bigint, n bigint, n_before bigint, mid double")
    dealt = np.array([r.rank_sum for r in resampling.permuted_rank_sums(cells, len(rows), int(y.sum()), 20000, 1).collect()])
    assert len(dealt) == 20000 and abs(dealt.mean() - shuffled.mean()) < 5 * shuffled.std() / 100
    assert np.isclose(dealt.std(), shuffled.std(), rtol=0.05)
    for q in (1, 10, 50, 90, 99):
        assert abs((dealt <= np.percentile(shuffled, q)).mean() - (shuffled <= np.percentile(shuffled, q)).mean()) < 0.02


def test_close_scores_draw_on_their_own(spark):
    rows = spark.createDataFrame([(0.1,), (0.1 + 1e-14,), (1e12,), (1e12 + 0.5,)], "p double")
    assert rows.select(resampling.score_text(F.col("p")).alias("t")).distinct().count() == 4


def test_normal_tail(spark):
    from math import erfc, sqrt

    from helixframe.functions.scores import two_sided_normal

    z = [0.0, 1e-9, 0.1, -1.0, 1.959964, 5.0, -8.8, 9.0, 20.0, 37.0]
    got = [r[0] for r in spark.createDataFrame([(float(x),) for x in z], "z double").select(two_sided_normal(F.col("z"))).collect()]
    want = [erfc(abs(x) / sqrt(2)) for x in z]
    assert np.allclose(got, want, rtol=1e-12, atol=0)
    odd = spark.createDataFrame([(None,), (float("nan"),)], "z double").select(two_sided_normal(F.col("z"))).collect()
    assert [r[0] for r in odd] == [None, None]


def test_ranking_in_blocks_deals_rows_once(spark):
    rng = np.random.default_rng(9)
    p = np.where(rng.random(6000) < 0.3, 0.5, np.round(rng.random(6000), 3))
    rows = [(int(i % 2), float(v), int(rng.random() < v)) for i, v in enumerate(p)] + [(0, None, 1), (1, 0.2, None)]
    df = spark.createDataFrame(rows, "g int, p double, y int").cache()
    want = {r.g: r for r in metrics.ranking_metrics(df, groups=["g"]).collect()}
    found = metrics.ranking_in_blocks(df, groups=["g"], limit=200)
    for r in found.collect():
        w = want[r.g]
        assert (r.n, r.n_pos) == (w.n, w.n_pos) and np.isclose(r.roc_auc, w.roc_auc) and np.isclose(r.pr_auc, w.pr_auc)
    one = metrics.ranking_in_blocks(df, limit=200).first()
    assert np.isclose(one.roc_auc, metrics.ranking_metrics(df).first().roc_auc)
    assert len(want) == 2
