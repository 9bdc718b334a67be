import random
import re

import numpy as np
import pytest

from helixframe.llm import ngram_join
from helixframe.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and root(i) != root(j):
                common = len(a & b)
                if 100 * common >= 75 * (len(a) + len(b) - common):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d if d is not None else -1), len(sets[i]), (d if not sets[i] else least.get(root(i), None)) if d is not None else least.get(root(i)) if sets[i] else None) for i, (d, _) in enumerate(docs))


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(2000)]
    passage = [f"p{i}" for i in range(40)]
    docs = []
    base = [rng.choice(words) for _ in range(120)]
    for d in range(n):
        kind = d % 5
        if kind == 0:  # one large family of near copies, many of which do not link to each other
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = rng.choice(words)
        elif kind == 1 and docs:  # copies and near copies of anything
            w = (docs[rng.randrange(len(docs))][1] or "").split()
            if w and rng.random() < 0.6:
                w[rng.randrange(len(w))] = "x"
            if w and rng.random() < 0.3:
                w = w[:-rng.randrange(1, 4)] or w
        elif kind == 2:  # a passage that many share
            w = [rng.choice(words) for _ in range(rng.randrange(10, 60))]
            at = rng.randrange(len(w))
            w[at:at] = passage
        else:
            w = [rng.choice(words[:30]) for _ in range(rng.randrange(0, 12))]
        docs.append((d, " ".join(w)))
    return docs


ODD = [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "a b c d"), (1005, "a b c d e"), (None, "a b c d"), (1006, " \n"),
       (3, "other text under a known id here"), (1007, "w1 " * 30_000), (1008, "w1 " * 29_000 + "w2")]


@pytest.mark.parametrize("seed,hot,pivots", [(1, 4096, 8), (2, 20, 1), (3, 4096, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, pivots):
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    monkeypatch.setattr(ngram_join, "PIVOTS", pivots)
    monkeypatch.setattr(ngram_join, "BLOCK_NODES", 7)
    docs = corpus(seed) + ODD
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n", "3 as component_id").repartition(3)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.link_components(df).collect())
    assert got == brute(docs)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_components(none).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f"), (6, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.link_components(one).collect())) == [(5, 2, 5), (6, 0, 6)]


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_prefix_length_is_safe():
    for n in range(1, 400):
        p = ngram_join.prefix_length(n)
        # a set that shares less than n - p + 1 shingles cannot link with anything not smaller
        assert not ngram_join.linked(n - p, n, n) and 1 <= p <= n
        assert np.all(p >= n - -(-75 * n // 100) + 1)
