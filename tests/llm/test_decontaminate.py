import random
import re
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(w):
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, items):
    """(doc, item) with a window of the item's size at or above the threshold."""
    out = set()
    for d, text in docs:
        w = words(text)
        for i, item in items:
            v = words(item)
            if not v or not w or (len(v) < 5 and len(w) < len(v)) or (len(v) >= 5 and len(w) < 5):
                continue
            size = min(len(v), len(w))
            if any(dc.weighted_similarity(bag(w[s:s + size]), bag(v)) >= 0.75 for s in range(len(w) - size + 1)):
                out.add((d, i))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(sentence(rng.choice([12, 20, 20, 35, 50])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "two words"), (103, items[0][1]), (None, items[1][1] + " x")]
    docs = []
    for d in range(250):
        w = sentence(rng.randrange(0, 150))
        if d % 3 == 0:
            leak = words(rng.choice(items)[1])
            if d % 2 and len(leak) > 8:
                for _ in range(rng.randrange(1, 4)):
                    leak[rng.choice([0, 1, -1, -2, rng.randrange(len(leak))])] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() for x in leak] if d % 5 == 0 else leak
        if d % 40 == 0:
            w = words(items[d % 25][1])[:-2]  # shorter than the item
        docs.append((d, " \n".join(w)))
    return docs + [(1000, None), (1001, ""), (1002, " ".join(sentence(30_000)) + " " + items[3][1]), (7, docs[7][1]), (1003, (items[2][1] + " ") * 300)], items


@pytest.mark.parametrize("per_pass", [20_000, 8])
def test_equals_brute_force(spark, per_pass):
    docs, items = case(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as similarity").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_contamination(df, bench, per_pass).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 60
    assert sum(r.doc_id == 1003 and r.item_id == 2 for r in got) == 1  # one run of overlapping windows
    kept = dc.drop_contaminated(df, bench, per_pass)
    assert kept.columns == df.columns
    flagged = {d for d, _ in want}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in docs if d not in flagged)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_contamination(docs, none).count() == 0
    assert dc.drop_contaminated(docs, none).count() == 1
    assert dc.find_contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 2**64, 300, dtype=np.uint64)
    queries = prints[rng.integers(300, size=500)]
    for _ in range(26):
        queries = queries ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    index = dc.HammingIndex(prints)
    got = set(zip(*(x.tolist() for x in index.search(queries))))
    near = np.bitwise_count(queries[:, None] ^ prints[None, :]) <= dc.RADIUS
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(near))}


def test_what_the_index_and_the_shared_shingle_leave_to_compare(monkeypatch):
    """Random prints: the radius leaves a few in a hundred. Texts without a shingle of an item cost no comparison,
    a planted item only those of the windows around it."""
    import pyarrow as pa

    from helixframe.llm.words import SPACES, words_of

    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, 400, dtype=np.uint64)
    found = dc.HammingIndex(prints).search(rng.integers(0, 2**64, 200, dtype=np.uint64))[0].size
    assert found / (200 * 400) < 0.05
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choice(vocabulary, 30)) for _ in range(200)]
    texts = [" ".join(rng.choice(vocabulary, 400)) for _ in range(50)]
    index, calls, compare = dc.ItemIndex(list(range(200)), items), [], dc.weighted_similarity
    monkeypatch.setattr(dc, "weighted_similarity", lambda a, b: calls.append(1) or compare(a, b))

    def matches(rows):
        words = words_of(pa.array(rows), SPACES)
        return index.matches(words.hashes, words.first)

    assert matches(texts) == [] and len(calls) == 0
    planted = [f"{texts[0]} {items[5]} {texts[1]}"]
    assert [m[1] for m in matches(planted)] == [5]
    assert 0 < len(calls) < 0.1 * 2 * 30 * 200  # of all windows that touch the item with all items
