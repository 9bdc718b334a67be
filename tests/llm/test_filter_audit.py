import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from helixframe.llm import filter_audit as fa

LONG = " ".join(f"word{i}" for i in range(120))
TEXTS = [
    None, "", " ", "\n\t", "short", LONG, LONG + " $", LONG.upper(), "again " * 150, "again " * 150 + "#", "A" * 40, LONG + "\x1cx y",
    ("Word word " * 80) + LONG, "é" * 300, LONG.replace("word", "WOrd"), "x" * 300_000, "tab\tsplit\x0bwords\x0cof\rall\nkinds " * 30,
]
DOCS = [(i, TEXTS[i % len(TEXTS)], ["en", "de", None, ""][i % 4], "s") for i in range(140)]
DOCS += [(None, LONG, "en", "s"), (None, LONG, "en", "s"), (3, LONG, "en", "s"), (3, LONG, "fr", "s"), (500, "x" * 300_000, "en", "s")]
LABELS = [(i, i % 2, i % 3 == 0) for i in range(0, 140, 2)] + [(4, 1, True), (4, None, None), (None, 1, True), (9999, 1, True)]


def brute(docs, labels):
    marks = defaultdict(lambda: [0, 0])
    for key, quality, toxic in labels:
        if key is not None:
            marks[key][0] |= quality == 1
            marks[key][1] |= bool(toxic)
    least = {}
    for key, text, *_ in docs:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    rows = []
    for key, text, lang, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": key is not None and key > least[text],
        }
        good, toxic = marks[key] if key in marks else (0, 0)
        rows.append((lang or "", {c for c, v in fails.items() if v}, good, toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        alive = [True] * len(rows)
        for step, letter in enumerate(order, 1):
            for i, (part, fails, good, toxic) in enumerate(rows):
                at = out.setdefault((part, order, step), Counter())
                hit = letter in fails
                at["kept"] += alive[i] and not hit
                at["removed"] += alive[i] and hit
                at["redundant"] += hit and not alive[i]
                at["unique_fails"] += fails == {letter}
                at["good_lost"] += good if alive[i] and hit else 0
                at["toxic_lost"] += toxic if alive[i] and hit else 0
                shapley[part, letter] += alive[i] and hit
                alive[i] = alive[i] and not hit
    return {(*k, *[v[c] for c in fa.COUNTS], shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").selectExpr(
        "*", "1 as mask", "2 as part", "3 as key", "4 as n", "5 as digest", "6 as good", "7 as _id", "8 as _h", "9 as _part", "10 as rank", "11 as node")
    marks = spark.createDataFrame([(k, q, None if t is None else int(t)) for k, q, t in labels], "doc_id long, quality int, toxic int")
    return d, marks.selectExpr("*", "1 as good", "2 as key", "3 as text")


def test_equals_brute_force(spark):
    docs, labels = frames(spark, DOCS, LABELS)
    rows = fa.audit_filters(docs.repartition(5), labels).collect()
    assert {tuple(r) for r in rows} == brute(DOCS, LABELS)
    assert len(rows) == 600 * 4
    assert fa.audit_filters(docs, labels).columns == ["part", "filter_order", "step", *fa.COUNTS, "shapley"]


def test_empty_tables(spark):
    docs, labels = frames(spark, DOCS, LABELS)
    assert fa.audit_filters(docs.limit(0), labels).count() == 0
    rows = fa.audit_filters(docs, labels.limit(0)).collect()
    assert len(rows) == 2400 and all(r.good_lost == 0 and r.toxic_lost == 0 for r in rows)


def test_measures_do_not_depend_on_slices():
    import pyarrow as pa

    texts = pa.array([t or "" for t in TEXTS])
    whole = fa.measure(texts)
    for i in range(len(texts)):
        one = fa.measure(texts.slice(i, 1))
        assert {k: v[0] for k, v in one.items()} == {k: v[i] for k, v in whole.items()}
    assert list(fa.slices(np.array([5, 5, 20, 1]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_few_filters_and_wrong_names(spark):
    docs, labels = frames(spark, DOCS, LABELS)
    rows = fa.audit_filters(docs, labels, {"A": "n_words < 100"}).collect()
    assert len(rows) == 2 * 2 * 4
    for r in rows:
        if r.step == 2:
            assert r.kept == {p: n for p, n in Counter().items()}.get(r.part, r.kept)
    for checks in ({"A": "true", "E": "true"}, {"AB": "true"}, {c: "true" for c in "abcdefg"}):
        with pytest.raises(ValueError):
            fa.audit_filters(docs, labels, checks)
