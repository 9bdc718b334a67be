from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helixframe.llm import line_dedup as ld

LINE = "a line that is surely long enough"
POOL = [LINE, " " + LINE.upper() + "\t", LINE + "É", LINE + "é", "short line", "", "x" * 19, "x" * 20, "é" * 20, "\x0b\x0c" + "y" * 30 + "\r", "z" * 100_000]


def brute(docs, least_docs=3, least_chars=20):
    lower = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars and doc is not None:
                holders[key(line)].add(doc)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= least_docs}
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or (doc is not None and doc >= keeper[key(x)])]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


DOCS = [(i, "\n".join(POOL[(i * 3 + j * (i % 5 + 1)) % len(POOL)] for j in range(i % 9))) for i in range(60)]
DOCS += [(None, LINE), (None, LINE + "\nalone"), (7, None), (7, ""), (8, LINE), (8, LINE), (61, "\n" * 5), (62, "\n".join([LINE] * 2000 + ["end"])), (63, LINE), (64, "one line " * 20000)]


@pytest.mark.parametrize("parts", [16, 4096])
def test_equals_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr(ld, "HOT_PARTS", parts)  # 16: some keys are joined by broadcast, others not
    df = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr(
        "doc_id", "'k' as n_lines", "text", "1 as row", "2 as t1", "3 as pos", "4 as gone", "5 as _gone", "6 as _id", "7 as _h", "8 as _part", "9 as rank", "10 as node", "11 as id")
    out = ld.dedup_lines(df.repartition(3))
    assert result(out) == brute(DOCS)
    assert out.columns == [c for c in df.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert {r.rank for r in out.collect()} == {9}


def test_thresholds_and_empty(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert result(ld.dedup_lines(df, least_docs=2, least_chars=5)) == brute(DOCS, 2, 5)
    assert ld.dedup_lines(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert result(ld.dedup_lines(nothing)) == [(1, 1, 0, ""), (2, 1, 0, "")]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 9)), st.lists(st.sampled_from(POOL[:-1]), max_size=8).map("\n".join)), max_size=25))
def test_any_documents(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(ld.dedup_lines(df)) == brute(docs)
