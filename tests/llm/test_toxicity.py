import random
import zlib

import numpy as np
import pyarrow as pa

from helixframe.llm import toxicity


def corpus(n=900, seed=0):
    rng = random.Random(seed)
    calm = [f"wort{i}" for i in range(200)]
    rude = ["idiota", "idioten", "lump", "schuft"]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(calm) for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 15))]
        toxic = rng.random() < 0.25
        where = None
        if toxic:
            where = rng.randrange(len(sentences))
            sentences[where] += " " + rng.choice(rude) + " " + rng.choice(calm)
        rows.append((i, ". ".join(sentences) + ".", where))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_sentences(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    scored = {r.doc_id: r for r in toxicity.score_documents(docs, *model).collect()}
    flags = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, *_ in rows}
    held = [i for i in flags if flags[i]]
    toxic = {i: t for i, _, t in labels}
    assert 200 < len(held) < 400
    assert sum(scored[i].predicted == toxic[i] for i in held) / len(held) > 0.97
    assert {r.doc_id for r in docs.where(toxicity.held_out(docs.doc_id)).collect()} == set(held)
    hits = [i for i in held if toxic[i] and scored[i].predicted]
    for i in hits:
        text, where = rows[i][1], rows[i][2]
        spans = [text[s.start:s.start + s.length] for s in scored[i].offending]
        assert spans == [text.split(". ")[where].rstrip(".")]


def test_odd_rows(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame([*[r[:2] for r in rows], (-1, None), (-2, ""), (None, "lump"), (-3, "..."), (-4, "ruhig " * 200_000), (3, "twice"), (3, "twice")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    more = docs.selectExpr("*", "1 as score", "2 as toxic", "'x' as predicted")
    got = toxicity.score_documents(more, *model).collect()
    assert len(got) == 307 and all(0 <= r.score <= 1 for r in got)
    scores = {r.doc_id: r.score for r in got}
    assert scores[-1] == scores[-2] == scores[-3] == 0
    kept = toxicity.drop_toxic(more, *model)
    assert kept.columns == more.columns
    assert kept.count() == sum(1 - r.predicted for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    none = toxicity.fit(empty, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score_documents(empty, *none).count() == 0
    assert max(r.score for r in toxicity.score_documents(docs.limit(50), *none).collect()) < 0.01


def test_score_equals_plain_noisy_or():
    rng = np.random.default_rng(0)
    weights, bias = rng.normal(size=toxicity.BUCKETS), -2.0
    texts = ["One two. three", "", None, "a. b! c? d\ne", "x"]
    features, first, text, _, _ = toxicity.sentence_features(pa.array(texts))
    got = toxicity.noisy_or(toxicity.sentence_logits(features, first, weights, bias), text, len(texts))
    stops = np.append(first, features.size)
    for t in range(len(texts)):
        keep = 1.0
        for s in np.flatnonzero(text == t):
            keep *= 1 - 1 / (1 + np.exp(-(bias + weights[features[stops[s]:stops[s + 1]]].sum())))
        assert abs(got[t] - (1 - keep)) < 1e-12
    assert [int((text == t).sum()) for t in range(5)] == [2, 0, 0, 5, 1]
