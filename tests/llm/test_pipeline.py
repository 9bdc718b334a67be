import random
import zlib

import numpy as np
import pyarrow as pa

import corpus_pipeline
from helixframe.llm import ngram_join, packing, toxicity
from helixframe.llm.catalog import tokenizer_path
from helixframe.llm.tokens import Encoder
from test_decontaminate import brute as leaks
from test_ngram_join import brute as groups


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(5, 15))) + "."
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(10)]
    docs, labels = [], []
    for d in range(400):
        text = " ".join(sentence() for _ in range(rng.randrange(1, 12)))
        toxic = d % 4 == 0
        if toxic:
            text += f" you {rng.choice(['fool', 'twit'])} there."
        elif d % 7 == 0:
            text += " " + items[d % 10][1]
        elif d % 11 == 0 and d > 50:
            text = docs[d - 11][1] + " tail"
        docs.append((d, text, "en", "s", len(text)))
        labels.append((d, 1, int(toxic)))
    docs += [(5, docs[5][1], "en", "s", 1), (900, None, None, None, None), (901, "", "en", "s", 0), (None, "lonely text without an id", "en", "s", 3)]
    return docs, labels, items


def test_stages_equal_brute_force(spark, tmp_path):
    docs, labels, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = str(tmp_path)
    rows = spark.read.parquet(f"{d}/documents.parquet")
    schema = rows.schema
    model = toxicity.fit(rows, spark.read.parquet(f"{d}/labels.parquet"))
    order = lambda rs: sorted(map(tuple, rs), key=str)
    left = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, rows, d)
        if name == "toxicity":
            features, first, text, _, _ = toxicity.sentence_features(pa.array([r[1] for r in left]))
            scores = toxicity.noisy_or(toxicity.sentence_logits(features, first, *model), text, len(left))
            want = [r for r, s in zip(left, scores) if s < 0.7]
            assert 80 < len(left) - len(want) < 120 and not any("fool" in (r[1] or "") for r in want)
        elif name == "ngram_join":
            seen, want = set(), []
            root = {key: comp for key, _, comp in groups([(r[0], r[1]) for r in left])}
            for r in left:
                wordless = not (r[1] or "").strip()
                if wordless or ((r[0] is None or root[r[0]] == r[0]) and r[0] not in seen):
                    seen.add(r[0])
                    want.append(r)
            assert len(want) < len(left)
            # of repeated rows any one stays: they differ here in n_chars only
            assert order(r[:4] for r in out.collect()) == order(r[:4] for r in want)
            want = [tuple(r) for r in out.collect()]
        elif name == "decontamination":
            bad = {x for x, _ in leaks([(r[0], r[1]) for r in left], items)}
            want = [r for r in left if r[0] not in bad]
            assert len(left) - len(want) > 20
        if name == "packing":
            break
        assert order(out.collect()) == order(want)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in schema]
        out.write.parquet(f"{d}/stage{k}")
        rows, left = spark.read.parquet(f"{d}/stage{k}"), want
    encode = Encoder(tokenizer_path())
    want = []
    for r in left:
        ids = np.array([*encode(r[1] or ""), 2], dtype="<u4")
        want += [(r[0], p, s, n, zlib.crc32(ids[s:s + n].tobytes())) for p, (s, n) in enumerate(packing.cut_pieces(ids.size, 1024))]
    got = corpus_pipeline.run(spark, d).collect()
    assert order(r[:5] for r in got) == order(want)


def test_keep_one_with_few_broadcast_rows(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PICK_ROWS", 0)
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(3, text), (1, text + " x"), (1, text + " x"), (None, text), (7, None), (7, None), (8, "a b")]
    rows = ngram_join.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(str, rows)) == sorted(map(str, spark.createDataFrame([(1, text + " x"), (7, None), (7, None), (8, "a b")], "doc_id long, text string").collect()))
