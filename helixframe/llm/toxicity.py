"""Toxicity by multiple-instance learning: labels are of documents, scores of sentences.

A sentence has the probability sigmoid(bias + weights of its distinct words and word beginnings);
a document is toxic if any sentence is (noisy-or), and that probability is fitted to the document
labels. The same weights then tell which sentences offend.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import LOWER, NON_WORD, _power_tables, mix, words_of
from helixframe.session import cut_lineage

BUCKETS = 1 << 18
#: Labelled rows that a model is fitted on, at most, of each label.
SAMPLE = 3000
BEGINNING = 4
THRESHOLD = 0.7
PASSES = 400
SENTENCE_ENDS = np.zeros(256, dtype=bool)
SENTENCE_ENDS[[ord(c) for c in ".!?\n"]] = True
SLICE = 64


def beginnings(words, size: int = BEGINNING) -> np.ndarray:
    """Hash of the first bytes of each word (of whole words not longer than that)."""
    down = words.starts
    total = np.zeros(down.size, dtype=np.uint64)
    up, _ = _power_tables(size + 1)
    for i in range(size):
        at = np.minimum(down + i, max(words.data.size - 1, 0))
        inside = down + i < words.ends
        total += np.where(inside, (LOWER[words.data[at]].astype(np.uint64) + np.uint64(1)) * up[i], np.uint64(0))
    return mix(total ^ np.uint64(0x5DEECE66D))


def sentence_features(texts: pa.Array):
    """(features, first feature of each sentence, text of each sentence): distinct in a sentence.

    A sentence has at least one word. Features are bucket numbers below BUCKETS; the second half
    of the buckets is for beginnings.
    """
    words = words_of(texts, NON_WORD)
    half = np.uint64(BUCKETS // 2)
    ends = np.flatnonzero(SENTENCE_ENDS[words.data])
    text = np.searchsorted(words.first, np.arange(words.hashes.size), "right") - 1
    key = np.searchsorted(ends, words.starts) + text
    _, sentence, count = np.unique(key, return_inverse=True, return_counts=True)
    features = np.concatenate([words.hashes % half, half + beginnings(words) % half]).astype(np.int64)
    pairs = np.unique(np.concatenate([sentence, sentence]).astype(np.int64) * BUCKETS + features)
    owner = pairs // BUCKETS
    first = np.searchsorted(owner, np.arange(count.size))
    lead = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64) if count.size else np.zeros(0, np.int64)
    return pairs % BUCKETS, first, text[lead] if count.size else lead, words, lead


def sentence_logits(features: np.ndarray, first: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    return np.add.reduceat(weights[features], first) + bias if first.size else np.zeros(0)


def noisy_or(logits: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """1 - product of (1 - p) over the sentences of each text; 0 without sentences."""
    return -np.expm1(-np.bincount(text, weights=np.logaddexp(0, logits), minlength=n))


def telling(toxic: np.ndarray, clean: np.ndarray, positive: int, n: int) -> np.ndarray:
    """Features whose documents are toxic more often than chance allows, from the numbers of toxic
    and clean documents that hold each feature.

    The likelihood ratio (G-squared) of document counts must exceed twice the log of the number of
    features, so that about none passes by luck; words of single documents never do.
    """
    share = positive / max(n, 1)

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)

    a, b = toxic.astype(float), clean.astype(float)
    k = a + b
    g = 2 * (part(a, k * share) + part(b, k * (1 - share)) + part(positive - a, (n - k) * share) + part(n - positive - b, (n - k) * (1 - share)))
    bound = 2 * np.log(max(np.count_nonzero(k), 2))
    return np.flatnonzero((g > bound) & (a > k * share))


def train(owner, features, d: int, text, labels, passes: int = PASSES, rate: float = 0.15, decay: float = 0.01):
    """Weights (none negative) of d features and bias, by full-batch Adam on the document log-loss.

    `owner` is the sentence of each entry of `features`, `text` the document of each sentence.
    """
    n, sentences = labels.size, text.size
    w, b = np.zeros(d), -5.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, passes + 1):
        z = np.bincount(owner, weights=w[features], minlength=sentences) + b
        total = np.bincount(text, weights=np.logaddexp(0, z), minlength=n)
        slope = np.where(labels == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0) / n
        dz = slope[text] / (1 + np.exp(-z))
        g = np.append(np.bincount(features, weights=dz[owner], minlength=d) + decay / n * w, dz.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, b


def held_out(key):
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Model from a bounded sample of labelled rows outside the held-out third.

    Of each label, the `sample` rows with the smallest hash of their id are taken; rows without
    label, id or document are left out, a document labelled twice is toxic if any label says so;
    equal texts count once. Tasks count the documents of each feature; one task fits the weights of
    the telling features, whose occurrences in the sample are few. Without labelled documents every
    score is near 0.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    of = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for label in (0, 1)]
    picked = of[0].union(of[1])
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    rows = cut_lineage(rows.dropDuplicates(["text", "toxic"]).select("text", "toxic"))

    def slices(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                yield part.column(1).to_numpy(zero_copy_only=False), sentence_features(part.column(0))[:3]

    def count(batches):
        held, docs_of = np.zeros((2, BUCKETS), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for labels, (features, first, text) in slices(batches):
            docs_of += np.bincount(labels, minlength=2)
            pairs = np.unique(np.repeat(text, np.diff(np.append(first, features.size))) * BUCKETS + features)
            for label in (0, 1):
                held[label] += np.bincount(pairs[labels[pairs // BUCKETS] == label] % BUCKETS, minlength=BUCKETS)
        label, feature = np.nonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*label.tolist(), 0, 1], pa.int32()), pa.array([*feature.tolist(), -1, -1], pa.int64()), pa.array([*held[label, feature].tolist(), *docs_of.tolist()], pa.int64())],
            names=["toxic", "feature", "n"])

    counts = rows.mapInArrow(count, "toxic int, feature bigint, n bigint").groupBy("toxic", "feature").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros((2, BUCKETS + 1), dtype=np.int64)  # the last column counts documents
    tables[counts["toxic"].to_numpy(), counts["feature"].to_numpy()] = counts["n"].to_numpy()
    used = telling(tables[1, :-1], tables[0, :-1], int(tables[1, -1]), int(tables[:, -1].sum()))

    def features_of(batches):
        for labels, (features, first, text) in slices(batches):
            at = np.minimum(np.searchsorted(used, features), max(used.size - 1, 0))
            keep = used[at] == features if used.size else np.zeros(features.size, dtype=bool)
            owner = np.repeat(np.arange(first.size), np.diff(np.append(first, features.size)))[keep]
            bounds = np.searchsorted(text, np.arange(labels.size + 1))
            cuts = np.searchsorted(owner, bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int32()), pa.array(np.diff(bounds), pa.int32()),
                 pa.array([owner[a:z] - first_of for a, z, first_of in zip(cuts[:-1], cuts[1:], bounds[:-1])], pa.list_(pa.int32())),
                 pa.array([at[keep][a:z] for a, z in zip(cuts[:-1], cuts[1:])], pa.list_(pa.int32()))],
                names=["toxic", "sentences", "owner", "features"])

    def fit_all(batches):
        labels, sizes, owner, features = [], [], [], []
        before = 0
        for batch in batches:
            for label, size, own, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                labels.append(label)
                sizes.append(size)
                owner.append(own.values.to_numpy().astype(np.int64) + before)
                features.append(held.values.to_numpy().astype(np.int64))
                before += size
        if not labels:
            return
        text = np.repeat(np.arange(len(sizes)), sizes)
        w, b = train(np.concatenate(owner), np.concatenate(features), used.size, text, np.array(labels))
        yield pa.RecordBatch.from_arrays([pa.array([*used.tolist(), -1], pa.int64()), pa.array([*w.tolist(), b], pa.float64())], names=["feature", "weight"])

    found = (rows.mapInArrow(features_of, "toxic int, sentences int, owner array<int>, features array<int>").coalesce(1)
             .mapInArrow(fit_all, "feature bigint, weight double").toPandas())
    weights, bias = np.zeros(BUCKETS, dtype=np.float32), -20.0
    if len(found):
        at = found["feature"].to_numpy()
        weights[at[at >= 0]] = found["weight"].to_numpy()[at >= 0]
        bias = float(found["weight"].to_numpy()[at < 0][0])
    return weights, bias


def score_documents(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, and offending: (start, length, score) of the sentences at or above
    one half, in code points of the text, for predicted documents.

    Whole texts are scored where they lie. Null and empty texts score 0; repeated rows come back
    repeated.
    """
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("offending", pa.list_(span))])

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                features, first, text, words, lead = sentence_features(part.column(1))
                logits = sentence_logits(features, first, weights, bias)
                scores = noisy_or(logits, text, part.num_rows)
                predicted = (scores >= threshold).astype(np.int32)
                spans = [[] for _ in range(part.num_rows)]
                stops = np.append(lead, words.starts.size)
                for s in np.flatnonzero((logits >= 0) & (predicted[text] == 1) if logits.size else logits):
                    begin, end = words.starts[stops[s]], words.ends[stops[s + 1] - 1]
                    head = words.data[words.offsets[text[s]]:begin].tobytes().decode("utf-8", "replace")
                    body = words.data[begin:end].tobytes().decode("utf-8", "replace")
                    spans[text[s]].append({"start": len(head), "length": len(body), "score": float(1 / (1 + np.exp(-logits[s])))})
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(predicted), pa.array(spans, pa.list_(span))], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, score double, predicted int, offending array<struct<start:bigint,length:bigint,score:double>>")


def drop_toxic(docs: DataFrame, weights: np.ndarray, bias: float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not predicted, with all their columns."""
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                features, first, text, _, _ = sentence_features(part.column(at))
                scores = noisy_or(sentence_logits(features, first, weights, bias), text, part.num_rows)
                yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
