"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact verification.

A window of a document has as many words as an item (the whole document, if it is shorter). The
fingerprints of all windows of a size come from one prefix sum over the signed hash bits of the
shingles. An index over blocks of fingerprint bits finds all items of that size within the Hamming
radius: two fingerprints no further apart than the radius agree in some block up to
radius // blocks bits, and each block's table lists the items that close to every block value.
Candidates are verified by the exact weighted Jaccard similarity of five-word shingles, weighted
by their counts. Windows without any shingle of an item of their size have similarity 0 and get no
fingerprint.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.words import SPACES, combine, words_of

K = 5
THRESHOLD = 0.75
#: Fingerprints of sets with similarity 0.75 differ in 11 of 64 bits, give or take 3.
RADIUS = 24
#: Bits of each block of a fingerprint.
BLOCKS = (9, 9, 9, 9, 9, 9, 10)
ITEMS_PER_PASS = 20_000
SLICE = 256
PIECE = 8192
_BITS = np.arange(64, dtype=np.uint64)


def signed_bits(hashes: np.ndarray) -> np.ndarray:
    return (((hashes[:, None] >> _BITS) & np.uint64(1)).astype(np.int8) * 2 - 1)


def pack_signs(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)


def simhash(hashes: np.ndarray) -> np.uint64:
    return pack_signs(signed_bits(hashes).sum(axis=0, dtype=np.int64)[None, :])[0]


class HammingIndex:
    """All stored fingerprints within a radius of a query, by blocks of bits."""

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: tuple = BLOCKS):
        self.prints, self.radius, self.tables = prints, radius, []
        shift, near = 0, radius // len(blocks)
        for bits in blocks:
            values = ((prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            flips = [sum(1 << b for b in flip) for r in range(near + 1) for flip in combinations(range(bits), r)]
            keys = (values[:, None] ^ np.array(flips)[None, :]).ravel()
            items = np.repeat(np.arange(prints.size), len(flips))
            order = np.argsort(keys, kind="stable")
            self.tables.append((shift, (1 << bits) - 1, np.searchsorted(keys[order], np.arange((1 << bits) + 1)), items[order]))
            shift += bits

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) index pairs within the radius, each once."""
        pairs = []
        for shift, mask, first, items in self.tables:
            values = ((queries >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)
            low, count = first[values], first[values + 1] - first[values]
            query = np.repeat(np.arange(queries.size), count)
            at = np.arange(query.size) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            pairs.append(query * max(self.prints.size, 1) + items[at])
        found = np.unique(np.concatenate(pairs))
        query, item = found // max(self.prints.size, 1), found % max(self.prints.size, 1)
        close = np.bitwise_count(queries[query] ^ self.prints[item]) <= self.radius
        return query[close], item[close]


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of smaller counts over sum of larger counts."""
    shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


class _Class:
    """Items with the same number of words."""

    def __init__(self, size: int, ids: list, shingles: list[np.ndarray]):
        self.size, self.ids = size, ids
        self.k = min(K, size)
        self.width = size - self.k + 1
        self.counts = [Counter(s.tolist()) for s in shingles]
        self.index = HammingIndex(np.array([simhash(s) for s in shingles], dtype=np.uint64))


class ItemIndex:
    """Index of a bounded block of benchmark items; items without words never match."""

    def __init__(self, ids: list, texts: list):
        words = words_of(pa.array([t or "" for t in texts], pa.string()), SPACES)
        by: dict[int, list] = {}
        for i, key in enumerate(ids):
            hashes = words.hashes[words.first[i]:words.first[i + 1]]
            if hashes.size:
                by.setdefault(hashes.size, []).append((key, combine(hashes, min(K, hashes.size))))
        self.classes = [_Class(n, [k for k, _ in rows], [s for _, s in rows]) for n, rows in sorted(by.items())]
        self.lengths = sorted({c.k for c in self.classes})
        self.known, self.classes_of = {}, {}
        for k in self.lengths:
            owners: dict[int, set] = {}
            for c, cls in enumerate(self.classes):
                if cls.k == k:
                    for counts in cls.counts:
                        for h in counts:
                            owners.setdefault(h, set()).add(c)
            keys = np.array(sorted(owners), dtype=np.uint64)
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.known[k] = (keys, sieve)
            self.classes_of[k] = [owners[h] for h in keys.tolist()]

    def matches(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple]:
        """(text, item id, first word, words, distance, similarity): the best of each run of
        overlapping windows that match an item."""
        anchors: dict[tuple[int, int], list] = {}
        runs = {k: combine(hashes, k) for k in self.lengths}
        for k in self.lengths:
            keys, sieve = self.known[k]
            at = np.flatnonzero(sieve[(runs[k] & np.uint64(0xFFFFF)).astype(np.int64)])
            slot = np.searchsorted(keys, runs[k][at])
            same = keys[np.minimum(slot, keys.size - 1)] == runs[k][at]
            at, slot = at[same], slot[same]
            text = np.searchsorted(first, at, "right") - 1
            inside = at + k <= first[text + 1]
            for a, t, s in zip(at[inside].tolist(), text[inside].tolist(), slot[inside].tolist()):
                for c in self.classes_of[k][s]:
                    anchors.setdefault((t, c), []).append(a)
        out = []
        for (t, c), places in sorted(anchors.items()):
            low, high = int(first[t]), int(first[t + 1])
            out += [(t, *m) for m in self._windows(self.classes[c], runs[self.classes[c].k], low, high, np.array(places))]
        return out

    def _windows(self, cls: _Class, runs: np.ndarray, low: int, high: int, places: np.ndarray) -> list[tuple]:
        count = high - low - cls.k + 1  # shingles of the text
        width = min(cls.width, count)
        steps = np.arange(width)
        starts = np.unique((places[:, None] - low - steps[None, :]).ravel()) if places.size * width < 1 << 22 else np.arange(count - width + 1)
        starts = starts[(starts >= 0) & (starts <= count - width)]
        hits: dict[int, list] = {}
        for piece in range(0, starts.size, PIECE):
            part = starts[piece:piece + PIECE]
            base, stop = int(part[0]), int(part[-1]) + width
            if stop - base > 4 * (PIECE + width):  # far apart places: one window at a time is cheaper
                prints = np.array([simhash(runs[low + s:low + s + width]) for s in part], dtype=np.uint64)
            else:
                sums = np.zeros((stop - base + 1, 64), dtype=np.int32)
                np.cumsum(signed_bits(runs[low + base:low + stop]), axis=0, out=sums[1:])
                prints = pack_signs(sums[part - base + width] - sums[part - base])
            for q, i in zip(*(x.tolist() for x in cls.index.search(prints))):
                s = int(part[q])
                similarity = weighted_similarity(Counter(runs[low + s:low + s + width].tolist()), cls.counts[i])
                if similarity >= THRESHOLD:
                    distance = int(np.bitwise_count(prints[q] ^ cls.index.prints[i]))
                    hits.setdefault(i, []).append((s, distance, similarity))
        rows = []
        for i, found in sorted(hits.items()):
            last, best = None, None
            for hit in sorted(found):
                if last is not None and hit[0] > last + width + cls.k - 2:
                    rows.append((cls.ids[i], best[0], width + cls.k - 1, best[1], best[2]))
                    best = None
                if best is None or hit[2] > best[2]:
                    best = hit
                last = hit[0]
            rows.append((cls.ids[i], best[0], width + cls.k - 1, best[1], best[2]))
        return rows


def item_blocks(benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS):
    """Item indexes of at most about `per_pass` items each; together they hold every item."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-rows.count() // per_pass))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = part.collect()
        yield ItemIndex([r.item_id for r in found], [r.text for r in found])


def find_contamination(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, item_id, first_word, words, distance, similarity of every matching place.

    Matching windows of one item that overlap in a chain are one place, given by the best of them:
    copies of an item with no or only a few words between them give one row.
    Documents are read whole, once for each block of items, and do not move. Null and empty texts
    match nothing, nor do items without words; an item of fewer than five words matches its exact
    word sequence. Repeated rows are reported as often as they occur.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("words", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())])
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = None
    for index in item_blocks(benchmark, per_pass):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for low in range(0, batch.num_rows, SLICE):
                    part = batch.slice(low, SLICE)
                    words = words_of(part.column(1), SPACES)
                    keys = part.column(0).to_pylist()
                    out = [(keys[t], *more) for t, *more in shared.value.matches(words.hashes, words.first)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        one = rows.mapInArrow(run, "doc_id bigint, item_id bigint, first_word bigint, words bigint, distance int, similarity double")
        found = one if found is None else found.union(one)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """The rows of docs that match no item, with all their columns."""
    at = docs.columns.index("text")
    kept = docs
    for index in item_blocks(benchmark, per_pass):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                for low in range(0, batch.num_rows, SLICE):
                    part = batch.slice(low, SLICE)
                    words = words_of(part.column(at), SPACES)
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[[m[0] for m in shared.value.matches(words.hashes, words.first)]] = False
                    yield part.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
