"""N-gram Jaccard join of documents: a grouped prefix join with exact verification.

Two documents link if 100 * intersection >= 75 * union of their distinct five-word shingles.

1. Shingles are ordered by document frequency, rare ones first (frequent ones are found by an exact
   count over all documents of 32-bit shingle hashes). Any common order gives the same result;
   this one keeps passages that many documents share out of the prefixes.
2. Linked documents share a shingle of their prefixes (the first size - ceil(0.75 size) + 1).
   Documents with equal sets are one node; nodes with identical prefixes and size are one group.
   Only groups enter the index; an index row is (shingle, group, size).
3. Groups that share a prefix shingle and fit in size are candidates. A shingle of many groups gives
   no all-pairs list: every group is paired with a few pivots of the shingle, and what these pairs
   leave unconnected is compared with all other groups of the shingle in the end, in blocks, so that
   no link is lost.
4. Group pairs are expanded to nodes, filtered by an upper bound of the intersection (from counts of
   hashed shingle classes) and verified on the full sets. Pairs inside a component are skipped.

Shingle hashes have 64 bits, sets are compared by 48 of them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.components import components
from helixframe.llm.words import SPACES, mix, shingle_sets, words_of
from helixframe.session import cut_lineage

K = 5
PERCENT = 75
#: A shingle hash this frequent, and above the chance load of its 32-bit slot, goes to the end of
#: the order; the most frequent FREQUENT_MAX are known to all tasks (8 bytes each).
FREQUENT = 8
FREQUENT_MAX = 1 << 20
#: Index rows of one shingle from which on they are spread over tasks.
HOT_ROWS = 4096
SALTS = 64
PIVOTS = 8
CLASSES = 256
BLOCK_NODES = 512
SLICE = 64
#: Shingles that a task gathers before it sends packed blocks.
GATHER = 1 << 18
#: Rows of two numbers that may be broadcast to pick documents (about 100 bytes each).
PICK_ROWS = 500_000


def linked(common, left, right):
    """The link condition, for numbers, arrays and columns alike."""
    return 100 * common >= PERCENT * (left + right - common)


def fits(left, right):
    """Sizes that may link; left <= right."""
    return 100 * left >= PERCENT * right


def prefix_length(size: int) -> int:
    return size + (-PERCENT * size) // 100 + 1


def _sets(batches, column: int):
    """(batch slice, sets of its texts)."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE):
            part = batch.slice(low, SLICE)
            yield part, list(shingle_sets(words_of(part.column(column), SPACES), K))


def node_of(shingles: np.ndarray) -> int:
    """64-bit identity of a set, never negative."""
    with np.errstate(over="ignore"):
        total = mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(shingles.size) * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(np.array([total]))[0] >> np.uint64(1))


class Order:
    """Global order of shingles: rare ones by hash, then frequent ones by count and hash."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray):
        order = np.argsort(slots)
        self.slots, self.counts = slots[order], counts[order]
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[self.slots >> np.uint32(16)] = True

    def frequency(self, shingles: np.ndarray) -> np.ndarray:
        """Count of frequent shingles, 0 of others."""
        slots = (shingles >> np.uint64(32)).astype(np.uint32)
        out = np.zeros(shingles.size, dtype=np.int64)
        maybe = np.flatnonzero(self.sieve[slots >> np.uint32(16)])
        if maybe.size:
            at = np.minimum(np.searchsorted(self.slots, slots[maybe]), self.slots.size - 1)
            hit = self.slots[at] == slots[maybe]
            out[maybe[hit]] = self.counts[at[hit]]
        return out

    def prefix(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix of a sorted set, and the frequencies of its members."""
        seen = self.frequency(shingles)
        length = prefix_length(shingles.size)
        if seen.any():
            order = np.argsort(seen, kind="stable")[:length]
            return shingles[order], seen[order]
        return shingles[:length], seen[:length]


def group_of(prefix: np.ndarray, size: int) -> int:
    return node_of(np.append(np.sort(prefix), np.uint64(size) + np.uint64(1)))


def _frequent(texts: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit shingle hashes with the largest document frequencies, and these.

    Tasks count what they hold and send sorted blocks by hash range, once per distinct hash; a
    range is counted by one task. Only frequent ones come to the driver, FREQUENT_MAX at most.
    """
    span = -(-(1 << 32) // buckets)

    def blocks(values):
        unique, counts = np.unique(values, return_counts=True)
        many = counts > 1
        cuts = np.searchsorted(unique, np.arange(1, buckets) * span)
        rows = []
        for b, (v, c, m) in enumerate(zip(np.split(unique, cuts), np.split(counts, cuts), np.split(many, cuts))):
            if v.size:
                rows.append((b, v[~m].tobytes(), v[m].tobytes(), c[m].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "once", "many", "counts"])

    def send(batches):
        held, n = [], 0
        for _, sets in _sets(batches, 0):
            held += [(s >> np.uint64(32)).astype(np.uint32) for s in sets]
            n += sum(map(len, sets))
            if n >= GATHER:
                yield blocks(np.concatenate(held))
                held, n = [], 0
        if n:
            yield blocks(np.concatenate(held))

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        once = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["once"]])
        many = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["many"]])
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["counts"]])
        values, total = np.unique(once, return_counts=True)
        values, where = np.unique(np.concatenate([values, many]), return_inverse=True)
        sums = np.bincount(where, weights=np.concatenate([total, counts])).astype(np.int64)
        least = max(FREQUENT, 4 * int(sums.sum()) * buckets >> 32)
        keep = sums >= least
        return pd.DataFrame({"slot": values[keep].astype(np.int64), "n": sums[keep]})

    found = (texts.mapInArrow(send, "bucket int, once binary, many binary, counts binary").groupBy("bucket")
             .applyInPandas(count, "slot bigint, n bigint").orderBy(F.desc("n"), "slot").limit(FREQUENT_MAX).toPandas())
    return found["slot"].to_numpy().astype(np.uint32), found["n"].to_numpy().astype(np.int64)


def _index(texts: DataFrame, order, buckets: int) -> DataFrame:
    """Rows of kind 0: group pair (a, b); kind 1: (a: shingle, b: group, n: size) of shingles with more
    groups than pivots pair; kind 2: the same for hot shingles, not paired yet."""
    span = -(-(1 << 64) // buckets)
    bounds = np.array([i * span for i in range(1, buckets)], dtype=np.uint64)
    fields = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ["bucket", "shingles", "groups", "sizes"]

    def blocks(held):
        shingles = np.concatenate([h[0] for h in held])
        seen = np.concatenate([h[1] for h in held])
        groups = np.concatenate([np.full(h[0].size, h[2], dtype=np.int64) for h in held])
        sizes = np.concatenate([np.full(h[0].size, h[3], dtype=np.uint32) for h in held])
        hot = seen >= HOT_ROWS
        bucket = np.searchsorted(bounds, shingles, "right").astype(np.int64)
        bucket[hot] = buckets + groups[hot] % SALTS
        line = np.lexsort((shingles, bucket))
        shingles, groups, sizes, bucket = shingles[line], groups[line], sizes[line], bucket[line]
        present, starts = np.unique(bucket, return_index=True)
        rows = []
        for b, low, high in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), bucket.size]):
            rows.append((b, shingles[low:high].tobytes(), groups[low:high].tobytes(), sizes[low:high].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), fields)], names=names)

    def send(batches):
        held, n, known = [], 0, set()
        for _, sets in _sets(batches, 0):
            for s in sets:
                if s.size:
                    prefix, seen = order.value.prefix(s)
                    group = group_of(prefix, s.size)
                    if group not in known:  # equal texts and groups of this task enter once
                        known.add(group)
                        held.append((prefix, seen, group, s.size))
                        n += prefix.size
            if n >= GATHER:
                yield blocks(held)
                held, n = [], 0
            if len(known) > 1_000_000:
                known.clear()
        if n:
            yield blocks(held)

    def pair(rows: pd.DataFrame) -> pd.DataFrame:
        shingles = np.concatenate([np.frombuffer(b, np.uint64) for b in rows["shingles"]])
        groups = np.concatenate([np.frombuffer(b, np.int64) for b in rows["groups"]])
        sizes = np.concatenate([np.frombuffer(b, np.uint32) for b in rows["sizes"]]).astype(np.int64)
        rank = mix(groups.astype(np.uint64))
        line = np.lexsort((rank, shingles))
        shingles, groups, sizes = shingles[line], groups[line], sizes[line]
        new = np.ones(shingles.size, dtype=bool)
        new[1:] = (shingles[1:] != shingles[:-1]) | (groups[1:] != groups[:-1])  # the same group from several tasks
        shingles, groups, sizes = shingles[new], groups[new], sizes[new]
        as_rows = shingles.view(np.int64)
        if rows["bucket"].iloc[0] >= buckets:
            return pd.DataFrame({"kind": 2, "a": as_rows, "b": groups, "n": sizes})
        first = np.flatnonzero(np.append(True, shingles[1:] != shingles[:-1]))
        count = np.diff(np.append(first, shingles.size))
        start = np.repeat(first, count)
        place = np.arange(shingles.size) - start
        found = []
        for p in range(PIVOTS):
            mine = np.flatnonzero(place > p)
            if not mine.size:
                break
            pivot = start[mine] + p
            low, high = np.minimum(sizes[mine], sizes[pivot]), np.maximum(sizes[mine], sizes[pivot])
            ok = fits(low, high)
            a, b = groups[mine[ok]], groups[pivot[ok]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        wide = np.repeat(count, count) > PIVOTS + 1
        return pd.concat([
            pd.DataFrame({"kind": 0, "a": pairs[:, 0], "b": pairs[:, 1], "n": 0}),
            pd.DataFrame({"kind": 1, "a": as_rows[wide], "b": groups[wide], "n": sizes[wide]})])

    return texts.mapInArrow(send, "bucket int, shingles binary, groups binary, sizes binary").groupBy("bucket").applyInPandas(
        pair, "kind int, a bigint, b bigint, n bigint")


def _facts(docs: DataFrame, order) -> DataFrame:
    """doc_id, tid (hash of the text), n, node, grp, classes (counts of hashed shingle classes; null if
    one exceeds a byte)."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("grp", pa.int64()), ("classes", pa.binary())])

    def run(batches):
        for part, sets in _sets(batches, 1):
            rows = []
            for key, tid, s in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), sets):
                if not s.size:
                    rows.append((key, tid, 0, None, None, None))
                    continue
                counts = np.bincount((s & np.uint64(CLASSES - 1)).astype(np.int64), minlength=CLASSES)
                rows.append((key, tid, s.size, node_of(s), group_of(order.value.prefix(s)[0], s.size), counts.astype(np.uint8).tobytes() if counts.max() < 256 else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(
        run, "doc_id bigint, tid bigint, n bigint, node bigint, grp bigint, classes binary")


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node pairs (a, b) whose intersection can be large enough, with that bound's share."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("classes").alias(f"c{c}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(i).to_numpy() for i in (2, 4))
            most = np.minimum(na, nb)
            left, right = batch.column(3), batch.column(5)
            known = np.flatnonzero(left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False))
            if known.size:
                x, y = (np.frombuffer(b"".join(c.take(pa.array(known)).to_pylist()), np.uint8).reshape(-1, CLASSES) for c in (left, right))
                most = most.copy()
                most[known] = np.minimum(most[known], np.minimum(x, y).sum(axis=1, dtype=np.int64))
            keep = pa.array(fits(np.minimum(na, nb), np.maximum(na, nb)) & linked(most, na, nb))
            share = pa.array(most / (na + nb - most))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), share.filter(keep)], names=["a", "b", "share"])

    wide = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ca", "nb", "cb")
    return wide.mapInArrow(run, "a bigint, b bigint, share double")


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The node pairs that link, by their full sets. `pairs` is a written table."""
    wanted = cut_lineage(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
                         .join(nodes.select("node", "doc_id"), "node"))
    picked = wanted.select(F.col("doc_id").alias("_id"), "node")
    if wanted.count() <= PICK_ROWS:
        picked = F.broadcast(picked)

    def run(batches):
        for part, sets in _sets(batches, 0):
            want = part.column(1).to_pylist()
            keys, held = [], []
            for s, node in zip(sets, want):
                if s.size and node_of(s) == node:  # ids may repeat
                    keys.append(node)
                    held.append(s.view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.binary())], names=["node", "held"])

    texts = docs.join(picked, docs.doc_id.eqNullSafe(F.col("_id"))).select("text", "node")
    sets = texts.mapInArrow(run, "node bigint, held binary")
    side = lambda c: sets.select(F.col("node").alias(c), F.col("held").alias(f"s{c}"))

    def opened(data: bytes) -> np.ndarray:
        out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
        out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
        return out.view(np.uint64).ravel()

    def check(batches):
        for batch in batches:
            a, b = [], []
            last = None
            for x, y, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if last is None or last[0] != x:
                    last = (x, opened(left.as_py()))
                other = opened(right.as_py())
                both = np.sort(np.concatenate([last[1], other]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                if linked(common, last[1].size, other.size):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb")
    return joined.mapInArrow(check, "a bigint, b bigint").distinct()


def _apart(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    if roots is None:
        return pairs
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    both = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _hot_pairs(rows: DataFrame) -> DataFrame:
    """Each group of a hot shingle with the shingle's pivots."""
    from pyspark.sql import Window

    rows = rows.select("a", "b", "n").distinct()
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"), "b"))).where(F.col("r") <= PIVOTS)
    pivots = ranked.select("a", F.col("b").alias("p"), F.col("n").alias("m"))
    return rows.join(pivots, "a").where(fits(F.least("n", "m"), F.greatest("n", "m"))).select(F.col("b").alias("a"), F.col("p").alias("b"))


def jaccard_links(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(facts, roots): doc_id, tid, n_shingles, node of every document, and (node, root) of all nodes with a link
    to another node (None if there is none).

    `docs` is read four times (three passes over the texts, one for the texts of candidates).
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = 4 * max(1, docs.rdd.getNumPartitions())
    texts = docs.select("text")
    order = docs.sparkSession.sparkContext.broadcast(Order(*_frequent(texts, buckets)))
    facts = cut_lineage(_facts(docs, order))
    nodes = cut_lineage(facts.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("grp").alias("grp"), F.max("classes").alias("classes")))
    found = cut_lineage(_index(texts, order, buckets))
    near = found.where("kind = 0").select("a", "b").union(_hot_pairs(found.where("kind = 2")))
    groups = cut_lineage(_ordered(near))

    # expand: the first node of each group stands for it, other members are paired with it
    members = nodes.select("grp", "node", "n")
    heads = members.groupBy("grp").agg(F.min("node").alias("head"))
    inside = members.join(heads, "grp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    head = lambda c: heads.select(F.col("grp").alias(c), F.col("head").alias(f"h{c}"))
    across = groups.join(head("a"), "a").join(head("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    bounded = cut_lineage(_bounded(_ordered(across.union(inside)), nodes))

    roots = None

    def connect(pairs: DataFrame) -> None:
        nonlocal roots
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            return
        edges = cut_lineage(_verified(docs, pairs, nodes))
        if roots is not None:
            edges = edges.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = cut_lineage(components(edges))

    # the likeliest partner of every node first, then what is still apart
    both = bounded.union(bounded.select(F.col("b").alias("a"), F.col("a").alias("b"), "share"))
    best = both.groupBy("a").agg(F.max_by("b", F.struct("share", "b")).alias("b"))
    connect(_ordered(best))
    connect(_apart(bounded.select("a", "b"), roots))
    # what pivots could not tell, among nodes that are still apart
    connect(_open_pairs(found, groups, nodes, roots))
    return facts.select("doc_id", "tid", F.col("n").alias("n_shingles"), "node"), roots


def _bound_matrix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Upper bound of the intersection of every left set with every right one."""
    out = np.empty((len(left), len(right)), dtype=np.int64)
    for i, row in enumerate(left):
        out[i] = np.minimum(row[None, :], right).sum(axis=1, dtype=np.int64)
    return out


def _open_pairs(found: DataFrame, groups: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Node pairs that may link, of different components that share a wide shingle, or a group of
    several nodes, or such a group and a candidate partner of it.

    In each of these sets the nodes outside its largest component are compared with all others, in
    blocks of BLOCK_NODES each side, by their bounds in one matrix; only the pairs that the bound
    leaves become rows. A set whose nodes are all connected costs nothing.
    """
    placed = nodes.select("grp", "node", "n", "classes")
    placed = placed.withColumn("root", F.col("node")) if roots is None else placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = cut_lineage(placed)
    several = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("grp")
    flat = groups.union(groups.select(F.col("b").alias("a"), F.col("a").alias("b")))
    shared = found.where("kind > 0").select(F.col("a").alias("of"), F.col("b").alias("grp")).union(
        flat.join(several, F.col("a") == F.col("grp"), "left_semi").select(F.xxhash64("a").alias("of"), F.col("b").alias("grp"))).union(
        several.select(F.xxhash64("grp").alias("of"), "grp"))
    held = cut_lineage(shared.distinct().join(placed.select("grp", "node", "root"), "grp").select("of", "node", "root"))
    sizes = held.groupBy("of", "root").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x")).groupBy("of").agg(
        F.max_by("root", F.struct("c", "root")).alias("main"), F.count(F.lit(1)).alias("k"), F.sum("c").alias("all"),
        F.max("c").alias("most"), F.bit_xor("x").alias("x")).where("k > 1")
    # sets of the same nodes once
    sizes = cut_lineage(sizes.groupBy("x", "all").agg(F.min(F.struct("of", "main", "most")).alias("s")).select(
        "s.of", "s.main", F.ceil(F.col("all") / BLOCK_NODES).cast("long").alias("tall"),
        F.ceil((F.col("all") - F.col("s.most")) / BLOCK_NODES).cast("long").alias("wide")))
    # a pair that shares several sets is compared in the first of them only
    chosen = held.join(sizes, "of")
    lists = chosen.groupBy("node").agg(F.collect_set("of").alias("sets"))  # no longer than a prefix
    rows = chosen.withColumn("out", F.col("root") != F.col("main")).join(lists, "node").join(placed.select("node", "n", "classes"), "node")
    rows = rows.withColumn("sets", F.filter("sets", lambda x: x < F.col("of")))
    columns = ["of", "row", "col", "node", "root", "out", "n", "classes", "sets"]
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    left = rows.where("out").withColumn("row", F.pmod(F.xxhash64("node"), "wide")).withColumn("col", every("tall"))
    right = rows.withColumn("col", F.pmod(F.xxhash64("node"), "tall")).withColumn("row", every("wide"))
    left, right = (side.select(*[F.col(c).alias(c) for c in columns]) for side in (left, right))

    def compare(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(a) or not len(b):
            return out
        na, nb = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None, :]
        full = b"\xff" * CLASSES  # unknown counts bound nothing
        x, y = (np.stack([np.frombuffer(c or full, np.uint8) for c in t["classes"]]) for t in (a, b))
        unknown = a["classes"].isna().to_numpy()[:, None] | b["classes"].isna().to_numpy()[None, :]
        most = np.minimum(np.minimum(na, nb), np.where(unknown, 1 << 62, _bound_matrix(x, y)))
        keep = fits(np.minimum(na, nb), np.maximum(na, nb)) & linked(most, na, nb)
        keep &= a["root"].to_numpy()[:, None] != b["root"].to_numpy()[None, :]
        ids, others = a["node"].to_numpy(), b["node"].to_numpy()
        keep &= ~b["out"].to_numpy()[None, :] | (ids[:, None] < others[None, :])
        i, j = np.nonzero(keep)
        before, earlier = ([frozenset(x.tolist()) for x in t["sets"]] for t in (a, b))
        new = np.array([before[x].isdisjoint(earlier[y]) for x, y in zip(i.tolist(), j.tolist())], dtype=bool)
        return pd.DataFrame({"a": ids[i[new]], "b": others[j[new]]})

    pairs = left.groupBy("of", "row", "col").cogroup(right.groupBy("of", "row", "col")).applyInPandas(compare, "a bigint, b bigint")
    return _ordered(pairs)


def _rooted(docs: DataFrame) -> DataFrame:
    facts, roots = jaccard_links(docs)
    if roots is None:
        return facts.withColumn("root", F.col("node"))
    return facts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def link_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every document.

    A text without words has no shingles and is alone. Null ids: the component's smallest id that
    is not null, or null. Rows that repeat an id with other texts are documents of their own.
    """
    placed = _rooted(docs)
    least = placed.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id (null ids last).

    Texts without words are alone, so all of them stay. Of repeated rows (equal id and text) one
    stays. The rows to drop are found by id and text hash; documents move only if there are more of
    those than may be broadcast, and the few repeated ones to drop repetitions.
    """
    placed = cut_lineage(_rooted(docs).where("root is not null").select("doc_id", "tid", "root"))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")
    keepers = placed.groupBy("root").agg(F.min(key).alias("k"))
    other = (F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("tid") == F.col("k.tid")))
    dropped = cut_lineage(placed.join(keepers, "root").where(~other).select("doc_id", "tid").distinct())
    twice = cut_lineage(placed.groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "tid"))

    taken = {c.lower() for c in docs.columns}
    key_id, key_text = (next(n for i in itertools.count() if (n := f"_{c}{i}") not in taken) for c in ("id", "tid"))

    def matching(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        side = keys.select(F.col("doc_id").alias(key_id), F.col("tid").alias(key_text))
        if keys.count() <= PICK_ROWS:
            side = F.broadcast(side)
        text_hash = F.xxhash64(F.col("text").cast("string"))
        return rows.join(side, F.col("doc_id").cast("bigint").eqNullSafe(F.col(key_id)) & (text_hash == F.col(key_text)), how)

    kept = matching(docs, dropped, "left_anti")
    if twice.isEmpty():
        return kept
    return matching(kept, twice, "left_anti").union(matching(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
