"""Approximate nearest neighbours by cosine: inverted lists and an adaptive dimension scan.

Vectors are scaled to unit length and rotated at random, so that the first dimensions of a
difference tell about all of it. Within each probed list the distance to the query is summed block
of columns by block of columns; after each block a hypothesis test on the partial distance drops
the candidates that hardly can come under the query's current fifth-best. What survives is scored
exactly, in double precision, on the original vectors.

Equal vectors are searched as one: of their ids only the few smallest can be among the nearest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.session import cut_lineage

SEED = 7
#: Vectors that the lists are fitted on, at most; queries of the sample that set the probes.
SAMPLE = 20_000
SAMPLE_QUERIES = 400
#: Vectors of a list, as far as the sample allows (16 sampled vectors a list at least).
LIST_ROWS = 512
#: Share of the sample's true neighbours that the probed lists must hold.
TARGET = 0.985
GROUP_ROWS = 2048
GROUP_QUERIES = 2048
BLOCK = 16
#: Width of the test, in standard deviations of the partial distance.
WIDTH = 2.1


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]


def fit_centres(sample: np.ndarray, lists: int, passes: int = 8, seed: int = SEED) -> np.ndarray:
    """Spherical k-means; an empty list takes the vector that fits its own list worst."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(passes):
        best, fit = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, best, sample)
        empty = np.flatnonzero(np.bincount(best, minlength=lists) == 0)
        sums[empty] = sample[np.argsort(fit)[:empty.size]]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centres)
    return centres[np.argsort(centres @ np.linalg.svd(centres - centres.mean(0), full_matrices=False)[2][0])]


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    best, fit = np.empty(len(x), dtype=np.int64), np.empty(len(x))
    for low in range(0, len(x), 2048):
        dots = x[low:low + 2048] @ centres.T
        best[low:low + 2048] = dots.argmax(1)
        fit[low:low + 2048] = dots.max(1)
    return best, fit


def probes_needed(sample: np.ndarray, centres: np.ndarray, k: int, target: float = TARGET) -> int:
    """Lists to probe so that, in the sample, they hold the target share of true neighbours."""
    queries = sample[:SAMPLE_QUERIES]
    owner, _ = _nearest(sample, centres)
    ranks = []
    for low in range(0, len(queries), 64):
        part = queries[low:low + 64]
        dots = part @ sample.T
        dots[np.arange(len(part)), np.arange(low, low + len(part))] = -2
        near = np.argpartition(-dots, min(k, dots.shape[1] - 1), axis=1)[:, :k]
        order = np.argsort(np.argsort(-(part @ centres.T), axis=1), axis=1)
        ranks.append(np.take_along_axis(order, owner[near], axis=1).ravel())
    return int(np.quantile(np.concatenate(ranks), target)) + 1 if ranks else 1


def adaptive_scan(query: np.ndarray, rows: np.ndarray, bounds: list[tuple[int, int]], k: int, block: int = BLOCK, width: float = WIDTH) -> np.ndarray:
    """Indices of rows that may be among the k nearest of a rotated unit query.

    `bounds` are the (first, last + 1) rows of the probed lists, nearest list first. Ties with the
    k-th distance stay in.
    """
    dim = query.size
    found, distances = np.zeros(0, dtype=np.int64), np.zeros(0)
    limit = np.inf
    for low, high in bounds:
        alive = np.arange(low, high)
        partial = np.zeros(high - low)
        for start in range(0, dim, block):
            stop = min(dim, start + block)
            part = rows[alive, start:stop] - query[start:stop]
            partial += np.einsum("ij,ij->i", part, part)
            if stop < dim and np.isfinite(limit):
                keep = partial * (dim / stop) <= limit * (1 + width / np.sqrt(stop)) ** 2
                alive, partial = alive[keep], partial[keep]
                if not alive.size:
                    break
        keep = partial <= limit + 1e-6
        found, distances = np.concatenate([found, alive[keep]]), np.concatenate([distances, partial[keep]])
        if found.size > k:
            limit = np.partition(distances, k - 1)[k - 1]
            keep = distances <= limit + 1e-6
            found, distances = found[keep], distances[keep]
    return found


def usable(vector):
    """Column: a vector with finite components, not all zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(wide, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def nearest(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where `is_query` holds,
    among all rows but itself.

    Rows without id, and unusable vectors (null, zero, with null or non-finite components, or of
    another length than most) take no part. Equal rows count once; rows that share an id but not
    the vector are one query each, and never each other's neighbours. Lists are fitted on a bounded
    sample, every row is indexed. A group of rows that one task scans is bounded on both sides: a
    list with many rows is split, and so are its queries. How many lists are probed follows from
    the sample; on vectors without any clusters it is a large part of them.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(column).alias("v"), is_query.alias("asked"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = sizes[0].dim if sizes else 1
    rows = rows.where(F.size("v") == dim).withColumn("uid", F.xxhash64("v"))
    first = Window.partitionBy("uid", "v").orderBy("vec_id")
    distinct = cut_lineage(
        rows.select("uid", "v", "vec_id").withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
        .groupBy("uid", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")))
    asked = rows.where(F.coalesce(F.col("asked"), F.lit(False))).select(F.col("vec_id").alias("query_id"), "uid").distinct()
    n = distinct.count()

    turn = rotation(dim)
    sample = distinct.orderBy(F.xxhash64("uid", F.lit(SEED)), "uid").limit(SAMPLE).select("v").toPandas()["v"]
    sampled = unit(_matrix(sample)) @ turn if len(sample) else np.zeros((0, dim))
    lists = max(1, min(n // LIST_ROWS, len(sample) // 16))
    centres = fit_centres(sampled, lists) if len(sample) > 1 else np.ones((1, dim))
    probed = probes_needed(sampled, centres, k) if lists > 1 else 1
    dtype = distinct.schema["v"].dataType.simpleString()

    def assign(batches):
        for batch in batches:
            v = batch.column(1)
            owner, _ = _nearest(unit(v.flatten().to_numpy().astype(np.float64).reshape(-1, dim)) @ turn, centres)
            yield pa.RecordBatch.from_arrays([pa.array(owner), *batch.columns], names=["list", "uid", "v", "ids"])

    indexed = cut_lineage(distinct.mapInArrow(assign, f"list bigint, uid bigint, v {dtype}, ids array<bigint>"))
    counts = np.zeros(lists, dtype=np.int64)
    for row in indexed.groupBy("list").count().collect():  # at most SAMPLE / 16 rows
        counts[row["list"]] = row["count"]
    # neighbouring lists share a group up to GROUP_ROWS rows; a larger list has groups of its own
    group_of, parts, at, room = np.zeros(lists, dtype=np.int64), np.ones(lists, dtype=np.int64), -1, 0
    for i, c in enumerate(counts.tolist()):
        if c > GROUP_ROWS:
            parts[i] = -(-c // GROUP_ROWS)
            group_of[i], at, room = at + 1, at + int(parts[i]), 0
        else:
            if c > room:
                at, room = at + 1, GROUP_ROWS
            group_of[i], room = max(at, 0), room - c
    table = F.array(*[F.struct(F.lit(int(g)).alias("g"), F.lit(int(p)).alias("p")) for g, p in zip(group_of, parts)])
    here = F.element_at(table, F.col("list").cast("int") + 1)
    placed = indexed.withColumn("grp", here["g"] + F.pmod(F.xxhash64("uid", F.lit(1)), here["p"]))

    def probe(batches):
        for batch in batches:
            q = unit(batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim)) @ turn
            near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probed]
            who, groups = [], []
            for i, mine in enumerate(near):
                for g in {int(group_of[c]) + p for c in mine for p in range(int(parts[c]))}:
                    who.append(i)
                    groups.append(g)
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int64()), batch.column(0).take(pa.array(who, pa.int64())), batch.column(1).take(pa.array(who, pa.int64()))], names=["grp", "uid", "v"])

    queries = distinct.join(asked.select("uid").distinct(), "uid", "left_semi").select("uid", "v")
    sent = cut_lineage(queries.mapInArrow(probe, f"grp bigint, uid bigint, v {dtype}"))
    load = sent.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("long").alias("splits"))
    left = placed.join(load, "grp").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))).select("grp", "part", "list", "uid", "v", "ids")
    right = sent.join(load, "grp").withColumn("part", F.pmod(F.xxhash64("uid", F.lit(2)), F.col("splits"))).select("grp", "part", "uid", "v")

    def scan(key, data: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(data) and len(asks):
            data = data.sort_values(["list", "uid"], kind="stable")
            owner = data["list"].to_numpy()
            original = _matrix(data["v"])
            norms = np.linalg.norm(original, axis=1)
            turned = (original / norms[:, None]) @ turn
            held = data["ids"].to_list()
            asked_for = _matrix(asks["v"])
            lengths = np.linalg.norm(asked_for, axis=1)
            q = (asked_for / lengths[:, None]) @ turn
            present = np.unique(owner)
            starts, stops = np.searchsorted(owner, present, "left"), np.searchsorted(owner, present, "right")
            span = dict(zip(present.tolist(), zip(starts.tolist(), stops.tolist())))
            near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probed]
            for i, uid in enumerate(asks["uid"].to_list()):
                bounds = [span[c] for c in near[i].tolist() if c in span]
                found = adaptive_scan(q[i], turned, bounds, k + 1)
                score = original[found] @ asked_for[i] / (norms[found] * lengths[i])
                best = sorted((-s, x) for s, f in zip(score.tolist(), found.tolist()) for x in held[f])[:k + 1]
                out += [(uid, x, -s) for s, x in best]
        return pd.DataFrame(out, columns=["uid", "vec_id", "score"])

    found = left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part")).applyInPandas(scan, "uid bigint, vec_id bigint, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    merged = found.withColumn("n", F.row_number().over(Window.partitionBy("uid").orderBy(*order))).where(F.col("n") <= k + 1)
    own = asked.join(merged.select("uid", "vec_id", "score"), "uid").where(F.col("vec_id") != F.col("query_id"))
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "uid").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
