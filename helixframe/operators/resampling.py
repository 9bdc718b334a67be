"""Bootstrap, paired bootstrap and permutation tests that never multiply the shuffled rows.

* Rows collapse to cells (label and score combinations with a count) before anything is drawn.
* A Poisson bootstrap is used: every row would get weight Poisson(1), so a cell of n rows gets
  Poisson(n). The draw is a function of (seed, replicate, cell), hence independent of the
  partitioning, of task retries, and shared by paired scores.
* Replicates live inside the tasks as numpy columns. Cells are grouped into score blocks of
  bounded size; what leaves a block is a few sums per replicate.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.scores import clip_prob
from helixframe.operators.metrics import matthews, ranking_metrics, rate, score_cells
from helixframe.operators.ordered import block_cuts, running_sums, with_block
from helixframe.session import cut_lineage

PRIME = 2**31 - 1
BLOCK_CELLS = 250_000
DRAWS_AT_ONCE = 4_000_000
METRICS = ("roc_auc", "pr_auc", "f1", "brier_loss", "mcc", "precision", "recall")


# ---- shared random numbers ------------------------------------------------------------------

def cell_hash(*parts: Column) -> dict[str, Column]:
    """Two 31-bit numbers of a cell, from the md5 of its text form."""
    digest = F.md5(F.concat_ws(":", *parts))

    def piece(start):
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint") % PRIME

    return {"h1": piece(1), "h2": piece(9)}


def score_text(c: Column) -> Column:
    """Engine-neutral text of a score: nine decimals as an integer, then seven more of the rest, so
    that scores that differ within double precision draw on their own."""
    whole = F.round(c * 1e9)
    return F.concat_ws(".", whole.try_cast("decimal(38,0)").cast("string"), F.round((c * 1e9 - whole) * 1e7).cast("bigint").cast("string"))


def coefficients(seed: int, replicates: int) -> np.ndarray:
    """Five hash coefficients per replicate, from md5 of `seed:replicate`."""
    out = np.empty((replicates, 5), dtype=np.int64)
    for r in range(replicates):
        digest = hashlib.md5(f"{seed}:{r}".encode()).hexdigest()
        extra = hashlib.md5(f"{seed}:{r}:e".encode()).hexdigest()
        out[r] = [int(digest[i : i + 8], 16) % PRIME for i in (0, 8, 16, 24)] + [
            int(extra[:8], 16) % PRIME
        ]
    return out


def uniform_ints(h1: np.ndarray, h2: np.ndarray, coef: np.ndarray) -> np.ndarray:
    """(cells x replicates) integers below PRIME: a cubic polynomial hash modulo a prime."""
    a, b, c, d, e = (coef[:, i][None, :] for i in range(5))
    x, z = h1[:, None], h2[:, None]
    v = (a * x + b) % PRIME
    v = (v * x + c) % PRIME
    v = (v * x + d) % PRIME
    return (v + (e * z) % PRIME) % PRIME


_LOG_FACTORIALS = np.array([math.lgamma(k + 1.0) for k in range(257)])


def log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k!, from a table for small k and Stirling's series (error below 1e-15) beyond."""
    x = np.maximum(k, 256).astype(np.float64)
    series = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(k <= 256, _LOG_FACTORIALS[np.minimum(k, 256)], series)


def poisson_draws(counts: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Inverse-CDF Poisson(count) per row of `u`, at any count: the mass beyond 12 standard
    deviations is below double precision."""
    out = np.empty(u.shape, dtype=np.float64)
    for n in np.unique(counts):
        rows = counts == n
        reach = int(12 * math.sqrt(n)) + 40
        k = np.arange(max(0, int(n) - reach), int(n) + reach + 1)
        cdf = np.cumsum(np.exp(k * math.log(n) - n - log_factorial(k)))
        out[rows] = k[0] + np.searchsorted(cdf, u[rows], side="left")
    return out


def _weights(pdf: pd.DataFrame, coef: np.ndarray) -> np.ndarray:
    v = uniform_ints(pdf["h1"].to_numpy(np.int64), pdf["h2"].to_numpy(np.int64), coef)
    return poisson_draws(pdf["n"].to_numpy(np.int64), (v + 0.5) / PRIME)


# ---- cells and blocks -----------------------------------------------------------------------

def _tracks(df: DataFrame, y: str, scores: dict[str, str], groups: Sequence[str], count: str | None = None) -> DataFrame:
    """Long cells (groups, track, score, y, n, h1, h2); every track of a cell shares h1, h2. A row stands for as
    many as its column `count` says."""
    present = F.col(y).isNotNull()
    for c in scores.values():
        present = present & F.col(c).isNotNull()
    cols = {f"s_{t}": F.col(c).cast("double") for t, c in scores.items()}
    cells = (
        df.filter(present)
        .select(
            *groups, F.col(y).cast("int").alias("y"), *[e.alias(n) for n, e in cols.items()],
            (F.lit(1) if count is None else F.col(count)).cast("bigint").alias("n"))
        .groupBy(*groups, "y", *cols)
        .agg(F.sum("n").alias("n"))
    )
    cells = cells.withColumns(
        cell_hash(F.col("y").cast("string"), *[score_text(F.col(c)) for c in cols])
    )
    each = F.array(
        *[F.struct(F.lit(t).alias("track"), F.col(f"s_{t}").alias("score")) for t in scores]
    )
    return cells.select(*groups, "y", "n", "h1", "h2", F.explode(each).alias("t")).select(
        *groups, "t.track", "t.score", "y", "n", "h1", "h2"
    )


def _block_sums(pdf: pd.DataFrame, coef: np.ndarray, threshold: float, above=None):
    """Per-replicate sums of one block; `above` holds weights of higher-scored blocks."""
    pdf = pdf.sort_values("score", kind="stable")
    score = pdf["score"].to_numpy(float)
    y = pdf["y"].to_numpy(int)
    starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    level = score[starts]
    step = max(1, DRAWS_AT_ONCE // max(1, len(pdf)))
    parts = []
    for lo in range(0, len(coef), step):
        w = _weights(pdf, coef[lo : lo + step])
        wp = np.add.reduceat(w * (y == 1)[:, None], starts, axis=0)
        wn = np.add.reduceat(w * (y == 0)[:, None], starts, axis=0)
        below = np.cumsum(wn, axis=0) - wn
        tp = np.cumsum(wp[::-1], axis=0)[::-1]
        fp = np.cumsum(wn[::-1], axis=0)[::-1]
        if above is not None:
            tp = tp + above[0][None, lo : lo + step]
            fp = fp + above[1][None, lo : lo + step]
        seen = tp + fp
        call = (level >= threshold)[:, None]
        parts.append(
            pd.DataFrame(
                {
                    "rep": np.arange(lo, lo + w.shape[1]),
                    "wp": wp.sum(0),
                    "wn": wn.sum(0),
                    "u": (wp * (below + wn / 2)).sum(0),
                    "ap": np.divide(wp * tp, seen, out=np.zeros_like(seen), where=seen > 0).sum(0),
                    "tp": (wp * call).sum(0),
                    "fp": (wn * call).sum(0),
                    "br": (wp * ((1 - level) ** 2)[:, None] + wn * (level**2)[:, None]).sum(0),
                }
            )
        )
    return pd.concat(parts, ignore_index=True)


SUMS = ("wp", "wn", "u", "ap", "tp", "fp", "br")


def replicate_metrics(
    df: DataFrame,
    y: str,
    scores: dict[str, str],
    groups: Sequence[str] = (),
    replicates: int = 1000,
    seed: int = 42,
    threshold: float = 0.5,
    block_cells: int = BLOCK_CELLS,
    salts: int = 64,
    count: str | None = None,
) -> DataFrame:
    """All metrics per (groups, track, rep) over shared resamples; single-class ones dropped. `count` names a
    column of how many rows a row stands for."""
    groups = list(groups)
    keys = [*groups, "track"]
    coef = coefficients(seed, replicates)
    # the cells are counted, cut into blocks and drawn from twice: write them once
    tracks = cut_lineage(_tracks(df, y, scores, groups, count))
    splits, hot = block_cuts(tracks, "score", block_cells)
    tracks = with_block(tracks, "score", splits)
    is_hot = F.col("score").isin(*hot) if hot else F.lit(False)
    tracks = tracks.withColumns(
        {"single": is_hot, "salt": F.when(is_hot, F.col("h1") % salts).otherwise(0)}
    )
    shape = tracks.select(*keys, "_block", "single").schema
    schema = shape.simpleString()[7:-1] + ", rep int, " + ", ".join(f"{s} double" for s in SUMS)
    lead = [*keys, "_block", "single"]

    def first_pass(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _block_sums(pdf, coef, threshold)
        for c in reversed(lead):
            out.insert(0, c, pdf[c].iloc[0])
        return out

    sums = tracks.groupBy(*lead, "salt").applyInPandas(first_pass, schema)
    if not splits:
        per_rep = sums.select(*keys, "rep", *SUMS)
    else:
        merged = sums.groupBy(*lead, "rep").agg(*[F.sum(s).alias(s) for s in SUMS])
        merged = merged.withColumn(
            "u", F.when(F.col("single"), F.col("wp") * F.col("wn") / 2).otherwise(F.col("u"))
        )
        over = W.partitionBy(*keys, "rep")
        lower = over.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        higher = over.orderBy(F.col("_block").desc()).rowsBetween(W.unboundedPreceding, -1)
        placed = merged.withColumns(
            {
                "below": F.coalesce(F.sum("wn").over(lower), F.lit(0.0)),
                "tp_above": F.coalesce(F.sum("wp").over(higher), F.lit(0.0)),
                "fp_above": F.coalesce(F.sum("wn").over(higher), F.lit(0.0)),
            }
        )
        totals = placed.groupBy(*keys, "rep").agg(
            F.sum("wp").alias("wp"),
            F.sum("wn").alias("wn"),
            F.sum(F.col("u") + F.col("wp") * F.col("below")).alias("u"),
            F.sum("tp").alias("tp"),
            F.sum("fp").alias("fp"),
            F.sum("br").alias("br"),
        )
        # average precision is not additive: a second pass with the weights above each block
        tp_all = F.col("tp_above") + F.col("wp")
        hot_ap = placed.filter("single").select(
            *keys, "rep",
            F.coalesce(
                F.try_divide(F.col("wp") * tp_all, tp_all + F.col("fp_above") + F.col("wn")), F.lit(0.0)
            ).alias("ap"),
        )
        above = placed.filter(~F.col("single")).select(*keys, "_block", "rep", "tp_above", "fp_above")
        ap_schema = tracks.select(*keys).schema.simpleString()[7:-1] + ", rep int, ap double"

        def second_pass(cells: pd.DataFrame, offsets: pd.DataFrame) -> pd.DataFrame:
            offsets = offsets.sort_values("rep")
            out = _block_sums(
                cells, coef, threshold,
                (offsets["tp_above"].to_numpy(float), offsets["fp_above"].to_numpy(float)),
            )[["rep", "ap"]]
            for c in reversed(keys):
                out.insert(0, c, cells[c].iloc[0])
            return out

        cool_ap = (
            tracks.filter(~F.col("single")).groupBy(*keys, "_block")
            .cogroup(above.groupBy(*keys, "_block"))
            .applyInPandas(second_pass, ap_schema)
        )
        ap = hot_ap.unionByName(cool_ap).groupBy(*keys, "rep").agg(F.sum("ap").alias("ap"))
        per_rep = totals.join(ap, [*keys, "rep"])

    p, q, tp, fp = F.col("wp"), F.col("wn"), F.col("tp"), F.col("fp")
    return per_rep.filter((p > 0) & (q > 0)).select(
        *keys, "rep",
        (F.col("u") / (p * q)).alias("roc_auc"),
        (F.col("ap") / p).alias("pr_auc"),
        rate(2 * tp, tp + fp + p).alias("f1"),
        (F.col("br") / (p + q)).alias("brier_loss"),
        matthews(tp, fp, p - tp, q - fp).alias("mcc"),
        rate(tp, tp + fp).alias("precision"),
        rate(tp, p).alias("recall"),
    )


def bootstrap_metrics(
    df, y="y", score="p", groups=(), replicates=1000, seed=42, threshold=0.5, ci=0.95, **more
) -> DataFrame:
    """Mean, median, percentile interval, std and effective replicates for seven metrics."""
    clipped = df.withColumn("_p", clip_prob(F.col(score)))
    reps = replicate_metrics(clipped, y, {"p": "_p"}, groups, replicates, seed, threshold, **more)
    long = reps.unpivot([*groups, "rep"], list(METRICS), "metric", "value")
    return summarize(long, [*groups, "metric"], "value", ci)


def summarize(long: DataFrame, keys: Sequence[str], value: str, ci=0.95) -> DataFrame:
    """Summary over replicates; each group holds at most `replicates` values."""
    low = (1.0 - ci) / 2.0
    return long.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, 0.5).alias("median"),
        F.percentile(value, low).alias("ci_lo"),
        F.percentile(value, 1.0 - low).alias("ci_hi"),
        F.stddev_samp(value).alias("std"),
        F.count(value).alias("n_effective"),
    )


def paired_bootstrap_delta(
    df, y="y", score_a="p_a", score_b="p_b", groups=(), replicates=1000, seed=42,
    alternative="two-sided", metrics=("roc_auc", "pr_auc"), count=None, **more
) -> DataFrame:
    """metric(a) - metric(b) on shared resamples: point, mean, interval, p-value.

    `alternative`: `two-sided` is 2 min(P[d<=0], P[d>=0]); `two-sided-complement` is
    2 min(P[d>=0], 1 - P[d>=0]); `greater` is P[d<=0].
    """
    groups = list(groups)
    reps = replicate_metrics(df, y, {"a": score_a, "b": score_b}, groups, replicates, seed, count=count, **more)

    def of(track, metric):
        return F.max(F.when(F.col("track") == track, F.col(metric)))

    deltas = reps.groupBy(*groups, "rep").agg(
        *[(of("a", m) - of("b", m)).alias(m) for m in metrics]
    )
    long = deltas.unpivot([*groups, "rep"], list(metrics), "metric", "delta")
    le = F.avg((F.col("delta") <= 0).cast("double"))
    ge = F.avg((F.col("delta") >= 0).cast("double"))
    p_value = {
        "two-sided": 2 * F.least(le, ge),
        "two-sided-complement": 2 * F.least(ge, 1 - ge),
        "greater": le,
    }[alternative]
    boot = long.groupBy(*groups, "metric").agg(
        F.avg("delta").alias("boot_mean_delta"),
        F.percentile("delta", 0.025).alias("ci_lo"),
        F.percentile("delta", 0.975).alias("ci_hi"),
        p_value.alias("p_value"),
        F.count("delta").alias("n_boot_used"),
    ).withColumn("n_boot_skipped", F.lit(replicates) - F.col("n_boot_used"))
    both = df.filter(F.col(score_a).isNotNull() & F.col(score_b).isNotNull())
    a = ranking_metrics(both, y, score_a, groups, count=count)
    b = ranking_metrics(both, y, score_b, groups, count=count)
    on = groups or F.lit(True)
    b = b.select(*groups, *[F.col(m).alias(f"b_{m}") for m in metrics])
    points = a.join(b, on).select(
        *groups, F.col("n").alias("n_samples"),
        *[F.struct(F.col(m).alias("estimate_a"), F.col(f"b_{m}").alias("estimate_b")).alias(m) for m in metrics],
    ).unpivot([*groups, "n_samples"], list(metrics), "metric", "e")
    points = points.select(
        *groups, "metric", "n_samples", "e.estimate_a", "e.estimate_b",
        (F.col("e.estimate_a") - F.col("e.estimate_b")).alias("delta"),
    )
    return points.join(boot, [*groups, "metric"])


# ---- permutation ----------------------------------------------------------------------------

#: Distinct scores that a task deals positives to, and tasks that share a small table's replicates.
DEAL_CELLS = 4096
DEAL_TASKS = 32
DEAL_PARTS = 10_000
#: Standard deviations of a split that are tabulated; the uniform numbers have 31 bits and reach 6.3 of them.
REACH = 7


def split_counts(left: int, right: int, m: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many of m positives fall among the `left` of left + right rows: inverse of the hypergeometric
    distribution at u, one for each replicate. The masses follow from the ratios of neighbours."""
    if left == 0 or right == 0:
        return m if right == 0 else np.zeros_like(m)
    total = left + right
    mean = m * (left / total)
    sd = np.sqrt(np.maximum(mean * (right / total) * ((total - m) / max(total - 1, 1)), 0.0))
    low = np.maximum(np.maximum(0, m - right), np.floor(mean - REACH * sd - 10).astype(np.int64))
    high = np.minimum(np.minimum(m, left), np.ceil(mean + REACH * sd + 10).astype(np.int64))
    k = (low[:, None] + np.arange(int((high - low).max(initial=0)))[None, :]).astype(np.float64)
    held = m[:, None].astype(np.float64)
    ratio = np.maximum(left - k, 0) * np.maximum(held - k, 0) / ((k + 1) * np.maximum(right - held + k + 1, 1))
    ratio[k >= high[:, None]] = 0.0
    mass = np.cumprod(np.concatenate([np.ones((len(m), 1)), ratio], axis=1), axis=1)
    below = np.cumsum(mass, axis=1)
    return low + (below < (u * below[:, -1])[:, None]).sum(axis=1)


def node_start(k: int, depth: int, cells: int) -> int:
    """First cell of the k-th node of a depth of the splitting tree."""
    return k * cells >> depth


def deal(node: tuple[int, int], stop: int, cells: int, before, m: np.ndarray, coef: np.ndarray):
    """Splits m positives (one number for each replicate) from a node (depth, k) down to depth `stop`, or to single cells;
    yields ((depth, k), positives). `before(i)` is the number of rows ahead of cell i. A node's draw depends
    on the replicate and the node only, so the outcome does not depend on where the tree is cut."""
    open_nodes = [(node, m)]
    while open_nodes:
        (depth, k), m = open_nodes.pop()
        low, high = node_start(k, depth, cells), node_start(k + 1, depth, cells)
        if low == high:
            continue
        if depth == stop or high - low == 1:
            yield (depth, k), m
            continue
        middle = node_start(2 * k + 1, depth + 1, cells)
        digest = hashlib.md5(str((1 << depth) + k).encode()).hexdigest()
        h1, h2 = (np.array([int(digest[i:i + 8], 16) % PRIME]) for i in (0, 8))
        left = split_counts(before(middle) - before(low), before(high) - before(middle), m, (uniform_ints(h1, h2, coef)[0] + 0.5) / PRIME)
        open_nodes += [((depth + 1, 2 * k), left), ((depth + 1, 2 * k + 1), m - left)]


def permuted_rank_sums(cells: DataFrame, n_cells: int, m: int, replicates: int, seed: int) -> DataFrame:
    """rep and the rank sum of m positives that are dealt to the cells (i, n, n_before, mid), one row for each
    replicate.

    A binary tree over the cells in order of score deals the positives: those of a node are split between
    its halves by a hypergeometric draw. The tree is cut into blocks of DEAL_CELLS cells; a first pass
    deals to blocks, a second inside them, so the cost is scores x replicates, not rows x replicates. Only
    block sizes reach the driver, one number for DEAL_CELLS scores.
    """
    depth = max(0, math.ceil(math.log2(max(1, n_cells) / DEAL_CELLS)))
    blocks = 1 << depth
    chunks = max(1, DEAL_TASKS // blocks)
    coef = coefficients(seed, replicates)
    block = F.floor(((F.col("i") + 1) * blocks - 1) / F.lit(n_cells)).cast("bigint") if blocks > 1 else F.lit(0).cast("bigint")
    placed = cells.withColumn("block", block)
    firsts = {r["block"]: r["first"] for r in placed.groupBy("block").agg(F.min("n_before").alias("first")).collect()} if blocks > 1 else {0: 0}
    starts = [0, *[firsts.get(b) for b in range(1, blocks)]]

    def to_blocks(batches):
        # rows ahead of a node that begins a block; what is asked for are starts of blocks and the end
        ends = {node_start(b, depth, n_cells): s for b, s in enumerate(starts) if s is not None}
        for pdf in batches:
            for chunk in pdf["id"]:
                reps = np.arange(chunk, replicates, tasks)
                for (d, k), got in deal((0, 0), depth, n_cells, lambda i: ends.get(i, n_rows), np.full(len(reps), m), coef[reps]):
                    yield pd.DataFrame({"block": k << (depth - d), "chunk": reps % chunks, "rep": reps, "m": got})

    def inside(key, part: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(dealt):
            return pd.DataFrame({"rep": pd.Series(dtype="int64"), "rank_sum": pd.Series(dtype="float64")})
        part = part.sort_values("i")
        first, ahead, mid = int(part["i"].iloc[0]), np.append(part["n_before"], part["n_before"].iloc[-1] + part["n"].iloc[-1]), part["mid"].to_numpy()
        reps, total = dealt["rep"].to_numpy(), np.zeros(len(dealt))
        for (d, k), got in deal((depth, int(key[0])), 1 << 62, n_cells, lambda i: int(ahead[i - first]), dealt["m"].to_numpy(np.int64), coef[reps]):
            total += got * mid[node_start(k, d, n_cells) - first]
        return pd.DataFrame({"rep": reps, "rank_sum": total})

    n_rows = int(cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    tasks = min(DEAL_TASKS, max(1, replicates))
    dealt = cells.sparkSession.range(0, tasks, 1, tasks).mapInPandas(to_blocks, "block bigint, chunk bigint, rep bigint, m bigint")
    spread = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))))
    # few bytes and much work: a stated number of partitions is not coalesced
    parts = min(2 * blocks * chunks, DEAL_PARTS)
    left, right = (rows.repartition(parts, "block", "chunk").groupBy("block", "chunk") for rows in (spread, dealt))
    sums = left.cogroup(right).applyInPandas(inside, "rep bigint, rank_sum double")
    return sums.groupBy("rep").agg(F.sum("rank_sum").alias("rank_sum"))


def permutation_auc_test(df, y="y", score="p", replicates=10_000, seed=42) -> DataFrame:
    """One-sided label-permutation test of AUC > 0.5, one row.

    A permutation of the labels matters only by how many positives each distinct score gets, so these
    counts are drawn, exactly as often as shuffled labels would give them (see `permuted_rank_sums`).
    """
    present = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    counted = score_cells(present, y, score).select("score", (F.col("pos") + F.col("neg")).alias("n"), "pos", F.lit(1).cast("bigint").alias("one"))
    ranked = running_sums(counted, "score", ["n", "one"])
    cells = cut_lineage(ranked.select(
        F.col("one_before").cast("bigint").alias("i"), "n", F.col("n_before").cast("bigint").alias("n_before"), "pos",
        (F.col("n_before") + (F.col("n") + 1) / 2).cast("double").alias("mid")))
    stats = cells.agg(
        F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("m"),
        F.sum(F.col("pos") * F.col("mid")).alias("s")).first()
    n, m, observed = stats["n"], stats["m"], stats["s"]
    per_rep = permuted_rank_sums(cells, stats["cells"], m, replicates, seed)
    scale = float(m) * float(n - m)
    shift = m * (m + 1) / 2.0
    auc = (observed - shift) / scale if scale else None
    return per_rep.agg(
        F.lit(auc).cast("double").alias("auc"),
        F.avg(((F.col("rank_sum") - shift) / scale if scale else F.lit(None)) .cast("double")).alias("null_mean"),
        F.avg((F.col("rank_sum") >= F.lit(observed)).cast("double")).alias("p_value"),
        F.count(F.lit(1)).alias("n_permutations"),
        F.lit(n).cast("bigint").alias("n"),
        F.lit(m).cast("bigint").alias("n_pos"),
    )


def auc_significance(
    df, slices: dict[str, object], y="y", score="p", replicates=10_000, draws=1000, seed=42, ci=0.95
) -> DataFrame:
    """Permutation test and bootstrap interval of the AUC for each slice (condition, or True for all
    rows): one row per slice."""
    out = None
    for name, condition in slices.items():
        rows = df if condition is True else df.filter(condition)
        test = permutation_auc_test(rows, y, score, replicates, seed)
        reps = replicate_metrics(rows, y, {"p": score}, (), draws, seed)
        low = (1.0 - ci) / 2.0
        interval = reps.agg(
            F.percentile("roc_auc", low).alias("ci_lo"), F.percentile("roc_auc", 1.0 - low).alias("ci_hi"), F.count("roc_auc").alias("n_boot")
        )
        one = test.join(interval, F.lit(True)).select(F.lit(name).alias("slice"), "*")
        out = one if out is None else out.unionByName(one)
    return out
