"""Order-dependent building blocks that never sort a whole table in one task.

Every rank statistic here works on *cells*: rows pre-aggregated per distinct value, so that ties
(however hot) collapse before the shuffle. Running sums over the cells use one window per group
while the counted number of distinct values is small; beyond that the value range is cut into
blocks, block totals are summed first, and the window runs inside each block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.session import cut_lineage

CELLS_PER_WINDOW = 1_000_000
#: Values that are drawn to place each cut point, and in all at most (8 bytes each, on the driver).
SAMPLE_PER_BLOCK = 20
SAMPLE_MAX = 2_000_000


def cut_points(rows: DataFrame, value: str, total: int, limit: int) -> list[float]:
    """Cut points for about limit / 2 rows per block, as quantiles of a hash sample of the values.

    The sample is the rows with the smallest hashes, so it is the same in every run; its size
    follows from the number of blocks and is bounded.
    """
    n_blocks = max(2, math.ceil(2 * total / limit))
    size = min(SAMPLE_MAX, SAMPLE_PER_BLOCK * n_blocks)
    share = min(1.0, (size + 6 * size**0.5 + 20) / total)
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    near = rows.select(F.col(value).cast("double").alias("v"), mark.alias("m")).filter(
        F.col("v").isNotNull() & (F.col("m").cast("double") / 2.0**64 + 0.5 < share))
    drawn = sorted(r[0] for r in near.orderBy("m", "v").limit(size).collect())
    if not drawn:
        return []
    return [drawn[len(drawn) * i // n_blocks] for i in range(1, n_blocks)]


def value_splits(cells: DataFrame, value: str, limit: int | None = None) -> list[float]:
    """Cut points that bound the cells per block; empty when one window is small enough.

    `cells` is counted and should be a written table. Fixing the cut points as literals makes
    every later pass agree on the blocks, also after task retries.
    """
    limit = CELLS_PER_WINDOW if limit is None else limit
    total = cells.count()
    return [] if total <= limit else sorted(set(cut_points(cells, value, total, limit)))


def with_block(df: DataFrame, value: str, splits: Sequence[float], block: str = "_block") -> DataFrame:
    """Block number of a value: how many cut points are <= value; -1 for NULL."""
    if not splits:
        return df.withColumn(block, F.lit(0))
    bounds = [-math.inf, *splits, math.inf]
    cut = Bucketizer(splits=bounds, inputCol=f"{block}_in", outputCol=f"{block}_out")
    shaped = df.withColumn(f"{block}_in", F.col(value).cast("double"))
    return (
        cut.transform(shaped)
        .withColumn(block, F.coalesce(F.col(f"{block}_out").cast("int"), F.lit(-1)))
        .drop(f"{block}_in", f"{block}_out")
    )


def _over(groups: Sequence[str]):
    return W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))


def running_sums(
    cells: DataFrame,
    value: str,
    measures: Sequence[str],
    groups: Sequence[str] = (),
    descending: bool = False,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Add `<m>_before` (sum over strictly earlier values) and `<m>_total` for each measure.

    `cells` must hold one row per (group, value).
    """
    groups = list(groups)
    if splits is None:  # the cells are counted and used: write them once
        cells = cut_lineage(cells)
        splits = value_splits(cells, value)
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())

    if not splits:
        before = _over(groups).orderBy(way(value)).rowsBetween(W.unboundedPreceding, -1)
        return cells.withColumns(
            {f"{m}_before": F.coalesce(F.sum(m).over(before), F.lit(0)) for m in measures}
            | {f"{m}_total": F.sum(m).over(_over(groups)) for m in measures}
        )

    blocked = with_block(cells, value, splits)
    keys = [*groups, "_block"]
    earlier = _over(groups).orderBy(way("_block")).rowsBetween(W.unboundedPreceding, -1)
    totals = blocked.groupBy(*keys).agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    totals = totals.select(
        *keys,
        *[F.coalesce(F.sum(f"_{m}").over(earlier), F.lit(0)).alias(f"_{m}_off") for m in measures],
        *[F.sum(f"_{m}").over(_over(groups)).alias(f"{m}_total") for m in measures],
    )
    inside = W.partitionBy(*keys).orderBy(way(value)).rowsBetween(W.unboundedPreceding, -1)
    summed = blocked.withColumns(
        {f"_{m}_in": F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures}
    )
    out = summed.join(totals, keys)
    return out.withColumns(
        {f"{m}_before": F.col(f"_{m}_in") + F.col(f"_{m}_off") for m in measures}
    ).drop("_block", *[f"_{m}_in" for m in measures], *[f"_{m}_off" for m in measures])


def value_cells(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Distinct non-null values with their row counts."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*groups, value)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    groups: Sequence[str] = (),
    cells: DataFrame | None = None,
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Linear-interpolated exact quantiles, one row per group: `n, q0, q1, ...`."""
    groups = list(groups)
    cells = value_cells(df, value, groups) if cells is None else cells
    ranked = running_sums(cells, value, ["n"], groups, splits=splits)
    at = {i: F.lit(float(q)) * (F.col("n_total") - 1) for i, q in enumerate(probabilities)}

    def pick(rank):
        hit = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    aggs = [F.max("n_total").alias("n")]
    for i, pos in at.items():
        aggs += [pick(F.floor(pos)).alias(f"_lo{i}"), pick(F.ceil(pos)).alias(f"_hi{i}")]
    wide = ranked.groupBy(*groups).agg(*aggs)
    out = [F.col("n")]
    for i, q in enumerate(probabilities):
        pos = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(f"q{i}"))
    return wide.select(*groups, *out)


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities, groups=()) -> DataFrame:
    """Exact quantiles of many columns in one pass over a long (column, value) table."""
    return exact_quantiles(to_long(df, columns, groups), "value", probabilities, [*groups, "column"])


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    shaped = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return shaped.unpivot(list(keep), list(columns), "column", "value")


def medians_wide(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column."""
    long = column_quantiles(df, columns, [0.5])
    return long.groupBy().agg(
        *[F.max(F.when(F.col("column") == c, F.col("q0"))).alias(c) for c in columns]
    )


def mid_ranks(df: DataFrame, value: str, groups=(), out: str = "rank_mid", splits=None) -> DataFrame:
    """Average rank among non-null values per row (NULL stays NULL), plus `<out>_n` the count."""
    groups = list(groups)
    ranked = running_sums(value_cells(df, value, groups), value, ["n"], groups, splits=splits)
    ranks = ranked.select(
        *[F.col(g).alias(f"_{g}") for g in groups],
        F.col(value).alias("_value"),
        (F.col("n_before") + (F.col("n") + 1) / 2).alias(out),
        F.col("n_total").alias(f"{out}_n"),
    )
    on = F.col(value) == F.col("_value")
    for g in groups:
        on = on & (F.col(g) == F.col(f"_{g}"))
    return df.join(ranks, on, "left").drop("_value", *[f"_{g}" for g in groups])


def hash_order(key, seed: int):
    """Seeded order of a key: md5 text, equal in every engine and for every partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


HASH_BLOCK_ROWS = 65_536


def hash_digits(rows: int) -> int:
    """Hex digits that cut so many rows into blocks of at most about HASH_BLOCK_ROWS."""
    return max(1, math.ceil(math.log(max(rows, 1) / HASH_BLOCK_ROWS, 16))) if rows > HASH_BLOCK_ROWS else 1


def hash_ranks(df: DataFrame, key: str, seed: int, groups=(), out: str = "hash_rank") -> DataFrame:
    """1-based position of each key in the seeded order, without one global sort.

    Leading md5 digits cut a group into even blocks; their number follows from the counted rows, so
    that a window sees about HASH_BLOCK_ROWS rows at any size.
    """
    groups = list(groups)
    shaped = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn(
        "_b", F.substring("_h", 1, hash_digits(df.count()))
    )
    earlier = _over(groups).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        shaped.groupBy(*groups, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn(f"{out}_n", F.sum("_n").over(_over(groups)))
        .drop("_n")
    )
    inside = W.partitionBy(*groups, "_b").orderBy("_h", key)
    return (
        shaped.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*groups, "_b"])
        .withColumn(out, F.col("_in") + F.col("_off"))
        .drop("_h", "_b", "_in", "_off")
    )


def block_cuts(rows: DataFrame, value: str, limit: int) -> tuple[list[float], list[float]]:
    """(cut points, hot values) for about `limit` rows per block.

    A value that fills more than a block by itself is isolated between two cut points, so that
    callers can spread it by a hash. Only bounded lists of numbers reach the driver.
    """
    total = rows.count()
    if total <= limit:
        return [], []
    cuts = cut_points(rows, value, total, limit)
    hot = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    return sorted({float(c) for c in cuts} | {math.nextafter(h, math.inf) for h in hot}), hot


def ordinal_ranks(
    df: DataFrame, value: str, key: str, groups=(), out: str = "rank_ordinal", limit: int = CELLS_PER_WINDOW
) -> DataFrame:
    """0-based ordinal rank of non-null values, plus `<out>_n` their count; ties follow the md5 of
    the key and NULL values get NULL.

    Rows are ordered inside value blocks and shifted by the counts of earlier blocks. A hot value
    is further cut into hash blocks by the number of rows, so no task sorts more than a block.
    """
    groups = list(groups)
    shaped = df.withColumns({"_h": hash_order(F.col(key), 0), "_null": F.col(value).isNull()})
    splits, hot = block_cuts(df.filter(F.col(value).isNotNull()), value, limit)
    digits = hash_digits(df.count()) if hot else 1
    shaped = with_block(shaped, value, splits) if splits else shaped.withColumn("_block", F.lit(0))
    is_hot = F.coalesce(F.col(value).isin(*hot), F.lit(False)) if hot else F.lit(False)
    shaped = shaped.withColumn("_part", F.when(is_hot, F.substring("_h", 1, digits)).otherwise(""))
    keys = [*groups, "_null", "_block", "_part"]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(value, "_h", key)) - 1
    if not splits:
        ranked = shaped.withColumns({out: place, f"{out}_n": F.count(value).over(_over([*groups, "_null"]))})
    else:
        whole = _over([*groups, "_null"])
        earlier = whole.orderBy("_block", "_part").rowsBetween(W.unboundedPreceding, -1)
        offsets = shaped.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).select(
            *keys,
            F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_off"),
            F.sum("_k").over(whole).alias(f"{out}_n"),
        )
        ranked = shaped.withColumn("_in", place).join(offsets, keys).withColumn(out, F.col("_in") + F.col("_off"))
    present = ~F.col("_null")
    return ranked.withColumns(
        {c: F.when(present, F.col(c)) for c in (out, f"{out}_n")}
    ).select(*df.columns, out, f"{out}_n")
