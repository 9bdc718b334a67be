"""Whitening of embeddings by the leading components of their covariance.

Entries become integers, so that sums and centred products are exact however Spark deals the rows:
tasks return one number for each dimension and pair of dimensions, never rows. Only the covariance, of the
size of one vector squared, reaches the driver, where `spectrum.leading` slices its spectrum. The
projection is one pass of Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from helixframe.llm.spectrum import leading

SCALE, SHIFT = 1024, 100_000
#: Larger entries have no bigint; their rows count as holding a non-finite entry.
ENTRY_LIMIT = 2.0 ** 52
#: Below this, products and sums of whole numbers are exact in doubles.
EXACT = 2 ** 53
BIGINT = 2 ** 63
WIDE = pa.decimal128(38, 0)


def usable(column: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of `dim` finite entries, and the entries as integers x."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    if not dim or not rows.size:
        return np.zeros(0, np.int64), np.zeros((0, dim or 0), np.int64)
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    entries = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore"):
        good = (np.abs(entries) < ENTRY_LIMIT).all(axis=1)
    return rows[good], np.floor(entries[good] * SCALE).astype(np.int64) + SHIFT


def exact_sum(values: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    most = int(np.abs(values).max(initial=0))
    wide = values if most * len(values) < BIGINT else values.astype(object)
    return wide.sum(axis=0).astype(object)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers; by doubles where these are exact."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < EXACT:
        real = y.astype(np.float64)
        return (real.T @ real).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def decimals(numbers) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in numbers], WIDE)


def common_dimension(rows: DataFrame) -> int:
    """The size that most vectors of finite entries have, the larger one in a tie; 0 without vectors."""
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(usable(batch.column(0), dim)[0])], pa.int64())})

    found = rows.mapInArrow(sizes, "dim int, n bigint").groupBy("dim").agg(F.sum("n").alias("n")).filter("n > 0")
    top = found.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return top[0]["dim"] if top else 0


@dataclass
class Whitening:
    """n vectors with sums S per dimension; centre is the integer next to S / n, rest is S - n * centre."""

    dim: int
    n: int
    sums: list[int]
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    certificates: list[tuple[int, int, float]]

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened values of rows of x - centre."""
        fraction = np.array([r / self.n for r in self.rest])
        return ((y - fraction) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)**2 for each row, exact; null beyond a bigint."""
        n, rest = self.n, np.array(self.rest, dtype=object)
        most = n * int(np.abs(y).max(initial=0)) + max(abs(int(r)) for r in self.rest)
        if self.dim * most * most < BIGINT:
            d = n * y - rest.astype(np.int64)
            return (d * d).sum(axis=1).tolist()
        # n*n * sum y*y - 2n * sum y*rest + sum rest*rest, in Python integers
        small = self.dim * int(np.abs(y).max(initial=0)) * max(int(np.abs(y).max(initial=0)), n) < BIGINT
        w = y if small else y.astype(object)
        squares, mixed = (w * w).sum(axis=1), (w * (rest.astype(np.int64) if small else rest)).sum(axis=1)
        last = sum(int(r) ** 2 for r in self.rest)
        whole = [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares.tolist(), mixed.tolist())]
        return [v if v < BIGINT else None for v in whole]


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening:
    """Sums in one pass, products of centred entries in a second, then the leading eigenpairs."""
    rows = df.select(F.col(vector).alias("v"))
    dim = common_dimension(rows)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            x = usable(batch.column(0), dim)[1]
            n, total = n + len(x), total + exact_sum(x)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "n": pa.array([n] * dim, pa.int64()), "s": decimals(total)})

    found = rows.mapInArrow(sums, "i int, n bigint, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect() if dim else []
    if not found:
        return Whitening(dim, 0, [], np.zeros(0, np.int64), [], np.zeros(0), np.zeros((dim, 0)), 0.0, [])
    n, total = found[0]["n"], [int(r["s"]) for r in found]
    centre = np.array([(2 * s + n) // (2 * n) for s in total], dtype=np.int64)
    rest = [s - n * int(c) for s, c in zip(total, centre)]
    left, right = np.triu_indices(dim)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, any_row = np.zeros((dim, dim), dtype=object), False
        for batch in batches:
            x = usable(batch.column(0), dim)[1]
            if len(x):
                sums, any_row = sums + exact_products(x - centre), True
        if any_row:
            yield pa.RecordBatch.from_pydict({"i": pa.array(left, pa.int32()), "j": pa.array(right, pa.int32()), "s": decimals(sums[left, right])})

    pairs = rows.mapInArrow(products, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    covariance = np.zeros((dim, dim))
    for i, j, s in pairs:  # what the integer centres leave is taken off exactly
        covariance[i, j] = covariance[j, i] = (n * int(s) - rest[i] * rest[j]) / (n * n)
    found = leading(covariance, components)
    return Whitening(dim, n, total, centre, rest, found.values, found.vectors, float(np.trace(covariance)), found.certificates)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity, measured in a pass of its
    own. Each batch is centred on its mean before multiplying; batches add by their means' products."""
    k = len(model.values)
    if not k:
        return 0.0
    at_i, at_j = (a.ravel() for a in np.indices((k, k)))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, between, first = np.zeros((k, k)), np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            x = usable(batch.column(0), model.dim)[1]
            if len(x):
                w = model.project(x - model.centre)
                mean = w.mean(axis=0)
                inside += (w - mean).T @ (w - mean)
                between += len(w) * np.outer(mean, mean)
                first += len(w) * mean
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(at_i, pa.int32()), "j": pa.array(at_j, pa.int32()), "inside": inside.ravel(), "between": between.ravel(), "first": first[at_i]})

    rows = df.select(F.col(vector).alias("v")).mapInArrow(moments, "i int, j int, inside double, between double, first double")
    sums = rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("inside", "between", "first")]).collect()
    mean = {r["i"]: r["first"] / model.n for r in sums}
    return max(abs(r["inside"] / model.n + r["between"] / model.n - mean[r["i"]] * mean[r["j"]] - (r["i"] == r["j"])) for r in sums)


def whiten(df: DataFrame, model: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component (from 1), deviation and whitened of every usable row and component."""
    kind = df.schema[key].dataType
    k = len(model.values)
    schema = StructType([StructField(key, kind), StructField("component", IntegerType()), StructField("deviation", LongType()), StructField("whitened", DoubleType())])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = usable(batch.column(1), model.dim)
            if not k or not rows.size:
                continue
            y = x - model.centre
            again = np.repeat(np.arange(len(y)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(rows[again])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))),
                pa.array(model.deviations(y), pa.int64()).take(pa.array(again)), pa.array(model.project(y).ravel())],
                names=[key, "component", "deviation", "whitened"])

    return df.select(key, F.col(vector).alias("_vector")).mapInArrow(project, schema)


def whiten_embeddings(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """Whitened values of every row on the leading components of the table's covariance.

    An entry c becomes x = floor(1024 c) + 100000. Returns key, component, n, deviation (exact sum of
    (n x - S)**2, null where it exceeds a bigint), whitened, explained (share of the trace) and
    identity_error (one measured value).

    Rows whose vector is null, empty, holds a null, a non-finite entry or one of 2**52 and more, or has
    another size than most vectors are left out; repeated rows and null keys stay. A component without
    variance is not returned, so a table of constant vectors, of one row or of none gives no rows. Other
    columns are not read.
    """
    model = fit_whitening(df, vector, components)
    share = F.create_map(*[x for i, e in enumerate(model.values.tolist()) for x in (F.lit(i + 1), F.lit(e / model.trace))]) if len(model.values) else None
    explained = F.element_at(share, F.col("component")) if share is not None else F.lit(None).cast("double")
    return whiten(df, model, key, vector).select(
        key, "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(identity_error(df, model, vector)).alias("identity_error"))
