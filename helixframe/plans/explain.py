"""Path-dependent Shapley attributions of a fitted ensemble of boosted trees.

A leaf is a product game: a feature on its path contributes one if the row meets all its conditions there
(and zero if not) when it is known, and the share of the training weight that goes the leaf's way when it
is not. A path of m features has 2**m patterns of met conditions, so each leaf becomes a small table of
attributions by pattern, and a batch of rows looks its patterns up. The ensemble is read from the model's
own saved node table; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from helixframe.session import scratch_path

#: Rows that look up their patterns at a time.
ROWS_AT_ONCE = 4096
#: Bytes of the tables of all leaves up to which a task keeps them; larger ones are made anew for each lookup.
TABLE_BYTES = 64 << 20


@dataclass
class Leaf:
    """features of the path with the interval (low, high] that leads here and the share z of weight that goes this way."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray

    def table(self) -> np.ndarray:
        """(2**m patterns x m) attributions: bit j of a pattern tells that the conditions of feature j are met."""
        m = len(self.features)
        met = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
        weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
        out = np.empty_like(met)
        for i in range(m):
            terms = np.zeros((1 << m, m))  # coefficients of the product over the other features, by how many are known
            terms[:, 0] = 1.0
            for j in range(m):
                if j != i:
                    terms[:, 1:], terms[:, 0] = terms[:, 1:] * self.share[j] + terms[:, :-1] * met[:, j:j + 1], terms[:, 0] * self.share[j]
            out[:, i] = self.value * (met[:, i] - self.share[i]) * (terms @ weight)
        return out


@dataclass
class Explainer:
    """The leaves of all trees; `base` is the log-odds that is expected without any feature."""

    leaves: list[Leaf]
    base: float

    def tables(self) -> Iterable[np.ndarray]:
        """The table of each leaf."""
        if sum(len(leaf.features) << len(leaf.features) for leaf in self.leaves) * 8 > TABLE_BYTES:
            return (leaf.table() for leaf in self.leaves)
        if "_tables" not in self.__dict__:
            self._tables = [leaf.table() for leaf in self.leaves]
        return self._tables

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        """(rows x features) attributions to the log-odds."""
        columns = np.ascontiguousarray(rows.T)
        out = np.zeros(columns.shape)
        for leaf, table in zip(self.leaves, self.tables()):
            pattern = np.zeros(columns.shape[1], dtype=np.int64)
            for j, (i, low, high) in enumerate(zip(leaf.features, leaf.low, leaf.high)):
                met = ((columns[i] > low) & (columns[i] <= high)).astype(np.int64)
                pattern += met << j
            for j, i in enumerate(leaf.features):  # a path names each feature once
                out[i] += table[:, j].take(pattern)
        return out.T


def tree_leaves(nodes: dict[int, dict], scale: float) -> Iterator[Leaf]:
    """Leaves of one tree of node rows by id, values times `scale`."""
    todo = [(0, {})]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node["left"] < 0:
            f = sorted(path)
            low, high, share = (np.array([path[i][k] for i in f], dtype=float) for k in range(3))
            yield Leaf(scale * node["prediction"], np.array(f, dtype=np.int64), low, high, share)
            continue
        i, cut, whole = node["feature"], node["threshold"], node["weight"]
        low, high, share = path.get(i, (-np.inf, np.inf, 1.0))
        todo.append((node["left"], path | {i: (low, min(high, cut), share * nodes[node["left"]]["weight"] / whole)}))
        todo.append((node["right"], path | {i: (max(low, cut), high, share * nodes[node["right"]]["weight"] / whole)}))


def explainer(model, spark) -> Explainer:
    """Explainer of a boosted-tree classification model. Its node table has one row for each node of each tree."""
    path = scratch_path(spark, "model")
    model.save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select(
        "treeID", "id", "prediction", F.col("impurityStats")[0].alias("weight"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("cut"),
        F.col("split.numCategories").alias("categories")).collect()
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        node = r.asDict()
        if r["left"] >= 0:
            if r["categories"] > 2:
                raise ValueError("splits on category indices are not supported; encode categories as columns")
            # a split of a two-valued column (0 or 1) lists the values that go left
            node["threshold"] = r["cut"][0] if r["categories"] < 0 else 0.5
            if r["categories"] == 2 and 0.0 not in r["cut"]:
                node["left"], node["right"] = node["right"], node["left"]
        trees.setdefault(r["treeID"], {})[r["id"]] = node
    leaves = [leaf for i, weight in enumerate(model.treeWeights) for leaf in tree_leaves(trees[i], 2.0 * weight)]
    base = sum(leaf.value * float(np.prod(leaf.share)) for leaf in leaves)
    return Explainer([leaf for leaf in leaves if len(leaf.features)], base)


def attributions(model, rows: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """`keep`, base, one column for each encoded feature, and log_odds (of the model) for every row with `features`.

    base plus the attributions is log_odds. Names that clash with `keep` raise.
    """
    names, keep = list(names), list(keep)
    if len({*names, *keep, "base", "log_odds"}) < len(names) + len(keep) + 2:
        raise ValueError("names of features and kept columns must differ")
    explain = explainer(model, rows.sparkSession)
    scored = model.transform(rows).select(
        *[F.col(f"`{c}`") for c in keep], vector_to_array("rawPrediction")[1].alias("log_odds"), vector_to_array("features").alias("features"))
    # raw predictions are half the log-odds
    scored = scored.withColumn("log_odds", 2 * F.col("log_odds"))
    n_keep = len(keep)
    schema = StructType([*scored.schema.fields[:n_keep], StructField("base", DoubleType()), *[StructField(n, DoubleType()) for n in names], StructField("log_odds", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                values = part.column(n_keep + 1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                phi = explain(values)
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:n_keep], pa.array(np.full(part.num_rows, explain.base)), *[pa.array(phi[:, i]) for i in range(len(names))], part.column(n_keep)],
                    names=schema.fieldNames())

    return scored.mapInArrow(run, schema)
