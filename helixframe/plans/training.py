"""Features, boosted trees, calibration and retraining studies on spark.ml."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegression
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.constants import NON_MODEL_COLUMNS
from helixframe.functions.scores import finite
from helixframe.operators.isotonic import apply_isotonic, fit_isotonic
from helixframe.operators.metrics import brier_decomposition, brier_logloss, ranking_metrics, score_cells
from helixframe.operators.ordered import column_quantiles
from helixframe.operators.profiling import numeric_columns
from helixframe.operators.resampling import paired_bootstrap_delta
from helixframe.operators.splitting import group_subsample, hash_ranks
from helixframe.plans.boosting import Tree, grow_stage, node_rows, score_bins
from helixframe.session import cut_lineage, scratch_path

MIN_FREQUENCY = 25
POOLED = "__infrequent__"
# --- Fixed values: feature groups removed one at a time ---
FEATURE_GROUPS = {
    "conservation": (
        "phyloP100way_vertebrate", "phyloP30way_mammalian", "phastCons100way_vertebrate",
        "phastCons30way_mammalian", "GERP++_RS", "GERP++_NR",
    ),
    "physicochemical": (
        "Grantham_distance", "BLOSUM62_score", "hydrophobicity_ref", "hydrophobicity_alt",
        "molecular_weight_ref", "molecular_weight_alt", "pI_alt", "volume_ref", "volume_alt",
        "polarity_ref", "polarity_alt", "charge_ref", "charge_alt",
        "polarity_change", "volume_change", "charge_change",
    ),
    "aa_identity": ("ref_aa", "alt_aa"),
    "allele_frequency": ("AF_popmax", "AN", "AC", "log_AF"),
    "gene_constraint": ("pLI", "oe_lof_upper", "mis_z", "oe_mis_upper", "lof_z"),
    "imputation_flags": (
        "is_imputed_phyloP100way_vertebrate", "is_imputed_phastCons100way_vertebrate",
        "is_imputed_GERP++_RS", "is_imputed_Grantham_distance", "is_imputed_BLOSUM62_score",
    ),
}


def model_columns(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) model inputs: everything but keys, labels and leaky columns."""
    gone = set(NON_MODEL_COLUMNS) | set(exclude)
    numeric = numeric_columns(df, with_bool=True, exclude=gone)
    text = [f.name for f in df.schema.fields if f.dataType.typeName() == "string" and f.name not in gone]
    if not numeric and not text:
        raise ValueError("no usable feature columns")
    return numeric, text


def one_hot_levels(df: DataFrame, column: str, min_frequency=MIN_FREQUENCY) -> DataFrame:
    """Levels of a categorical column and the encoded level each of them maps to."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("MISSING")).alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn(
        "encoded", F.when(F.col("n") >= min_frequency, F.col("level")).otherwise(POOLED)
    )


def clean_model_inputs(df: DataFrame, numeric, categorical, medians: dict[str, float]) -> DataFrame:
    """Infinities to NULL, train-median fill, booleans to bytes, doubles to floats, missing
    categories to MISSING."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in numeric:
            if f.dataType.typeName() == "boolean":
                out[f.name] = F.coalesce(c.cast("tinyint"), F.lit(medians.get(f.name)).cast("tinyint"))
            elif f.dataType.typeName() in ("double", "float"):
                out[f.name] = F.coalesce(finite(c), F.lit(medians.get(f.name))).cast("float")
            else:
                out[f.name] = F.coalesce(c.cast("double"), F.lit(medians.get(f.name))).cast("float")
        elif f.name in categorical:
            out[f.name] = F.coalesce(c, F.lit("MISSING"))
    return df.withColumns(out)


def train_medians(df: DataFrame, numeric: Sequence[str]) -> dict[str, float]:
    """Exact medians of finite values; one row per column reaches the driver."""
    if not numeric:
        return {}
    shaped = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in numeric])
    return {r["column"]: r["q0"] for r in column_quantiles(shaped, list(numeric), [0.5]).collect()}


@dataclass
class FeatureModel:
    """Preprocessing fitted on train and applied unchanged to any other table."""

    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float]
    levels: dict[str, DataFrame] = field(repr=False)
    stages: PipelineModel = field(repr=False, default=None)

    def _pooled(self, df: DataFrame) -> DataFrame:
        out = clean_model_inputs(df, self.numeric, self.categorical, self.medians)
        for i, c in enumerate(self.categorical):
            table = self.levels[c].select(F.col("level").alias(c), F.col("encoded").alias(f"_enc{i}"))
            out = out.join(table, c, "left")
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        encoded = self.stages.transform(self._pooled(df))
        return encoded.select(*df.columns, "features")

    def manifest(self) -> list[str]:
        """Encoded feature names, `num__x` and `cat__column_LEVEL`."""
        names = [f"num__{c}" for c in self.numeric]
        for i, c in enumerate(self.categorical):
            names += [f"cat__{c}_{label}" for label in self.stages.stages[i].labels]
        return names

    def owners(self) -> list[str]:
        """The column of each entry of `features`."""
        return [*self.numeric, *[c for i, c in enumerate(self.categorical) for _ in self.stages.stages[i].labels]]


def fit_features(train: DataFrame, numeric=None, categorical=None, min_frequency=MIN_FREQUENCY) -> FeatureModel:
    if numeric is None:
        numeric, categorical = model_columns(train)
    categorical = list(categorical or [])
    medians = train_medians(train, numeric)
    levels = {c: cut_lineage(one_hot_levels(train, c, min_frequency)) for c in categorical}
    model = FeatureModel(list(numeric), categorical, medians, levels)
    prepared = model._pooled(train)
    # the labels are those of the written levels, so that train is not read for them again
    indexers = [
        StringIndexerModel.from_labels(
            sorted((r[0] for r in levels[c].select("encoded").distinct().collect()), key=lambda v: v.encode("utf-16-be")),
            inputCol=f"_enc{i}", outputCol=f"_idx{i}", handleInvalid="keep")
        for i, c in enumerate(categorical)
    ]
    # 'keep' adds an unknown slot and dropLast removes it again: unseen levels become all zeros
    hots = [OneHotEncoder(inputCol=f"_idx{i}", outputCol=f"_hot{i}", dropLast=True) for i in range(len(categorical))]
    # column names may contain characters that the assembler would parse, hence the plain aliases
    inputs = [f"_hot{i}" for i in range(len(categorical))]
    assembler = VectorAssembler(inputCols=[*numeric, *inputs], outputCol="features", handleInvalid="keep")
    model.stages = Pipeline(stages=[*indexers, *hots, assembler]).fit(prepared)
    return model


def class_weight(df: DataFrame, label="label") -> DataFrame:
    """Negatives per positive, one row."""
    return df.agg(
        F.count_if(F.col(label) == 1).alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg")
    ).withColumn("weight", F.try_divide(F.col("n_neg").cast("double"), F.col("n_pos")))


DEFAULT_PARAMS = {"max_depth": 5, "step_size": 0.1, "subsample": 0.8, "max_iter": 500, "min_instances": 1, "feature_share": "all", "patience": 80, "tolerance": 1e-4}
#: Trees of the first round of growth, beyond the patience. A round is a job; the next one goes on from its trees.
FIRST_TREES = 120
#: Cells that a task makes instances of, and cells that it scores.
CELLS_PER_TASK = 150_000
CELLS_PER_SCORING = 50_000
#: Bins of a feature of many values, which are those that the library makes by itself, and values that are all told apart.
BINS = 32
FEW_VALUES = 64
#: Training rows are counted in cells of equal bins and label. A cell is cut into instances of equal weight, none
#: of more rows than this part of the table, so that the draws of `subsample` stay fine where cells are few.
FINE_SHARE = 65_536


def stopped_at(losses: Sequence[float], patience: int, tolerance: float = 0.0) -> tuple[int, bool]:
    """(number of trees of the best prefix, whether `patience` trees after it brought no better one).

    Better is lower by more than `tolerance`, so that a loss which creeps towards its limit ends. Later
    trees than that do not count, even where the loss falls again: growth would have stopped.
    """
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best] - tolerance:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


@dataclass
class BoostedTrees:
    """The best prefix of a grown ensemble. `losses` holds the validation loss after each grown tree."""

    trees: list[Tree] = field(repr=False)
    edges: Sequence[Sequence[float]] = field(repr=False)
    step: float
    losses: list[float] = field(repr=False)
    best_iteration: int
    stopped: bool

    @cached_property
    def model(self) -> GBTClassificationModel:
        return as_model(self.trees, self.edges, self.step)

    @property
    def n_grown(self) -> int:
        return len(self.losses)

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(rows)

    def loss_table(self, spark: SparkSession) -> DataFrame:
        """iteration (from 1), val_loss and is_best; one row for each grown tree."""
        rows = [(i, float(v), i == self.best_iteration) for i, v in enumerate(self.losses, 1)]
        return spark.createDataFrame(rows, "iteration int, val_loss double, is_best boolean")


def prefix(model: GBTClassificationModel, n_trees: int) -> GBTClassificationModel:
    """The ensemble of the first trees, through the public constructor of Spark's model class."""
    java, context = model._java_obj, SparkSession.active().sparkContext
    jvm, gateway = context._jvm, context._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n_trees)
    weights = gateway.new_array(jvm.double, n_trees)
    all_trees, all_weights = java.trees(), java.treeWeights()
    for i in range(n_trees):
        trees[i], weights[i] = all_trees[i], all_weights[i]
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights)
    return GBTClassificationModel(java.copyValues(cut, jvm.org.apache.spark.ml.param.ParamMap()))


def boosting_rows(rows: DataFrame, label: str, weight: float) -> DataFrame:
    """features, _label and _w of each row."""
    return rows.select(
        "features", F.col(label).cast("double").alias("_label"), F.when(F.col(label) == 1, weight).otherwise(1.0).alias("_w"))


def as_model(trees: Sequence[Tree], edges: Sequence[Sequence[float]], step: float) -> GBTClassificationModel:
    """The library's model of grown trees: an ensemble of so many leaves is saved, and their nodes take its node table's place."""
    spark = SparkSession.active()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    leaf = jvm.org.apache.spark.ml.tree.LeafNode(0.0, 0.0, jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(gateway.new_array(jvm.double, 3), 0))
    tree = kind("tree", leaf, len(edges))
    all_trees, weights = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    for i in range(len(trees)):
        all_trees[i], weights[i] = tree, step if i else 1.0
    path = scratch_path(spark, "grown")
    empty = jvm.org.apache.spark.ml.classification.GBTClassificationModel("GBTClassifier_cells", all_trees, weights, len(edges))
    for param, column in ((empty.labelCol(), "_label"), (empty.weightCol(), "_w")):
        empty.set(param, column)
    GBTClassificationModel(empty).save(path)
    nodes = spark.read.parquet(f"{path}/data")
    cuts = [[*map(float, e), math.inf] for e in edges]
    spark.createDataFrame(node_rows(trees, cuts), nodes.schema).write.mode("overwrite").parquet(f"{path}/data")
    return GBTClassificationModel.load(path)


def grow_trees(rows: DataFrame, params: dict, n_trees: int, seed: int) -> GBTClassificationModel:
    """An ensemble of exactly so many trees over features, _label and _w. Each tree depends on the seed and the
    trees before it, so a longer ensemble begins with the shorter one."""
    edges = bin_edges(rows)
    flat = with_bins(rows, edges, [c for c in rows.columns if c in ("_label", "_part", "_w")])
    bins = F.array(*[F.col(f"b{i}").cast("double") for i in range(len(edges))])
    shaped = flat.withColumn("features", array_to_vector(bins))
    return as_model(grow_stage(shaped, shaped.limit(0), len(edges), params, n_trees, seed)[0], edges, params["step_size"])


def between(low: float, high: float) -> float:
    """A cut point from which `high` is apart."""
    middle = (low + high) / 2
    return middle if low <= middle < high else low


def bin_edges(rows: DataFrame) -> list[list[float]]:
    """Cut points of each entry of `features`; a value belongs left of a cut point it equals.

    Up to FEW_VALUES distinct values are told apart by their middles, more are cut at exact quantiles into BINS bins.
    """
    arrays = rows.select(vector_to_array("features").alias("v"))
    first = arrays.first()
    if first is None:
        return []
    columns = [f"x{i}" for i in range(len(first.v))]
    flat = arrays.select(*[F.nanvl(F.col("v")[i], F.lit(None).cast("double")).alias(c) for i, c in enumerate(columns)])
    about = flat.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if about[c] <= 2 * FEW_VALUES]
    found = flat.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in few]).first() if few else {}
    edges = {c: [between(a, b) for a, b in zip(found[c], found[c][1:])] for c in few if len(found[c]) <= FEW_VALUES}
    many = [c for c in columns if c not in edges]
    if many:
        for r in column_quantiles(flat, many, [k / BINS for k in range(1, BINS)]).collect():
            edges[r["column"]] = sorted({r[f"q{k}"] for k in range(BINS - 1)})
    return [edges[c] for c in columns]


def with_bins(rows: DataFrame, edges: Sequence[Sequence[float]], kept: Sequence[str]) -> DataFrame:
    """The kept columns and b0, b1, ..., the bin number of each feature."""
    arrays = rows.select(*kept, vector_to_array("features").alias("_v"))
    flat = arrays.select(*kept, *[F.col("_v")[i].alias(f"x{i}") for i in range(len(edges))])
    cut = [i for i, e in enumerate(edges) if e]
    if cut:  # a bucket begins at its lower bound, a bin after it
        flat = Bucketizer(
            splitsArray=[[-math.inf, *[math.nextafter(e, math.inf) for e in edges[i]], math.inf] for i in cut],
            inputCols=[f"x{i}" for i in cut], outputCols=[f"b{i}" for i in cut], handleInvalid="keep").transform(flat)
    return flat.select(*kept, *[(F.col(f"b{i}") if e else F.lit(0)).cast("int").alias(f"b{i}") for i, e in enumerate(edges)])


def count_cells(rows: DataFrame, edges: Sequence[Sequence[float]], label: str) -> DataFrame:
    """_label, _n and the bin number of each feature, one row for each label and bins that occur."""
    flat = with_bins(rows.withColumn("_label", F.col(label).cast("double")), edges, ["_label"])
    return flat.groupBy("_label", *[f"b{i}" for i in range(len(edges))]).agg(F.count(F.lit(1)).alias("_n"))


def boosting_cells(rows: DataFrame, edges: Sequence[Sequence[float]], label: str, weight: float, fine: bool) -> DataFrame:
    """Instances of the cells of a table."""
    return cell_instances(cut_lineage(count_cells(rows, edges, label)), weight, fine)


def kept_cells(cells: DataFrame, at: Sequence[int]) -> DataFrame:
    """Written cells of the features at these places only, numbered anew."""
    bins = [f"b{i}" for i in range(len(at))]
    return cut_lineage(cells.select("_label", "_n", *[F.col(f"b{i}").alias(b) for b, i in zip(bins, at)]).groupBy("_label", *bins).agg(F.sum("_n").alias("_n")))


def cell_instances(cells: DataFrame, weight: float, fine: bool) -> DataFrame:
    """features (bin numbers), _label, _part, _n and _w of written cells, which are written once; _n is a number of rows.

    With `fine` a cell of more than 1 / FINE_SHARE of the rows is cut into equal instances. So a table of up
    to FINE_SHARE rows keeps one instance for each row, and the instances of a larger one follow from the
    bins that occur.
    """
    bins = [c for c in cells.columns if c not in ("_label", "_n")]
    total = cells.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    most = max(1, -(-total // FINE_SHARE)) if fine else max(1, total)
    parts = F.ceil(F.col("_n") / most).cast("int")
    instances = cells.agg(F.coalesce(F.sum(parts), F.lit(0))).first()[0]
    dealt = cells.withColumn("_parts", parts).withColumn("_part", F.explode(F.sequence(F.lit(1), "_parts")))
    dealt = dealt.repartition(max(1, -(-instances // CELLS_PER_TASK)), "_label", *bins, "_part")
    rows_of = F.col("_n") / F.col("_parts") if fine else F.col("_n")
    return cut_lineage(dealt.select(
        array_to_vector(F.array(*[F.col(b).cast("double") for b in bins])).alias("features"), "_label", "_part", rows_of.alias("_n"),
        (F.col("_n") / F.col("_parts") * F.when(F.col("_label") == 1, weight).otherwise(1.0)).alias("_w")))


def on_values(model: GBTClassificationModel, edges: Sequence[Sequence[float]]) -> GBTClassificationModel:
    """The model over the features themselves of a model over their bins: cut points take the place of bin
    numbers in its saved node table."""
    spark = SparkSession.active()
    binned, valued = scratch_path(spark, "binned"), scratch_path(spark, "valued")
    model.save(binned)
    model.save(valued)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in (*e, math.inf)]) for e in edges])
    split = F.col("nodeData.split")
    cut = F.get(F.get(table, split["featureIndex"]), F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0))).cast("int"))
    nodes = spark.read.parquet(f"{binned}/data")
    nodes = nodes.withColumn("nodeData", F.col("nodeData").withField(
        "split.leftCategoriesOrThreshold",
        F.when(F.col("nodeData.leftChild") >= 0, F.array(cut)).otherwise(split["leftCategoriesOrThreshold"])))
    nodes.write.mode("overwrite").parquet(f"{valued}/data")
    return GBTClassificationModel.load(valued)


def train_boosted_trees(train: DataFrame, val: DataFrame, label="label", params=None, seed=42) -> BoostedTrees:
    """Gradient-boosted trees with class weights, cut to the prefix of least validation loss.

    Growth goes on while one of the last `patience` trees was the best, to at most `max_iter`. Both inputs
    carry `features`. Trees are grown over bins of the features; so rows of equal bins and label are counted
    first, and every level of every tree reads the counts.
    """
    weight = class_weight(train, label).first()["weight"] or 1.0
    edges = bin_edges(train)
    rows, held = boosting_cells(train, edges, label, weight, True), boosting_cells(val, edges, label, weight, False)
    return grow_to_best(rows, held, edges, params, seed)


def grow_to_best(rows: DataFrame, held: DataFrame, edges: Sequence[Sequence[float]], params=None, seed=42) -> BoostedTrees:
    """`train_boosted_trees` on instances of cells."""
    p = DEFAULT_PARAMS | (params or {})
    trees: list[Tree] = []
    losses: list[float] = []
    for size in sorted({min(p["max_iter"], p["patience"] + FIRST_TREES), p["max_iter"]}):
        before = list(losses)
        more, lost = grow_stage(
            rows, held, len(edges), p, size, seed, trees, lambda new, before=before: stopped_at([*before, *new], p["patience"], p["tolerance"])[1])
        trees, losses = trees + more, losses + lost
        best, stopped = stopped_at(losses, p["patience"], p["tolerance"])
        if stopped:
            break
    return BoostedTrees(trees[:best], edges, p["step_size"], losses, best, stopped)


def score_rows(model, features: DataFrame, out="p_raw") -> DataFrame:
    scored = model.transform(features).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("rawPrediction", "probability", "prediction", "features")


def fit_platt(df: DataFrame, y="y", p="p"):
    """One-feature logistic regression with unit L2 strength, fitted on weighted score cells."""
    cells = score_cells(df, y, p).select(
        "score", F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("pos").cast("double").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), F.col("neg").cast("double").alias("weight")),
        )).alias("e"),
    ).select("score", "e.label", "e.weight").filter("weight > 0")
    n = cells.agg(F.sum("weight")).first()[0]
    rows = VectorAssembler(inputCols=["score"], outputCol="features").transform(cells)
    return LogisticRegression(
        labelCol="label", weightCol="weight", regParam=1.0 / n, elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=1e-9,
    ).fit(rows)


def apply_platt(model, df: DataFrame, p="p", out="p_platt") -> DataFrame:
    slope, bias = float(model.coefficients[0]), float(model.intercept)
    return df.withColumn(out, 1.0 / (1.0 + F.exp(-(F.col(p) * slope + bias))))


def decomposition_table(val: DataFrame, test: DataFrame, y="y", p="p") -> DataFrame:
    """Raw, Platt and isotonic scores on both splits, fitted on validation."""
    platt, iso = fit_platt(val, y, p), fit_isotonic(val, y, p)
    rows = val.select(F.lit("val").alias("split"), y, p).unionByName(test.select(F.lit("test").alias("split"), y, p))
    scored = apply_isotonic(iso, apply_platt(platt, rows, p, "platt"), p, "isotonic").withColumn("raw", F.col(p))
    long = scored.select("split", y, "raw", "platt", "isotonic").unpivot(
        ["split", y], ["raw", "platt", "isotonic"], "calibrator", "prob"
    )
    keys = ["calibrator", "split"]
    loss = brier_logloss(long, y, "prob", keys).select(*keys, "log_loss")
    return brier_decomposition(long, y, "prob", groups=keys).join(loss, keys)


@dataclass
class FittedScorer:
    """Features, trees and calibration fitted on one table, with the scores of its val and test rows."""

    features: FeatureModel
    trees: BoostedTrees
    predictions: DataFrame = field(repr=False)


@dataclass
class PreparedRows:
    """What fits share: features fitted on train, the encoded rows, and the written cells of train and val."""

    features: FeatureModel
    rows: DataFrame = field(repr=False)
    edges: list[list[float]] = field(repr=False)
    cells: dict[str, DataFrame] = field(repr=False)
    weight: float


def prepare_rows(data: DataFrame, drop: Sequence[str] = (), key="variant_key", label="label", keep=(), keyed=True) -> PreparedRows:
    """Without `keyed` the encoded rows carry split and label only, as studies of metrics need."""
    numeric, text = model_columns(data, {"split", "family", key, label, *drop, *keep})
    features = fit_features(data.filter(F.col("split") == "train"), numeric, text)
    ready = cut_lineage(features.transform(data).select(*((key, *keep) if keyed else ()), "split", label, "features"))
    rows = {s: ready.filter(F.col("split") == s) for s in ("train", "val")}
    weight = class_weight(rows["train"], label).first()["weight"] or 1.0
    edges = bin_edges(rows["train"])
    return PreparedRows(features, ready, edges, {s: cut_lineage(count_cells(r, edges, label)) for s, r in rows.items()}, weight)


def grow_prepared(ready: PreparedRows, drop: Sequence[str] = (), params=None, seed=42) -> tuple[BoostedTrees, list[int]]:
    """Trees on the cells without the columns in `drop`, and the places of the other features: medians, levels and
    bins of a column do not depend on others."""
    at = [i for i, c in enumerate(ready.features.owners()) if c not in set(drop)]
    if not at:
        raise ValueError("no usable feature columns")
    cells = ready.cells if len(at) == len(ready.edges) else {s: kept_cells(c, at) for s, c in ready.cells.items()}
    train, val = (cell_instances(cells[s], ready.weight, s == "train") for s in ("train", "val"))
    return grow_to_best(train, val, [ready.edges[i] for i in at], params, seed), at


def score_held_cells(ready: PreparedRows, fits: Sequence[tuple[BoostedTrees, list[int]]], label="label") -> DataFrame:
    """Written cells of val and test: split, y_true, _n and the scores p0, p1, ... of fits of `grow_prepared`. Rows of
    equal bins have equal scores, so no row is scored by itself."""
    test = cut_lineage(count_cells(ready.rows.filter(F.col("split") == "test"), ready.edges, label))
    cells = ready.cells["val"].withColumn("split", F.lit("val")).unionByName(test.withColumn("split", F.lit("test")))
    bins = [f"b{i}" for i in range(len(ready.edges))]
    scored = cells.repartition(-(-cells.count() // CELLS_PER_SCORING) or 1, "split", "_label", *bins)
    for i, (trees, at) in enumerate(fits):
        features = array_to_vector(F.array(*[F.col(bins[j]).cast("double") for j in at]))
        scored = score_bins(scored.withColumn("features", features), trees.trees, trees.step, f"p{i}")
    return cut_lineage(scored.select("split", F.col("_label").cast("int").alias("y_true"), "_n", *[f"p{i}" for i in range(len(fits))]))


def fit_prepared(ready: PreparedRows, drop: Sequence[str] = (), key="variant_key", label="label", params=None, seed=42, keep=()) -> FittedScorer:
    """Fit of `grow_prepared` with the scores of its rows."""
    trees, at = grow_prepared(ready, drop, params, seed)
    held = ready.rows.filter(F.col("split").isin("val", "test"))
    if len(at) < len(ready.edges):
        held = VectorSlicer(inputCol="features", outputCol="_kept", indices=at).transform(held).drop("features").withColumnRenamed("_kept", "features")
    raw = cut_lineage(score_rows(trees, held).select(key, "split", *keep, F.col(label).alias("y_true"), "p_raw"))
    iso = fit_isotonic(raw.filter(F.col("split") == "val"), "y_true", "p_raw")
    return FittedScorer(ready.features, trees, apply_isotonic(iso, raw, "p_raw", "p_calibrated"))


def fit_scorer(data: DataFrame, drop: Sequence[str] = (), key="variant_key", label="label", params=None, seed=42, keep=()) -> FittedScorer:
    """Fit on train, choose the prefix on val, calibrate on val.

    `data` carries `split`. Columns in `drop` are left out of the model.
    """
    return fit_prepared(prepare_rows(data, drop, key, label, keep), (), key, label, params, seed, keep)


def train_and_score(data: DataFrame, drop: Sequence[str] = (), **settings) -> DataFrame:
    """Predictions for val and test of `fit_scorer`."""
    return fit_scorer(data, drop, **settings).predictions


def random_params(seed: int, trial: int) -> dict:
    """Bounded random parameters, a function of (seed, trial). The ranges are fixed values."""
    digest = hashlib.md5(f"{seed}:{trial}".encode()).hexdigest()
    u = [int(digest[i : i + 4], 16) / 65535.0 for i in range(0, 24, 4)]
    return {
        "max_depth": 3 + int(u[0] * 4.999),
        "step_size": round(0.025 + u[1] * (0.12 - 0.025), 6),
        "min_instances": 1 + int(u[2] * 7.999),
        "subsample": round(0.72 + u[3] * 0.28, 6),
        "feature_share": round(0.65 + u[4] * 0.35, 6),
    }


#: Fits of a search or a study that run at the same time; each is distributed by itself.
FITS_AT_ONCE = 8
#: A rung keeps one in so many trials and gives each so many times the trees.
HALVING = 2


def rungs(trials: int, max_trees: int, least: int = 8) -> list[tuple[int, int]]:
    """(trials, trees) of each rung of successive halving: half of the trials go on with twice the
    trees, until few are left or `max_trees` is reached. The last rung grows what is allowed."""
    out = [(trials, min(least, max_trees))]
    while out[-1][0] > 4 and out[-1][1] < max_trees:
        out.append((-(-out[-1][0] // HALVING), min(max_trees, out[-1][1] * HALVING)))
    return out


def search_rows(data: DataFrame, key: str, label: str, keep) -> tuple[DataFrame, DataFrame]:
    """Instances of the cells of train and val."""
    ready = prepare_rows(data.filter(F.col("split").isin("train", "val")), (), key, label, keep)
    return tuple(cell_instances(ready.cells[s], ready.weight, s == "train") for s in ("train", "val"))


def run_rung(train: DataFrame, val: DataFrame, width: int, trials: Sequence[int], n_trees: int, params, seed: int, grown: dict[int, tuple]) -> dict[int, tuple]:
    """trial -> (average precision, AUC, best iteration) of its best prefix of `n_trees` trees.

    The fits run side by side and go on from the trees and losses in `grown`, and each writes its validation
    scores to a folder of its own; the metrics of all of them are one grouped aggregate over these.
    """
    path = scratch_path(train.sparkSession, "rung")

    def fit(trial: int) -> tuple[int, int]:
        p, (trees, losses) = params(trial), grown.get(trial, ([], []))
        more, lost = grow_stage(train, val, width, p, n_trees, seed, trees)
        grown[trial] = trees, losses = trees + more, losses + lost
        best = stopped_at(losses, p["patience"], p["tolerance"])[0]
        score_bins(val, trees[:best], p["step_size"]).select(F.col("_label").cast("int").alias("y"), "p_raw", "_n").write.parquet(f"{path}/trial={trial}")
        return trial, best

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        best = dict(pool.map(fit, trials))
    scored = train.sparkSession.read.option("basePath", path).schema("y int, p_raw double, _n bigint, trial int").parquet(path)
    table = ranking_metrics(scored, "y", "p_raw", ["trial"], count="_n").select("trial", "pr_auc", "roc_auc").collect()
    return {r["trial"]: (r["pr_auc"] or 0.0, r["roc_auc"] or 0.0, best[r["trial"]]) for r in table}


def param_search(data: DataFrame, trials=40, key="variant_key", label="label", seed=42, max_iter=500, search_trees=64, keep=(), prune=True) -> tuple[dict, DataFrame]:
    """Seeded random search by validation average precision with successive halving: best parameters
    and the history, one row for each trial with its last rung.

    All trials grow a few trees; the better half of a rung (ties to the smaller trial) goes on with
    twice as many, to `search_trees`. A longer ensemble begins with the shorter one, so trials go on from their
    trees. Without `prune` every trial grows `search_trees` at once. Features are prepared
    and written once, and one metric row of each trial reaches the driver. The best parameters carry
    `max_iter` for a fit with patience.
    """
    train, val = search_rows(data, key, label, keep)
    width = len(train.first()["features"])
    plan = rungs(trials, search_trees) if prune else [(trials, search_trees)]
    left, last, grown = list(range(trials)), {}, {}
    for rung, (n, n_trees) in enumerate(plan):
        left = left[:n]
        found = run_rung(train, val, width, left, n_trees, lambda t: DEFAULT_PARAMS | random_params(seed, t), seed, grown)
        last |= {t: (rung, n_trees, *m) for t, m in found.items()}
        left.sort(key=lambda t: (-last[t][2], t))
    columns = ("max_depth", "step_size", "min_instances", "subsample", "feature_share")
    rows = [(t, *[random_params(seed, t)[c] for c in columns], *last[t]) for t in sorted(last)]
    history = data.sparkSession.createDataFrame(
        rows, "trial int, max_depth int, step_size double, min_instances int, subsample double, feature_share double, "
        "rung int, n_trees int, val_pr double, val_roc double, best_iteration int")
    return random_params(seed, left[0]) | {"max_iter": max_iter}, history


def side_by_side(fits: Sequence[Callable]) -> list:
    """Results of independent fits that run at the same time, in order."""
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        return list(pool.map(lambda fit: fit(), fits))


def feature_ablation(data: DataFrame, groups: dict[str, Sequence[str]], replicates=200, params=None, seed=42, key="variant_key", keep=()) -> DataFrame:
    """Retrain without each group; test metrics, change from the full model, paired interval."""
    present = {name: found for name, columns in groups.items() if (found := [c for c in columns if c in data.columns])}

    ready = prepare_rows(data, key=key, keep=keep, keyed=False)
    fits = side_by_side([lambda drop=drop: grow_prepared(ready, drop, params, seed) for drop in ([], *present.values())])
    scored = score_held_cells(ready, fits)
    val, test = (scored.filter(F.col("split") == s) for s in ("val", "test"))
    steps = side_by_side([lambda i=i: fit_isotonic(val, "y_true", f"p{i}", count="_n") for i in range(len(fits))])
    for i, iso in enumerate(steps):
        test = apply_isotonic(iso, test, f"p{i}", f"c{i}")
    test, out = cut_lineage(test), None
    for i, (name, columns) in enumerate(present.items(), 1):
        pair = test.select(F.col("y_true").alias("y"), F.col("c0").alias("p_a"), F.col(f"c{i}").alias("p_b"), "_n")
        rows = paired_bootstrap_delta(pair, replicates=replicates, seed=seed, count="_n").select(
            F.lit(name).alias("removed"), F.lit(len(columns)).alias("n_removed"), "metric",
            F.col("estimate_a").alias("full"), F.col("estimate_b").alias("without"), "delta", "ci_lo", "ci_hi", "p_value",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def single_group_models(data: DataFrame, groups: dict[str, Sequence[str]], params=None, seed=42, key="variant_key", label="label", keep=()) -> DataFrame:
    """Train on one group of columns only; test metrics per group."""
    numeric, text = model_columns(data, {"split", "family", key, label, *keep})
    names = [name for name, columns in groups.items() if any(c in data.columns for c in columns)]
    ready = prepare_rows(data, key=key, label=label, keep=keep, keyed=False)
    others = [[c for c in (*numeric, *text) if c not in groups[name]] for name in names]
    scored = score_held_cells(ready, side_by_side([lambda drop=drop: grow_prepared(ready, drop, params, seed) for drop in others]), label)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("feature_group"), F.col(f"p{i}").alias("p_raw")) for i, name in enumerate(names)]))
    both = scored.filter(F.col("split") == "test").select("y_true", "_n", each.alias("e")).select("y_true", "_n", "e.*")
    return ranking_metrics(both, "y_true", "p_raw", ["feature_group"], count="_n").select("feature_group", "n", "n_pos", "roc_auc", "pr_auc")


def learning_curve(data: DataFrame, fractions=(0.10, 0.25, 0.50, 0.75, 1.00), group="family", params=None, seed=42, key="variant_key", keep=()) -> DataFrame:
    """Metrics on val and test after training on a seeded share of the train groups."""
    rest = data.filter(F.col("split") != "train")
    train = data.filter(F.col("split") == "train")
    ranked = cut_lineage(hash_ranks(train.select(group).distinct(), group, seed))

    def scores(f: float) -> DataFrame:
        part = train if f >= 1.0 else group_subsample(train, group, f, seed, ranked).select(*train.columns)
        ready = prepare_rows(part.unionByName(rest), key=key, keep=keep, keyed=False)
        scored = score_held_cells(ready, [grow_prepared(ready, (), params, seed)])
        return scored.select(F.lit(float(f)).alias("fraction"), "split", "y_true", F.col("p0").alias("p_raw"), "_n")

    both = reduce(DataFrame.unionByName, side_by_side([lambda f=f: scores(f) for f in fractions]))
    return ranking_metrics(both, "y_true", "p_raw", ["split", "fraction"], count="_n")


def score_versions(model, features: FeatureModel, versions: dict[str, DataFrame], label="label") -> DataFrame:
    """One fitted model on several versions of the data; metrics per version."""
    out = None
    for name, table in versions.items():
        scored = score_rows(model, features.transform(table))
        rows = ranking_metrics(scored, label, "p_raw").withColumn("version", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
