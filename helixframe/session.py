"""Session-level helpers: shared scratch folder, checkpoint, checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_BYTES = 64 << 20
SPREAD_MAX_BYTES = 64 << 20
_local_dirs: dict[str, str] = {}
HOTSPOT_METHOD_BYTES = "8000"


def tune(spark: SparkSession) -> SparkSession:
    """Session settings that suit wide cleaning expressions.

    HotSpot never compiles methods above 8000 bytes of bytecode, so a larger generated stage
    would run interpreted; below the limit Spark keeps whole-stage code, above it falls back to
    per-expression code that is compiled.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", HOTSPOT_METHOD_BYTES)
    return spark


def is_local(spark: SparkSession) -> bool:
    """Driver and tasks in one process, so that they see the same files."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables.

    A cluster names it in `spark.checkpoint.dir`; without that setting a cluster has no folder that
    all executors see, and this raises. Only local sessions get a temporary folder, one for each
    application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        configured = _local_dirs[app]
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: survives executor loss, computed once."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame, columns: dict) -> DataFrame:
    """`withColumns` whose columns are evaluated once for each row, however many filters use them.

    A filter on a plain column is moved below it, with the column's expression written out at each
    use. Filters stay above a generator, here of one row.
    """
    fold = str if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    new = {fold(name): name for name in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if fold(c) not in new]
    row = F.struct(*[e.alias(name) for name, e in columns.items()])
    out = df.select(*kept, row.alias("_once")).select(*kept, F.inline(F.array("_once")))
    names = dict.fromkeys([*[new.get(fold(c), c) for c in df.columns], *columns])
    return out.select(*[F.col(f"`{c}`") for c in names])


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size of a frame; of a written table, that of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_side(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """The written side of a join, with a broadcast hint if its rows fit.

    Rows are counted after writing; a row is taken as its schema's width or its share of the files
    times four, whichever is larger. A larger table is left to the shuffle join.
    """
    written = cut_lineage(df)
    rows = written.count()
    width = sum(8 if f.dataType.typeName() not in ("string", "binary") else 24 for f in written.schema.fields) + 16
    return F.broadcast(written) if max(rows * width, 4 * plan_bytes(written)) <= max_bytes else written


def spread(df: DataFrame, keys) -> DataFrame:
    """Redistribute a small table of fewer partitions than cores (one file of one row group).

    Only tables of at most SPREAD_MAX_BYTES are moved; larger ones are split by the reader.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) > SPREAD_MAX_BYTES or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
