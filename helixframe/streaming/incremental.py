"""Resumable enrichment and chunked ingestion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.profiling import af_summary
from helixframe.session import cut_lineage
from helixframe.streaming.store import RANGES, KeyedStore


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The stored result, or an empty table before the first run."""
    return KeyedStore(spark, path, schema, "").read()


def incremental_enrich(
    wanted: DataFrame, path: str, schema: str, resolve: Callable[[DataFrame], DataFrame], key="variant_key", ranges=RANGES,
) -> DataFrame:
    """Resolve only keys missing from the store, append them, return the rows of all wanted keys.

    `resolve` returns one row per key it could answer, with NULL fields when the answer is
    "nothing"; those rows are stored and not asked for again. Keys it does not return count as
    failed and are retried by the next call. A null key is a key like others. Only the hash ranges of the
    wanted keys are read, and nothing stored is overwritten: a repeated batch changes nothing.
    """
    store = KeyedStore(wanted.sparkSession, path, schema, key, ranges)
    state = store.manifest()
    keys = cut_lineage(wanted.select(key).distinct())
    among = store.ranges_of(keys, state)
    stored = store.read(among, state).select(F.col(key).alias("_stored"))
    misses = keys.join(stored, F.col(key).eqNullSafe(F.col("_stored")), "left_anti")
    store.append(resolve(misses))
    found = store.read(among).withColumnRenamed(key, "_stored")
    return wanted.join(found, F.col(key).eqNullSafe(F.col("_stored")), "left").drop("_stored")


def stream_enrich(source: DataFrame, path: str, schema: str, resolve, checkpoint: str, key="variant_key"):
    """The same work over a stream of keys, draining what is available.

    A micro-batch that is replayed finds its keys stored; one that broke before its commit left nothing.
    """

    def each(frame: DataFrame, batch_id: int) -> None:
        incremental_enrich(frame, path, schema, resolve, key)

    query = (
        source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def stream_ingest(source: DataFrame, out: str, stats: str, checkpoint: str, standardize: Callable[[DataFrame], DataFrame]) -> None:
    """Standardize each micro-batch, write it to its own folder, and keep its counts.

    Folders are named by batch and overwritten, so a replayed batch changes nothing.
    """

    def each(frame: DataFrame, batch_id: int) -> None:
        rows = standardize(frame)
        target = f"{out}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(target)
        written = frame.sparkSession.read.parquet(target)
        counts = af_summary(written).withColumn("af_count", F.lit(written.filter("AF is not null").count()))
        counts.write.mode("overwrite").parquet(f"{stats}/batch={batch_id}")

    query = (
        source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingest_totals(spark: SparkSession, stats: str) -> DataFrame:
    """Totals over all batches; the mean is weighted by the batch counts."""
    return spark.read.parquet(stats).agg(
        F.sum("total").alias("total"), F.sum("common").alias("common"), F.sum("rare").alias("rare"),
        F.try_divide(F.sum(F.col("mean_af") * F.col("af_count")), F.sum("af_count")).alias("mean_af"),
    )
