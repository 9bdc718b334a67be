"""Writers for tables and metric reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from helixframe.constants import COMMON_AF
from helixframe.session import cut_lineage


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), mode="overwrite") -> None:
    """Table snapshot. Sorting inside partitions lets position lookups skip row groups.

    The folders' columns lead the order: the writer needs rows in it, and would sort anew by them alone.
    """
    out = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


#: Rows of a report that go into one file.
REPORT_ROWS = 100_000


def write_metrics_csv(df: DataFrame, path: str, mode="overwrite") -> None:
    """A report of at most REPORT_ROWS rows is one file, a larger one as many as it has partitions.
    It is written and counted first, so the stage that computes it stays parallel."""
    report = cut_lineage(df)
    if report.count() <= REPORT_ROWS:
        report = report.coalesce(1)
    report.write.mode(mode).option("header", True).csv(path)


def af_stat_columns():
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("AF") > COMMON_AF).alias("common"),
        F.count_if(F.col("AF") <= COMMON_AF).alias("rare"),
        F.coalesce(F.avg("AF"), F.lit(0.0)).alias("mean_af"),
    ]


def write_with_stats(df: DataFrame, path: str, mode="append") -> dict:
    """Write an AF table and return its running counts, collected by the same job."""
    seen = Observation("af_stats")
    df.observe(seen, *af_stat_columns()).write.mode(mode).parquet(path)
    return dict(seen.get)
