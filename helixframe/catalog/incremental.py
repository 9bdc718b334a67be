"""Incremental enrichment and streaming ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.catalog.base import R, query, rounded
from helixframe.session import plan_bytes, scratch_path
from helixframe.sources.readers import standardize_af_table
from helixframe.streaming import incremental

C = F.col
SCHEMA = "k bigint, status string, value double"


#: Bytes of a given table for each file of a stream that is made of it.
FILE_BYTES = 32 << 20


def stream_of(t, table: str, rows, name: str):
    """Rows of a given table as a stream of files, half of them in a batch. A larger table makes more files, so
    that no task deals or reads more."""
    path, files = scratch_path(t.spark, name), max(4, -(-plan_bytes(getattr(t, table)) // FILE_BYTES))
    rows.repartition(files).write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 2)).parquet(path)


def resolver(t):
    """Answers from orders: every tenth key fails, customers divisible by seven resolve to nothing."""
    table = t.orders.selectExpr("o_orderkey as k", "o_custkey", "o_orderstatus", "o_totalprice")

    def resolve(misses):
        hit = misses.join(table, "k").filter("k % 10 <> 3")
        nothing = C("o_custkey") % 7 == 0
        return hit.select("k", F.when(~nothing, C("o_orderstatus")).alias("status"), F.when(~nothing, C("o_totalprice")).alias("value"))

    return resolve


@query("incremental_enrich", """SELECT w.k, CASE WHEN o.k % 10 <> 3 AND o.c % 7 <> 0 THEN o.s END status, CASE WHEN o.k % 10 <> 3 AND o.c % 7 <> 0 THEN o.v END AS value, o.k IS NOT NULL AND o.k % 10 <> 3 stored
    FROM (SELECT DISTINCT l_orderkey k FROM lineitem) w LEFT JOIN (SELECT o_orderkey k, o_custkey c, o_orderstatus s, o_totalprice v FROM orders) o USING (k)""")
def _(t):
    path = scratch_path(t.spark, "store")
    wanted = t.lineitem.select(C("l_orderkey").alias("k")).distinct()
    incremental.incremental_enrich(wanted.filter("k % 3 = 0"), path, SCHEMA, resolver(t), "k")
    out = incremental.incremental_enrich(wanted, path, SCHEMA, resolver(t), "k")
    stored = incremental.read_store(t.spark, path, SCHEMA).select("k", F.lit(True).alias("stored"))
    return out.join(stored, "k", "left").select("k", "status", "value", F.coalesce("stored", F.lit(False)).alias("stored"))


@query("stream_enrich", """SELECT count(*) n, count(DISTINCT o_orderkey) n_keys FROM orders WHERE o_orderkey % 10 <> 3 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    path = scratch_path(t.spark, "store")
    stream = stream_of(t, "lineitem", t.lineitem.select(C("l_orderkey").alias("k")), "keys")
    incremental.stream_enrich(stream, path, SCHEMA, resolver(t), scratch_path(t.spark, "progress"), "k")
    return incremental.read_store(t.spark, path, SCHEMA).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("n_keys"))


@query("stream_ingest_stats", f"""SELECT cast(count(*) AS BIGINT) total, count(*) FILTER ("AF" > 1e-2) common, count(*) FILTER ("AF" <= 1e-2) rare, {R('avg("AF")')} mean_af FROM @afall""")
def _(t):
    out, stats = (scratch_path(t.spark, n) for n in ("afout", "afstats"))
    stream = stream_of(t, "lineitem", t.afall.select("variant_key", "AF", "AN", "AC"), "afin")
    incremental.stream_ingest(stream, out, stats, scratch_path(t.spark, "progress"), standardize_af_table)
    return rounded(incremental.ingest_totals(t.spark, stats))
