"""Scans and sinks.

Each query writes text that Spark derives from the given tables into the shared folder and reads
it back with the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.catalog.base import R, REF, RID, ROLES, query, rounded
from helixframe.catalog.filters import DENOVO, DENOVO_ROWS, denovo
from helixframe.catalog.scalars import ALTS, INFO, POPMAX_SQL, RECORDS_SQL, RECS_SQL, JSON, aa_sql, info_alt_sql, info_one_sql, token_sql
from helixframe.functions import residues
from helixframe.functions.variants import is_common, log_af
from helixframe.operators import cleaning, dedup, structure
from helixframe.operators.profiling import af_summary
from helixframe.session import scratch_path
from helixframe.sources import blockgzip, readers, writers

C = F.col


def as_text(t, df, name: str, header=True, sep="\t", ext=".gz") -> str:
    """Delimited gzip text of a table, NULL as an empty cell."""
    path = scratch_path(t.spark, name)
    df.select(*[C(f"`{c}`").cast("string").alias(c) for c in df.columns]).write.option("sep", sep).option(
        "header", header).option("emptyValue", "").option("quote", "\u0000").option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").csv(path)
    return path


def as_lines(t, df, name: str) -> str:
    path = scratch_path(t.spark, name)
    df.select(C(df.columns[0]).alias("value")).write.text(path)
    return path


LAB_COLS = [c for c in ROLES["lab"][1] if c not in ("o1",)]


@query("scan_label_tsv", "SELECT " + ", ".join(f'nullif("{c}", \'\') AS "{c}"' for c in LAB_COLS) + " FROM @lab")
def _(t):
    return readers.read_label_table(t.spark, as_text(t, t.lab.select(*LAB_COLS), "labels"))


AF_OUT = f'SELECT variant_key, rid, "AF", greatest("AF_AFR", "AF_EAS") AS "AF_popmax", "AN", "AC", {R("""log10(coalesce("AF", 0e0) + 1e-8)""")} log_af, coalesce("AF" > 1e-2, false) is_common FROM @af'


@query("scan_af_table", AF_OUT.replace(" rid,", "").replace("FROM @af", "FROM @afall"))
def _(t):
    path = scratch_path(t.spark, "af")
    t.afall.select("variant_key", "AF", "AF_AFR", "AF_EAS", "AN", "AC").write.parquet(path)
    out = readers.read_af_table(t.spark, path)
    return out.withColumn("log_af", F.round("log_AF", 8) + F.lit(0.0)).select("variant_key", "AF", "AF_popmax", "AN", "AC", "log_af", "is_common")


@query("scan_af_table_text", """SELECT chr || ':' || cast(pos AS VARCHAR) || ':' || ref || ':' || alt AS variant_key, f AS "AF", f AS "AF_popmax", NULL::DOUBLE AS "AN", a AS "AC"
    FROM (SELECT chr, pos, ref, alt, "AC" / 100 f, "AC" a FROM @var) WHERE chr IS NOT NULL""")
def _(t):
    raw = t.var.select(F.concat(F.lit("chr"), "chr").alias("#chr"), C("pos").alias("pos(1-based)"), F.lower("ref").alias("Ref"), C("alt").alias("ALT"),
                       (C("AC") / 100).alias("global_af"), C("AC").alias("allele_count"))
    out = readers.read_af_table(t.spark, as_text(t, raw, "aftext", sep=","), "csv", ",")
    return out.select("variant_key", "AF", "AF_popmax", "AN", "AC")


REC = "cast(o_orderkey % 22 + 1 as string) || chr(9) || cast(o_orderkey * 3 + 1 as string) || chr(9) || 'rs' || cast(o_custkey as string) || chr(9) || substr('ACGT', cast(o_custkey % 4 as int) + 1, 1) || chr(9) || {alts} || chr(9) || '50' || chr(9) || 'PASS' || chr(9) || {info}"


VCF_SQL = f"""SELECT cast(o_orderkey % 22 + 1 AS VARCHAR) || ':' || cast(o_orderkey * 3 + 1 AS VARCHAR) || ':' || substr('ACGT', cast(c % 4 AS INT) + 1, 1) || ':' || upper(alt) AS variant_key, allele,
      {info_alt_sql('AF')} AS "AF", {R(POPMAX_SQL)} AS "AF_popmax", {info_one_sql('AN')} AS "AN", {info_alt_sql('AC')} AS "AC", {R(f'log10(coalesce({info_alt_sql("AF")}, 0) + 1e-8)')} AS "log_AF", coalesce({info_alt_sql('AF')} > 1e-2, false) AS is_common
    FROM {RECORDS_SQL} r JOIN (SELECT o_orderkey, o_custkey c FROM orders) USING (o_orderkey)"""


def vcf_lines(t):
    lines = t.orders.selectExpr("'chr' || " + REC.format(alts=ALTS, info=INFO) + " as value")
    header = t.spark.range(1).select(F.lit("##fileformat=VCFv4.2").alias("value")).union(
        t.spark.range(1).select(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")))
    return header.union(lines)


@query("scan_vcf", VCF_SQL)
def _(t):
    return rounded(readers.read_vcf(t.spark, as_lines(t, vcf_lines(t), "vcf")))


@query("scan_vcf_blocks", VCF_SQL)
def _(t):
    path = scratch_path(t.spark, "vcf")
    blockgzip.write_block_gzip(vcf_lines(t), path, header=False)
    return rounded(readers.read_vcf(t.spark, path, fmt="blockgzip"))


ANNOTATION_SQL = f"""SELECT variant_key, {aa_sql('aaref')} ref_aa, {aa_sql('aaalt')} alt_aa, try_cast({token_sql('cons_text')} AS DOUBLE) AS "phyloP100way_vertebrate",
      nullif(regexp_extract(upper({token_sql('ss_text')}), '([HEC])', 1), '') ss, coalesce({token_sql('domain_text')} <> '', false) pfam_domain, NULL::DOUBLE AS "GERP++_RS"
    FROM @annall WHERE variant_key IN (SELECT variant_key FROM @af)"""


def annotation_text(t):
    parts = F.split("variant_key", ":")
    return t.annall.select(
        F.concat(F.lit("chr"), parts[0]).alias("#chr"), parts[1].alias("pos(1-based)"), parts[2].alias("ref"), F.lower(parts[3]).alias("alt"),
        "aaref", "aaalt", C("cons_text").alias("phyloP100way_vertebrate"), C("ss_text").alias("PSIPRED_pred"), C("domain_text").alias("Interpro_domain"),
        C("rid").alias("unused_1"), C("packed").alias("unused_2"))


def annotation_features(out):
    return out.select("variant_key", "ref_aa", "alt_aa", "phyloP100way_vertebrate", C("secondary_structure_prediction").alias("ss"), "pfam_domain", "GERP++_RS")


@query("scan_annotation_pruned", ANNOTATION_SQL)
def _(t):
    return annotation_features(readers.read_annotation(t.spark, as_text(t, annotation_text(t), "annotation"), keys=t.af))


#: Compressed bytes of a range in these queries, so that the files of the small tables are read by several tasks.
RANGE_BYTES = 1 << 17


@query("scan_annotation_blocks", ANNOTATION_SQL)
def _(t):
    path = scratch_path(t.spark, "annotation")
    blockgzip.write_block_gzip(annotation_text(t), path)
    return annotation_features(readers.read_annotation(t.spark, path, "blockgzip", keys=t.af, split_bytes=RANGE_BYTES))


@query("scan_label_blocks", "SELECT " + ", ".join(f'nullif("{c}", \'\') AS "{c}"' for c in LAB_COLS) + " FROM @lab")
def _(t):
    path = scratch_path(t.spark, "labels")
    blockgzip.write_block_gzip(t.lab.select(*LAB_COLS), path)
    return blockgzip.read_block_gzip(t.spark, path, split_bytes=RANGE_BYTES)


@query("scan_gene_constraint", """SELECT gene, "pLI", oe_lof_upper, mis_z FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY oe_lof_upper NULLS LAST, "pLI", mis_z NULLS FIRST) rn
    FROM (SELECT 'N' || cast(s_nationkey AS VARCHAR) gene, s_acctbal / 10000e0 AS "pLI", case when s_suppkey % 5 = 0 then null else cast(s_suppkey % 13 AS DOUBLE) / 10 end oe_lof_upper, case when s_suppkey % 6 = 0 then null else cast(s_suppkey % 9 as double) end mis_z FROM supplier)) WHERE rn = 1""")
def _(t):
    raw = t.supplier.selectExpr("'N' || s_nationkey as gene", "s_name as transcript", "s_acctbal / 10000e0 as pLI", "case when s_suppkey % 5 = 0 then null else cast(s_suppkey % 13 as double) / 10e0 end as oe_lof_upper", "case when s_suppkey % 6 = 0 then null else cast(s_suppkey % 9 as double) end as mis_z")
    return readers.read_gene_constraint(t.spark, as_text(t, raw, "constraint"))


@query("scan_denovo_tsv", f"SELECT variant_key, count(*) n, min(gene) gene, max(label) AS label FROM {DENOVO_ROWS} GROUP BY variant_key")
def _(t):
    path = scratch_path(t.spark, "denovo")
    body = denovo(t).select(F.concat_ws("\t", *[F.coalesce(C(c), F.lit("")) for c in DENOVO]).alias("value"))
    head = t.spark.range(1).select(F.lit("##version=1.6.1").alias("value")).union(t.spark.range(1).select(F.lit("#" + "\t".join(DENOVO))))
    head.coalesce(1).write.text(path)
    body.write.mode("append").text(path)
    rows = cleaning.label_external(readers.read_denovo_table(t.spark, path))
    return rows.groupBy("variant_key").agg(F.count(F.lit(1)).alias("n"), F.min("gene").alias("gene"), F.max("label").alias("label"))


@query("scan_predictor_tsv", f"""SELECT variant_key, score, CASE WHEN score > 0.5 THEN 'likely_pathogenic' ELSE 'likely_benign' END am_class FROM (SELECT variant_key, rid, "AC" / 90 score FROM @var) WHERE variant_key IN (SELECT variant_key FROM @af)""")
def _(t):
    score = C("AC") / 90
    raw = t.var.select(F.concat(F.lit("chr"), "chr"), "pos", "ref", "alt", F.lit("hg38"), F.lit("P1"), C("rid"), F.lit("A1B"), score, F.when(score > 0.5, "likely_pathogenic").otherwise("likely_benign"))
    names = [f"c{i}" for i in range(10)]
    lines = raw.toDF(*names).select(F.concat_ws("\t", *names).alias("value"))
    head = t.spark.range(3).select(F.lit("# header comment").alias("value"))
    out = readers.read_predictor(t.spark, as_lines(t, head.union(lines), "predictor"), t.af)
    return out.withColumnRenamed("am_pathogenicity", "score")


@query("scan_parquet_projected", "SELECT DISTINCT variant_key FROM @var")
def _(t):
    path = scratch_path(t.spark, "keys")
    writers.write_parquet(t.var, path, partition_by=["chr"], sort_by=["pos"])
    return readers.read_keys(t.spark, path)


#: Rows of a file of compressed JSON, which one task reads.
JSON_ROWS = 1_000_000


@query("scan_annotation_json", f"SELECT variant_key, len(recs) n_records, json_extract_string(recs[1], '$.transcript_id') first_transcript, cast(json_extract_string(recs[2], '$.protein_start') AS INTEGER) second_start FROM {RECS_SQL} WHERE recs IS NOT NULL")
def _(t):
    path = scratch_path(t.spark, "json")
    rows = t.lineitem.selectExpr(f"{RID} as k", f"{JSON} as j").filter("j is not null")
    rows.select(F.concat(F.lit('{"variant_key":"'), "k", F.lit('","transcript_consequences":'), "j", F.lit("}")).alias("value")).write.option(
        "compression", "gzip").option("maxRecordsPerFile", JSON_ROWS).text(path)
    tc = C("transcript_consequences")
    return readers.read_annotation_json(t.spark, path).select(
        "variant_key", F.size(tc).cast("bigint").alias("n_records"), F.get(tc, F.lit(0))["transcript_id"].alias("first_transcript"), F.get(tc, F.lit(1))["protein_start"].alias("second_start"))


PDB = "'ATOM  ' || lpad(cast(l_orderkey % 100000 as string), 5, ' ') || ' ' || case when l_linenumber = 6 then ' CB ' else ' CA ' end || ' ' || case when l_suppkey % 2 = 0 then 'ALA' else 'GLY' end || ' A' || lpad(cast(l_orderkey % 9000 as string), 4, ' ') || '    ' || lpad(cast(l_partkey % 61 as string) || '.500', 8, ' ') || lpad(cast(l_orderkey % 53 as string) || '.000', 8, ' ') || lpad('-' || cast(l_linenumber as string) || '.250', 8, ' ') || '  1.00' || lpad(cast(l_partkey % 90 as string) || '.' || cast(10 + l_suppkey % 89 as string), 6, ' ')"
PDB_SQL = f"(SELECT *, row_number() OVER (PARTITION BY sid, pos ORDER BY serial) rn FROM (SELECT cast(l_suppkey AS VARCHAR) || '_' || cast(l_linenumber AS VARCHAR) || '_' || cast(l_partkey AS VARCHAR) sid, cast(l_orderkey % 9000 AS INTEGER) pos, l_orderkey % 100000 serial, l_partkey % 61 + 0.5 x, cast(l_orderkey % 53 AS DOUBLE) y, -(l_linenumber + 0.25) z, cast(cast(l_partkey % 90 AS VARCHAR) || '.' || cast(10 + l_suppkey % 89 AS VARCHAR) AS DOUBLE) bfactor, case when l_suppkey % 2 = 0 then 'ALA' else 'GLY' end residue FROM lineitem WHERE l_linenumber <> 6))"


@query("scan_pdb_atoms", f"SELECT sid structure_id, pos, residue, cast(x AS DOUBLE) x, y, cast(z AS DOUBLE) z, bfactor FROM {PDB_SQL} WHERE rn = 1")
def _(t):
    lines = t.lineitem.selectExpr("l_suppkey || '_' || l_linenumber || '_' || l_partkey as structure_id", f"{PDB} as value")
    path = scratch_path(t.spark, "pdb")
    lines.write.parquet(path)
    return readers.parse_pdb(t.spark.read.parquet(path)).select("structure_id", "pos", "residue", "x", "y", "z", "bfactor")


@query("structure_features", f"""WITH p AS MATERIALIZED (SELECT l_suppkey sid, cast(l_orderkey * 10 + l_linenumber AS BIGINT) * 100000 + l_partkey AS pos, cast(l_partkey % 37 AS DOUBLE) x, cast(l_orderkey % 41 AS DOUBLE) y, cast(l_linenumber * 5 AS DOUBLE) z, l_quantity b FROM lineitem)
    SELECT a.sid structure_id, a.pos, a.b bfactor, {R('(SELECT avg(c.b) FROM p c WHERE c.sid = a.sid AND c.pos BETWEEN a.pos - 5 AND a.pos + 5)')} window_mean, (SELECT count(*) - 1 FROM p c WHERE c.sid = a.sid AND (a.x - c.x) ** 2 + (a.y - c.y) ** 2 + (a.z - c.z) ** 2 <= 25) neighbors FROM p a""")
def _(t):
    atoms = t.lineitem.selectExpr("l_suppkey as structure_id", "cast(l_orderkey * 10 + l_linenumber as bigint) * 100000 + l_partkey as pos", "cast(l_partkey % 37 as double) as x", "cast(l_orderkey % 41 as double) as y", "cast(l_linenumber * 5 as double) as z", "l_quantity as bfactor")
    return rounded(structure.structure_features(atoms))


@query("sink_parquet", "SELECT chr, count(*) n, count(DISTINCT variant_key) n_keys FROM @var GROUP BY chr")
def _(t):
    path = scratch_path(t.spark, "snapshot")
    writers.write_parquet(t.var.select("chr", "pos", "variant_key"), path, partition_by=["chr"], sort_by=["pos"])
    back = t.spark.read.schema("pos bigint, variant_key string, chr string").parquet(path)
    return back.groupBy("chr").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("variant_key").alias("n_keys"))


@query("sink_metrics_csv", f"SELECT split, cast(count(*) AS BIGINT) n, {R('avg(p)')} mean_p FROM @pred GROUP BY split")
def _(t):
    path = scratch_path(t.spark, "metrics")
    writers.write_metrics_csv(rounded(t.pred.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"))), path)
    return t.spark.read.schema("split string, n bigint, mean_p double").option("header", True).csv(path)


STATS = f"""SELECT count(*) total, count(*) FILTER ("AF" > 1e-2) common, count(*) FILTER ("AF" <= 1e-2) rare, {R('coalesce(avg("AF"), 0)')} mean_af FROM @afall"""


@query("sink_with_running_stats", STATS)
def _(t):
    path = scratch_path(t.spark, "afsink")
    rows = t.afall.select("variant_key", "AF", "AN", "AC", log_af(C("AF")).alias("log_AF"), is_common(C("AF")).alias("is_common"))
    stats = writers.write_with_stats(rows, path)
    counted = t.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("total"))
    return rounded(counted.select("total", *[F.lit(stats[k]).cast("bigint" if k != "mean_af" else "double").alias(k) for k in ("common", "rare", "mean_af")]))
