"""Readers. Text sources are read as strings and cast; nothing is inferred.

Block-gzip files (`fmt="blockgzip"`) are read by byte ranges, one file by many tasks; a plain gzip file is
one task. Tables that are read often should be converted to Parquet once
(`writers.write_parquet(..., partition_by=["chr"])`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe import constants as K
from helixframe.functions import text as X
from helixframe.functions import variants as V
from helixframe.functions.residues import norm_aa
from helixframe.operators.dedup import most_constrained
from helixframe.sources import blockgzip


def string_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def header_of(spark: SparkSession, path: str, sep="\t") -> list[str]:
    """Column names from the first line of the first file."""
    return spark.read.text(path).first()[0].split(sep)


def read_delimited(spark, path, columns: Sequence[str] | None = None, sep="\t", comment=None) -> DataFrame:
    """Delimited text with a header, all columns as strings, empty cells NULL.

    Without `columns` the names come from the first file, and every file's header is compared with
    them: a folder whose files differ in their columns raises.
    """
    names = header_of(spark, path, sep) if columns is None else list(columns)
    reader = spark.read.option("sep", sep).option("header", True).option("enforceSchema", columns is not None)
    if comment:
        reader = reader.option("comment", comment)
    return reader.schema(string_schema(names)).csv(path)


def read_label_table(spark, path, sep="\t") -> DataFrame:
    return read_delimited(spark, path, sep=sep)


def resolve_columns(available: Sequence[str], wanted: dict[str, Sequence[str]]) -> dict[str, str | None]:
    """Canonical name -> source column: exact match first, then by letters and digits only."""

    def bare(name):
        return "".join(ch for ch in name.lower() if ch.isalnum())

    loose = {bare(c): c for c in available}
    out: dict[str, str | None] = {}
    for name, candidates in wanted.items():
        hits = (c if c in available else loose.get(bare(c)) for c in candidates)
        out[name] = next((h for h in hits if h), None)
    return out


# --- Fixed values: accepted column spellings ---
AF_ALIASES = {
    "variant_key": ("variant_key", "variant key"),
    "chr": ("chr", "chrom", "chromosome", "#chr"),
    "pos": ("pos", "position", "pos(1-based)", "start"),
    "ref": ("ref", "referenceallele", "reference", "referenceallelevcf"),
    "alt": ("alt", "alternateallele", "alternate", "alternateallelevcf"),
    "AF": ("AF", "allele_frequency", "global_af", "gnomad_af"),
    "AF_popmax": ("AF_popmax", "popmax_af", "af_popmax"),
    "AN": ("AN", "allele_number", "sample_size"),
    "AC": ("AC", "allele_count"),
}
ANNOTATION_ALIASES = {
    "chr": ("#chr", "chr"),
    "pos": ("pos(1-based)", "pos"),
    "ref": ("ref",),
    "alt": ("alt",),
    "ref_aa": ("aaref",),
    "alt_aa": ("aaalt",),
    "phyloP100way_vertebrate": ("phyloP100way_vertebrate",),
    "phyloP30way_mammalian": ("phyloP30way_mammalian", "phyloP470way_mammalian"),
    "phastCons100way_vertebrate": ("phastCons100way_vertebrate",),
    "phastCons30way_mammalian": ("phastCons30way_mammalian", "phastCons470way_mammalian"),
    "GERP++_RS": ("GERP++_RS",),
    "GERP++_NR": ("GERP++_NR",),
    "SiPhy_29way_logOdds": ("SiPhy_29way_logOdds",),
    "Grantham_distance": ("Grantham",),
    "BLOSUM62_score": ("BLOSUM62",),
    "secondary_structure_prediction": ("PSIPRED_pred", "PSIPRED2_pred", "secondary_structure"),
    "solvent_accessibility": ("ASAquick", "solvent_accessibility", "RSA"),
    "disorder_prediction_score": ("disorder_score", "IUPred_score", "VSL2_score"),
    "pfam_domain": ("Pfam_domain", "Interpro_domain"),
}


def af_popmax_table(df: DataFrame, overall="AF"):
    """Row maximum over the population AF columns that exist, else the overall AF."""
    wanted = {p: (f"AF_{p}", f"AF_{p.lower()}", f"af{p.lower()}") for p in K.POPULATIONS}
    found = [c for c in resolve_columns(df.columns, wanted).values() if c]
    values = [X.to_number(F.col(f"`{c}`")) for c in found]
    if not values:
        return F.col(overall)
    return values[0] if len(values) == 1 else F.greatest(*values)


def standardize_af_table(df: DataFrame) -> DataFrame:
    """Any AF table to `variant_key, AF, AF_popmax, AN, AC, log_AF, is_common`."""
    at = resolve_columns(df.columns, AF_ALIASES)

    def number(name):
        return X.to_number(F.col(f"`{at[name]}`")) if at[name] else F.lit(None).cast("double")

    if at["variant_key"]:
        key = F.col(f"`{at['variant_key']}`").cast("string")
    elif all(at[n] for n in ("chr", "pos", "ref", "alt")):
        ref, alt = (F.upper(F.trim(F.coalesce(F.col(f"`{at[n]}`"), F.lit("")))) for n in ("ref", "alt"))
        key = V.variant_key(X.norm_chrom(F.col(f"`{at['chr']}`")), number("pos").cast("bigint"), ref, alt)
    else:
        raise ValueError("AF table needs variant_key or chr/pos/ref/alt columns")
    base = df.withColumns({"_key": key, "_af": number("AF"), "_an": number("AN"), "_ac": number("AC")})
    popmax = number("AF_popmax") if at["AF_popmax"] else af_popmax_table(base, "_af")
    return base.select(
        F.col("_key").alias("variant_key"), F.col("_af").alias("AF"), popmax.alias("AF_popmax"),
        F.col("_an").alias("AN"), F.col("_ac").alias("AC"),
        V.log_af(F.col("_af")).alias("log_AF"), V.is_common(F.col("_af")).alias("is_common"),
    ).filter(F.coalesce(F.length("variant_key"), F.lit(0)) > 0)


def read_af_table(spark, path, fmt="parquet", sep="\t") -> DataFrame:
    raw = spark.read.parquet(path) if fmt == "parquet" else read_delimited(spark, path, sep=sep)
    return standardize_af_table(raw)


def parse_vcf(lines: DataFrame, column="value") -> DataFrame:
    """VCF text lines to one row per (record, alternate allele) with frequency columns."""
    cells = F.split(F.col(column), "\t")
    records = lines.filter(~F.col(column).startswith("#") & (F.size(cells) >= 8)).select(
        X.norm_chrom(cells[0]).alias("chr"),
        cells[1].try_cast("bigint").alias("pos"),
        F.upper(cells[3]).alias("ref"),
        V.info_map(cells[7]).alias("info"),
        F.posexplode(F.split(cells[4], ",")).alias("allele", "alt"),
    )
    i = F.col("allele")
    af = V.info_alt_value(F.col("info"), "AF", i)
    return records.filter(~F.col("alt").isin("", ".")).select(
        V.variant_key(F.col("chr"), F.col("pos"), F.col("ref"), F.upper("alt")).alias("variant_key"),
        "allele",
        af.alias("AF"),
        V.af_popmax(F.col("info"), i).alias("AF_popmax"),
        V.info_scalar(F.col("info"), "AN").alias("AN"),
        V.info_alt_value(F.col("info"), "AC", i).alias("AC"),
        V.log_af(af).alias("log_AF"),
        V.is_common(af).alias("is_common"),
    ).filter(F.col("variant_key").isNotNull())


def read_vcf(spark, path, keys: DataFrame | None = None, fmt="text") -> DataFrame:
    rows = parse_vcf(blockgzip.read_block_lines(spark, path) if fmt == "blockgzip" else spark.read.text(path))
    return rows if keys is None else rows.join(keys.select("variant_key"), "variant_key", "left_semi")


def standardize_annotation(df: DataFrame, keys: DataFrame | None = None, aliases=None) -> DataFrame:
    """Wide annotation rows to keyed features. The key filter runs before the feature columns
    are computed; unmapped features are NULL."""
    at = resolve_columns(df.columns, aliases or ANNOTATION_ALIASES)
    missing = [n for n in ("chr", "pos", "ref", "alt") if not at[n]]
    if missing:
        raise ValueError(f"annotation table lacks key columns: {missing}")
    col = {n: F.col(f"`{c}`") if c else F.lit(None).cast("string") for n, c in at.items()}
    used = sorted({c for c in at.values() if c})
    parts = {
        "_chr": X.norm_chrom(col["chr"]), "_pos": X.as_numeric(col["pos"]).cast("bigint"),
        "_ref": F.upper(X.first_token(col["ref"])), "_alt": F.upper(X.first_token(col["alt"])),
    }
    # the parts are columns first, so that the key reads each of them as often as it likes
    rows = df.select(*[F.col(f"`{c}`") for c in used], *[e.alias(n) for n, e in parts.items()])
    rows = rows.select(*[F.col(f"`{c}`") for c in used], V.variant_key(*[F.col(n) for n in parts]).alias("variant_key"))
    rows = rows.filter(F.col("variant_key").isNotNull())
    if keys is not None:
        rows = rows.join(keys.select("variant_key"), "variant_key", "left_semi")
    special = {
        "ref_aa": norm_aa, "alt_aa": norm_aa,
        "secondary_structure_prediction": X.secondary_structure,
        "solvent_accessibility": X.first_token,
        "pfam_domain": X.domain_present,
    }
    features = [n for n in at if n not in ("chr", "pos", "ref", "alt")]
    return rows.select(
        "variant_key", *[special.get(n, X.as_numeric)(col[n]).alias(n) for n in features]
    )


def read_annotation(spark, path, fmt="csv", sep="\t", keys=None, split_bytes=blockgzip.SPLIT_BYTES) -> DataFrame:
    """Keyed features of a wide table. Of block-gzip text only the columns in use are cut."""
    if fmt == "blockgzip":
        names = blockgzip.read_block_gzip(spark, path, sep=sep).columns
        used = sorted({c for c in resolve_columns(names, ANNOTATION_ALIASES).values() if c})
        raw = blockgzip.read_block_gzip(spark, path, used, sep, split_bytes)
    else:
        raw = spark.read.parquet(path) if fmt == "parquet" else read_delimited(spark, path, sep=sep)
    return standardize_annotation(raw, keys)


def read_gene_constraint(spark, path, sep="\t", fmt="csv") -> DataFrame:
    """Gene and its constraint metrics, one row per gene."""
    raw = blockgzip.read_block_gzip(spark, path, sep=sep) if fmt == "blockgzip" else read_delimited(spark, path, sep=sep)
    have = [c for c in K.CONSTRAINT_COLUMNS if c in raw.columns]
    rows = raw.select("gene", *[X.to_number(F.col(c)).alias(c) for c in have])
    return most_constrained(rows, have)


def read_denovo_table(spark, path) -> DataFrame:
    """External TSV with an optional `##` line and a `#`-prefixed header, all strings."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("##"))
    marked = lines.filter(F.col("value").startswith("#")).first()
    header = (marked or lines.first())[0]
    names = [n.lstrip("#") for n in header.split("\t")]
    cells = F.split(F.col("value"), "\t", -1)
    body = lines.filter(F.col("value") != header)
    return body.select(*[F.nullif(F.get(cells, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


PREDICTOR_SCHEMA = (
    "chrom string, pos bigint, ref string, alt string, genome string, uniprot_id string, "
    "transcript_id string, protein_variant string, am_pathogenicity double, am_class string"
)


def read_predictor(spark, path, keys: DataFrame | None = None) -> DataFrame:
    """Header-less predictor TSV with `#` comment lines, keyed, optionally cut to `keys`."""
    raw = spark.read.option("sep", "\t").option("comment", "#").schema(PREDICTOR_SCHEMA).csv(path)
    rows = raw.select(
        V.variant_key(X.norm_chrom_external(F.col("chrom")), F.col("pos"), F.upper("ref"), F.upper("alt")).alias("variant_key"),
        "am_pathogenicity", "am_class",
    ).filter(F.col("variant_key").isNotNull())
    return rows if keys is None else rows.join(keys.select("variant_key"), "variant_key", "left_semi")


def read_keys(spark, path, key="variant_key") -> DataFrame:
    """Distinct keys; only that column is read."""
    return spark.read.parquet(path).select(key).filter(F.col(key).isNotNull()).distinct()


CONSEQUENCE_SCHEMA = (
    "array<struct<transcript_id:string,canonical:int,consequence_terms:array<string>,"
    "amino_acids:string,protein_start:int,sift_score:double,polyphen_score:double,"
    "phylop100way_vertebrate:string,phastcons100way_vertebrate:string,"
    "`gerp++_rs`:string,`gerp++_nr`:string>>"
)


def parse_annotation_json(df: DataFrame, column="json") -> DataFrame:
    """Nested consequence text to `variant_key, transcript_consequences`."""
    return df.withColumn("transcript_consequences", F.from_json(column, CONSEQUENCE_SCHEMA)).drop(column)


def read_annotation_json(spark, path) -> DataFrame:
    schema = f"variant_key string, transcript_consequences {CONSEQUENCE_SCHEMA}"
    return spark.read.schema(schema).json(path)


def parse_pdb(lines: DataFrame, column="value", structure="structure_id") -> DataFrame:
    """Fixed-width ATOM lines to CA residues with coordinates and B-factor.

    Alternate locations of a residue collapse to the first serial number.
    """
    line = F.col(column)

    def cut(start, stop):
        return F.trim(F.substring(line, start, stop - start + 1))

    atoms = lines.filter(line.startswith("ATOM") & (cut(13, 16) == "CA")).select(
        structure,
        cut(7, 11).try_cast("int").alias("serial"),
        cut(18, 20).alias("residue"),
        cut(22, 22).alias("chain"),
        cut(23, 26).try_cast("int").alias("pos"),
        cut(31, 38).try_cast("double").alias("x"),
        cut(39, 46).try_cast("double").alias("y"),
        cut(47, 54).try_cast("double").alias("z"),
        cut(61, 66).try_cast("double").alias("bfactor"),
    )
    from helixframe.operators.dedup import keep_first

    return keep_first(atoms.filter(F.col("pos").isNotNull()), [structure, "chain", "pos"], ["serial"]).drop("serial")


def read_pdb(spark, path) -> DataFrame:
    """All structures under a path; the file name is the structure id."""
    lines = spark.read.text(path).withColumn(
        "structure_id", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.pdb.*$", "")
    )
    return parse_pdb(lines)
