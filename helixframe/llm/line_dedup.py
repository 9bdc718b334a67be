"""Lines that many documents share are dropped everywhere but in one document.

Every line is exploded to (document, position, hash of its normalised form) without its text, which is
written once. Distinct documents are counted for each hash, the hashes over the threshold are joined
back, and each document gets the positions it loses; its text is put together from the slices between
them. Texts are shuffled once, to meet their positions. All of it is built-in expressions.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
LEAST_CHARS = 20
LEAST_DOCS = 3
#: A line that fills more than this part of all line places is joined by broadcast; there are fewer than 4,096.
HOT_PARTS = 4096


def body() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def wide_hash(value: Column) -> list[Column]:
    """128 bits as two integers."""
    return [F.xxhash64(value), F.xxhash64(F.lit(0x5EED), value)]


def line_keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, t1, t2 (hash of the text), pos from 0, h1, h2 (hash of the key) of every line whose key
    has `least_chars` code points: blanks stripped at both ends, A-Z lowered."""
    t1, t2 = wide_hash(body())
    low = F.translate(body(), ascii_uppercase, ascii_lowercase)
    lines = docs.select(F.col("doc_id"), t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split(low, "\n", -1)).alias("pos", "line"))
    keyed = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).filter(F.length("key") >= least_chars)
    h1, h2 = wide_hash(F.col("key"))
    return keyed.select("doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


def repeated_keys(keys: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """h1, h2, n_docs and keeper (largest doc_id) of the keys of at least `least_docs` documents. Spark
    deals the pairs of key and document first, so that a hot key is counted by many tasks."""
    return keys.groupBy("h1", "h2").agg(
        F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper")).filter(F.col("n_docs") >= least_docs)


def dropped_lines(keys: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, t1, t2, pos of the lines to drop; `keys` is a written table.

    Documents per key add up to at most the lines, so fewer than HOT_PARTS keys are held by more than
    a HOT_PARTS-th of them: these are broadcast. Each other key is a small share of its join.
    """
    limit = keys.count() // HOT_PARTS
    found = cut_lineage(repeated_keys(keys, least_docs))
    hot = F.broadcast(found.filter(F.col("n_docs") > limit).select("h1", "h2", "keeper"))
    rest = found.filter(F.col("n_docs") <= limit).select("h1", "h2", "keeper")
    mild = keys.join(hot.drop("keeper"), ["h1", "h2"], "left_anti")
    met = keys.join(hot, ["h1", "h2"]).unionByName(mild.join(rest, ["h1", "h2"]))
    return met.filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper"))).select("doc_id", "t1", "t2", "pos")


def without(lines: Column, gone: Column) -> Column:
    """The lines at other than the sorted positions, joined again: slices between neighbouring positions,
    so the work is linear in the text."""
    before = F.concat(F.array(F.lit(-1)), gone)
    after = F.concat(gone, F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1))), "\n")


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS) -> DataFrame:
    """`docs` with the text that is left, n_lines (before dropping) and n_dropped.

    A line whose key (see `line_keys`) stands in `least_docs` documents is dropped, all its places in a
    document at once, but in the largest doc_id that holds it. Shorter keys are never dropped.
    Null and empty texts are one empty line and come back empty. Rows without a doc_id count as no
    document and keep no repeated line; rows of one doc_id count as one document and are treated
    alike. Every row comes back with its other columns; an input column named n_lines or n_dropped is replaced.
    """
    keys = cut_lineage(line_keys(docs.select("doc_id", "text"), least_chars))
    lost = dropped_lines(keys, least_docs).groupBy("doc_id", "t1", "t2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    lost = lost.select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("gone").alias("_gone"))
    t1, t2 = wide_hash(body())
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), body().alias("text"), t1.alias("t1"), t2.alias("t2"))
    met = rows.join(lost, F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(without(lines, F.col("_gone")))
    own = {"n_lines": F.size(lines).cast("long"), "n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")}
    return met.select(
        *[(kept if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in own],
        *[c.alias(name) for name, c in own.items()])
