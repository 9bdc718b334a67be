"""How filters of a corpus interact: what each one removes at each place of every order.

A document is reduced to a mask of the filters that it fails, and the table to the counts of each
(part, mask) cell: at most 2**k cells for each part, whatever its size. Each cell folds over the array
of all orders with `transform` and `aggregate`, which gives one struct for each (order, step), weighted
by the cell's counts; the cells of a part are merged by elementwise sums of these structs.

Texts are measured as Arrow columns beside the scan; from there on a document is a digest and a mask, and
everything is built-in expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.words import utf8_buffer

#: All orders of k filters are folded: k! arrays of k structs for each cell.
MOST_FILTERS = 6
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

#: Failure conditions over the columns of `measures`; the last filter of every audit is the one for exact copies.
CHECKS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_upper > 10 * n_chars",
    "D": "n_symbols > 0",
}
COPY = "E"


#: Texts that are measured together hold at most so many bytes, or are one text.
SLICE_BYTES = 1 << 19
#: Word places of a slice are marked in a table of at most so many cells, larger ones are sorted.
MARKS = 1 << 26
UPPER = np.zeros(256, dtype=bool)
UPPER[ord("A"):ord("Z") + 1] = True
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#$%&*|")] = True


def slices(sizes: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > most:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Numbers of each text. Words are cut by Arrow and coded by a dictionary, so equal codes are equal words."""
    data, offsets = utf8_buffer(texts)
    n = len(texts)
    sums = {"n_chars": pc.utf8_length(texts).to_numpy(zero_copy_only=False)}
    for name, wanted in (("n_upper", UPPER), ("n_symbols", SYMBOL)):
        sums[name] = np.diff(np.searchsorted(np.flatnonzero(wanted[data]), offsets))
    cut = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(n), np.diff(cut.offsets.to_numpy()))
    flat = cut.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # blanks at the ends leave empty pieces
    coded = flat.dictionary_encode()
    codes, width = coded.indices.to_numpy(zero_copy_only=False)[real].astype(np.int64), len(coded.dictionary)
    owner = owner[real]
    sums["n_words"] = np.bincount(owner, minlength=n)
    if n * width <= MARKS:
        marked = np.zeros((n, width), dtype=bool)
        marked[owner, codes] = True
        sums["n_distinct"] = np.count_nonzero(marked, axis=1)
    else:
        sums["n_distinct"] = np.bincount(np.unique(owner * width + codes) // width, minlength=n)
    return sums


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text, and what the checks read: n_words, n_distinct (maximal runs of
    characters other than `[\\x20\\x09-\\x0D]`, case-sensitive), n_chars (code points), n_upper (A-Z), n_symbols."""
    numbers = ("n_words", "n_distinct", "n_chars", "n_upper", "n_symbols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            for low, high in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                part = texts.slice(low, high - low)
                sums = measure(part)
                digests = [hashlib.sha256(t.as_buffer()).digest() for t in part]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(digests, pa.binary()),
                    *[pa.array(sums[n], pa.int64()) for n in numbers]], names=["doc_id", "part", "digest", *numbers])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text"))
    return rows.mapInArrow(run, "doc_id bigint, part string, digest binary, " + ", ".join(f"{n} bigint" for n in numbers))


def failures(docs: DataFrame, checks: Mapping[str, str] = CHECKS) -> DataFrame:
    """doc_id, part, digest and mask of each document: bit i is set where check i fails. The bit of
    exact copies is left to `mask_cells`."""
    mask = F.lit(0)
    for i, check in enumerate(checks.values()):
        mask = mask + F.when(F.expr(check), 1 << i).otherwise(0)
    return measures(docs).select("doc_id", "part", "digest", mask.alias("mask"))


def mask_cells(failed: DataFrame, labels: DataFrame, copy_bit: int) -> DataFrame:
    """part, mask, n, good, toxic: the counts of each cell.

    A text's copies share a digest, and so the bits of all other checks: they are counted by digest
    and part before they meet, and only the rows of the smallest doc_id are no copies. No step gathers
    the copies themselves.
    """
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.select(F.col("doc_id").alias("_id"), F.lit(0).alias("_s"), "good", "toxic")
    # rows without an id match no label; they are dealt by their digest
    rows = failed.withColumns({
        "key": F.coalesce(F.col("doc_id"), F.lit(0).cast("long")),
        "salt": F.when(F.col("doc_id").isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64("digest"), F.lit(1 << 20)).cast("int")),
    })
    marked = rows.join(marks, (F.col("key") == F.col("_id")) & (F.col("salt") == F.col("_s")), "left").withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)) for c in ("good", "toxic")})
    kinds = ["digest", "part", "mask", "good", "toxic"]
    by_id = marked.groupBy("key", "salt", *kinds).agg(F.count(F.lit(1)).alias("k"))
    known = F.when(F.col("salt") == 0, F.col("key"))
    counted = by_id.groupBy(*kinds).agg(
        F.sum("k").alias("n"), F.min(known).alias("first"), F.min_by("k", known).alias("n_first"),
        F.sum(F.when(F.col("salt") == 0, 0).otherwise(F.col("k"))).alias("n_unknown"))
    smallest = F.min("first").over(Window.partitionBy("digest"))
    originals = F.col("n_unknown") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = counted.withColumn("least", smallest).withColumn("originals", originals).select(
        "part", "good", "toxic", F.inline(F.array(
            F.struct(F.col("mask").alias("mask"), F.col("originals").alias("n")),
            F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("originals")).alias("n")))))
    return split.filter("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def fold_cell(letters: str) -> Column:
    """One struct for each order and step of a cell with columns mask, n, good and toxic.

    The fold along an order carries whether the cell's documents are still there.
    """
    orders = F.split(F.lit(" ".join("".join(p) for p in permutations(letters))), " ")

    def one_order(order: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            bit = F.element_at(F.create_map(*[x for k, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << k))]), order.substr(i, F.lit(1)))
            fails = F.col("mask").bitwiseAND(bit) != 0
            removed, kept = acc["alive"] & fails, acc["alive"] & ~fails

            def weighed(flag: Column, weight: str = "n") -> Column:
                return F.when(flag, F.col(weight)).otherwise(F.lit(0).cast("long"))

            here = F.struct(
                order.alias("filter_order"), i.alias("step"), weighed(kept).alias("kept"), weighed(removed).alias("removed"),
                weighed(fails & ~acc["alive"]).alias("redundant"), weighed(F.col("mask") == bit).alias("unique_fails"),
                weighed(removed, "good").alias("good_lost"), weighed(removed, "toxic").alias("toxic_lost"))
            return F.struct(kept.alias("alive"), F.concat(acc["steps"], F.array(here)).alias("steps"))

        fields = "filter_order:string,step:int," + ",".join(f"{c}:bigint" for c in COUNTS)
        start = F.struct(F.lit(True).alias("alive"), F.array().cast(f"array<struct<{fields}>>").alias("steps"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(letters))), start, step, lambda acc: acc["steps"])

    return F.flatten(F.transform(orders, one_order))


def audit_filters(docs: DataFrame, labels: DataFrame, checks: Mapping[str, str] = CHECKS, copy: str = COPY) -> DataFrame:
    """One row for each part (value of lang), order of the filters and step.

    kept, removed and redundant count the part's documents after, at and before that step; unique_fails
    those that fail this filter only; good_lost and toxic_lost the removed ones that `labels` marks with
    quality or toxic 1; shapley what the filter removes in all orders together, at any step.

    `checks` maps one-letter names to failure conditions (see `measures`); `copy` names the check for a
    text equal to that of a smaller doc_id, kept or not. Null texts are empty, null lang is the part '',
    null labels mark nothing, and a document with several label rows is marked if any of them marks it.
    Rows without a doc_id are counted, carry no label and are never copies nor have copies; rows of
    one doc_id are no copies of each other. Other columns are not read. No documents, no rows.
    """
    letters = "".join([*checks, copy])
    if len(letters) > MOST_FILTERS or len(set(letters)) < len(letters) or any(len(c) != 1 for c in [*checks, copy]):
        raise ValueError(f"at most {MOST_FILTERS} filters of distinct one-letter names")
    cells = mask_cells(failures(docs, checks), labels.select("doc_id", "quality", "toxic"), 1 << len(checks))
    folded = cells.select("part", F.inline(fold_cell(letters)))
    merged = folded.groupBy("part", "filter_order", "step").agg(*[F.sum(c).alias(c) for c in COUNTS])
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return merged.withColumn("_letter", letter).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_letter"))).select(
        "part", "filter_order", "step", *COUNTS, "shapley")
