"""Merge of the sources: first rows, filters on computed columns, order of frequencies."""

import math

from pyspark.sql import functions as F

from helixframe.functions import text
from helixframe.operators import cleaning, dedup
from helixframe.plans import dataset
from helixframe.session import computed_once


def test_first_row_does_not_depend_on_input_order(spark):
    cells = [("a", 1, "x"), ("a", 1, "w"), ("a", 2, "b"), ("b", None, "z"), ("b", 0, "y")]
    for rows in (cells, cells[::-1]):
        df = spark.createDataFrame(rows, "k string, o int, v string").coalesce(1)
        for order in (["o"], [F.col("o")]):
            out = dedup.keep_first(df, ["k"], order)
            assert out.columns == ["k", "o", "v"] and sorted(map(tuple, out.collect())) == [("a", 1, "w"), ("b", None, "z")]
    maps = df.withColumn("m", F.create_map("k", "v"))
    assert sorted(r.m["b"] for r in dedup.keep_first(maps, ["k"], ["o", "v"]).collect() if r.k == "b") == ["z"]


def test_filters_read_computed_columns(spark):
    raw = spark.createDataFrame(
        [("single nucleotide variant", "missense_variant", "Pathogenic", "practice guideline", "chr7", "na", "12", "a", "g", "TP53")],
        "Type string, MolecularConsequence string, ClinicalSignificance string, ReviewStatus string, Chromosome string, PositionVCF string, Start string, ReferenceAllele string, AlternateAllele string, GeneSymbol string")
    out = cleaning.clean_labels(raw)
    assert [(r.variant_key, r.label) for r in out.collect()] == [("7:12:A:G", 1)]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    filters = [line for line in plan if "Filter" in line]
    assert filters and not any("[0-9]" in line for line in filters)


def test_computed_once_keeps_places(spark):
    df = computed_once(spark.sql("select 1 a, 2 B, 3 c"), {"b": F.col("a") + F.col("c"), "d": F.lit("x")})
    assert df.columns == ["a", "b", "c", "d"] and tuple(df.first()) == (1, 4, 3, "x")


def test_numbers_of_words(spark):
    cells = ["na", "NaN", "inf", "-Infinity", "1e3", " 7 ", "", ".", "\t5", "0x1p3", "I", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(text.to_number(F.col("c"))).collect()] == [
        None, None, math.inf, -math.inf, 1000.0, 7.0, None, None, 5.0, 8.0, None, None]


def test_frequencies_by_an_order_outside_the_result(spark):
    labels = spark.createDataFrame([("k", 1, 0)], "variant_key string, label int, o int")
    ann = spark.createDataFrame([("k", 0.5)], "variant_key string, cons double")
    freq = spark.createDataFrame([("k", 0.1, 2), ("k", 0.2, 1)], "variant_key string, AF double, o1 int")
    for order in (["o1"], [F.col("o1")]):
        out = dataset.merge_sources(labels, ann, freq, ["o"], ["cons"], order)
        assert out.columns == ["variant_key", "label", "o", "cons", "AF", "has_annotation"] and out.first().AF == 0.2
