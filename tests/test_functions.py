"""Column expressions on small tables of cases."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe import constants as K
from helixframe.functions import families, residues, text, variants


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_norm_chrom(spark):
    cases = {"chr1": "1", "CHRX": "X", "23": "X", "24": "Y", "01": "1", "22": "22", "0": None, "25": None,
             "": None, " ": None, "NA": None, "<NA>": None, ".": None, "MT": "MT", "chrUn_1": "UN_1", None: None, " chr7 ": "7"}
    assert apply(spark, text.norm_chrom, list(cases)) == list(cases.values())


def test_norm_chrom_external(spark):
    cases = {"chrM": "MT", "MT": "MT", "chr99": "99", "nan": "", None: "", "x": "X", "CHR2": "2", "Chr2": "CHR2"}
    assert apply(spark, text.norm_chrom_external, list(cases)) == list(cases.values())


def test_tokens_and_numbers(spark):
    cases = ["1.5;2", ".;3", " 4 , 5", "NA", "", "x", None, "nan", "None;7"]
    assert apply(spark, text.first_token, cases) == ["1.5", None, "4", None, None, "x", None, None, None]
    assert apply(spark, text.as_numeric, cases) == [1.5, None, 4.0, None, None, None, None, None, None]


def test_packed_scores(spark):
    cases = ["0.1;0.9;.", "0.5", ".", "", None, "bad;0.2", ";;0.3"]
    assert apply(spark, text.packed_scores, cases) == [0.9, 0.5, None, None, None, None, 0.3]
    assert apply(spark, lambda c: text.packed_scores(c, smallest=True), cases) == [0.1, 0.5, None, None, None, None, 0.3]


def test_review_stars(spark):
    cases = ["practice guideline", "Reviewed by expert panel", "criteria provided, multiple submitters, no conflicts",
             "criteria provided, multiple submitters", "criteria provided, single submitter",
             "criteria provided, conflicting interpretations", "no assertion", None]
    assert apply(spark, text.review_stars, cases) == [4, 3, 2, 1, 1, 1, 0, 0]


def test_labels(spark):
    cases = [" Pathogenic", "LIKELY BENIGN", "Uncertain", None]
    assert apply(spark, text.canonical_label, cases) == ["Pathogenic", "Likely benign", None, None]
    assert apply(spark, text.binary_label, cases) == [1, 0, None, None]


def test_consequence_membership(spark):
    cases = ["missense_variant", "a, Missense_Variant", "missense_variant_x", "xmissense_variant", None, "missense_variant ,b"]
    assert apply(spark, text.has_consequence, cases) == [True, True, False, False, False, True]


@pytest.mark.parametrize("gene,family", [
    ("KRTAP10", "KRTAP"), ("KRT5", "KRT"), ("HLA-A", "HLA"), ("ZNF12", "ZNF"), ("SLC12A3", "SLC12"), ("CDH1", "CDH"),
    ("PCDHB4", "PCDH"), ("OR2A5", "OR2"), ("RPL3", "RPL"), ("MT-ND1", "MT"), ("FOXA1", "FOXA"), ("FOXA2", "FOXA"),
    ("brca1", "BRCA"), (None, ""), ("123", "123"), ("TRIM5", "TRIM"), ("ANKRD1", "ANKR"),
])
def test_gene_family(spark, gene, family):
    assert apply(spark, families.gene_family, [gene]) == [family]


def test_strata_family_differs(spark):
    assert apply(spark, families.strata_family, ["SLC12A3", "KRTAP10", "RPL3", "KCNQ1"]) == ["SLC", "KRT", "RP", "KCNQ"]


def test_canonical_variant(spark):
    rows = [("chr1", "10", "G>A"), ("1", "x", "G>A"), ("1", "5", "G>G"), ("1", "5", "GA>T"), (None, "5", "G>A"), ("M", "7", " c > t ")]
    df = spark.createDataFrame(rows, "c string, p string, v string")
    out = df.select(variants.canonical_variant(F.col("c"), F.col("p"), change=F.col("v"))["variant_key"].alias("k")).collect()
    assert [r.k for r in out] == ["1:10:G:A", None, None, None, None, "MT:7:C:T"]


def test_info_fields(spark):
    rows = ["AF=0.1,0.2;AC=5;AN=50;DB", "AF=.;AC_AFR=4;AN_AFR=8;AF_eas=0.3", "AF=1;AF=2", "DB"]
    df = spark.createDataFrame([(r,) for r in rows], "info string").withColumn("m", variants.info_map(F.col("info")))
    one = F.lit(1)
    out = df.select(variants.info_alt_value(F.col("m"), "AF", one).alias("af"), variants.info_alt_value(F.col("m"), "AC", one).alias("ac"),
                    variants.af_popmax(F.col("m"), F.lit(0)).alias("pm"), variants.info_scalar(F.col("m"), "AN").alias("an")).collect()
    assert [tuple(r) for r in out] == [(0.2, 5.0, None, 50.0), (None, None, 0.5, None), (1.0, None, None, None), (None, None, None, None)]


def test_matrices_are_symmetric_and_complete():
    b, g = K.triangle_pairs(K.BLOSUM62_TRIANGLE), K.triangle_pairs(K.GRANTHAM_TRIANGLE, 0)
    for m in (b, g):
        assert len(m) == 400 and all(m[x, y] == m[y, x] for x, y in m)
    assert b["W", "W"] == 11 and b["A", "R"] == -1 and g["C", "W"] == 215 and g["L", "I"] == 5
    assert all(g[a, a] == 0 for a in K.RESIDUES)


def test_matrix_fill_keeps_stated_values(spark):
    df = spark.createDataFrame([("A", "R", None), ("A", "R", 7.0), (None, "R", None)], "ref_aa string, alt_aa string, Grantham_distance double")
    out = residues.fill_matrices(df).select("Grantham_distance", "BLOSUM62_score").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(112.0, -1.0), (7.0, -1.0), (None, None)], key=str)


def test_sequence_window_and_skip(spark):
    seq = "".join(K.RESIDUES[i % 20] for i in range(3000))
    df = spark.createDataFrame([(seq, p) for p in (1, 600, 1500, 3000)], "s string, p bigint")
    for r in df.select("p", *[e.alias(n) for n, e in residues.sequence_window(F.col("s"), F.col("p")).items()]).collect():
        assert len(r.window) == 1022 and r.window[r.window_pos - 1] == seq[r.p - 1]
    cases = spark.createDataFrame([("ARN", 2, "R", "A"), ("", 1, "A", "R"), ("ARN", 9, "A", "R"), ("ARN", 1, "R", "A"), ("ARN", 1, "A", "X"), ("ARN", None, "A", "R")], "s string, p bigint, r string, a string")
    got = [r[0] for r in cases.select(residues.score_skip_reason(*[F.col(c) for c in "spra"])).collect()]
    assert got == [None, "no_seq", "bad_pos", "ref_mismatch", "non_canonical_aa", "bad_pos"]


def test_pick_missense(spark):
    schema = "array<struct<id:string,canonical:int,consequence_terms:array<string>>>"
    rows = [([("a", 0, ["missense_variant"]), ("b", 1, ["missense_variant"])],), ([("a", 1, ["intron"]), ("c", 0, ["missense_variant"])],), ([("a", 1, ["intron"])],), (None,)]
    df = spark.createDataFrame(rows, f"t {schema}")
    assert [r[0] for r in df.select(residues.pick_missense(F.col("t"))["id"]).collect()] == ["b", "c", None, None]
    assert [r[0] for r in df.select(residues.pick_any_missense(F.col("t"))["id"]).collect()] == ["a", "c", None, None]


def test_llr(spark):
    df = spark.createDataFrame([(0.5, 0.25), (0.0, 0.5)], "r double, a double")
    got = [r[0] for r in df.select(residues.llr(F.col("r"), F.col("a"))).collect()]
    assert math.isclose(got[0], math.log(0.5)) and math.isclose(got[1], math.log(0.5) - math.log(1e-12))


def student_tail(t, n):
    """Two-sided tail by the finite series for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(n))
    c, s = math.cos(angle), math.sin(angle)
    if n % 2:
        term = total = c
        for k in range(3, n - 1, 2):
            term *= c * c * (k - 1) / k
            total += term
        return 1 - 2 / math.pi * (angle + (s * total if n > 1 else 0.0))
    term = total = 1.0
    for k in range(2, n - 1, 2):
        term *= c * c * (k - 1) / k
        total += term
    return 1 - s * total


def test_student_tail(spark):
    from helixframe.functions.scores import two_sided_student

    rows = [(float(t), n) for n in (1, 2, 3, 4, 5, 10, 17, 50, 99, 100, 301, 1000, 5000, 60001) for t in (0.0, 1e-6, 0.01, 0.3, 1.0, 1.9, 2.5, 4.0, 6.0, 30.0)]
    df = spark.createDataFrame(rows, "t double, n long")
    got = df.select("t", "n", two_sided_student(F.col("t") ** 2 / (F.col("n") + F.col("t") ** 2), F.col("n")).alias("p")).collect()
    assert max(abs(r.p - student_tail(r.t, r.n)) for r in got) < 1e-11
    # tabulated: 5 % points of two-sided tests
    table = {1: 12.706204736, 5: 2.570581836, 10: 2.228138852, 30: 2.042272456, 120: 1.979930405}
    df = spark.createDataFrame([(t, n) for n, t in table.items()], "t double, n long")
    assert all(abs(r[0] - 0.05) < 1e-9 for r in df.select(two_sided_student(F.col("t") ** 2 / (F.col("n") + F.col("t") ** 2), F.col("n"))).collect())
    odd = spark.createDataFrame([(None, 5), (0.5, 0), (0.5, None), (1.5, 4), (0.0, 4), (1.0, 4)], "s double, n long")
    assert [r[0] for r in odd.coalesce(1).select(two_sided_student(F.col("s"), F.col("n"))).collect()] == [None, None, None, None, 1.0, 0.0]
    many = spark.createDataFrame([(1e-10, 10**10)], "s double, n long").select(two_sided_student(F.col("s"), F.col("n"))).first()[0]
    assert abs(many - math.erfc(math.sqrt(0.5))) < 1e-9
