"""Fixed domain values. Everything here is a published constant or a documented default."""

from __future__ import annotations

# --- Fixed values: missing-value spellings -------------------------------------------------
CHROM_NULL_TOKENS = ("NA", "NAN", "NONE", "NULL", "<NA>", ".", "-")
ALLELE_NULL_TOKENS = ("", "NA", "NAN", "NONE", "NULL", ".", "-")
CELL_NULL_TOKENS = ("", ".", "NA", "N/A", "nan", "None")

# --- Fixed values: residues ----------------------------------------------------------------
# residue, hydrophobicity, molecular_weight, pI, volume, polarity, charge
RESIDUE_PROPERTIES = (
    ("A", 1.8, 89.09, 6.00, 88.6, 8.1, 0.0),
    ("R", -4.5, 174.20, 10.76, 173.4, 10.5, 1.0),
    ("N", -3.5, 132.12, 5.41, 114.1, 11.6, 0.0),
    ("D", -3.5, 133.10, 2.77, 111.1, 13.0, -1.0),
    ("C", 2.5, 121.15, 5.07, 108.5, 5.5, 0.0),
    ("Q", -3.5, 146.15, 5.65, 143.8, 10.5, 0.0),
    ("E", -3.5, 147.13, 3.22, 138.4, 12.3, -1.0),
    ("G", -0.4, 75.07, 5.97, 60.1, 9.0, 0.0),
    ("H", -3.2, 155.16, 7.59, 153.2, 10.4, 0.0),
    ("I", 4.5, 131.17, 6.02, 166.7, 5.2, 0.0),
    ("L", 3.8, 131.17, 5.98, 166.7, 4.9, 0.0),
    ("K", -3.9, 146.19, 9.74, 168.6, 11.3, 1.0),
    ("M", 1.9, 149.21, 5.74, 162.9, 5.7, 0.0),
    ("F", 2.8, 165.19, 5.48, 189.9, 5.2, 0.0),
    ("P", -1.6, 115.13, 6.30, 112.7, 8.0, 0.0),
    ("S", -0.8, 105.09, 5.68, 89.0, 9.2, 0.0),
    ("T", -0.7, 119.12, 5.60, 116.1, 8.6, 0.0),
    ("W", -0.9, 204.23, 5.89, 227.8, 5.4, 0.0),
    ("Y", -1.3, 181.19, 5.66, 193.6, 6.2, 0.0),
    ("V", 4.2, 117.15, 5.96, 140.0, 5.9, 0.0),
)
PROPERTY_NAMES = ("hydrophobicity", "molecular_weight", "pI", "volume", "polarity", "charge")
RESIDUES = tuple(row[0] for row in RESIDUE_PROPERTIES)

THREE_LETTER = (
    ("ALA", "A"), ("ARG", "R"), ("ASN", "N"), ("ASP", "D"), ("CYS", "C"),
    ("GLN", "Q"), ("GLU", "E"), ("GLY", "G"), ("HIS", "H"), ("ILE", "I"),
    ("LEU", "L"), ("LYS", "K"), ("MET", "M"), ("PHE", "F"), ("PRO", "P"),
    ("SER", "S"), ("THR", "T"), ("TRP", "W"), ("TYR", "Y"), ("VAL", "V"),
)

RESIDUE_CLASS = (
    ("A", "non-polar"), ("V", "non-polar"), ("L", "non-polar"), ("I", "non-polar"),
    ("M", "non-polar"), ("P", "non-polar"),
    ("S", "polar"), ("T", "polar"), ("N", "polar"), ("Q", "polar"), ("C", "polar"),
    ("K", "positive"), ("R", "positive"), ("H", "positive"),
    ("D", "negative"), ("E", "negative"),
    ("F", "aromatic"), ("Y", "aromatic"), ("W", "aromatic"),
    ("G", "special"),
)
CLASS_NAMES = ("polar", "non-polar", "positive", "negative", "aromatic", "special")

# --- Fixed values: BLOSUM62 (Henikoff & Henikoff 1992), lower triangle with diagonal; the matrix is symmetric ---
BLOSUM62_TRIANGLE = """
A  4
R -1  5
N -2  0  6
D -2 -2  1  6
C  0 -3 -3 -3  9
Q -1  1  0  0 -3  5
E -1  0  0  2 -4  2  5
G  0 -2  0 -1 -3 -2 -2  6
H -2  0  1 -1 -3  0  0 -2  8
I -1 -3 -3 -3 -1 -3 -3 -4 -3  4
L -1 -2 -3 -4 -1 -2 -3 -4 -3  2  4
K -1  2  0 -1 -3  1  1 -2 -1 -3 -2  5
M -1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5
F -2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6
P -1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7
S  1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4
T  0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5
W -3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11
Y -2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7
V  0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4
"""

# --- Fixed values: Grantham (1974) distances, lower triangle; the diagonal is zero and the matrix symmetric ---
GRANTHAM_TRIANGLE = """
A
R 112
N 111  86
D 126  96  23
C 195 180 139 154
Q  91  43  46  61 154
E 107  54  42  45 170  29
G  60 125  80  94 159  87  98
H  86  29  68  81 174  24  40  98
I  94  97 149 168 198 109 134 135  94
L  96 102 153 172 198 113 138 138  99   5
K 106  26  94 101 202  53  56 127  32 102 107
M  84  91 142 160 196 101 126 127  87  10  15  95
F 113  97 158 177 205 116 140 153 100  21  22 102  28
P  27 103  91 108 169  76  93  42  77  95  98 103  87 114
S  99 110  46  65 112  68  80  56  89 142 145 121 135 155  74
T  58  71  65  85 149  42  65  59  47  89  92  78  81 103  38  58
W 148 101 174 181 215 130 152 184 115  61  61 110  67  40 147 177 128
Y 112  77 143 160 194  99 122 147  83  33  36  85  36  22 110 144  92  37
V  64  96 133 152 192  96 121 109  84  29  32  97  21  50  68 124  69  88  55
"""

# --- Fixed values: symbol prefixes that define a paralog family (first match wins) ---------
# (pattern, family name or None to use capture group 1)
SPLIT_FAMILIES = (
    (r"^KRTAP\d+", "KRTAP"),
    (r"^KRT\d+", "KRT"),
    (r"^HLA-", "HLA"),
    (r"^ZNF\d+", "ZNF"),
    (r"^(SLC\d+)A\d+", None),
    (r"^CDH\d+", "CDH"),
    (r"^PCDH\w*", "PCDH"),
    (r"^TRIM\d+", "TRIM"),
    (r"^TMEM\d+", "TMEM"),
    (r"^CCDC\d+", "CCDC"),
    (r"^LRRC\d+", "LRRC"),
    (r"^ANKR\w+", "ANKR"),
    (r"^(OR\d+)\w\d+", None),
    (r"^RPL\d+", "RPL"),
    (r"^RPS\d+", "RPS"),
    (r"^MT-", "MT"),
)
STRATA_FAMILIES = (
    (r"^(KRT[A-Z]*)\d+", "KRT"),
    (r"^(CDH)\d+", "CDH"),
    (r"^(HLA)-", "HLA"),
    (r"^(ZNF)\d+", "ZNF"),
    (r"^(OR[0-9]+[A-Z]+)\d*", None),
    (r"^(RP[LS])\d+", "RP"),
    (r"^(MT-)", "MT"),
    (r"^(SLC)\d+", "SLC"),
    (r"^(TMEM)\d+", "TMEM"),
    (r"^(COL)\d+", "COL"),
    (r"^(USH)\d+", "USH"),
    (r"^(DNAH)\d+", "DNAH"),
    (r"^(KCN[A-Z]+)\d+", None),
    (r"^(MYH)\d+", "MYH"),
    (r"^(MUC)\d+", "MUC"),
    (r"^(ABCA)\d+", "ABCA"),
)

# --- Fixed values: label cleaning ----------------------------------------------------------
VARIANT_TYPE = "single nucleotide variant"
CONSEQUENCE = "missense_variant"
CONSEQUENCE_MIN_RATIO = 0.1
POSITIVE_LABELS = ("Pathogenic", "Likely pathogenic")
NEGATIVE_LABELS = ("Benign", "Likely benign")
ALLOWED_CHROMOSOMES = tuple(str(i) for i in range(1, 23)) + ("X", "Y")
MISSENSE_CLASSES = ("missense", "missense-near-splice")
AFFECTED_PHENOTYPES = (
    "autism", "autismSpectrumDisorder", "developmentalDisorder", "intellectualDisability",
    "epilepsy", "schizophrenia", "congenitalHeartDisease", "congenital_heart_disease",
    "developmental_disorder", "intellectual_disability", "autism_spectrum_disorder",
)
CONTROL_PHENOTYPES = (
    "control", "controls", "siblingcontrol", "sibling", "unaffectedSibling", "unaffected",
)

# --- Fixed values: allele frequency --------------------------------------------------------
POPULATIONS = ("AFR", "AMR", "ASJ", "EAS", "FIN", "NFE", "SAS")
AF_EPSILON = 1e-8
COMMON_AF = 0.01

# --- Fixed values: annotation columns ------------------------------------------------------
CONSERVATION_COLUMNS = (
    "phyloP100way_vertebrate", "phyloP30way_mammalian", "phastCons100way_vertebrate",
    "phastCons30way_mammalian", "GERP++_RS", "GERP++_NR", "SiPhy_29way_logOdds",
)
CONSTRAINT_COLUMNS = ("pLI", "oe_lof_upper", "mis_z", "oe_mis_upper", "lof_z")
BANNED_PREDICTORS = (
    "REVEL", "ClinPred", "MetaLR", "MetaSVM", "MetaRNN", "BayesDel", "VEST4", "M-CAP",
)
ID_COLUMNS = (
    "variant_key", "chr", "pos", "ref", "alt", "gene", "label", "review_stars",
    "ClinicalSignificance", "PhenotypeIDS",
)
NON_MODEL_COLUMNS = ID_COLUMNS + ("is_common",)
IMPUTE_FLAG_COLUMNS = (
    "AF", "AF_popmax", "log_AF", "phyloP100way_vertebrate", "phastCons100way_vertebrate",
    "GERP++_RS", "Grantham_distance", "BLOSUM62_score",
)
# Lower rank is kept when two correlated columns of one family have equal missingness.
CONSERVATION_RANK = (("phylop", 0), ("phastcons", 1), ("gerp", 2))
SUBSTITUTION_RANK = (("grantham", 0), ("blosum", 1))
# Defaults for fields that the nested consequence records do not carry.
CONSEQUENCE_FIELDS = (
    ("phylop100way_vertebrate", "phyloP100way_vertebrate"),
    ("phastcons100way_vertebrate", "phastCons100way_vertebrate"),
    ("gerp++_rs", "GERP++_RS"),
    ("gerp++_nr", "GERP++_NR"),
)
CONSEQUENCE_DEFAULTS = (
    ("phyloP30way_mammalian", 2.791), ("phastCons30way_mammalian", 0.999), ("pfam_domain", 0.0),
    ("AF_popmax", 0.0), ("AN", 0.0), ("AC", 0.0), ("log_AF", -8.0),
)
CONSEQUENCE_FLAGS = (
    "is_imputed_phyloP100way_vertebrate", "is_imputed_phastCons100way_vertebrate",
    "is_imputed_GERP++_RS", "is_imputed_Grantham_distance", "is_imputed_BLOSUM62_score",
)

# --- Fixed values: evaluation --------------------------------------------------------------
PROB_EPSILON = 1e-12
THRESHOLD_GRID = (0.20, 0.80, 121)
OPERATING_TARGETS = (0.80, 0.90, 0.95, 0.99)
N_BINS = 15
LABEL_GAP_LIMIT = 0.08
MIN_SLICE_ROWS = 20
Z_95 = 1.959964
WINDOW_RESIDUES = 1022


def triangle_pairs(text: str, diagonal: int | None = None) -> dict[tuple[str, str], int]:
    """Expand a lower-triangle text block to all ordered residue pairs."""
    out: dict[tuple[str, str], int] = {}
    names: list[str] = []
    for line in text.split("\n"):
        cells = line.split()
        if not cells:
            continue
        row, values = cells[0], [int(v) for v in cells[1:]]
        names.append(row)
        for col, value in zip(names, values):
            out[row, col] = out[col, row] = value
        if diagonal is not None:
            out[row, row] = diagonal
    return out
