"""Readers, writers, training, streaming, and the query contract."""

import importlib.util
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators.ordered import exact_quantiles
from helixframe.plans import training
from helixframe.session import scratch_path, small_side
from helixframe.sources import readers, writers
from helixframe.streaming import incremental

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_vcf_multi_allelic(spark, tmp_path):
    lines = ["##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",
             "chr1\t5\t.\tg\tA,t\t.\tPASS\tAF=0.1,0.02;AC=7,9;AN=90", "2\t6\t.\tC\tG\t.\tPASS\tDB", "chr0\t6\t.\tC\tG\t.\tPASS\tDB"]
    (tmp_path / "a.vcf").write_text("\n".join(lines) + "\n")
    out = {r.variant_key: r for r in readers.read_vcf(spark, str(tmp_path / "a.vcf")).collect()}
    assert set(out) == {"1:5:G:A", "1:5:G:T", "2:6:C:G"}
    assert (out["1:5:G:T"].AF, out["1:5:G:T"].AC, out["1:5:G:T"].AN) == (0.02, 9.0, 90.0) and out["1:5:G:A"].is_common
    assert out["2:6:C:G"].AF is None and out["2:6:C:G"].log_AF == -8.0


def test_pdb_fixture(spark, tmp_path):
    atom = "ATOM  {s:>5}  CA  ALA A{r:>4}    {x:>8.3f}{y:>8.3f}{z:>8.3f}  1.00{b:>6.2f}"
    rows = [atom.format(s=i, r=i, x=3.8 * i, y=0, z=0, b=b) for i, b in ((1, 95), (2, 80), (3, 60))]
    (tmp_path / "AF-P1.pdb").write_text("\n".join(["HEADER", *rows, "END"]) + "\n")
    from helixframe.operators.structure import structure_features

    out = {r.pos: r for r in structure_features(readers.read_pdb(spark, str(tmp_path / "AF-P1.pdb"))).collect()}
    assert out[2].neighbors == 2 and np.isclose(out[2].window_mean, 78.3333333) and out[1].structure_id == "AF-P1"


def test_denovo_header_and_predictor(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("##version=1\n#SampleID\tChr\tGene\ns1\t1\t\ns2\tX\tG\n")
    out = readers.read_denovo_table(spark, str(tmp_path / "d.tsv"))
    assert out.columns == ["SampleID", "Chr", "Gene"] and [tuple(r) for r in out.orderBy("SampleID").collect()] == [("s1", "1", None), ("s2", "X", "G")]
    (tmp_path / "p.tsv").write_text("# c\n# c\nchr1\t5\tA\tG\thg19\tP\tT\tK1R\t0.9\tx\nchrM\t6\tA\tG\thg19\tP\tT\tK1R\t0.1\ty\n")
    keys = spark.createDataFrame([("1:5:A:G",)], "variant_key string")
    assert [r.am_pathogenicity for r in readers.read_predictor(spark, str(tmp_path / "p.tsv"), keys).collect()] == [0.9]


def test_column_resolution():
    got = readers.resolve_columns(["#chr", "Pos (1 Based)", "x"], {"chr": ("#chr", "chr"), "pos": ("pos(1-based)",), "alt": ("alt",)})
    assert got == {"chr": "#chr", "pos": "Pos (1 Based)", "alt": None}
    with pytest.raises(ValueError):
        from helixframe.operators.cleaning import require_columns

        class T:
            columns = ["a"]

        require_columns(T(), ["b"])


def test_write_with_stats(spark):
    df = spark.createDataFrame([(0.02,), (0.01,), (None,)], "AF double")
    stats = writers.write_with_stats(df, scratch_path(spark, "af"))
    assert (stats["total"], stats["common"], stats["rare"]) == (3, 1, 1) and np.isclose(stats["mean_af"], 0.015)


def test_incremental_resolves_each_key_once(spark):
    path, asked = scratch_path(spark, "store"), []
    schema = "k bigint, v string"

    def resolve(misses):
        asked.append(sorted(r.k for r in misses.collect()))
        return misses.filter("k <> 3").select("k", F.when(F.col("k") % 2 == 0, F.concat(F.lit("v"), "k")).alias("v"))

    for _ in range(2):
        out = incremental.incremental_enrich(spark.range(1, 5).withColumnRenamed("id", "k"), path, schema, resolve, "k")
        assert {r.k: r.v for r in out.collect()} == {1: None, 2: "v2", 3: None, 4: "v4"}
    assert asked == [[1, 2, 3, 4], [3]]


def test_small_side_broadcasts_only_counted_tables(spark):
    assert "broadcast" in small_side(spark.range(5))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small_side(spark.range(50), max_bytes=100)._jdf.queryExecution().logical().toString().lower()


def test_unseen_levels_encode_to_zeros(spark):
    from pyspark.ml.functions import vector_to_array

    train = spark.createDataFrame([(float(i), "A" if i < 30 else ("B" if i < 60 else f"rare{i}")) for i in range(65)], "x double, c string")
    model = training.fit_features(train, ["x"], ["c"])
    assert model.manifest() == ["num__x", "cat__c_A", "cat__c_B", "cat__c___infrequent__"]
    new = spark.createDataFrame([(None, "A"), (1.0, "rare61"), (2.0, "never"), (float("inf"), "B")], "x double, c string")
    got = sorted(tuple(r[0]) for r in model.transform(new).select(vector_to_array("features")).collect())
    assert sorted(t[1:] for t in got) == sorted([(1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0), (0.0, 1.0, 0.0)])
    assert [t[0] for t in got].count(32.0) == 2


def test_calibrators(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(500), 2)
    y = (rng.random(500) < p**2).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "y int, p double")
    iso = training.apply_isotonic(training.fit_isotonic(df), df).orderBy("p").select("p_calibrated").toPandas().p_calibrated.to_numpy()
    assert (np.diff(iso) >= -1e-12).all() and iso.min() >= 0 and iso.max() <= 1
    platt = training.apply_platt(training.fit_platt(df), df).orderBy("p").select("p_platt").toPandas().p_platt.to_numpy()
    assert (np.diff(platt) >= 0).all() and abs(platt.mean() - y.mean()) < 0.02


def test_random_params_are_bounded_and_stable():
    for trial in range(50):
        p = training.random_params(1, trial)
        assert 3 <= p["max_depth"] <= 7 and 0.025 <= p["step_size"] <= 0.12 and 0.72 <= p["subsample"] <= 1.0
    assert training.random_params(1, 3) == training.random_params(1, 3) != training.random_params(2, 3)


@pytest.fixture(scope="module")
def entry():
    spec = importlib.util.spec_from_file_location("entry", f"{ROOT}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_entry_runs(spark, entry):
    assert {r.split for r in entry.entry(spark).collect()} == {"train", "val", "test"}


def test_registry_is_complete(entry):
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 190 and set(o) <= set(q) and len(q) - len(o) <= 12


@pytest.mark.parametrize("name", ["clean_labels", "bootstrap_ci", "permutation_auc_test", "delong_test", "collapse_transcripts", "join_left_defaults",
                                  "reliability_bins", "operating_points", "join_within_radius", "profile_columns", "rank_fusion", "scan_vcf"])
def test_query_equals_its_sql(spark, entry, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == cols
    expect = sorted(tuple(str(r[at[c]]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == expect


def test_quantile_of_one_value(spark):
    r = exact_quantiles(spark.createDataFrame([(5.0,)], "v double"), "v", [0.0, 0.5, 1.0]).first()
    assert (r.n, r.q0, r.q1, r.q2) == (1, 5.0, 5.0, 5.0)


def test_replayed_batch_changes_nothing(spark):
    path, schema = scratch_path(spark, "store"), "k bigint, v string"

    def resolve(misses):
        return misses.select("k", F.concat(F.lit("v"), F.col("k").cast("string")).alias("v"))

    wanted = spark.range(10).withColumnRenamed("id", "k")
    for _ in range(3):
        out = incremental.incremental_enrich(wanted, path, schema, resolve, "k")
        assert out.filter("v is not null").count() == 10
        assert incremental.read_store(spark, path, schema).count() == 10


def test_replayed_stream_changes_nothing(spark):
    path, source, schema = scratch_path(spark, "store"), scratch_path(spark, "keys"), "k bigint, v string"
    spark.range(12).withColumnRenamed("id", "k").repartition(3).write.parquet(source)

    def resolve(misses):
        return misses.select("k", F.lit("x").alias("v"))

    for _ in range(2):  # a lost checkpoint replays every batch
        stream = spark.readStream.schema("k bigint").option("maxFilesPerTrigger", 1).parquet(source)
        incremental.stream_enrich(stream, path, schema, resolve, scratch_path(spark, "progress"), "k")
        store = incremental.read_store(spark, path, schema)
        assert (store.count(), store.select("k").distinct().count()) == (12, 12)


def test_cluster_without_shared_folder_raises():
    from types import SimpleNamespace as Stub

    from helixframe import session

    def of(master, folder=None):
        return Stub(conf=Stub(get=lambda key, default=None: folder), sparkContext=Stub(master=master, applicationId=f"test-{master}"))

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(of(master))
        assert session.shared_dir(of(master, "s3a://bucket/tmp/")) == "s3a://bucket/tmp"
    local = of("local[4]")
    assert session.shared_dir(local) == session.shared_dir(local)


def scanned(df):
    """The folders that the plan of a frame reads, one for each file scan, from the scans themselves."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            found.append(leaf.relation().location().rootPaths().apply(0).toString())
    return found


@pytest.mark.parametrize("folder", ["r", "a-rather-long-name-of-a-folder-" * 6])
def test_checks_read_their_input_once(spark, tmp_path, folder):
    from helixframe.operators import splitting

    rows = [(f"k{i}", f"g{i % 40}", i % 2, "A", "C") for i in range(400)]
    spark.createDataFrame(rows, "variant_key string, gene string, label int, ref_aa string, alt_aa string").write.parquet(f"{tmp_path}/{folder}")
    base = spark.read.parquet(f"{tmp_path}/{folder}")
    split = splitting.group_split(base, "gene")
    assert [p.endswith(f"/{folder}") for p in scanned(split)].count(True) == 1
    names = spark.createDataFrame([("num__a",)], "feature string")
    # the original is counted once, everything else comes from a written table of facts
    for table, of_input in ((splitting.validate_split(base, split, "gene"), 1), (splitting.leakage_gate(split, names, lambda c: c), 0)):
        found = scanned(table)
        assert [p.endswith(f"/{folder}") for p in found].count(True) == of_input
        assert found
        checks = {r.check: r.status for r in table.collect()}
        assert checks["train_test_overlap" if "train_test_overlap" in checks else "gene_overlap"] == "pass"


def test_folder_of_different_headers_raises(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("x\ty\n1\t2\n")
    (tmp_path / "b.tsv").write_text("y\tx\n3\t4\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_delimited(spark, str(tmp_path)).collect()
    (tmp_path / "b.tsv").write_text("x\ty\n3\t4\n")
    assert readers.read_delimited(spark, str(tmp_path)).count() == 2


def written(spark, name):
    """Files of the last scratch folder of that name."""
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    last = max((d for d in os.listdir(root) if d.startswith(f"{name}-")), key=lambda d: os.path.getmtime(f"{root}/{d}"))
    return [f"{root}/{last}/{f}" for f in os.listdir(f"{root}/{last}") if f.startswith("part-")]


def test_json_lines_are_written_compressed_in_small_files(spark, entry, monkeypatch):
    import gzip

    from helixframe.catalog import sources

    monkeypatch.setattr(sources, "JSON_ROWS", 500)
    n = entry.queries()["scan_annotation_json"](spark, SF).count()
    lines = [len(gzip.open(f, "rt").readlines()) for f in written(spark, "json")]
    assert sum(lines) == n > 500 and max(lines) <= 500


@pytest.mark.parametrize("name, folder", [("stream_ingest_stats", "afin"), ("stream_enrich", "keys")])
def test_files_of_a_stream_grow_with_the_table(spark, entry, monkeypatch, name, folder):
    from helixframe.catalog import incremental

    expect = [tuple(r) for r in entry.queries()[name](spark, SF).collect()]
    assert len(written(spark, folder)) == 4
    monkeypatch.setattr(incremental, "FILE_BYTES", 1 << 13)
    assert [tuple(r) for r in entry.queries()[name](spark, SF).collect()] == expect
    assert len(written(spark, folder)) > 8
