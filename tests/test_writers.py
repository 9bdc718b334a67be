import pyarrow.parquet as pq

from helixframe.sources import writers


def test_folders_of_a_snapshot_are_written_in_one_sorted_order(spark, tmp_path):
    df = spark.range(20_000).selectExpr("cast(id % 7 as string) as chr", "(id * 7919) % 20011 as pos", "id").coalesce(1)
    writers.write_parquet(df, str(tmp_path / "t"), partition_by=["chr"], sort_by=["pos"])
    for folder in (tmp_path / "t").glob("chr=*"):
        for file in folder.glob("*.parquet"):
            found = pq.read_table(file, partitioning=None)["pos"].to_pylist()
            assert found == sorted(found)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20_000
