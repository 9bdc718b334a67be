import pytest
from pyspark.sql import functions as F

from helixframe.session import scratch_path
from helixframe.streaming import incremental
from helixframe.streaming.store import KeyedStore

SCHEMA = "k bigint, v string"


def resolve(misses):
    return misses.select("k", F.concat(F.lit("v"), F.coalesce(F.col("k").cast("string"), F.lit("null"))).alias("v"))


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k bigint")


def test_null_key_is_stored_once(spark):
    path = scratch_path(spark, "store")
    for _ in range(3):
        out = incremental.incremental_enrich(keys(spark, [None, 1, 1]), path, SCHEMA, resolve, "k", ranges=4)
        assert sorted(map(tuple, out.collect()), key=str) == [(1, "v1"), (1, "v1"), (None, "vnull")]
        assert incremental.read_store(spark, path, SCHEMA).count() == 2


def test_batch_reads_only_the_ranges_of_its_keys(spark):
    path = scratch_path(spark, "store")
    incremental.incremental_enrich(keys(spark, range(200)), path, SCHEMA, resolve, "k", ranges=8)
    store = KeyedStore(spark, path, SCHEMA, "k")
    state = store.manifest()
    assert state.ranges == 8 and sorted(state.folders) == list(range(8))
    among = store.ranges_of(keys(spark, [7]), state)
    assert len(among) == 1
    files = store.read(among, state).inputFiles()
    assert files and all(f"range={among[0]}/" in f for f in files)
    out = incremental.incremental_enrich(keys(spark, [7, 1000]), path, SCHEMA, resolve, "k")
    read = {f.split("range=")[1].split("/")[0] for f in out.inputFiles() if "range=" in f}
    assert read == {str(r) for r in store.ranges_of(keys(spark, [7, 1000]), state)}
    assert {r.k: r.v for r in out.collect()} == {7: "v7", 1000: "v1000"}


def test_crash_before_the_swap_leaves_the_old_state(spark, monkeypatch):
    path = scratch_path(spark, "store")
    incremental.incremental_enrich(keys(spark, [1, 2]), path, SCHEMA, resolve, "k")
    before = KeyedStore(spark, path, SCHEMA, "k").manifest()

    def crash(self, state):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_swap", crash)
        with pytest.raises(OSError):
            incremental.incremental_enrich(keys(spark, [3, 4]), path, SCHEMA, resolve, "k")
    store = KeyedStore(spark, path, SCHEMA, "k")
    assert store.manifest() == before and store.read().count() == 2
    store.files.write_new("manifest/000000000099.json", '{"version": 99, "ra')  # a torn manifest is passed over
    assert store.manifest() == before
    out = incremental.incremental_enrich(keys(spark, [3, 4]), path, SCHEMA, resolve, "k")
    assert {r.v for r in out.collect()} == {"v3", "v4"} and store.read().count() == 4
    assert len(store.vacuum()) == 1 and store.read().count() == 4


def test_two_writers_of_one_version(spark):
    store = KeyedStore(spark, scratch_path(spark, "store"), SCHEMA, "k", 2)
    state = store.manifest()
    store.append(resolve(keys(spark, [1])))
    state.version += 1
    with pytest.raises(RuntimeError, match="another writer"):
        store._swap(state)


def test_many_small_batches_compact(spark):
    path = scratch_path(spark, "store")
    store = KeyedStore(spark, path, SCHEMA, "k", 2)
    for i in range(6):
        store.append(resolve(keys(spark, range(10 * i, 10 * i + 10))))
    assert {len(f) for f in store.manifest().folders.values()} == {6}
    assert store.compact(most=5) == [0, 1]
    assert {len(f) for f in store.manifest().folders.values()} == {1}
    assert sorted(r.k for r in store.read().collect()) == list(range(60))
    assert len(store.vacuum()) == 6 and store.read().count() == 60
    assert store.compact(most=5) == []
