"""A keyed store in hash ranges, whose state is one small manifest.

Every commit writes its rows to a folder of its own, one subfolder for each hash range of the key, and then
a new manifest version that names all folders in use. A reader takes the newest whole manifest, so a
crash between write and commit leaves the old state, and a repeated batch finds its keys stored. Lookups
read only the ranges of their keys; ranges that many small commits have filled are compacted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGES = 64
#: Folders of a range from which on a commit compacts it.
MOST_FOLDERS = 16


class _Files:
    """Small files and folder listings through the session's Hadoop filesystem, so on any path Spark can read."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        at = self.path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(f"{self.root}/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Whole or not at all; False if the name is taken."""
        draft, target = self.path(f"{self.root}/.draft-{uuid.uuid4().hex}"), self.path(f"{self.root}/{name}")
        stream = self.fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.fs.mkdirs(target.getParent())
        if self.fs.exists(target) or not self.fs.rename(draft, target):
            self.fs.delete(draft, True)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.root}/{name}"), True)


@dataclass
class Manifest:
    """`folders` names the data folders of each range in use."""

    version: int = 0
    ranges: int = RANGES
    folders: dict[int, list[str]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"version": self.version, "ranges": self.ranges, "folders": {str(r): f for r, f in sorted(self.folders.items())}})


class KeyedStore:
    """Rows of one key column under a folder. The number of ranges is fixed by the first commit."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, ranges: int = RANGES):
        self.spark, self.path, self.schema, self.key, self.new_ranges = spark, path.rstrip("/"), schema, key, ranges
        self.files = _Files(spark, path)

    def manifest(self) -> Manifest:
        """The newest manifest that is whole; an empty one before the first commit."""
        for name in reversed(self.files.names("manifest")):
            try:
                found = json.loads(self.files.read(f"manifest/{name}"))
            except json.JSONDecodeError:
                continue
            return Manifest(found["version"], found["ranges"], {int(r): f for r, f in found["folders"].items()})
        return Manifest(ranges=self.new_ranges)

    def range_of(self, ranges: int):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(ranges)).cast("int")

    def read(self, among: Sequence[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """Stored rows, of the given ranges only."""
        state = manifest or self.manifest()
        paths = [f"{self.path}/data/{folder}/range={r}" for r, folders in sorted(state.folders.items()) if among is None or r in among for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def ranges_of(self, keys: DataFrame, state: Manifest) -> list[int]:
        """Ranges that hold these keys: one small number each, at most as many as the store has."""
        return sorted(r[0] for r in keys.select(self.range_of(state.ranges).alias("r")).distinct().collect())

    def _write(self, rows: DataFrame, state: Manifest) -> tuple[str, list[int]]:
        folder = uuid.uuid4().hex
        names = self.spark.createDataFrame([], self.schema).columns
        placed = rows.select(*names, self.range_of(state.ranges).alias("range"))
        placed.repartition("range").sortWithinPartitions("range", self.key).write.partitionBy("range").parquet(f"{self.path}/data/{folder}")
        return folder, sorted(int(n.removeprefix("range=")) for n in self.files.names(f"data/{folder}") if n.startswith("range="))

    def _swap(self, state: Manifest) -> None:
        if not self.files.write_new(f"manifest/{state.version:012d}.json", state.text()):
            raise RuntimeError(f"version {state.version} of {self.path} was committed by another writer; run the batch again")

    def append(self, rows: DataFrame) -> None:
        """Add rows whose keys are not stored yet; ranges of many folders are compacted."""
        state = self.manifest()
        folder, used = self._write(rows, state)
        if not used:
            self.files.delete(f"data/{folder}")
            return
        folders = {r: list(f) for r, f in state.folders.items()}
        for r in used:
            folders.setdefault(r, []).append(folder)
        self._swap(Manifest(state.version + 1, state.ranges, folders))
        if any(len(f) >= MOST_FOLDERS for f in folders.values()):
            self.compact()

    def compact(self, most: int = MOST_FOLDERS) -> list[int]:
        """Rewrite the ranges of at least `most` folders as one folder each; the others are not read."""
        state = self.manifest()
        full = [r for r, f in state.folders.items() if len(f) >= most]
        if full:
            folder, used = self._write(self.read(full, state), state)
            folders = {r: f for r, f in state.folders.items() if r not in full} | {r: [folder] for r in used}
            self._swap(Manifest(state.version + 1, state.ranges, folders))
        return full

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest manifest does not name (left by crashes and compaction) and
        older manifests. Readers of an older state must have ended."""
        state = self.manifest()
        kept = {f for folders in state.folders.values() for f in folders}
        gone = [n for n in self.files.names("data") if n not in kept]
        for name in gone:
            self.files.delete(f"data/{name}")
        for name in self.files.names("manifest"):
            if name < f"{state.version:012d}.json":
                self.files.delete(f"manifest/{name}")
        return gone
