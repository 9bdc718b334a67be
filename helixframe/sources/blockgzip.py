"""Delimited text in block-gzip files, read by byte ranges.

A block-gzip file is a chain of small gzip members that carry their own length, so a task can start in
the middle: it finds the next block header, inflates from there, leaves the torn first line to the range
before and finishes the line that its last block tears. One file of any size is thus read by many tasks,
where Spark's own readers give a gzip file to one.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# --- Fixed values: layout of a block header and the empty block that ends a file ---
MAGIC = b"\x1f\x8b\x08\x04"
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK_BYTES = 1 << 16
#: Text of a block when writing; a block of incompressible text still fits BLOCK_BYTES.
BLOCK_TEXT = 0xFF00
SPLIT_BYTES = 32 << 20
#: Ranges beyond which larger ones are read, up to SPLIT_BYTES each, as every range costs a task its start.
MANY_RANGES = 512
CHUNK_BYTES = 8 << 20


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """Filesystem and plain path; a path without scheme, or `file:/x`, is local."""
    plain = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(plain)


def block_size(head: bytes) -> int | None:
    """Bytes of the block whose header starts here, or None if none does."""
    if len(head) < 18 or not head.startswith(MAGIC):
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    at = 12
    while at + 4 <= 12 + extra and at + 6 <= len(head):
        kind, size = head[at:at + 2], struct.unpack_from("<H", head, at + 2)[0]
        if kind == b"BC" and size == 2:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + size
    return None


def is_chain(data: bytes, at: int, last: bool) -> bool:
    """Whether blocks follow each other from here for more than the size of one block, or to the end of
    the file. Bytes inside a block that look like a header do not: what they lead to stays inside."""
    start = at
    while at - start <= BLOCK_BYTES:
        if last and at == len(data):
            return True
        size = block_size(data[at:at + 64])
        if size is None or size < 26:
            return False
        at += size
        if at > len(data):
            return False
    return True


def first_block(file, start: int, size: int) -> int:
    """Offset of the first block at or after `start`; `size` if there is none."""
    if start == 0:
        return 0
    file.seek(start)
    data = file.read(min(4 * BLOCK_BYTES, size - start))
    last = start + len(data) == size
    for hit in re.finditer(re.escape(MAGIC), data):
        if hit.start() > BLOCK_BYTES:
            break
        if is_chain(data, hit.start(), last):
            return start + hit.start()
    if last and len(data) < BLOCK_BYTES:
        return size
    raise ValueError(f"no block header after byte {start}: not a block-gzip file")


def blocks(file, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, text) of each block from `at`; a damaged block raises."""
    held, base = b"", at
    file.seek(at)
    while at < size:
        if len(held) - (at - base) < BLOCK_BYTES and base + len(held) < size:
            held, base = held[at - base:] + file.read(CHUNK_BYTES), at
        low = at - base
        length = block_size(held[low:low + 64])
        if length is None or low + length > len(held):
            raise ValueError(f"broken block at byte {at}")
        body = zlib.decompressobj(31)
        text = body.decompress(held[low:low + length])
        if not body.eof:
            raise ValueError(f"broken block at byte {at}")
        yield at, text
        at += length


def range_text(file, start: int, end: int, size: int, chunk: int = CHUNK_BYTES) -> Iterator[bytes]:
    """The whole lines that belong to the blocks that start in [start, end), in pieces of whole lines.

    A range after the first begins behind its first line break, and every range ends with the first line
    break that it finds beyond its blocks. So each line is in one range, however long it is.
    """
    held: list[bytes] = []
    total, torn = 0, start > 0
    for at, text in blocks(file, first_block(file, start, size), size):
        beyond = at >= end
        if torn:
            if beyond:  # not one line starts here
                return
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, torn = text[cut + 1:], False
        if beyond:
            cut = text.find(b"\n")
            held.append(text if cut < 0 else text[:cut + 1])
            if cut >= 0:
                break
            continue
        held.append(text)
        total += len(text)
        if total >= chunk:
            data = b"".join(held)
            cut = data.rfind(b"\n") + 1
            if cut:
                yield data[:cut]
            held, total = [data[cut:]], len(data) - cut
    data = b"".join(held)
    if data:
        yield data


def range_bytes(asked: int, total: int) -> int:
    """Bytes of a range: as asked, more where that would be very many ranges."""
    return max(asked, min(SPLIT_BYTES, total // MANY_RANGES))


def cut_columns(text: bytes, names: list[str], wanted: list[str], sep: str) -> pa.Table:
    """The wanted columns of whole lines, as strings; empty and missing cells are null. The others are
    skipped by the parser."""
    try:
        return csv.read_csv(
            pa.BufferReader(text), read_options=csv.ReadOptions(column_names=names, block_size=max(len(text) + 1, 1 << 16), use_threads=False),
            parse_options=csv.ParseOptions(delimiter=sep, quote_char=False, newlines_in_values=False),
            convert_options=csv.ConvertOptions(include_columns=wanted, column_types={n: pa.string() for n in wanted}, null_values=[""], strings_can_be_null=True))
    except pa.ArrowInvalid:  # lines of other widths, or of white space only
        at = [names.index(n) for n in wanted]
        rows = [line.rstrip("\r").split(sep) for line in text.decode("utf-8", "replace").split("\n") if line.rstrip("\r")]
        return pa.table({n: pa.array([(r[i] or None) if i < len(r) else None for r in rows], pa.string()) for n, i in zip(wanted, at)})


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    size: int


class BlockGzipSource(DataSource):
    """`spark.read.format("blockgzip")`: options path (file or folder), sep, splitBytes, lines.

    With `lines` every line is a row of one column `value`; else the first line of each file holds the
    names, and a schema of some of them reads only these.
    """

    @classmethod
    def name(cls) -> str:
        return "blockgzip"

    def files(self) -> list[tuple[str, int]]:
        system, path = open_path(self.options["path"])
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path))
        root = self.options["path"].rstrip("/")
        files = sorted((root if info.is_file else f"{root}/{f.base_name}", f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))
        if not files:
            raise ValueError(f"no block-gzip file under {root}")
        return files

    def header(self, path: str) -> list[str]:
        system, plain = open_path(path)
        with system.open_input_file(plain) as file:
            text = b""
            for _, block in blocks(file, 0, file.size()):
                text += block
                if b"\n" in text:
                    break
        return text.split(b"\n", 1)[0].rstrip(b"\r").decode().split(self.options.get("sep", "\t"))

    def schema(self) -> StructType:
        names = ["value"] if self.options.get("lines") == "true" else self.header(self.files()[0][0])
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockGzipReader(self, schema.fieldNames())


class BlockGzipReader(DataSourceReader):
    def __init__(self, source: BlockGzipSource, wanted: list[str]):
        options = source.options
        self.wanted, self.sep, self.lines = wanted, options.get("sep", "\t"), options.get("lines") == "true"
        self.files = source.files()
        self.split = range_bytes(int(options.get("splitBytes", SPLIT_BYTES)), sum(size for _, size in self.files))
        self.names = [] if self.lines else source.header(self.files[0][0])
        lost = [] if self.lines else [n for n in wanted if n not in self.names]
        if lost:
            raise ValueError(f"no such columns: {lost}")

    def partitions(self) -> list[ByteRange]:
        return [ByteRange(path, low, min(size, low + self.split), size) for path, size in self.files for low in range(0, size, self.split)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        system, plain = open_path(part.path)
        with system.open_input_file(plain) as file:
            head = part.start == 0 and not self.lines
            for text in range_text(file, part.start, part.end, part.size):
                if head:
                    first, _, text = text.partition(b"\n")
                    head = False
                    if first.rstrip(b"\r").decode().split(self.sep) != self.names:
                        raise ValueError(f"the header of {part.path} differs from that of the first file")
                if not text:
                    continue
                if self.lines:
                    rows = [line.rstrip("\r") for line in text.decode("utf-8", "replace").removesuffix("\n").split("\n")]
                    yield pa.RecordBatch.from_pydict({self.wanted[0]: pa.array(rows, pa.string())})
                else:
                    yield from cut_columns(text, self.names, self.wanted, self.sep).select(self.wanted).combine_chunks().to_batches(max_chunksize=10_000)


def read_block_gzip(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Named string columns of delimited block-gzip text; empty cells are null. Without `columns`, all of
    the header. A folder whose files differ in their header raises. Large folders are read in ranges of more
    than `split_bytes`."""
    spark.dataSource.register(BlockGzipSource)
    reader = spark.read.format("blockgzip").option("sep", sep).option("splitBytes", split_bytes)
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.load(path)


def read_block_lines(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every line of block-gzip text as `value`."""
    spark.dataSource.register(BlockGzipSource)
    return spark.read.format("blockgzip").option("lines", "true").option("splitBytes", split_bytes).load(path)


def pack_blocks(text: bytes, level: int = 6, block_text: int = BLOCK_TEXT) -> bytes:
    """Block-gzip bytes of a text, without the block that ends a file."""
    out = []
    for low in range(0, len(text), block_text):
        piece = text[low:low + block_text]
        deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = deflate.compress(piece) + deflate.flush()
        out.append(MAGIC + struct.pack("<IBBHBBHH", 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(piece), len(piece)))
    return b"".join(out)


def write_block_gzip(df: DataFrame, path: str, sep: str = "\t", header: bool = True) -> None:
    """One block-gzip file for each partition, written under another name and moved when whole, so that a
    repeated task replaces its own file. Nulls are empty cells."""
    names = df.columns
    cells = df.select(F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names]).alias("line"))
    head = (sep.join(names) + "\n").encode() if header else b""
    system, plain = open_path(path)
    system.create_dir(plain, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        target = f"{open_path(path)[1]}/part-{task.partitionId():05d}.bgz"
        system = open_path(path)[0]
        draft = f"{open_path(path)[1]}/.draft-{task.partitionId():05d}-{task.taskAttemptId()}"
        count = 0
        with system.open_output_stream(draft) as file:
            held = head
            for batch in batches:
                count += batch.num_rows
                held += "".join(f"{line}\n" for line in batch.column(0).to_pylist()).encode()
                whole = len(held) // BLOCK_TEXT * BLOCK_TEXT
                file.write(pack_blocks(held[:whole]))
                held = held[whole:]
            file.write(pack_blocks(held) + END_BLOCK)
        system.move(draft, target)
        yield pa.RecordBatch.from_pydict({"rows": pa.array([count], pa.int64())})

    cells.mapInArrow(write, "rows bigint").agg(F.sum("rows")).collect()
