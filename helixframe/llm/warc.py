"""WARC archives: one record per row, read back by boundary-chain verification.

Writing: Spark's text writer with the record separator as line separator makes plain
(uncompressed) archives on any store. Equal payloads are kept once: the record of the largest id
is a `response`, the others are `revisit` records that refer to it.

Reading: Spark's text reader cuts files into byte ranges and, with the version line as line
separator, hands every task the places where a record may begin, payload text included. A first
pass looks at headers only: a task turns each place into a link to its successor (place + header +
Content-Length + separator) and shortens the links to the first place beyond its byte range. Pointer
jumping from the start of each file over these links finds the entry of each range. A second pass
reads each range from its entry, one record after the other; a version line inside a payload is
bytes of that record, so forged records cost no more than other text.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.session import cut_lineage

VERSION = "WARC/1.0\r\n"
END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
STAMP = "2000-01-01T00:00:00Z"
_M = len(VERSION)

PARTS = "kind int, file string, block bigint, place bigint, exit bigint"
SPAN = "file string, block bigint, place bigint, next bigint, complete boolean"
RECORD = ("record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, "
          "payload_digest string, payload binary")


def sha1_base32(payload):
    """Column expression: upper-case base32 of the SHA-1 of a binary column."""
    bits = F.sha1(payload)
    letters = []
    for i in range(8):  # five hex digits are four letters
        number = F.conv(F.substring(bits, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _field(name: str, value):
    """Header line, or nothing where the value is null; line breaks inside a value are escaped."""
    safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


def _urn(key):
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html",
                   records_per_file: int = 1_000_000) -> None:
    """One record per row. A null payload is empty; a null key or uri is left out of the header.

    Rows that share both payload and largest key are all responses. Only the keys of payloads
    that occur more than once are written aside; the planner broadcasts that table if its files
    are small and otherwise joins by shuffle, where it splits a hot payload.
    """
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"),
                        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumn("digest", sha1_base32(F.col("body").cast("binary")))
    shared = cut_lineage(
        rows.groupBy("digest").agg(F.max("key").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("digest", "keeper"))
    rows = rows.join(shared, "digest", "left").withColumn(
        "again", F.coalesce(F.col("key") < F.col("keeper"), F.col("key").isNull() & F.col("keeper").isNotNull()))
    block = F.when(F.col("again"), F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "body"))
    record = F.concat(
        F.lit(VERSION),
        F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"), F.lit("\r\n"),
        _field("WARC-Record-ID", _urn(F.col("key"))),
        _field("WARC-Date", F.lit(STAMP)),
        _field("WARC-Target-URI", F.col("uri")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _field("WARC-Refers-To", F.when(F.col("again"), _urn(F.col("keeper")))),
        _field("WARC-Profile", F.when(F.col("again"), F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _field("X-Payload-Length", F.when(F.col("again"), F.octet_length("body"))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _field("Content-Length", F.octet_length("block")), F.lit("\r\n"), F.col("block"))
    (rows.withColumn("block", block).select(record.alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", records_per_file).text(path))


class _Open:
    """A candidate record that still waits for bytes of its block."""

    def __init__(self, line: bytes, keep: bool):
        head, found, rest = line.partition(b"\r\n\r\n")
        self.fields = {}
        for item in head.split(b"\r\n"):
            name, colon, value = item.partition(b":")
            if colon:
                self.fields.setdefault(name.strip().lower(), value.strip())
        length = self.fields.get(b"content-length", b"")
        self.valid = bool(found) and length.isdigit()
        if not self.valid:
            return
        self.length = int(length)
        self.consumed = len(head) + 4 + self.length + 4
        self.left, self.seen, self.size, self.head = self.length, b"", 0, False
        self.sha, self.parts, self.keep = hashlib.sha1(), [], keep
        self.feed(rest)

    def feed(self, more: bytes) -> None:
        more = more[:self.left]
        self.left -= len(more)
        if not self.head:  # HTTP header before the payload
            self.seen += more
            cut = self.seen.find(b"\r\n\r\n")
            http = self.fields.get(b"content-type", b"").lower().startswith(b"application/http")
            if http and cut < 0 and self.left:
                return
            more, self.seen, self.head = (self.seen[cut + 4:] if http and cut >= 0 else self.seen), b"", True
        self.sha.update(more)
        self.size += len(more)
        if self.keep:
            self.parts.append(more)

    def row(self) -> tuple:
        def text(name):
            value = self.fields.get(name)
            return None if value is None else value.decode("utf-8", "replace")

        kind = text(b"warc-type")
        stated = self.fields.get(b"x-payload-length", b"")
        if kind == "revisit":  # the payload is in the record it refers to
            digest = (text(b"warc-payload-digest") or "").removeprefix("sha1:") or None
            size, payload = (int(stated) if stated.isdigit() else None), None
        else:
            digest, size = base64.b32encode(self.sha.digest()).decode(), self.size
            payload = b"".join(self.parts) if self.keep else None
        return (kind, text(b"warc-record-id"), text(b"warc-target-uri"), text(b"warc-refers-to"), size, digest, payload)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", VERSION).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"))


#: Links that go to Spark in one batch.
LINK_ROWS = 1 << 16


def _consumed(line: bytes) -> int | None:
    """Bytes from a place to the end of the record that begins there, or None if none does."""
    head, found, _ = line.partition(b"\r\n\r\n")
    if not found:
        return None
    for item in head.split(b"\r\n"):
        name, colon, value = item.partition(b":")
        if colon and name.strip().lower() == b"content-length":
            value = value.strip()
            return len(head) + 4 + int(value) + 4 if value.isdigit() and len(value) < 19 else None
    return None


def _exits(places: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Where each place's chain leaves the range: links are followed while they meet a place, in doubling steps."""
    at = np.searchsorted(places, nexts)
    inside = (at < places.size) & (places[np.minimum(at, places.size - 1)] == nexts) if places.size else np.zeros(0, bool)
    follow = np.where(inside, at, np.arange(places.size))
    while True:
        further = follow[follow]
        if (further == follow).all():
            return nexts[follow]
        follow = further


def _links(batches):
    """Rows of kind 1: a candidate and where its chain leaves the range; 2: bytes of a range. Two numbers of
    each candidate are held."""
    current, place, places, nexts = None, 0, array("q"), array("q")

    def rows(kind, at, out):
        n = len(at)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, kind, np.int32)), pa.array([current[0]] * n, pa.string()), pa.array([current[1]] * n, pa.int64()),
            pa.array(at, pa.int64()), pa.array(out, pa.int64())], names=["kind", "file", "block", "place", "exit"])

    def close():
        at = np.array(places, dtype=np.int64)
        out = _exits(at, np.array(nexts, dtype=np.int64))
        for low in range(0, len(at), LINK_ROWS):
            yield rows(1, at[low:low + LINK_ROWS], out[low:low + LINK_ROWS])
        yield rows(2, [0], [place])

    for batch in batches:
        for file, block, scalar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            line = scalar.as_py() or b""
            if (file, block) != current:
                if current is not None:
                    yield from close()
                current, place, places, nexts = (file, block), 0, array("q"), array("q")
            if block or place:  # what stands before the first version line of a file is no record
                size = _consumed(line)
                if size is not None:
                    places.append(place)
                    nexts.append(place + size + _M)
            place += len(line) + _M
    if current is not None:
        yield from close()


def _entries(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(file, block, entry): the first place of each range that is on the chain from its file's start."""
    order = Window.partitionBy("file").orderBy("block")
    blocks = cut_lineage(blocks.withColumn("base", F.sum("exit").over(order) - F.col("exit"))
                         .select("file", "block", "base", F.count(F.lit(1)).over(Window.partitionBy("file")).alias("n")))
    jumps = cut_lineage(links.join(blocks, ["file", "block"]).select(
        "file", "block", "base", (F.col("base") + F.col("place")).alias("at"), (F.col("base") + F.col("exit")).alias("to")))
    widest = blocks.agg(F.max("n")).first()[0] or 0
    reach = blocks.select("file", F.lit(_M).cast("bigint").alias("at")).distinct()
    hops = jumps.select("file", "at", "to")
    rounds = max(0, int(widest - 1)).bit_length()
    for step in range(rounds):
        ahead = reach.join(hops, ["file", "at"]).select("file", F.col("to").alias("at"))
        reach = cut_lineage(reach.union(ahead).distinct())
        if step + 1 < rounds:
            onward = hops.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
            hops = cut_lineage(hops.join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")))
    return jumps.join(reach, ["file", "at"], "left_semi").select("file", "block", (F.col("at") - F.col("base")).alias("entry"))


def _placed(batches):
    """The lines with their place in the range."""
    current, place = None, 0
    for batch in batches:
        files, starts, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
        places = []
        for file, block, line in zip(files, starts, rows):
            if (file, block) != current:
                current, place = (file, block), 0
            places.append(place)
            place += len(line.as_buffer()) + _M
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=["file", "block", "line", "place"])


def _records(keep: bool):
    """The records of each range from its entry on. One record is open at a time; the last one of a range may be
    incomplete."""

    def run(batches):
        schema = pa.schema([
            ("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("next", pa.int64()), ("complete", pa.bool_()),
            ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
            ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        out, held, current, want, item, at = [], 0, None, None, None, 0

        def done(complete: bool):
            out.append((*current, at, at + item.consumed + _M, complete, *item.row()))

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4)]
            for file, block, place, entry, scalar in zip(*columns, batch.column(2)):
                if (file, block) != current:
                    if item is not None:
                        done(False)
                    current, want, item = (file, block), entry, None
                if item is not None:
                    item.feed(VERSION.encode() + (scalar.as_py() or b""))
                elif place == want:
                    item, at = _Open(scalar.as_py() or b"", keep), place
                    if not item.valid:
                        item = None
                        continue
                else:
                    continue
                if not item.left:
                    done(True)
                    held += item.size
                    want, item = at + item.consumed + _M, None
                    if len(out) >= 4096 or (keep and held > 1 << 24):
                        yield flush()
                        out, held = [], 0
        if item is not None:
            done(False)
        if out:
            yield flush()

    return run


#: Ranges whose entries may be broadcast (about 200 bytes each).
ENTRY_ROWS = 300_000


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives below path: record_type, record_id, target_uri, refers_to,
    payload_bytes, payload_digest (base32 SHA-1 of the bytes read; for revisits as stated in their
    header) and payload (null for revisits, and where payload=False).

    Records behind a broken chain (a damaged length) are left out, those before it are kept.
    """
    fields = "record_type record_id target_uri refers_to payload_bytes payload_digest payload".split()
    lines = _lines(spark, path)
    parts = cut_lineage(lines.mapInArrow(_links, PARTS))
    links = parts.where("kind = 1").select("file", "block", "place", "exit")
    blocks = parts.where("kind = 2").select("file", "block", "exit")
    entries = cut_lineage(_entries(blocks, links))
    placed = lines.mapInArrow(_placed, "file string, block bigint, line binary, place bigint")
    if entries.count() <= ENTRY_ROWS:
        met = placed.join(F.broadcast(entries), ["file", "block"])
    else:  # the lines of a range stay together, in order
        met = placed.join(entries, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "place")
    found = cut_lineage(met.select("file", "block", "line", "place", "entry").mapInArrow(_records(payload), f"{SPAN}, {RECORD}"))
    whole = found.where("complete").select(*fields)
    torn = cut_lineage(found.where("not complete").select("file", "block", "place", "next"))
    if torn.isEmpty():
        return whole
    return whole.union(_mend(placed, blocks, torn, payload).select(*fields))


def _mend(placed: DataFrame, blocks: DataFrame, torn: DataFrame, keep: bool) -> DataFrame:
    """Records that cross a block's end: at most one for each block."""

    def join(key, rows):
        import pandas as pd

        rows = rows.sort_values("at")
        item = _Open(VERSION.encode().join(bytes(x) for x in rows["line"]), keep)
        return pd.DataFrame([item.row()], columns="record_type record_id target_uri refers_to payload_bytes payload_digest payload".split())

    order = Window.partitionBy("file").orderBy("block")
    bases = blocks.withColumn("base", F.sum("exit").over(order) - F.col("exit")).select("file", "block", "base")
    rows = placed.join(bases, ["file", "block"]).select("file", "line", (F.col("base") + F.col("place")).alias("at"))
    spans = torn.join(bases, ["file", "block"]).select(
        "file", (F.col("base") + F.col("place")).alias("low"), (F.col("base") + F.col("next")).alias("high"))
    near = rows.join(spans, (rows.file == spans.file) & (rows["at"] >= spans.low) & (rows["at"] < spans.high)).select(
        rows.file, "low", "at", "line")
    return near.groupBy("file", "low").applyInPandas(join, RECORD)


def page_number(urn):
    """The key inside a record id."""
    return F.nullif(F.regexp_extract(urn, "^<urn:page:(.*)>$", 1), F.lit("")).cast("bigint")
