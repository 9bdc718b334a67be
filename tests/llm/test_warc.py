import base64
import hashlib
import tempfile

from helixframe.llm import warc


def expected(rows):
    keep = {}
    for key, _, html in rows:
        body = (html or "").encode()
        keep[body] = max(keep.get(body, -1), -1 if key is None else key)
    out = set()
    for key, _, html in rows:
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        again = (key if key is not None else -1) < keep[body]
        out.add((key, len(body), digest, "revisit" if again else "response", keep[body] if again else None))
    return out


def result(df):
    return {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.select(
        warc.page_number(df.record_id).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_number(df.refers_to).alias("refers_to")).collect()}


def nested():
    inner = warc.VERSION + "WARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 400)) for i in range(70)]
    rows += [(200 + i, None, f"{'é' * i}{inner * (i % 5)}{warc.VERSION}{'y' * 300}{warc.VERSION * 3}") for i in range(25)]
    return rows + [(300, "u\r\nWARC-Type: evil", None), (301, "a", ""), (302, "b", "same"), (303, "b", "same"), (None, "c", "same"), (304, "z", "\r\n\r\n")]


def test_round_trip_with_version_lines_inside_payloads(spark):
    rows = nested()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for split in ("700b", "4k", "128m"):
        path = tempfile.mkdtemp(prefix="spark-") + "/w"
        warc.write_archives(df, path)
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        try:
            back = warc.read_archives(spark, path)
            assert back.count() == len(rows), split
            assert result(back) == expected(rows)
            bodies = {r.payload_digest: bytes(r.payload) for r in back.where("record_type = 'response'").collect()}
            assert all(base64.b32encode(hashlib.sha1(b).digest()).decode() == d for d, b in bodies.items())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.unset("spark.sql.files.minPartitionNum")


def test_empty_table(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def forged(megabytes):
    """Version lines with headers of large lengths, as the text of one page."""
    one = warc.VERSION + "WARC-Type: response\r\nContent-Length: 900000000\r\n\r\nx\r\n\r\n"
    return one * (megabytes * (1 << 20) // len(one))


def batches_of(text):
    import pyarrow as pa

    lines = text.encode().split(warc.VERSION.encode())
    for low in range(0, len(lines), 1000):
        part = lines[low:low + 1000]
        yield pa.RecordBatch.from_pydict({"file": pa.array(["f"] * len(part)), "block": pa.array([0] * len(part), pa.int64()), "line": pa.array(part, pa.binary())})


def test_forged_records_cost_linear_time_and_bounded_memory():
    import time
    import tracemalloc

    import pyarrow as pa

    payload = forged(20)
    block = warc.HTTP_HEAD + payload
    text = warc.VERSION + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n" + block + warc.END

    def read():
        links = [b for b in warc._links(batches_of(text))]
        places = sum(b.num_rows for b in links)

        def met():
            for b in warc._placed(batches_of(text)):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([warc._M] * b.num_rows, pa.int64())], names=["file", "block", "line", "place", "entry"])

        return places, [b for b in warc._records(False)(met())]

    start = time.perf_counter()
    places, found = read()
    took = time.perf_counter() - start
    assert places > 250_000 and took < 30
    rows = [r for b in found for r in b.to_pylist()]
    assert len(rows) == 1 and rows[0]["payload_bytes"] == len(payload) and rows[0]["complete"]
    assert rows[0]["payload_digest"] == base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()
    tracemalloc.start()
    read()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500 << 20


def test_forged_records_in_a_table(spark):
    rows = [(1, "u", forged(1)), (2, "v", "plain"), (3, "w", forged(1) + "end"), (4, "v", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = tempfile.mkdtemp(prefix="spark-") + "/w"
    warc.write_archives(df, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        assert result(warc.read_archives(spark, path)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
