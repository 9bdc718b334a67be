import gzip

import pyarrow as pa
import pytest

from helixframe.sources import blockgzip as bg
from helixframe.sources import readers


def lines_of(path, split):
    out, size = [], path.stat().st_size
    for low in range(0, size, split):
        with pa.OSFile(str(path)) as file:
            out += b"".join(bg.range_text(file, low, min(size, low + split), size, chunk=1000)).splitlines(keepends=True)
    return out


@pytest.mark.parametrize("split", [64, 300, 1000, 5000, 10**6])
@pytest.mark.parametrize("block", [7, 100, 0xFF00])
@pytest.mark.parametrize("end", ["\n", ""])
def test_every_line_is_in_one_range(tmp_path, split, block, end):
    text = "\n".join("x" * (i * 37 % 400) + str(i) for i in range(120)) + "\n" + "long" * 3000 + "\n\nlast" + end
    path = tmp_path / "a.bgz"
    path.write_bytes(bg.pack_blocks(text.encode(), block_text=block) + bg.END_BLOCK)
    assert gzip.decompress(path.read_bytes()).decode() == text
    if block == 7 and split < 1000:
        return  # thousands of ranges
    assert b"".join(lines_of(path, split)).decode() == text


def test_headers_inside_blocks_are_no_blocks(tmp_path):
    inner = bg.pack_blocks(b"inner line\n" * 50)
    noise = b"".join(bytes([i % 251]) for i in range(3000)).replace(b"\n", b" ")
    text = b"\n".join([b"first", inner.replace(b"\n", b" ") + noise, b"last"]) + b"\n"
    stored = bg.pack_blocks(text, level=0)  # stored as it is, so that the inner headers stand in the file
    assert inner[:18] in stored
    path = tmp_path / "a.bgz"
    path.write_bytes(stored + bg.pack_blocks(b"more\n" * 30000) + bg.END_BLOCK)
    for split in (50, 101, 700, 4000):
        assert b"".join(lines_of(path, split)) == text + b"more\n" * 30000


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    rows = [(str(i), None if i % 7 == 0 else f"v{i}", "wide" * (i % 50), f"é{i}") for i in range(30000)]
    df = spark.createDataFrame(rows, "id string, a string, b string, `c d` string")
    bg.write_block_gzip(df.coalesce(1), str(tmp_path / "t"))
    file = next((tmp_path / "t").glob("*.bgz"))
    plain = tmp_path / "plain.tsv"
    plain.write_bytes(gzip.decompress(file.read_bytes()))
    whole = bg.read_block_gzip(spark, str(file), split_bytes=20_000)
    assert whole.rdd.getNumPartitions() > 5 and whole.columns == df.columns
    want = sorted(map(tuple, readers.read_delimited(spark, str(plain)).collect()), key=str)
    assert sorted(map(tuple, whole.collect()), key=str) == want
    some = bg.read_block_gzip(spark, str(tmp_path / "t"), ["c d", "id"], split_bytes=50_000)
    assert sorted(map(tuple, some.collect())) == sorted((r[3], r[0]) for r in rows)
    assert bg.read_block_lines(spark, str(file), 33_333).count() == 30001
    with pytest.raises(Exception, match="no such columns"):
        bg.read_block_gzip(spark, str(file), ["nope"]).collect()


def test_lines_of_other_widths_and_other_headers(spark, tmp_path):
    (tmp_path / "a.bgz").write_bytes(bg.pack_blocks(b"x\ty\r\n1\t2\r\n3\n\n4\t5\t6\r\n") + bg.END_BLOCK)
    got = bg.read_block_gzip(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [("1", "2"), ("3", None), ("4", "5")]
    (tmp_path / "b.bgz").write_bytes(bg.pack_blocks(b"y\tx\n1\t2\n") + bg.END_BLOCK)
    with pytest.raises(Exception, match="(?i)header"):
        bg.read_block_gzip(spark, str(tmp_path)).collect()
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"x\ty\n" * 50000))
    with pytest.raises(Exception, match="(?i)block"):
        bg.read_block_gzip(spark, str(tmp_path / "c.gz"), ["x"], split_bytes=64).collect()


def test_ranges_grow_with_the_bytes_once_they_are_many(spark, tmp_path, monkeypatch):
    assert bg.range_bytes(1 << 17, 10 << 20) == 1 << 17
    assert bg.range_bytes(1 << 17, 2 << 30) == 4 << 20 and bg.range_bytes(1 << 17, 1 << 40) == bg.SPLIT_BYTES
    assert bg.range_bytes(64 << 20, 1 << 40) == 64 << 20
    monkeypatch.setattr(bg, "MANY_RANGES", 4)
    bg.write_block_gzip(spark.range(40_000).selectExpr("md5(cast(id as string)) as a", "id as b").coalesce(1), str(tmp_path / "t"))
    source = bg.BlockGzipSource({"path": str(tmp_path / "t"), "splitBytes": "1000"})
    parts = source.reader(source.schema()).partitions()
    assert 4 <= len(parts) <= 5 and parts[0].start == 0 and parts[-1].end == parts[-1].size
