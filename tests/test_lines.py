"""The line source: ends of lines across chunks and ranges, long and broken lines, streams."""

import random
import re
import resource

import pytest

from millrace.operators import contract
from millrace.sources import lines


def plain(data, most):
    """Places and lines by a split of the whole."""
    out, at = [], 0
    for m in re.finditer(rb"\r\n|\r|\n", data):
        out.append((at, data[at : m.start()]))
        at = m.end()
    if at < len(data):
        out.append((at, data[at:]))
    return [(p, v if len(v) <= most else None) for p, v in out]


def test_ranges_and_chunks():
    """Each line comes once, with its place, whatever the chunks and ranges, also where CR and LF are parted."""
    rng = random.Random(1)
    texts = [b"", b"\n", b"\r", b"\r\n", b"a", b"a\r\nb", b"\r\r\n\n", b"abc\r"] + [bytes(rng.choice(b"ab\r\n") for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    for data in texts:
        for chunk in (1, 2, 3, 7, 100):
            for split in (1, 2, 5, 100):
                got = []
                for b in range(0, len(data), split):
                    got += lines.lines_of(lambda at, n, data=data: data[at : at + n], len(data), b, min(b + split, len(data)), 4, chunk)
                assert got == plain(data, 4), (data, chunk, split)


def table(spark, folder, **options):
    """The folder's rows."""
    reader = spark.read.format(lines.register(spark)).option("path", str(folder))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_read(spark, tmp_path):
    """Order, limits in UTF-16 units, broken UTF-8, empty and hidden files; the rows are requests."""
    (tmp_path / "b.txt").write_bytes("é\r\n\r\n".encode() + b"\xff\n" + "😀😀".encode() + b"\n" + b"xxxx\nxxxxx\n")
    (tmp_path / "a.txt").write_bytes(b"last")
    (tmp_path / "_no").write_bytes(b"x")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    want = [("a.txt", 0, "last", False, None), ("b.txt", 0, "é", False, None), ("b.txt", 4, "", False, None), ("b.txt", 6, None, False, "notUtf8"), ("b.txt", 8, "😀😀", False, None), ("b.txt", 17, "xxxx", False, None), ("b.txt", 22, None, True, "requestTooLarge")]
    for options in ({}, {"split": 3}, {"chunk": 1, "split": 4}):
        rows = table(spark, tmp_path, limit=4, **options)
        assert [tuple(r) for r in rows.orderBy("file", "offset").collect()] == want
    errors = [r["error"] for r in contract.parse_requests(rows).orderBy("file", "offset").collect()]
    assert errors[3] == "invalidJson" and errors[6] == "requestTooLarge"
    assert table(spark, tmp_path / "sub").count() == 0
    assert table(spark, f"file://{tmp_path}", limit=4).count() == 7


def test_long_line(tmp_path):
    """A line of 100 MB is passed over in small memory, in one range and in many."""
    with open(tmp_path / "a", "wb") as f:
        f.write(b"first\n")
        for _ in range(100):
            f.write(b"x" * (1 << 20))
        f.write(b"\nlast\n")
    folder = lines.Folder({"path": str(tmp_path)})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for split in (1 << 30, 10 << 20):
        folder.split = split
        rows = [r for p in folder.pieces(folder.files()) for b in folder.read(p) for r in b.to_pylist()]
        assert [(r["value"], r["reason"]) for r in rows] == [("first", None), (None, "requestTooLarge"), ("last", None)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 40_000


def test_stream(spark, tmp_path):
    """Files that come are read once over restarts; one that comes among those read is an error."""
    source = tmp_path / "in"
    source.mkdir()
    lines.register(spark)

    def run():
        stream = spark.readStream.format(lines.NAME).option("path", str(source)).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return query

    (source / "1").write_bytes(b"a\nb")
    run()
    (source / "2").write_bytes(b"c\r")
    run()
    run()
    assert sorted((r["file"], r["offset"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", 0, "a"), ("1", 2, "b"), ("2", 0, "c")]
    (source / "0").write_bytes(b"late")
    (source / "3").write_bytes(b"d")
    with pytest.raises(Exception, match="2 files up to '2'"):
        run()
