import base64
import hashlib
import random
import zlib

import pytest

from rankweave.llm import warc
from rankweave.llm.shared import scratch_path

SCHEMA = "page_id long, url string, html string, digest string, first long, path string"


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    bodies = [f"<html>{''.join(rng.choices('abc dé', k=rng.choice([0, 50, 4000])))}</html>\r\n\r\n" for _ in range(60)]
    rows = [(i, f"http://x/{i} \r\ny", b, "q", 1, "z") for i, b in enumerate(bodies)]
    rows += [(100 + i, None, bodies[i % 3], None, None, None) for i in range(40)]
    rows += [(200, "u", None, "", 0, ""), (201, "u", "", "", 0, ""), (0, "again", bodies[0], "", 0, ""), (None, "none", bodies[1], "", 0, "")]
    rows += [(300, "big", "".join(chr(rng.randint(33, 0x2FF)) for _ in range(200_000)), "", 0, "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("size", [warc.RANGE, 1000, 37_000])
def test_round_trip(spark, pages, size):
    files = warc.write_archives(pages, scratch_path(spark, "warc"))
    got = warc.read_archives(files, size).collect()
    rows = pages.collect()
    first = {}
    for r in rows:
        h = r.html or ""
        if r.page_id is not None:
            first[h] = min(first.get(h, r.page_id), r.page_id)
    expected = []
    for r in rows:
        body = (r.html or "").encode()
        f = first.get(r.html or "")
        again = f is not None and r.page_id != f
        expected.append((f"{warc.ID}{r.page_id}", "revisit" if again else "response", base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body), f"{warc.ID}{f}" if again else None, None if again else body))
    assert sorted(((r.record_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got), key=str) == sorted(expected, key=str)


def test_archives_are_ordinary_gzip_members(spark, pages):
    files = warc.write_archives(pages, scratch_path(spark, "warc"))
    n = 0
    for row in files.collect():
        data = open(row.path.removeprefix("file:"), "rb").read()
        assert len(data) == row.bytes
        while data:
            one = zlib.decompressobj(31)
            assert one.decompress(data).startswith(b"WARC/1.0\r\n")
            data, n = one.unused_data, n + 1
    assert n == pages.count()


def test_false_magic_is_passed_over(tmp_path):
    members = [warc.record(i, "u", bytes(b"\x1f\x8b\x08\x00" * 50) + bytes([i]), None) for i in range(5)]
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    members.insert(2, (s := stored.compress(b"WARC/1.0\r\nX: 1\r\n\r\n" + b"\x1f\x8b\x08\x00junk" * 30)) + stored.flush())
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    size = path.stat().st_size
    starts = [0, *(sum(map(len, members[: k + 1])) for k in range(5))]
    for step in (7, 100, size):
        found = [at for low in range(0, size, step) for at, _ in warc.read_range(f"file://{path}", low, min(size, low + step))]
        assert found == starts
    assert s


def member(text, level=6, extra=b"", name=b""):
    """A gzip member with a header of any length."""
    raw = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = raw.compress(text) + raw.flush()
    head = bytes([0x1F, 0x8B, 8, (4 if extra else 0) | (8 if name else 0), 0, 0, 0, 0, 0, 255])
    head += (len(extra).to_bytes(2, "little") + extra if extra else b"") + (name + b"\0" if name else b"")
    return head + body + zlib.crc32(text).to_bytes(4, "little") + (len(text) & 0xFFFFFFFF).to_bytes(4, "little")


@pytest.mark.parametrize("step", [100, 5000, 1 << 20])
def test_long_gzip_headers(tmp_path, step):
    texts = [zlib.decompress(warc.record(i, "u", b"x" * 50, None), 31) for i in range(3)]
    data = [member(texts[0]), member(texts[1], extra=b"e" * 60_000, name=b"n" * 5000), member(texts[2], name=b"a" * 2000)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(data))
    found = [at for low in range(0, sum(map(len, data)), step) for at, _ in warc.read_range(f"file://{path}", low, min(sum(map(len, data)), low + step))]
    assert found == [0, len(data[0]), len(data[0]) + len(data[1])]


@pytest.mark.parametrize("size", [60, 300, 1000, 100_000])
def test_a_stored_inner_archive_is_not_read_as_records(spark, tmp_path, size):
    inner = b"".join(warc.record(900 + i, "in", b"inner" * 20, None) for i in range(5))
    texts = [zlib.decompress(warc.record(i, "u", inner if i == 1 else b"x%d" % i, None), 31) for i in range(4)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(member(t, 0 if i == 1 else 6) for i, t in enumerate(texts)))
    files = spark.createDataFrame([(f"file://{path}", path.stat().st_size)], "path string, bytes long")
    got = warc.read_archives(files, size).collect()
    assert sorted(r.record_id for r in got) == [f"{warc.ID}{i}" for i in range(4)]
    assert next(bytes(r.payload) for r in got if r.record_id == f"{warc.ID}1") == inner


def test_equal_payloads_without_any_page_id_are_responses(spark):
    rows = [(None, "a", "same", None, None, None), (None, "b", "same", None, None, None), (None, "c", None, None, None, None), (7, "d", "", None, None, None)]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "warc"))).collect()
    assert sorted((r.target_uri, r.record_type, r.refers_to) for r in got) == [("a", "response", None), ("b", "response", None), ("c", "revisit", f"{warc.ID}7"), ("d", "response", None)]


def test_damage_is_told(tmp_path):
    path = tmp_path / "a.warc.gz"
    path.write_bytes(warc.record(1, "u", b"x" * 1000, None)[:-20])
    with pytest.raises(EOFError):
        list(warc.read_range(f"file://{path}", 0, path.stat().st_size))


def test_least_payload(spark, pages):
    got = warc.read_archives(warc.write_archives(pages, scratch_path(spark, "warc"), least_payload=10_000)).collect()
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 10_000)


def test_empty(spark):
    files = warc.write_archives(spark.createDataFrame([], SCHEMA), scratch_path(spark, "warc"))
    assert warc.read_archives(files).count() == 0
