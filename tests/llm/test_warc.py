"""ZIP packages of web archives: what was written against what is read, and packages made by the standard library."""

import base64
import gzip
import hashlib
import io
import json
import zipfile

import pytest

from arggraph_spark.llm import warc

SCHEMA = "page_id long, url string, html string, payload binary, offset string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, b"x", "y") for r in rows], SCHEMA).repartition(3)


def plain(rows, least=0):
    groups, out = {}, []
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    for r in sorted(rows, key=order):
        raw = (r[2] or "").encode()
        first = groups.setdefault(raw, r) if len(raw) >= least else r
        sha = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((r[0], len(raw), sha, *(("response", None) if first is r else ("revisit", first[0]))))
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


ROWS = [
    (5, "http://a.example/x", "same"), (3, "http://b.example/y z\r\nX: 1", "same"), (9, None, "same"), (None, "u", "same"), (None, None, None), (2, "http://c.example/", None), (1, "ü", ""),
    (7, "http://d.example/", "\r\n\r\nHTTP/1.1 200 OK\r\n\r\nWARC/1.1"), (8, "http://[bad", "<p>é 日本</p>"), (11, "http://e.example/?a=b", "x" * 3_000_000), (12, "http://f.example/", "y" * 70_000),
]


@pytest.mark.parametrize("least", [0, 1, 5])
def test_round_trip(spark, least):
    rows = [[*r] for r in ROWS]
    got = warc.page_records(warc.read_packages(warc.write_packages(pages(spark, rows), least=least)))
    assert result(got) == plain(rows, least)


def test_rows_equal_in_all_columns_have_one_response(spark):
    rows = [[4, "u", "same"] for _ in range(50)] + [[4, "v", "same"], [2, None, None], [2, None, None], [6, "u", "other"], [None, None, "n"], [None, None, "n"]]
    got = warc.page_records(warc.read_packages(warc.write_packages(pages(spark, rows))))
    assert result(got) == plain(rows)


def test_empty_table(spark):
    got = warc.read_packages(warc.write_packages(pages(spark, [[1, "u", "x"]]).limit(0)))
    assert got.count() == 0


def test_small_packages_and_stretches(spark, tmp_path):
    rows = [[i, f"http://h.example/{i}", f"page {i % 7} " * 50] for i in range(60)]
    written = warc.write_packages(pages(spark, rows), folder=f"file://{tmp_path}", package_bytes=2000)
    names = [r["package"] for r in written.collect()]
    assert len(names) > 5
    assert result(warc.page_records(warc.read_packages(written.unionByName(written), stretch=300))) == plain(rows)
    for n in names:  # any reader opens them
        with zipfile.ZipFile(n.removeprefix("file://")) as z:
            assert z.testzip() is None
            raw = gzip.decompress(z.read("archive/data.warc.gz"))
            lines = z.read("indexes/index.cdxj").decode().splitlines()
        assert raw.count(b"WARC/1.1\r\n") == len(lines) + 1
        assert lines == sorted(lines)


def record(i, body=b"", kind="resource", extra=()):
    return warc.record({"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{i}>", "Content-Type": "text/plain", **dict(extra)}, body)


def package(path, members, before=b"", comment=b""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for name, data, method in members:
            z.writestr(zipfile.ZipInfo(name), data, compress_type=method)
        z.comment = comment
    path.write_bytes(before + held.getvalue())
    return str(path)


def read(spark, *names):
    return warc.read_packages(spark.createDataFrame([(n,) for n in names], "package string")).orderBy("offset").collect()


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("before", [b"", b"#!stub\n" * 100])
def test_archives_without_an_index_are_scanned(spark, tmp_path, packed, before, monkeypatch):
    bodies = [b"", b"a" * 10, b"\r\n\r\nb" * 500, b"c" * 100_000]
    raw = b"".join(gzip.compress(record(i, b)) if packed else record(i, b) for i, b in enumerate(bodies))
    monkeypatch.setattr(warc, "SCAN_BYTES", 5000)
    name = "archive/a.warc.gz" if packed else "archive/a.warc"
    rows = read(spark, package(tmp_path / "a.wacz", [(name, raw, 0), ("pages/pages.jsonl", b"{}", 8)], before, b"PK\x05\x06 in the comment"))
    assert [(r["record_id"], bytes(r["payload"]), r["problem"]) for r in rows] == [(f"<urn:x:{i}>", b, None) for i, b in enumerate(bodies)]


@pytest.mark.parametrize("compressed", [False, True])
def test_zip64_directory(tmp_path, monkeypatch, compressed):
    """Sizes, offsets and counts beyond the old limits, which are lowered here so that small files have them."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 3)
    data = [(f"archive/{i}.warc", bytes([65 + i]) * (40 * i), 8 if compressed and i == 2 else 0) for i in range(6)]
    for before in (b"", b"before"):
        name = package(tmp_path / f"z{len(before)}.zip", data, before)
        with open(name, "rb") as f:
            size = f.seek(0, 2)
            found = warc.members(f, size)
            assert [(m.name, m.size) for m in found] == [(n, len(d)) for n, d, _ in data]
            for m, (_, d, _) in zip(found, data, strict=True):
                if not m.method:
                    assert warc._at(f, warc.content_start(f, m), m.size) == d


def test_many_members(tmp_path):
    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"f{i}"), b"")
    with open(tmp_path / "m.zip", "rb") as f:
        assert len(warc.members(f, f.seek(0, 2))) == 66_000


@pytest.mark.parametrize("kind", ["cdx", "cdxj", "cdxj.gz"])
def test_indexes_stored_deflated_and_gzipped(spark, tmp_path, kind):
    packed = [gzip.compress(record(i, b"x" * i)) for i in range(4)]
    at, lines = 0, ["!meta 0 {}", "no index line"]
    for p in packed[1:3]:
        at += len(packed[0]) if not at else 0
        lines.append("com,example)/ 2020 " + json.dumps({"filename": "archive/a.warc.gz", "offset": at, "length": str(len(p))}))
        at += len(p)
    lines.append('x 1 {"filename": "a.warc.gz", "offset": 1000000, "length": 5}')
    index = "\n".join(lines).encode()
    index = gzip.compress(index[:20]) + gzip.compress(index[20:]) if kind.endswith("gz") else index
    rows = read(spark, package(tmp_path / "i.wacz", [("archive/a.warc.gz", b"".join(packed), 0), (f"indexes/index.{kind}", index, 8)]))
    assert [r["record_id"] for r in rows if not r["problem"]] == ["<urn:x:1>", "<urn:x:2>"]
    assert [r["problem"] for r in rows if r["problem"]] == ["the index points outside its archive"]


def test_damage_gives_rows_with_problems(spark, tmp_path):
    whole = package(tmp_path / "w.wacz", [("archive/a.warc", record(1, b"abc"), 0)])
    cut = tmp_path / "cut.wacz"
    cut.write_bytes(open(whole, "rb").read()[:-30])
    empty = tmp_path / "empty.wacz"
    empty.write_bytes(b"")
    bad = record(2, b"abc", extra={"WARC-Payload-Digest": "sha1:AAAA"}.items())
    names = [
        package(tmp_path / "c.wacz", [("archive/a.warc", record(1, b"abc"), 8)]),
        package(tmp_path / "t.wacz", [("archive/a.warc", record(1, b"abc")[:-6], 0)]),
        package(tmp_path / "g.wacz", [("archive/a.warc.gz", gzip.compress(record(1, b"abc"))[:-9], 0)]),
        package(tmp_path / "d.wacz", [("archive/a.warc", bad, 0)]),
        package(tmp_path / "n.wacz", [("archive/a.warc", b"not a record", 0)]),
        str(cut), str(empty), str(tmp_path / "absent.wacz"),
    ]
    rows = read(spark, *names)
    assert {r["package"] for r in rows} == set(names)
    assert all(r["problem"] for r in rows)
    assert [bytes(r["payload"]) for r in rows if r["payload"] is not None] == [b"abc"]
    good = read(spark, whole)
    assert [(bytes(r["payload"]), r["problem"]) for r in good] == [(b"abc", None)]
