"""Attached files: workbooks and photographs read by the standard library."""

from __future__ import annotations

import io
import struct
import zipfile

import pytest

from archivolt.queries import attachments as made
from archivolt.sources import attachments as A

SCHEMA = "id int, type string, name string, content binary"


def read(spark, files):
    rows = spark.createDataFrame([(i, *f) for i, f in enumerate(files)], SCHEMA)
    return [(r["kind"], r["status"], r["text"], r["attrs"]) for r in A.read(rows).orderBy("id").collect()]


def test_workbook(spark):
    found = read(spark, [(None, "a.XLSX", made._workbook(7, "F", 2.5)), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", None, made._workbook(8, "O", 3.0))])
    assert found[0] == ("workbook", "ok", "# One\nOrder & key\t7\ninline\t2.5\tTrue\n# Två\nstatus\tmade", {"sheets": "One, Två"})
    assert found[1][2].endswith("inline\t3\tTrue\n# Två")


def test_bounds_of_a_workbook(monkeypatch):
    monkeypatch.setattr(A, "MOST_CELLS", 3)
    status, text, attrs = A.workbook(made._workbook(7, "F", 2.5))
    assert status == "ok" and "made" not in text and attrs == {"sheets": "One, Två"}
    monkeypatch.setattr(A, "MOST_PART", 100)
    try:
        A.workbook(made._workbook(7, "F", 2.5))
        raise AssertionError("a large part was unpacked")
    except ValueError as e:
        assert "more than 100 bytes" in str(e)


def test_photographs():
    assert A.image(made._jpeg(2, "1996:01:02")) == ("ok", None, {"format": "JPEG", "make": "Maker 2", "taken": "1996:01:02 10:00:00", "width": "3", "height": "3"})
    assert A.image(made._jpeg(6, "1996:01:02"))[2]["make"] == "Maker 1"  # the other byte order
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"crc!"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 640, 480, 8, 2, 0, 0, 0)) + chunk(b"eXIf", made._exif(">", "Nikon", "2001:02:03 04:05:06"))
    assert A.image(png)[2] == {"format": "PNG", "width": "640", "height": "480", "make": "Nikon", "taken": "2001:02:03 04:05:06"}
    assert A.image(b"GIF89a" + struct.pack("<HH", 9, 8) + b"..")[2] == {"format": "GIF", "width": "9", "height": "8"}


def test_directories_that_lie():
    ring = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 1) + struct.pack("<HHII", 0x8769, 4, 1, 8)
    assert A.exif(ring) == {} and A.exif(b"") == {} and A.exif(b"MM\0*\xff\xff\xff\xff") == {}
    far = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 9) + struct.pack("<HHII", 0x010F, 2, 50, 10**9)
    assert A.exif(far) == {}


def test_every_status(spark):
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    found = read(spark, [("text/plain", "x", b" \n"), ("TEXT/PLAIN; charset=x", None, "å\n".encode() + b"\xff"), ("application/pdf", "a.pdf", b"%PDF"), (None, None, b"x"), ("image/png", "x", b"no"), (None, "a.xlsx", empty.getvalue()), (None, "a.txt", None), ("text/csv", None, b"a" * 300_000)])
    assert [(k, s) for k, s, _, _ in found] == [("text", "empty"), ("text", "ok"), (None, "unsupported"), (None, "unsupported"), ("image", "error"), ("workbook", "error"), ("text", "missing"), ("text", "truncated")]
    assert found[1][2] == "å\n�" and found[4][3]["error"].startswith("ValueError") and len(found[7][2]) == 200_000
    assert read(spark, []) == []


def book(parts, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as made_of:
        for name, text in parts.items():
            made_of.writestr(name, text)
    return out.getvalue()


def parts_of(data):
    with zipfile.ZipFile(io.BytesIO(data)) as whole:
        return {name: whole.read(name).decode() for name in whole.namelist()}


def told(data):
    try:
        return A.workbook(data)
    except Exception as e:
        return type(e).__name__, str(e)


def test_made_workbooks_are_whole_archives():
    with zipfile.ZipFile(io.BytesIO(made._workbook(7, "F", 2.5))) as whole:
        assert whole.testzip() is None and {e.compress_type for e in whole.infolist()} == {zipfile.ZIP_DEFLATED}
        assert sorted(whole.namelist()) == ["xl/_rels/workbook.xml.rels", "xl/sharedStrings.xml", "xl/workbook.xml", "xl/worksheets/a.xml", "xl/worksheets/b.xml"]


def test_small_parts_need_no_file_objects(monkeypatch):
    data = made._workbook(7, "F", 2.5)
    files, want = [data, book(parts_of(data))], A.workbook(data)

    def no(*_, **__):
        raise AssertionError("a small part was opened as a file or parsed as one")

    monkeypatch.setattr(zipfile.ZipFile, "open", no)
    monkeypatch.setattr(A.ElementTree, "iterparse", no)
    assert [A.workbook(x) for x in files] == [want, want]


def test_parts_that_lie_are_told_by_zipfile(monkeypatch):
    plain, stored = made._workbook(7, "F", 2.5), book(parts_of(made._workbook(7, "F", 2.5)), zipfile.ZIP_STORED)
    second = plain.index(b"PK\1\2", plain.index(b"PK\1\2") + 4)
    overlapped = plain[: second + 42] + struct.pack("<I", 0) + plain[second + 46 :]
    damaged = [plain[:i] + bytes([plain[i] ^ bit]) + plain[i + 1 :] for i in range(len(plain)) for bit in (1, 0x40)]
    files = [plain, stored, b"before" + plain, plain[:-1], overlapped, *damaged]
    found = [told(x) for x in files]
    assert found[0] == found[1] == found[2] and found[0][0] == "ok" and found[4][0] == "BadZipFile"
    monkeypatch.setattr(A, "_small_part", lambda *_: None)
    assert found == [told(x) for x in files]


def test_parts_beyond_the_small_ones():
    parts = parts_of(made._workbook(7, "F", 2.5))
    rows = [f"<row><c><v>{i}</v></c></row>" for i in range(3000)]
    large = book(parts | {"xl/worksheets/a.xml": made._sheet(rows)})
    assert A.workbook(large)[1].split("\n") == ["# One", *map(str, range(3000)), "# Två", "status\tmade"]
    with pytest.raises(A.ElementTree.ParseError):
        A.workbook(book(parts | {"xl/worksheets/a.xml": made._sheet(rows)[:-9]}))


def test_remembered_parts_belong_to_their_bytes():
    parts = parts_of(made._workbook(7, "F", 2.5))
    other = book(parts | {"xl/sharedStrings.xml": parts["xl/sharedStrings.xml"].replace("key", "lock")})
    turned = book(parts | {"xl/_rels/workbook.xml.rels": parts["xl/_rels/workbook.xml.rels"].replace("/b.xml", "/x.xml").replace("/a.xml", "/b.xml").replace("/x.xml", "/a.xml")})
    for _ in range(2):
        assert "Order & lock\t7" in A.workbook(other)[1] and "Order & key\t7" in A.workbook(made._workbook(7, "F", 2.5))[1]
        assert A.workbook(turned)[1].startswith("# One\nstatus\tmade\n# Två\nOrder")


def test_orders_of_one_small_file_go_to_all_cores(spark):
    assert made.s13_attachment_formats(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
