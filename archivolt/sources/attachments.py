"""Text and facts of attached files: plain text, workbooks and images, by the standard library alone.

A file is read within bounds: characters of text, cells of a workbook, bytes of
one unpacked part.  What a file can't give is told by its status, never raised.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bounds of what is read of one file, and kinds by type and by name.
MOST_CHARS, MOST_CELLS, MOST_PART = 200_000, 50_000, 64 << 20
TYPES = {
    "text/plain": "text", "text/csv": "text", "text/markdown": "text", "application/json": "text",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "workbook",
    "image/jpeg": "image", "image/png": "image", "image/gif": "image",
}
ENDINGS = {"txt": "text", "csv": "text", "md": "text", "json": "text", "log": "text", "xlsx": "workbook", "xlsm": "workbook", "jpg": "image", "jpeg": "image", "png": "image", "gif": "image"}
#: Directory entries of a photograph.
EXIF = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "datetime", 0x9003: "taken"}
EXIF_DIRECTORY, ASCII = 0x8769, 2
FOUND = "struct<kind:string,status:string,text:string,attrs:map<string,string>>"
_FOUND = {"kind": pa.string(), "status": pa.string(), "text": pa.string(), "attrs": pa.map_(pa.string(), pa.string())}
#: The length of an entry's own header in an archive, bytes of a small part (also what a parser gets at once), small parts remembered.
HEADER, SMALL, KEPT = 30, 16 << 10, 64


def _ends(book: zipfile.ZipFile) -> dict[int, int]:
    """Where each entry has to end at the latest, by its place; nothing if two stand at one place."""
    places = sorted(e.header_offset for e in book.infolist())
    found = dict(zip(places, [*places[1:], book.start_dir]))
    return found if len(found) == len(places) else {}


def _small_part(data: bytes, entry: zipfile.ZipInfo, ends: dict[int, int]) -> bytes | None:
    """A small deflated entry, if all that the archive says of it holds; None leaves it to ``zipfile``, which takes several times as long."""
    at = entry.header_offset
    if entry.compress_type != zipfile.ZIP_DEFLATED or entry.flag_bits or entry.file_size > SMALL or not 0 <= at <= len(data) - HEADER:
        return None
    mark, flags, named, more = struct.unpack_from("<4s2xH18xHH", data, at)
    start = at + HEADER + named
    end = start + more + entry.compress_size
    if mark != b"PK\3\4" or flags or end > ends.get(at, 0) or data[at + HEADER : start].decode("cp437") != entry.orig_filename:
        return None
    opened = zlib.decompressobj(-zlib.MAX_WBITS)
    try:
        out = opened.decompress(data[start + more : end], SMALL + 1)
    except zlib.error:
        return None
    return out if opened.eof and len(out) == entry.file_size and zlib.crc32(out) == entry.CRC else None


def _part(book: zipfile.ZipFile, data: bytes, ends: dict[int, int], name: str) -> bytes:
    """One unpacked part; more bytes than ``MOST_PART`` are an error, whatever the archive says of its size."""
    out = _small_part(data, book.getinfo(name), ends)
    if out is None:
        with book.open(name) as f:
            out = f.read(MOST_PART + 1)
    if len(out) > MOST_PART:
        raise ValueError(f"{name} unpacks to more than {MOST_PART} bytes")
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(data: bytes, name: str) -> Iterator[ElementTree.Element]:
    """Whole elements of a name as they end; each is emptied behind its use."""
    parser = ElementTree.XMLPullParser(("end",))  # iterparse makes a class for every call
    for at in range(0, len(data) + SMALL, SMALL):
        if at < len(data):
            parser.feed(data[at : at + SMALL])
        else:
            parser.close()
        for _, e in parser.read_events():
            if _local(e.tag) == name:
                yield e
                e.clear()


def _said(e: ElementTree.Element) -> str:
    """The text of all runs below an element, without phonetic ones."""
    return "".join(t.text or "" for child in e if _local(child.tag) != "rPh" for t in child.iter() if _local(t.tag) == "t")


def _remembered(reader: Callable) -> Callable:
    """A reader of parts that keeps what it found in small ones: workbooks of one program have many alike."""
    kept = lru_cache(KEPT)(reader)
    return lambda part: (kept if len(part) <= SMALL else reader)(part)


@_remembered
def _targets(part: bytes) -> dict[str | None, str]:
    return {e.get("Id"): e.get("Target", "") for e in ElementTree.fromstring(part)}


@_remembered
def _strings(part: bytes) -> list[str]:
    return [_said(e) for e in _elements(part, "si")]


@_remembered
def _sheets(part: bytes) -> list[tuple[str, list[str]]]:
    """The sheets' names and references."""
    return [(e.get("name", ""), [v for k, v in e.attrib.items() if _local(k) == "id"][:1]) for e in ElementTree.fromstring(part).iter() if _local(e.tag) == "sheet"]


def _number(raw: str) -> str:
    x = float(raw)
    return str(int(x)) if x.is_integer() and abs(x) < 1e15 else str(x)


def _cell(c: ElementTree.Element, shared: list[str]) -> str:
    kind, value = c.get("t", "n"), next((e.text or "" for e in c if _local(e.tag) == "v"), None)
    if kind == "inlineStr":
        return "".join(_said(e) for e in c if _local(e.tag) == "is")
    if value is None or not value.strip():
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value.strip() == "1" else "False"
    return _number(value) if kind == "n" else value


def workbook(data: bytes) -> tuple[str, str | None, dict[str, str]]:
    """Sheets in order, each under its name, a line per row of the cells that hold something, tabs between."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names, ends = set(book.namelist()), _ends(book)
        targets = _targets(_part(book, data, ends, "xl/_rels/workbook.xml.rels"))
        shared = _strings(_part(book, data, ends, "xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in names else []
        sheets, lines, cells = [], [], 0
        for name, ids in _sheets(_part(book, data, ends, "xl/workbook.xml")):
            sheets.append(name)
            if cells >= MOST_CELLS:
                continue
            lines.append(f"# {sheets[-1]}")
            target = targets.get(ids[0], "") if ids else ""
            path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for row in _elements(_part(book, data, ends, path), "row"):
                values = [v for v in (_cell(c, shared) for c in row if _local(c.tag) == "c") if v.strip()]
                if values:
                    lines.append("\t".join(values))
                    cells += len(values)
                if cells >= MOST_CELLS:
                    break
    return "ok" if cells else "empty", "\n".join(lines)[:MOST_CHARS], {"sheets": ", ".join(sheets)}


def exif(tiff: bytes) -> dict[str, str]:
    """The named entries of a photograph's directories; what lies outside the data is passed over."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8 or struct.unpack(order + "H", tiff[2:4])[0] != 42:
        return {}
    found, waiting, seen = {}, [struct.unpack(order + "I", tiff[4:8])[0]], set()
    while waiting:
        at = waiting.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for i in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
            entry = tiff[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, size, value = struct.unpack(order + "HHII", entry)
            if tag == EXIF_DIRECTORY:
                waiting.append(value)
            elif tag in EXIF and kind == ASCII:
                raw = entry[8 : 8 + size] if size <= 4 else tiff[value : value + size]
                text = raw.split(b"\0")[0].decode("utf-8", "replace").strip()
                if text:
                    found[EXIF[tag]] = text[:100]
    return found


def _jpeg(data: bytes) -> dict[str, str]:
    out, at = {"format": "JPEG"}, 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD8:  # fill bytes and marks without a length
            at += 1 if mark == 0xFF else 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        if mark == 0xE1 and body.startswith(b"Exif\0\0"):
            out |= exif(body[6:])
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack(">HH", body[1:5])
            return out | {"width": str(width), "height": str(height)}
        at += 2 + size
    raise ValueError("a JPEG without a frame")


def _png(data: bytes) -> dict[str, str]:
    width, height = struct.unpack(">II", data[16:24])
    out, at = {"format": "PNG", "width": str(width), "height": str(height)}, 8
    while at + 8 <= len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"eXIf":
            out |= exif(data[at + 8 : at + 8 + size])
        at += 12 + size
    return out


def image(data: bytes) -> tuple[str, None, dict[str, str]]:
    """Format, size, and what the camera wrote."""
    if data[:2] == b"\xff\xd8":
        return "ok", None, _jpeg(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return "ok", None, _png(data)
    if data[:4] == b"GIF8":
        width, height = struct.unpack("<HH", data[6:10])
        return "ok", None, {"format": "GIF", "width": str(width), "height": str(height)}
    raise ValueError("no image that is known")


def plain(data: bytes) -> tuple[str, str, dict[str, str]]:
    whole = data.decode("utf-8", "replace")
    return ("empty" if not whole.strip() else "truncated" if len(whole) > MOST_CHARS else "ok"), whole[:MOST_CHARS], {}


_READERS = {"text": plain, "workbook": workbook, "image": image}


def _kind(type_: str | None, name: str | None) -> str | None:
    found = TYPES.get((type_ or "").split(";")[0].strip().lower())
    return found or ENDINGS.get((re.search(r"\.([^.]+)$", name or "") or [None, ""])[1].lower())


def read(files: DataFrame) -> DataFrame:
    """``files`` (type, name, content and others) with ``kind``, ``status``, ``text`` and ``attrs``.

    The type decides, else the name's ending.  Status: ok, truncated (text beyond the
    bound), empty, error (told in ``attrs``), unsupported (other kinds) or missing (null
    content).  Bytes that aren't UTF-8 become replacement marks; equal files are read
    alike; columns that are named like the new ones are replaced.
    """

    def found(types: pa.Array, names: pa.Array, contents: pa.Array) -> pa.Array:
        rows = {c: [] for c in _FOUND}
        for type_, name, content in zip(types, names, contents):
            kind, data = _kind(type_.as_py(), name.as_py()), content.as_py()
            try:
                told = ("missing" if data is None else "unsupported", None, {}) if data is None or kind is None else _READERS[kind](bytes(data))
            except Exception as e:  # a broken file is a row, not a failed job
                told = "error", None, {"error": f"{type(e).__name__}: {e}"[:300]}
            for c, v in zip(_FOUND, (kind, *told[:2], list(told[2].items()))):
                rows[c].append(v)
        return pa.StructArray.from_arrays([pa.array(rows[c], t) for c, t in _FOUND.items()], list(_FOUND))

    made = files.withColumn("__found", F.arrow_udf(found, FOUND).asNondeterministic()("type", "name", "content"))
    return made.withColumns({c: F.col("__found")[c] for c in _FOUND}).drop("__found")
