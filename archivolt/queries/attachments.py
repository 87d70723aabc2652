"""Attached files of four formats, written from orders and read again."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.registry import Registry
from archivolt.sources import attachments

registry = Registry()


def _sheet(rows: list[str]) -> str:
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(rows)}</sheetData></worksheet>'


def _entry(name: str, text: str, at: int) -> tuple[bytes, bytes]:
    """A deflated entry of an archive that stands at a place, and its line of the directory."""
    said, data = name.encode(), text.encode()
    packed = zlib.compress(data, wbits=-zlib.MAX_WBITS)
    facts = struct.pack("<4H3I2H", 0, 8, 0, 0x21, zlib.crc32(data), len(packed), len(data), len(said), 0)
    return b"PK\3\4" + struct.pack("<H", 20) + facts + said + packed, b"PK\1\2" + struct.pack("<2H", 20, 20) + facts + struct.pack("<3H2I", 0, 0, 0, 0, at) + said


@lru_cache
def _same(made: bool) -> tuple[bytes, bytes]:
    """The entries that all workbooks with the same second sheet have, and their lines of the directory."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    parts = {
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="r1"/><sheet name="Två" sheetId="2" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r2" Target="worksheets/b.xml"/><Relationship Id="r1" Target="/xl/worksheets/a.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{main}"><si><t>Order &amp; key</t></si><si><r><t>sta</t></r><r><t>tus</t></r><rPh><t>x</t></rPh></si></sst>',
        "xl/worksheets/b.xml": _sheet(['<row><c t="s"><v>1</v></c><c t="str"><v>made</v></c></row>'] if made else []),
    }
    entries, lines = b"", b""
    for name, text in parts.items():
        entry, line = _entry(name, text, len(entries))
        entries, lines = entries + entry, lines + line
    return entries, lines


def _workbook(key: int, status: str, price: float) -> bytes:
    """Two sheets: shared and inline strings, numbers, a truth value, empty cells and rows."""
    first = _sheet([f'<row><c t="s"><v>0</v></c><c><v>{key}</v></c><c/></row>', "<row/>", f'<row><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c><v>{price!r}</v></c><c t="b"><v>1</v></c></row>'])
    entries, lines = _same(status == "F")
    entry, line = _entry("xl/worksheets/a.xml", first, len(entries))
    return entries + entry + lines + line + struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, 5, 5, len(lines) + len(line), len(entries) + len(entry), 0)


def _exif(order: str, maker: str, taken: str) -> bytes:
    """A directory with a maker and a second one with the time of the picture."""
    made, at = maker.encode() + b"\0", taken.encode() + b"\0"
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    first = struct.pack(order + "H", 2) + struct.pack(order + "HHII", 0x010F, 2, len(made), 38) + struct.pack(order + "HHII", 0x8769, 4, 1, 38 + len(made)) + b"\0" * 4
    second = struct.pack(order + "H", 1) + struct.pack(order + "HHII", 0x9003, 2, len(at), 38 + len(made) + 18) + b"\0" * 4
    return head + first + made + second + at


def _jpeg(key: int, day: str) -> bytes:
    tiff = b"Exif\0\0" + _exif("<" if key % 8 < 4 else ">", f"Maker {key % 5}", f"{day} 10:00:00")
    frame = struct.pack(">BHHB", 8, key % 900 + 1, key % 700 + 1, 3) + b"\0" * 9
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 2) + tiff + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame + b"\xff\xd9"


def _content(key: pd.Series, status: pd.Series, price: pd.Series, day: pd.Series) -> pd.Series:
    out = []
    for k, s, p, d in zip(key, status, price, day):
        kind = k % 4
        out.append(f"Order {k}".encode() if kind == 0 else _workbook(k, s, p) if kind == 1 else _jpeg(k, d) if kind == 2 else b"PK broken" if k % 8 == 3 else b"%PDF-1.7")
    return pd.Series(out, index=key.index, dtype=object)


@registry.add(
    "select o_orderkey as id, case o_orderkey % 4 when 0 then 'text' when 1 then 'workbook' when 2 then 'image' else case when o_orderkey % 8 = 3 then 'workbook' end end as kind,"
    " case when o_orderkey % 4 < 3 then 'ok' when o_orderkey % 8 = 3 then 'error' else 'unsupported' end as status,"
    " case o_orderkey % 4 when 0 then concat('Order ', o_orderkey) when 1 then concat('# One', chr(10), 'Order & key', chr(9), o_orderkey, chr(10), 'inline', chr(9), case when o_totalprice = floor(o_totalprice) then o_totalprice::bigint::varchar else o_totalprice::varchar end, chr(9), 'True', chr(10), '# Två', case when o_orderstatus = 'F' then concat(chr(10), 'status', chr(9), 'made') else '' end) end as text,"
    " case when o_orderkey % 4 = 1 then 'sheets=One, Två' when o_orderkey % 4 = 2 then concat('format=JPEG;height=', o_orderkey % 900 + 1, ';make=Maker ', o_orderkey % 5, ';taken=', strftime(o_orderdate, '%Y:%m:%d'), ' 10:00:00;width=', o_orderkey % 700 + 1) when o_orderkey % 8 = 3 then 'error' else '' end as attrs from orders"
)
def s13_attachment_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text, workbooks, photographs, broken and unknown files: their status, text and facts."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "o_orderkey")  # a small file of orders has one part or two, the work is in the attached files
    key = F.col("o_orderkey") % 4
    kind = F.when(key == 0, "text/plain; charset=utf-8").when(key == 2, "IMAGE/JPEG")
    name = F.when((key == 1) | (F.col("o_orderkey") % 8 == 3), "Report.XLSX").otherwise("file")
    content = F.pandas_udf(_content, "binary")("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double"), F.date_format("o_orderdate", "yyyy:MM:dd"))
    found = attachments.read(rows.select(F.col("o_orderkey").alias("id"), kind.alias("type"), name.alias("name"), content.alias("content")))
    told = F.array_join(F.array_sort(F.transform(F.map_entries("attrs"), lambda e: F.when(e["key"] == "error", F.lit("error")).otherwise(F.concat_ws("=", e["key"], e["value"])))), ";")
    return found.select("id", "kind", "status", "text", told.alias("attrs"))
