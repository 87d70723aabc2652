"""Raw mail files as rows: parsed in the workers, never failing on a bad header."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime
from email import message_from_bytes, policy
from email.utils import getaddresses, parseaddr, parsedate_to_datetime
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "sha256 string, path string, message_id string, in_reply_to string, refs array<string>, subject string, from_name string, from_address string, "
    "recipients array<struct<role:string,name:string,address:string,ordinal:int>>, sent_at timestamp, body string, html string, attachments array<struct<name:string,type:string,size:long>>, error string"
)
_RECIPIENT = pa.struct([("role", pa.string()), ("name", pa.string()), ("address", pa.string()), ("ordinal", pa.int32())])
_ATTACHMENT = pa.struct([("name", pa.string()), ("type", pa.string()), ("size", pa.int64())])
_KINDS = {"refs": pa.list_(pa.string()), "recipients": pa.list_(_RECIPIENT), "sent_at": pa.timestamp("us", tz="UTC"), "attachments": pa.list_(_ATTACHMENT)}
_ARROW = pa.schema([(n, _KINDS.get(n, pa.string())) for n in "sha256 path message_id in_reply_to refs subject from_name from_address recipients sent_at body html attachments error".split()])
#: Dates outside these years are taken as missing.
YEARS = range(1990, 2101)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(sha256, path, raw) of the ``.eml`` and ``.emlx`` files below a folder, each content once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    mail = files.where(F.rlike(F.lower("path"), F.lit(r"\.emlx?$")))
    # an emlx file starts with a line that gives the length of the message
    head = F.regexp_extract(F.decode(F.substring("content", 1, 32), "ISO-8859-1"), r"^\s*([0-9]+)\s*\n", 0)
    is_x = F.endswith(F.lower("path"), F.lit(".emlx")) & (head != "")
    raw = F.when(is_x, F.substring("content", F.length(head) + 1, F.trim(head).cast("int"))).otherwise(F.col("content"))
    rows = mail.select(F.sha2(raw, 256).alias("sha256"), "path", raw.alias("raw"))
    return rows.groupBy("sha256").agg(F.min_by(F.struct("path", "raw"), "path").alias("f")).select("sha256", "f.path", "f.raw")


#: Headers without a grammar, and those of addresses.  Values of these shapes mean what they say, so the library's
#: parser, which takes longer than all else, reads the others; possessive, so none is walked twice.
UNSTRUCTURED, ADDRESSED = ("subject", "references", "in-reply-to", "date"), ("from", "to", "cc", "bcc")
_ATOM = "[A-Za-z0-9_+-]++"
_ADDRESS = rf"{_ATOM}(?:\.{_ATOM})*+@{_ATOM}(?:\.{_ATOM})*+"
_PERSON = rf"(?:(?:({_ATOM}(?: {_ATOM})*+) )?<({_ADDRESS})>|({_ADDRESS}))"
_PLAIN, _PERSON_OF, _ID = re.compile(r"(?:[!-<>-~]|=(?!\?)| (?! ))*+"), re.compile(_PERSON), re.compile(f"<{_ADDRESS}>")
_PEOPLE = re.compile(f"{_PERSON}(?:, {_PERSON})*+")
_BREAKS = re.compile(r"\r\n|\r|\n")


@lru_cache(maxsize=2000)
def _header(name: str, value: str):
    """A header as the library parses it; a parse takes some 20 kB, and most values come again."""
    return policy.default.header_factory(name, value)


class _Remembering(policy.EmailPolicy):
    """The default policy, but for headers that needn't be parsed or were."""

    def header_fetch_parse(self, name, value):
        if hasattr(value, "name"):
            return value
        value, kind = "".join(_BREAKS.split(value)), name.lower()
        plain = _PLAIN if kind in UNSTRUCTURED else _PEOPLE if kind in ADDRESSED else _ID if kind == "message-id" else None
        return value if plain and plain.fullmatch(value) else _header(name, value)


_POLICY = _Remembering()


def _people(values: list[str]) -> list[tuple[str, str]]:
    """(name, address) of the values of one header."""
    if all(map(_PEOPLE.fullmatch, values)):
        return [(name, address or bare) for value in values for name, address, bare in _PERSON_OF.findall(value)]
    return getaddresses(values)


def _text(part) -> str:
    try:
        return part.get_content()
    except (LookupError, UnicodeError, KeyError):
        return (part.get_payload(decode=True) or b"").decode("latin-1")


def parse(raw: bytes) -> dict:
    """One message as a dictionary of the schema's columns (but for its key)."""
    out: dict = {"refs": [], "recipients": [], "attachments": [], "error": None}
    try:
        m = message_from_bytes(raw, policy=_POLICY)
        text = lambda name: str(m.get(name, "") or "").strip() or None
        out |= {"message_id": text("Message-ID"), "in_reply_to": text("In-Reply-To"), "subject": text("Subject"), "refs": (text("References") or "").split()}
        sender = text("From") or ""
        (name, address), *more = _people([sender]) if _PEOPLE.fullmatch(sender) else [parseaddr(sender)]
        out |= {"from_name": name or None, "from_address": address.lower() or None} if not more else {"from_name": None, "from_address": None}
        for role in ("to", "cc", "bcc"):
            found = _people([str(v) for v in m.get_all(role, [])])
            out["recipients"] += [{"role": role, "name": n or None, "address": a.lower(), "ordinal": i} for i, (n, a) in enumerate(found) if a]
        try:
            at = parsedate_to_datetime(text("Date") or "")
            at = at.replace(tzinfo=at.tzinfo or UTC).astimezone(UTC)
            out["sent_at"] = at.replace(tzinfo=None) if at.year in YEARS else None
        except (TypeError, ValueError, OverflowError):
            out["sent_at"] = None
        for part in m.walk():
            kind, file = part.get_content_type(), part.get_filename()
            if part.is_multipart():
                continue
            if file or part.get_content_disposition() == "attachment":
                out["attachments"].append({"name": file, "type": kind, "size": len(part.get_payload(decode=True) or b"")})
            elif kind == "text/plain" and out.get("body") is None:
                out["body"] = _text(part)
            elif kind == "text/html" and out.get("html") is None:
                out["html"] = _text(part)
    except Exception as e:  # a broken original is kept aside with its reason, not lost
        out["error"] = f"{type(e).__name__}: {e}"
    return out


def parsed(raws: DataFrame) -> DataFrame:
    """``scan``'s rows parsed; rows with ``error`` belong in quarantine, those without content among them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_pylist([{"sha256": r["sha256"], "path": r["path"], **(parse(r["raw"]) if r["raw"] is not None else {"error": "no content"})} for r in rows], schema=_ARROW)

    return raws.select("sha256", "path", "raw").mapInArrow(work, SCHEMA)


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("error is null"), rows.where("error is not null").select("sha256", "path", "error")


def retried(quarantine: DataFrame, raws: DataFrame) -> DataFrame:
    """The quarantined originals parsed again, as after a repair of the parser."""
    return parsed(raws.join(quarantine.select("sha256").distinct(), "sha256", "left_semi"))


def direction(rows: DataFrame, owners: list[str]) -> DataFrame:
    """``rows`` with ``direction``: in unless the owner sent it, self when all recipients are the owner's too."""
    mine = F.col("from_address").isin(owners)
    others = F.exists("recipients", lambda r: ~r["address"].isin(owners))
    return rows.withColumn("direction", F.when(~F.coalesce(mine, F.lit(False)), "in").when((F.size("recipients") > 0) & ~others, "self").otherwise("out"))


def received_now() -> datetime:
    return datetime.now(UTC)


#: Types of attachment whose text is read, and the characters of it that are kept.
TEXT_TYPES, TEXT_LIMIT = ("text/plain", "text/csv", "text/markdown", "application/json"), 200_000


def attachment_text(files: DataFrame, *, limit: int = TEXT_LIMIT) -> DataFrame:
    """``files`` (type, content) with ``text`` and ``status``: ok, truncated, empty or unsupported.  A byte that isn't UTF-8 is a replacement mark."""
    readable = F.coalesce(F.lower("type").isin(*TEXT_TYPES), F.lit(False))
    whole = F.decode(F.coalesce("content", F.lit(b"")), "UTF-8")
    status = F.when(~readable, "unsupported").when(F.trim(whole) == "", "empty").when(F.length(whole) > limit, "truncated").otherwise("ok")
    return files.withColumn("status", status).withColumn("text", F.when(F.col("status").isin("ok", "truncated"), F.substring(whole, 1, limit)))
