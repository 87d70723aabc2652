"""Personal data: patterns propose, checksums confirm, context words adjust a score.

All of it is DataFrame functions.  Positions come from splitting a text at the
pattern and listing its matches: the pieces and matches alternate, so running
lengths give every match its place.  A text that can't hold a kind (no ``@``, no
plus sign, too few digits) is passed over without running that kind's pattern.
A text of any length is searched in one pass: no pattern recurses over a run.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import blocks, cut, fresh, let, running

SPAN = "struct<kind:string,start:int,end:int,score:double>"
#: Characters before a span in which context words count, and the least that a pattern can match (a phone number of +, 1, a sign, 1).
CONTEXT, LEAST_MATCH = 40, 4
#: Spans that only the method adds need this score.
LEAST_SCORE = 0.7
FOR, AGAINST = 0.2, -0.4
_AGAINST = r"(?i)\b(?:order|invoice|version|serial|isbn|tracking|build|commit|hash)\b"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high) & F.call_function("luhn_check", _digits(m))


def _octets(match: Column) -> Column:
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(match, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.coalesce(number(p).try_cast("int"), F.lit(999)) <= 255))


def mod_97(match: Column) -> Column:
    """The IBAN checksum: the country and check digits go last, letters count from 10, the rest mod 97 is 1."""
    code = F.regexp_replace(match, "[^A-Z0-9]", "")
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda r, c: F.pmod(r * F.when(c >= "A", 100).otherwise(10) + value(c), F.lit(97))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


@dataclass(frozen=True)
class Kind:
    """A kind: a cheap test that a text may hold it, its pattern, its validator, its score and its context."""

    name: str
    may: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True


#: In the order of reports.  A search starts only where a run of the pattern's first class starts, or where
#: the last match ended (\G); it then takes the whole run, so long runs cost one try.  Repeated groups are possessive:
#: the engine walks them in a loop, where other ones take a stack frame a round.
KINDS = (
    Kind(
        "email",
        lambda t: F.contains(t, F.lit("@")),
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True),
        0.8,
        r"(?i)\b(?:e-?mail|contact|write|mail)\b",
    ),
    Kind(
        "ip",
        lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")),
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        _octets,
        0.6,
        r"(?i)\b(?:ip|host|server|address|client)\b",
    ),
    Kind(
        "card",
        lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){15}")),
        r"[0-9](?:[\x20-]?+[0-9]){15,}+",
        _luhn(16, 19),
        0.8,
        r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)\b",
    ),
    Kind(
        "phone",
        lambda t: F.contains(t, F.lit("+")),
        r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m: F.length(_digits(m)).between(8, 15),
        0.5,
        r"(?i)\b(?:phone|call|tel|mobile|fax|whatsapp)\b",
    ),
    Kind(
        "iban",
        lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}")),
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        mod_97,
        0.9,
        r"(?i)\b(?:iban|account|bank|transfer)\b",
        base=False,
    ),
    Kind(
        "shortcard",
        lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
        r"(?<![0-9.+])[0-9](?:[\x20-]?[0-9]){12,14}(?![0-9])",
        _luhn(13, 15),
        0.6,
        r"(?i)\b(?:card|visa|amex|credit|debit|payment)\b",
        base=False,
    ),
)


def matches(text: Column, pattern: str, valid: Callable[[Column], Column]) -> Column:
    """Valid matches as (start, end, before): code points, leftmost, apart, without retries.

    ``before`` holds the ``CONTEXT`` characters ahead of a match.  Work is linear
    in the text and its matches but for a factor of their logarithm.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def placed(held: Column) -> Column:
        sizes = F.transform(held, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
        tails = F.transform(held, lambda x: F.right(F.concat(x["gap"], F.coalesce(x["hit"], F.lit(""))), F.lit(CONTEXT)))
        return let(F.struct(running(sizes, lambda a, b: a + b).alias("ends"), tails.alias("tails")), lambda known: spans(held, known))

    def spans(held: Column, known: Column) -> Column:
        reach = CONTEXT // LEAST_MATCH + 1  # pieces that may hold context: each but the first has a match

        def one(x: Column, i: Column) -> Column:
            end = F.get(known["ends"], i)
            earlier = F.array_join(F.slice(known["tails"], F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach))), "")
            before = F.right(F.concat(earlier, F.right(x["gap"], F.lit(CONTEXT))), F.lit(CONTEXT))
            found = F.struct((end - F.length(x["hit"])).alias("start"), end.alias("end"), before.alias("before"))
            return F.when(x["hit"].isNotNull() & valid(x["hit"]), found)

        return F.filter(F.transform(held, one), lambda s: s.isNotNull())

    return let(parts, placed)


def _spans(text: Column, kind: Kind) -> Column:
    def scored(s: Column) -> Column:
        score = F.lit(kind.score) + F.when(F.rlike(s["before"], F.lit(kind.context)), FOR).otherwise(0.0) + F.when(F.rlike(s["before"], F.lit(_AGAINST)), AGAINST).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"))

    found = F.transform(matches(text, kind.pattern, kind.valid), scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= LEAST_SCORE)
    return F.when(kind.may(text), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, *, text: str = "text", into: str = "pii") -> DataFrame:
    """``docs`` with ``into``: spans (kind, start, end, score) by kind as listed, then start.

    Positions are code points, ends exclusive.  Null and empty texts have no
    spans; kinds are searched apart, so spans of different kinds may overlap; a
    base span is kept whatever its score, an added one needs ``LEAST_SCORE``.
    An empty table stays empty; a column that is already named like ``into`` is replaced.
    """
    held = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return docs.withColumn(into, let(held, lambda t: F.concat(*[_spans(t, k) for k in KINDS])))


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; columns as they were.

    Overlapping spans become one, named after the one that starts first (of
    those, the longest).  Texts without spans, null ones included, are unchanged;
    equal rows are redacted alike and an empty table stays empty.
    """
    spans = fresh(docs, "pii")
    held = find_pii(docs, text=text, into=spans)
    whole = F.col(f"`{text}`")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.upper(s["kind"]).alias("kind"))))

    def joined(found: Column) -> Column:
        """The spans that start behind the ends of all before them, each to the end of those that it meets."""
        return let(running(F.transform(found, lambda s: -s["end"]), F.greatest), lambda ends: heads(found, ends))

    def heads(found: Column, ends: Column) -> Column:
        first = F.filter(
            F.transform(found, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(ends, i - 1)), F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("at")))),
            lambda s: s.isNotNull(),
        )
        last = F.size(ends) - 1
        return let(first, lambda f: F.transform(f, lambda s, j: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), F.get(ends, F.coalesce(F.get(f, j + 1)["at"] - 1, last)).alias("end"))))

    def written(parts: Column) -> Column:
        return let(F.transform(ordered, lambda s: s), lambda found: let(joined(found), lambda f: filled(parts, f)))

    def filled(parts: Column, found: Column) -> Column:
        until = lambda j: F.coalesce(F.get(found, j - 1)["end"], F.lit(0))
        out = F.transform(found, lambda s, j: F.concat(cut(parts, until(j), s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(out, ""), cut(parts, until(F.size(found)), F.length(whole)))

    clean = F.when(F.size(F.col(spans)) > 0, let(blocks(whole), written)).otherwise(whole)
    return held.withColumn(text, clean).select([F.col(f"`{c}`") for c in docs.columns])


def digest(found: DataFrame, doc_id: str = "doc_id", spans: str = "pii") -> DataFrame:
    """The contract's columns."""
    base = [k.name for k in KINDS if k.base]
    written = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col(doc_id).alias("doc_id"),
        *[of(k) for k in base],
        F.sha2(F.array_join(F.transform(F.filter(spans, lambda s: s["kind"].isin(base)), written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(spans, written), ",").alias("spans"),
    )
