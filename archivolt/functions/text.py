"""Text functions over messages as Spark columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Reply and forward prefixes, status words, tags.
REPLY_PREFIXES = ("re", "sv", "fw", "fwd", "vb", "aw", "wg", "tr", "rv", "vs", "antw")
SYSTEM_PREFIXES = ("re", "sv", "fw", "fwd", "vs", "vb", "aw")
TRAILING_STATUS = ("down", "up", "alarm", "alert", "error", "warning", "failed", "failure", "critical", "ok", "recovered", "resolved")
#: Local parts of machines, as a parsed message is marked by; and more of them, whose senders aren't counted as persons.
MACHINE_SENDER = r"^(no[-_.]?reply|do[-_.]?not[-_.]?reply|donotreply|notifications?|notify|alerts?|mailer-daemon|postmaster|bounces?|automated|robot)([+-].*)?$"
NO_REPLY = (
    r"^(no[-_.]?reply|do[-_.]?not[-_.]?reply|donotreply|notifications?|notify|alerts?|mailer-daemon|postmaster|bounces?|automated|robot|"
    r"news(letter)?|marketing|quarantine|reports?|digest|updates?)([+-].*)?$"
)
BULK_PRECEDENCE = ("bulk", "list", "junk")
TAG_STATUS = {
    "success": "ok",
    "succeeded": "ok",
    "ok": "ok",
    "warning": "warning",
    "warnings": "warning",
    "failed": "failed",
    "failure": "failed",
    "error": "failed",
    "errors": "failed",
    "reset/resolved": "ok",
    "resolved": "ok",
    "normal": "ok",
}
STATUS_WORDS = {
    "failed": r"\b(fail(ed|ure)?|errors?|fel|misslyckad(es)?|misslyckades|critical|kritisk|aborted|avbruten)\b",
    "warning": r"\b(warn(ings?)?|varning(ar)?|statistikvarning(ar)?|partial(ly)?|delvis)\b",
    "ok": r"\b(succe(ss|eded|ssful)|completed|slutförts|slutfördes|klar|lyckad(es)?|ok|resolved|åtgärdad)\b",
}
ZERO_COUNTS = r"\b(fail(ed|ures?)?|errors?|warn(ings?)?|fel|varningar)\s*[:=]\s*0\b|\b0\s+(fail(ed|ures?)?|errors?|warn(ings?)?|fel|varningar)\b"


def skeleton(subject: Column) -> Column:
    """Up to three words of a subject: prefixes gone, tokens with a digit are ``#``, a run of them one ``#``."""
    # possessive, as all repeated groups here: others take a stack frame a round, and a subject may repeat a prefix without end
    prefix = rf"^(?:\s*+(?:{'|'.join(REPLY_PREFIXES)})\s*+(?:\[[0-9]+\]|\([0-9]+\))?\s*+:)++"
    bare = F.regexp_replace(F.lower(F.coalesce(subject, F.lit(""))), prefix, "")
    shaped = lambda w: F.when(F.rlike(w, F.lit("[0-9]")), "#").otherwise(F.regexp_replace(w, r"[^\p{L}\p{N}#]+", ""))
    words = F.filter(F.transform(F.split(bare, r"\s+"), shaped), lambda w: w != "")
    kept = F.filter(words, lambda w, i: (i == 0) | (w != "#") | (F.get(words, i - 1) != "#"))
    return F.array_join(F.slice(kept, 1, 3), " ")


def pattern_key(from_address: Column, subject: Column) -> Column:
    return F.concat_ws("|", F.lower(F.coalesce(from_address, F.lit(""))), skeleton(subject))


def skeleton_regex(key: str) -> str:
    """A Java pattern that matches a subject exactly when ``key`` is its skeleton.

    Punctuation may stand in and between words; three words may be followed by
    more, fewer have to reach the end.  ``#`` stands for a run of tokens with digits.
    """
    mark = r"[^\p{L}\p{N}#\s]"
    prefix = rf"(?:\s*(?:{'|'.join(REPLY_PREFIXES)})\s*(?:\[[0-9]+\]|\([0-9]+\))?\s*:)*+"
    between = rf"\s+(?:{mark}+\s+)*+"
    number = rf"(?:\S*[0-9]\S*|{mark}*#{mark}*)"
    words = [w for w in key.split(" ") if w]
    if not words:
        return rf"(?iu)^{prefix}[^\p{{L}}\p{{N}}#]*$"

    def part(word: str) -> str:
        if word == "#":
            return f"{number}(?:{between}{number})*+"
        return f"{mark}*" + "".join(f"{re.escape(c)}{mark}*" for c in word)

    end = r"(?=\s|$)" if len(words) >= 3 else rf"(?:\s+{mark}+)*+\s*$"
    return rf"(?iu)^{prefix}\s*(?:{mark}+\s+)*+{between.join(map(part, words))}{end}"


def _system(subject: Column) -> tuple[Column, Column]:
    """(key, told): which system a subject comes from, and whether a tag or a status word tells it."""
    text = F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), rf"(?i)^\s*+(?:(?:{'|'.join(SYSTEM_PREFIXES)})\s*+:\s*+)++", ""))
    tag = F.regexp_extract(text, r"^(\[[^\]]*\])", 1)
    glued = F.regexp_extract(text, r"^\[[^\]]*\](\w+)", 1)
    status = rf"(?i)(?:^|\s)({'|'.join(TRAILING_STATUS)})(!*)\s*$"
    word, marks = F.regexp_extract(text, status, 1), F.regexp_extract(text, status, 2)
    before = F.trim(F.regexp_replace(text, status, ""))
    first = F.coalesce(F.get(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.lit(0)), F.lit("(no subject)"))
    ends = (word != "") & (before != "")
    key = F.when(tag != "", F.concat(F.regexp_replace(tag, "[0-9]{4,}", "#"), glued)).when(ends, F.concat(F.lit("… "), F.initcap(word), marks)).otherwise(F.regexp_replace(first, "[0-9]", "#"))
    return key, (tag != "") | ends


def system_key(subject: Column) -> Column:
    """Which system a shared sender's subject comes from: a leading tag, a trailing status word, or the first word."""
    return _system(subject)[0]


def system_told(subject: Column) -> Column:
    """Whether a tag or a status word tells the system, rather than a first word."""
    return _system(subject)[1]


def without_prefixes(subject: Column) -> Column:
    """A subject without its reply and forward prefixes."""
    return F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), rf"(?i)^\s*+(?:(?:{'|'.join(SYSTEM_PREFIXES)})\s*+:\s*+)++", ""))


def event_status(subject: Column, body: Column, default: str = "info") -> Column:
    """ok, warning, failed or the default: the subject decides where it can, else the body."""

    def of(text: Column) -> Column:
        t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), f"(?i){ZERO_COUNTS}", " "))
        tags = F.create_map(*[F.lit(x) for pair in TAG_STATUS.items() for x in pair])
        tag = F.regexp_extract(t, r"\[(success|succeeded|ok|warnings?|failed|failure|errors?)\]", 1)
        changed = F.regexp_extract(t, r"changed to ([a-z/]+)", 1)
        out = F.when(tag != "", tags[tag]).when(tags[changed].isNotNull(), tags[changed])
        for status, pattern in STATUS_WORDS.items():
            out = out.when(F.rlike(t, F.lit(f"(?U){pattern}")), status)
        return out

    return F.coalesce(of(subject), of(body), F.lit(default))


def automated_reasons(auto_submitted: Column, precedence: Column, list_id: Column, list_unsubscribe: Column, from_address: Column, return_path: Column) -> Column:
    """Why a message counts as automated, in a fixed order."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    local = F.lower(F.split_part(from_address, F.lit("@"), F.lit(1)))
    return F.array_compact(
        F.array(
            F.when(~F.lower(blank(auto_submitted)).isin("", "no"), "auto-submitted"),
            F.when(F.lower(blank(precedence)).isin(*BULK_PRECEDENCE), "precedence"),
            F.when(list_id.isNotNull() | (blank(list_unsubscribe) != ""), "list"),
            F.when(F.rlike(local, F.lit(MACHINE_SENDER)), "noreply-sender"),
            F.when(F.trim(blank(return_path)) == "<>", "null-return-path"),
        )
    )


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """Plural endings off (the S-stemmer): ies to y, es to e, s away, but for us and ss."""
    return (
        F.when(F.rlike(word, F.lit("(?<![ea])ies$")), F.regexp_replace(word, "ies$", "y"))
        .when(F.rlike(word, F.lit("(?<![aeo])es$")), F.regexp_replace(word, "es$", "e"))
        .when(F.rlike(word, F.lit("(?<![us])s$")), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def phrase_match(words: Column, phrase: list[str]) -> Column:
    """Whether the words stand next to each other."""
    if not phrase:
        return F.lit(False)
    return F.exists(F.sequence(F.lit(0), F.size(words)), lambda i: F.coalesce(F.slice(words, i + 1, len(phrase)) == F.array(*[F.lit(p) for p in phrase]), F.lit(False)))


def all_words(words: Column, asked: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in asked]), words)) == 0


def prefixes(query: str) -> list[str]:
    """Prefixes for words that are still being typed; none when the query has operators."""
    if re.search(r'["|]|\bOR\b|(?:^|\s)-\S', query):
        return []
    words = [w for w in re.findall(r"[^\W\d_]+", query.lower())]
    return [w[: max(4, len(w) - 2)] if len(w) >= 5 else w for w in words]


def prefix_match(words: Column, starts: list[str]) -> Column:
    out = F.lit(bool(starts))
    for p in starts:
        out = out & F.exists(words, _starting(p))
    return out


def _starting(p: str):
    return lambda w: F.startswith(w, F.lit(p))


# Characters that aren't seen, and letters of other scripts that look like Latin ones, with those.
HIDDEN = "[\u00ad\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufe00-\ufe0f\ufeff\U000e0000-\U000e007f\U000e0100-\U000e01ef]"
LOOK_ALIKE = "аеорсухіјѕԁԛԝАВЕКМНОРСТХІЈЅοаνρτχκιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "aeopcyxijsdqwABEKMHOPCTXIJSoavptxkiABEZHIKMNOPTYX"


_UNSEEN, _LOOKS = re.compile(HIDDEN), str.maketrans(LOOK_ALIKE, LATIN)


def normal(text: str) -> str:
    """``normalized`` of one text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text)).translate(_LOOKS)
    return " ".join(text.lower().split())


def normalized(text: Column) -> Column:
    """Hidden characters gone, compatibility forms (NFKC), look-alikes Latin, lower case, white space runs one blank, trimmed; null is empty.

    Spark has no function for compatibility forms, so this runs in Arrow batches.
    """

    def all_normal(texts: pd.Series) -> pd.Series:
        return texts.map(normal)

    return F.pandas_udf(all_normal, "string").asNondeterministic()(F.coalesce(text, F.lit("")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, also where lambdas inside read it for every element."""
    return F.transform(F.array(value), body).getItem(0)


def shingles(words: Column, n: int) -> Column:
    """Distinct n-word windows; fewer words are one window."""

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - n))
        return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])))

    return let(words, windows)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def wilson_lower(agreed: Column, n: Column, z: float = 1.645) -> Column:
    """The lower bound of an agreement rate."""
    p = agreed / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (p + z * z / (2 * n) - spread) / (1 + z * z / n)))


def snippet(text: Column, n: int = 200) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 1, n)


def strip_quotes(text: Column) -> Column:
    """The text before the first quoted line or reply header, without lines that start with ``>``."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    header = lambda x: F.rlike(x, F.lit(r"^(?:-{2,} ?Original Message|From: |Från: |On .{5,120} wrote:\s*$)"))
    cut = F.array_position(F.transform(lines, lambda x: header(x)), F.lit(True))
    kept = F.when(cut > 0, F.slice(lines, F.lit(1), cut.cast("int") - 1)).otherwise(lines)
    return F.rtrim(F.array_join(F.filter(kept, lambda x: ~F.startswith(x, F.lit(">"))), "\n"))


def masked_urls(text: Column) -> Column:
    """Addresses keep their scheme and host, not their path, query or fragment."""
    # a look ahead at the first character costs less at every place than a boundary or a look behind, so it goes first, here and in ``masked``
    return F.regexp_replace(text, r"""(?i)(?=[hfw])\b((?:https?|ftp)://|www\.)([a-z0-9.-]+(?::[0-9]+)?)(?:/[^\s<>"')\]]+|[?#][^\s<>"')\]]*)""", "$1$2/…")


def replaced(text: Column, pattern: str, instead: Callable[[Column], Column]) -> Column:
    """The text with each match of the pattern as ``instead`` gives it; a text without matches is only searched."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    made = F.array_join(F.transform(parts, lambda x: F.when(x["hit"].isNull(), x["gap"]).otherwise(F.concat(x["gap"], instead(x["hit"])))), "")
    return F.when(F.rlike(text, F.lit(pattern)), made).otherwise(text)


def _bare(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _iban(found: Column) -> Column:
    """Whether the check digits hold: country and check digits last, letters from 10, the rest mod 97 is 1."""
    code = F.replace(found, F.lit(" "))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    letters = F.filter(F.split(F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4)), ""), lambda c: c != "")
    rest = F.aggregate(letters, F.lit(0), lambda r, c: F.pmod(r * F.when(c >= "A", 100).otherwise(10) + value(c), F.lit(97)))
    return F.length(code).between(15, 34) & (rest == 1)


def _personal_id(found: Column) -> Column:
    """(YY)YYMMDD, a sign or none, four digits: a month and a day (60 more for a coordination number), Luhn's sum where no sign parts them."""
    digits = _bare(found)
    month, day = (F.substring(digits, F.length(digits) - at, F.lit(2)).cast("int") for at in (7, 5))
    parted = F.rlike(found, F.lit("[-+]"))
    return month.between(1, 12) & (day.between(1, 31) | day.between(61, 91)) & (parted | F.call_function("luhn_check", F.right(digits, F.lit(10))))


def masked(text: Column) -> Column:
    """Paths of addresses, IBANs, card numbers, personal numbers and phone numbers masked, in this order; null is empty.

    Each kind is a pattern and a check (mod 97, Luhn's sum, a date, a number of
    digits); what fails its check stays.
    """
    kinds = (
        (r"(?U)(?=[A-Z][A-Z][0-9])\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", _iban, "[iban]"),
        (r"(?=[0-9])(?<![0-9-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9-])", lambda m: F.call_function("luhn_check", _bare(m)), "[card]"),
        (r"(?=[0-9])(?<![0-9-])(?:19|20)?[0-9]{6}[-+]?[0-9]{4}(?![0-9-])", _personal_id, "[personnummer]"),
        (
            r"(?U)(?=[+0])(?<![\w./:+-])(?:(?:\+|00)[0-9]{1,3}[\x20-]?(?:\(0\)[\x20-]?)?[0-9]{1,4}(?:[\x20-]?[0-9]{2,4}){1,4}|0[0-9]{1,3}[\x20/-]?[0-9]{2,4}(?:[\x20-]?[0-9]{2,4}){0,3})(?![\w./:+-])",
            lambda m: F.length(_bare(m)).between(7, 15),
            "[phone]",
        ),
    )
    out = masked_urls(F.coalesce(text, F.lit("")))
    for pattern, holds, name in kinds:
        step = partial(_step, pattern, _kept_unless(holds, name))
        out = let(out, lambda text: step(text))  # noqa: B023, PLW0108  # read at once; each step's text is made once
    return out


def _step(pattern: str, instead: Callable[[Column], Column], text: Column) -> Column:
    return replaced(text, pattern, instead)


def _kept_unless(holds: Callable[[Column], Column], name: str) -> Callable[[Column], Column]:
    return lambda m: F.when(holds(m), F.lit(name)).otherwise(m)


# Phrases that ask the owner something, replies to meetings, words and dates of a deadline.
ASKING = (
    "kan du|kan ni|skulle du|skulle ni|vill du|vill ni|har du möjlighet|har ni möjlighet|hinner du|hinner ni|har du tid|vad tycker du|vad tycker ni|återkom|ge besked|"
    "could you|can you|would you|will you|are you able|do you have time|let me know|what do you think|please (?:confirm|advise|review|reply|respond)"
)
MEETING_REPLIES = (
    "accepted|declined|tentative|tentatively accepted|canceled|cancelled|updated invitation|invitation|new time proposed|accepterat|accepterad|avböjt|avböjd|"
    "preliminärt|preliminär|inställt|inställd|uppdaterad inbjudan|inbjudan|nytt tidsförslag|ny tid föreslagen"
)
URGENT = (
    "senast|deadline|innan|före|snarast|brådskande|asap|urgent|due (?:date|by)|"
    "by (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|tomorrow|eod|end of (?:the )?(?:day|week))"
)
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "maj": 5, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dec": 12}
#: A date so many days ahead is a deadline; tokens a character and dollars a million tokens.
HORIZON_DAYS, TOKENS_PER_CHARACTER, DOLLARS_PER_MILLION = 14, 0.345, 0.042


def without_links(text: Column) -> Column:
    """The text without web and mail addresses, whose question marks ask nothing."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(https?://|www\.)\S+|\S+@\S+", " ")


def asks(text: Column) -> Column:
    """Whether the text has a question mark or an asking phrase."""
    return F.rlike(without_links(text), F.lit(rf"(?iU)\?|\b(?:{ASKING})\b"))


def meeting_reply(subject: Column) -> Column:
    return F.coalesce(F.rlike(subject, F.lit(rf"(?iU)^\s*(?:{MEETING_REPLIES})\s*:")), F.lit(False))


def dates_in(text: Column, year: Column) -> Column:
    """Dates a text names (2024-09-30, 30/9, 30 sep, 30:e september) as an array; dates that don't exist are left out."""
    bare = F.coalesce(text, F.lit(""))
    year = year.cast("string")
    whole = F.transform(F.regexp_extract_all(bare, F.lit(r"(?U)\b(20\d\d-\d\d-\d\d)\b"), 1), lambda d: F.try_to_date(d, "yyyy-MM-dd"))
    short = F.transform(
        F.regexp_extract_all(bare, F.lit(r"(?U)\b([0-3]?\d/[01]?\d)\b"), 1), lambda d: F.try_to_date(F.concat_ws("-", year, F.split_part(d, F.lit("/"), F.lit(2)), F.split_part(d, F.lit("/"), F.lit(1))), "yyyy-M-d")
    )
    named = rf"(?iU)\b([0-3]?\d(?::[ae])?\.? (?:{'|'.join(MONTHS)}))[a-z]*\b"
    month = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    spelled = F.transform(
        F.regexp_extract_all(bare, F.lit(named), 1), lambda d: F.try_to_date(F.concat_ws("-", year, month[F.lower(F.right(d, F.lit(3)))].cast("string"), F.regexp_extract(d, r"^(\d+)", 1)), "yyyy-M-d")
    )
    return F.array_compact(F.concat(whole, short, spelled))


def names_deadline(text: Column, at: Column) -> Column:
    """Whether the text has an urgent word or a date within the horizon after ``at``."""
    day = at.cast("date")
    soon = F.exists(dates_in(text, F.year(day)), lambda d: (d >= day) & (d <= F.date_add(day, HORIZON_DAYS)))
    return F.rlike(F.coalesce(text, F.lit("")), F.lit(rf"(?iU)\b(?:{URGENT})\b")) | F.coalesce(soon, F.lit(False))


def weighted_score(fields: list[tuple[Column, float]], asked: list[str]) -> Column:
    """A relevance for ordering: the occurrences of asked words, each field by its weight.  ``fields``: (word array, weight)."""
    out = F.lit(0.0)
    for words, weight in fields:
        out = out + F.size(F.filter(words, lambda w: w.isin(asked))) * F.lit(weight)
    return out


def domain_root(domain: Column) -> Column:
    """The name part of a domain: mail.example.se is example."""
    parts = F.split(domain, r"\.")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(domain)


def human_bytes(n: Column) -> Column:
    """12 B, 1.5 kB, 3.0 MB up to TB; a dash for null."""
    out = F.when(n.isNull(), "—").when(n < 1024, F.concat(F.format_string("%.0f", n.cast("double")), F.lit(" B")))
    for power, unit in enumerate(("kB", "MB", "GB"), 1):
        out = out.when(n < 1024 ** (power + 1), F.format_string(f"%.1f {unit}", F.bround(n / float(1024**power), 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(n / float(1024**4), 1)))


def age_words(seconds: Column) -> Column:
    """Hours under two days, else days; an hour at least."""
    hours = F.greatest(F.lit(1), F.bround(seconds / 3600).cast("long"))
    days = F.bround(seconds / 86400).cast("long")
    in_hours = F.concat(hours.cast("string"), F.when(hours == 1, " hour").otherwise(" hours"))
    return F.when(seconds < 48 * 3600, in_hours).otherwise(F.concat(days.cast("string"), F.lit(" days")))


def estimated_tokens(text: Column) -> Column:
    return F.bround(F.length(F.coalesce(text, F.lit(""))) * TOKENS_PER_CHARACTER).cast("long")


def estimated_cost(tokens: Column) -> Column:
    return tokens * DOLLARS_PER_MILLION / 1_000_000
