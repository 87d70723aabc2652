"""Condition lists in JSON form, compiled to Spark columns.

``rule_column`` takes the rule form: a list is a conjunction, ``{"any": [...]}`` a
disjunction, a leaf ``{"field", "op", "value"}``.  ``placement_column`` takes the
placement form: ``all``, ``any`` and ``use`` (a named condition) over leaves such
as ``{"field": "account", "in": [...]}``.  Both give one column, so any number of
conditions costs one scan and Catalyst pushes down what it can.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ConditionError(ValueError):
    """A condition that can't be compiled, with the reason."""


# --- rules ------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """A field of the rule form: its column, and whether the column holds an array of values."""

    column: Column
    many: bool = False


def message_fields() -> dict[str, Field]:
    """Fields of a message row; arrays come from aggregated locations and participants."""
    plain = ["account", "direction", "from_address", "medium", "is_automated", "has_attachments", "size"]
    found = {name: Field(F.col(name)) for name in plain}
    found["received"] = Field(F.col("received_at"))
    found["from_domain"] = Field(F.split_part("from_address", F.lit("@"), F.lit(2)))
    found |= {name: Field(F.coalesce(name, F.lit(""))) for name in ("from_name", "subject", "list_id")}
    found |= {name: Field(F.col(column), many=True) for name, column in (("folder", "folders"), ("label", "labels"), ("recipient", "recipients"))}
    return found


def java_regex(pattern: str) -> str:
    """A POSIX-style pattern in Java's dialect, letters in either case, Unicode classes."""
    out = pattern.replace(r"\m", r"\b").replace(r"\M", r"\b")
    for name, cls in (("upper", r"\p{Lu}"), ("lower", r"\p{Ll}"), ("alnum", r"\p{L}\p{N}"), ("alpha", r"\p{L}"), ("digit", r"\p{Nd}"), ("space", r"\s")):
        out = out.replace(f"[:{name}:]", cls)
    try:
        re.compile(out.replace(r"\p{L}\p{N}", r"\w").replace(r"\p{Lu}", "A-Z").replace(r"\p{Ll}", "a-z").replace(r"\p{L}", "a-z").replace(r"\p{Nd}", "0-9"))
    except re.error as e:
        raise ConditionError(f"not a pattern: {pattern!r} ({e})") from e
    return f"(?iU){out}"


def _text(x: Column) -> Column:
    return F.lower(x.cast("string"))


#: op -> predicate of (column, value); null stays null, which a filter drops.
_LEAVES: dict[str, Callable[[Column, object], Column]] = {
    "is": lambda x, v: _text(x) == str(v).lower(),
    "is_not": lambda x, v: _text(x) != str(v).lower(),
    "contains": lambda x, v: F.contains(_text(x), F.lit(str(v).lower())),
    "not_contains": lambda x, v: ~F.contains(_text(x), F.lit(str(v).lower())),
    "starts_with": lambda x, v: F.startswith(_text(x), F.lit(str(v).lower())),
    "ends_with": lambda x, v: F.endswith(_text(x), F.lit(str(v).lower())),
    "matches": lambda x, v: F.rlike(x, F.lit(java_regex(str(v)))),
    "in": lambda x, v: _text(x).isin([str(i).lower() for i in v]),
    "is_set": lambda x, v: x.isNotNull() & (x.cast("string") != ""),
    "is_true": lambda x, v: F.coalesce(x, F.lit(False)),
    "is_false": lambda x, v: ~F.coalesce(x, F.lit(False)),
    "before": lambda x, v: x < F.lit(v).cast("timestamp"),
    "after": lambda x, v: x > F.lit(v).cast("timestamp"),
    "gt": lambda x, v: x > F.lit(v),
    "lt": lambda x, v: x < F.lit(v),
}


def rule_column(conditions: list, fields: Mapping[str, Field] | None = None) -> Column:
    """The conjunction of a condition list; an empty list matches nothing."""
    fields = message_fields() if fields is None else fields
    if not conditions:
        return F.lit(False)
    parts = [_rule_part(c, fields) for c in conditions]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _rule_part(condition: dict, fields: Mapping[str, Field]) -> Column:
    if not isinstance(condition, dict):
        raise ConditionError(f"a condition is an object, not {condition!r}")
    if "any" in condition:
        group = condition["any"]
        if not isinstance(group, list) or not group:
            raise ConditionError("a group names at least one condition")
        out = None
        for c in group:
            part = rule_column(c, fields) if isinstance(c, list) else _rule_part(c, fields)
            out = part if out is None else out | part
        return out
    name, op = condition.get("field"), condition.get("op")
    if name not in fields and str(name).startswith("header:"):
        fields = {name: Field(F.coalesce(F.col("headers")[str(name).split(":", 1)[1]], F.lit("")))}
    if name not in fields:
        raise ConditionError(f"no field {name!r}")
    if op not in _LEAVES:
        raise ConditionError(f"no operator {op!r}")
    leaf, held, value = _LEAVES[op], fields[name], condition.get("value")
    if not held.many:
        return leaf(held.column, value)
    if op == "is_set":
        return F.size(held.column) > 0
    return F.exists(held.column, lambda x: leaf(x, value))


# --- placement ----------------------------------------------------------------------


@dataclass
class Vocabulary:
    """The fields of the placement form by kind, and the named conditions."""

    scalars: Mapping[str, Column] = field(default_factory=dict)
    arrays: Mapping[str, Column] = field(default_factory=dict)
    booleans: Mapping[str, Column] = field(default_factory=dict)
    numbers: Mapping[str, Column] = field(default_factory=dict)
    named: Mapping[str, dict] = field(default_factory=dict)


def placement_column(condition: dict, words: Vocabulary, _inside: tuple[str, ...] = ()) -> Column:
    """A column that is never null."""
    for group, start in (("all", True), ("any", False)):
        if group in condition:
            out = F.lit(start)
            for c in condition[group]:
                part = placement_column(c, words, _inside)
                out = out & part if start else out | part
            return out
    if "use" in condition:
        name = condition["use"]
        if name not in words.named or name in _inside:
            raise ConditionError(f"no condition {name!r}, or it uses itself")
        return placement_column(words.named[name], words, (*_inside, name))
    name = condition.get("field")
    if name in words.booleans:
        return F.coalesce(words.booleans[name], F.lit(False)) == F.lit(bool(condition["is"]))
    if name in words.numbers:
        parts = [op(words.numbers[name], condition[k]) for k, op in (("lt", Column.__lt__), ("gt", Column.__gt__)) if k in condition]
        if not parts:
            raise ConditionError(f"{name}: lt or gt is asked for")
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return F.coalesce(out, F.lit(False))
    if name in words.scalars:
        x = words.scalars[name]
        if "set" in condition:
            found = x.isNotNull() if condition["set"] else x.isNull()
        elif "in" in condition:
            found = F.coalesce(x.isin(list(condition["in"])), F.lit(False))
        elif "not_in" in condition:
            found = ~F.coalesce(x.isin(list(condition["not_in"])), F.lit(False))
        elif "prefix" in condition:
            found = F.lit(False)
            for p in condition["prefix"]:
                found = found | F.coalesce(F.startswith(x, F.lit(p)), F.lit(False))
        else:
            raise ConditionError(f"{name}: in, not_in, prefix or set is asked for")
        if "else" in condition:
            return F.when(x.isNotNull(), found).otherwise(placement_column(condition["else"], words, _inside))
        return found
    if name in words.arrays:
        x = F.coalesce(words.arrays[name], F.array().cast("array<string>"))
        if "set" in condition:
            return (F.size(x) > 0) == F.lit(bool(condition["set"]))
        if "in" in condition or "not_in" in condition:
            values = condition.get("in", condition.get("not_in"))
            meets = F.arrays_overlap(x, F.array(*[F.lit(v) for v in values])) if values else F.lit(False)
            meets = F.coalesce(meets, F.lit(False))
            return meets if "in" in condition else ~meets
        if "prefix" in condition:
            starts = [F.coalesce(F.exists(x, _starting(p)), F.lit(False)) for p in condition["prefix"]]
            return reduce(Column.__or__, starts, F.lit(False))
    raise ConditionError(f"can't read {condition!r}")


def _starting(prefix: str) -> Callable[[Column], Column]:
    return lambda v: F.startswith(v, F.lit(prefix))


def in_words(condition: dict) -> str:
    """A placement condition as a sentence."""
    for group, word in (("all", " and "), ("any", " or ")):
        if group in condition:
            parts = [in_words(c) for c in condition[group]]
            return "(" + word.join(parts) + ")" if len(parts) > 1 else (parts or ["always" if group == "all" else "never"])[0]
    if "use" in condition:
        return f"as in {condition['use']}"
    name, rest = condition["field"], {k: v for k, v in condition.items() if k not in ("field", "else")}
    said = " and ".join(f"{name} {op.replace('_', ' ')} {', '.join(map(str, v)) if isinstance(v, list) else v}" for op, v in rest.items())
    return said + (f", or without it {in_words(condition['else'])}" if "else" in condition else "")


def _patterns(conditions: list) -> list[str]:
    """The patterns of all leaves."""
    out: list[str] = []
    for c in conditions:
        if isinstance(c, dict) and "any" in c:
            out += [p for part in c["any"] for p in _patterns(part if isinstance(part, list) else [part])]
        elif isinstance(c, dict) and c.get("op") == "matches":
            out.append(str(c.get("value")))
    return out


def problem(rows: DataFrame, conditions: list, fields: Mapping[str, Field] | None = None) -> str | None:
    """Why the conditions can't be used on ``rows``, or None: they are compiled, each pattern is tried, and the selection is run once on a single row."""
    spark = rows.sparkSession
    try:
        chosen = rule_column(conditions, fields)
        for pattern in _patterns(conditions):
            spark.range(1).select(F.rlike(F.concat(F.lit(""), F.col("id").cast("string")), F.lit(java_regex(pattern)))).collect()
        rows.limit(1).where(chosen).collect()
    except (ConditionError, TypeError, PySparkException) as e:
        return str(e).split("\n")[0]
    return None


def first_match(rules: list[tuple[str, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for value, holds in rules:
        out = F.when(holds, F.lit(value)) if out is None else out.when(holds, F.lit(value))
    if out is None:
        return otherwise if otherwise is not None else F.lit(None).cast("string")
    return out.otherwise(otherwise) if otherwise is not None else out
