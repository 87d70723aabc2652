"""Repair of conversation structure: the cheapest edits that make the roles alternate.

A row may be kept, given another role or deleted, and empty turns may be inserted
anywhere, so that the initials of the roles read ``(s?(ua)+)?``.  Of the cheapest
ways the one whose audit string (an initial an edit, in order) comes first is taken.

Between rows a conversation is in one of four states: nothing kept, a system turn
kept, last turn of the user, last turn of the assistant.  A row is consumed by one
macro edit: a run of inserts and the edit of the row, ``IK`` say.  The macros are
a prefix-free code, so of two audits over the same rows the one that comes first
stays first whatever follows, and a layer of the program needs no strings: each state
holds its cost and the *rank* of its audit among the states of the layer, with
a pointer to the macro and state it came from.  The audit is read off the pointers
afterwards.  Costs count from the cheapest state; a state more than ``SLACK`` dearer
can't win any more and is dropped.  So there are few different layers, and a
step from one to the next is looked up.

A conversation is cut into segments of bounded size.  Each is solved from every
state it may begin in, the small tables are joined in order, and each segment
then writes its own edits from the state it really begins in: one conversation may
hold any part of all rows.  Only its audit string, and the digest of its
repaired text, are made in one place, as they are one value a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import SPACE_CLASS, materialize, small_batches

#: Rows of a segment at most.
SEGMENT = 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: From any state the continuation of any other costs at most so much more.
SLACK = 5
STATES, INITIALS = "0sua", "suax"
#: Which state a turn of an initial leads to, by the state before it.
_NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: What a row's fault asks: nothing, that it be deleted, a cost if it stays.
SOUND, MUST_GO, CUT_OFF = 0, 1, 2
_ROLES = {"u": "user", "a": "assistant"}
_END = {0: "", 1: "II", 2: "I", 3: ""}

Layer = tuple[tuple[int, int] | None, ...]


def _macros() -> dict[str, list[tuple[str, str, str, int]]]:
    """Per state: (run of inserts, initials that it writes, state behind it, cost)."""
    found = {}
    for state in STATES:
        runs, at, wrote = [("", "", state, 0)], state, ""
        for n in (1, 2):
            new = "a" if at == "u" else "u"
            at, wrote = _NEXT[at, new], wrote + new
            runs.append(("I" * n, wrote, at, n * INSERT))
        found[state] = runs
    return found


_MACROS = _macros()


def _moves(state: str, initial: str, fault: int) -> list[tuple[str, str, str, int]]:
    """(macro, an initial per edit, state behind it, cost) of all ways to consume a row; '-': the role stays."""
    found = []
    for run, wrote, at, cost in _MACROS[state]:
        found.append((run + "D", wrote + "-", at, cost + DELETE))
        if fault == MUST_GO:
            continue
        late = TRUNCATED if fault == CUT_OFF else 0
        if (at, initial) in _NEXT:
            found.append((run + "K", wrote + "-", _NEXT[at, initial], cost + KEEP + late))
        new = "a" if at == "u" else "u"
        found.append((run + "R", wrote + new, _NEXT[at, new], cost + REROLE + late))
    return found


def kind_of(initial: str, fault: int) -> str:
    """A row as one letter: all that the edits depend on."""
    return chr(65 + 3 * INITIALS.index(initial if initial in INITIALS else "x") + fault)


class Layers:
    """Steps from layer to layer, looked up once known."""

    def __init__(self):
        self.known: dict[tuple[Layer, str], tuple[Layer, int, tuple]] = {}

    def step(self, layer: Layer, kind: str) -> tuple[Layer, int, tuple]:
        """The layer behind a row, the cost of its cheapest state, and per state (state before, macro, initials)."""
        found = self.known.get((layer, kind))
        if found is None:
            found = self.known[layer, kind] = self._step(layer, kind)
        return found

    def _step(self, layer: Layer, kind: str) -> tuple[Layer, int, tuple]:
        initial, fault = INITIALS[(ord(kind) - 65) // 3], (ord(kind) - 65) % 3
        best: dict[int, tuple] = {}
        for before, held in enumerate(layer):
            if held is None:
                continue
            for macro, wrote, state, cost in _moves(STATES[before], initial, fault):
                at, way = STATES.index(state), (held[0] + cost, held[1], macro, before, wrote)
                if at not in best or way < best[at]:
                    best[at] = way
        least = min(way[0] for way in best.values())
        best = {at: way for at, way in best.items() if way[0] <= least + SLACK}
        order = sorted(best, key=lambda at: best[at][1:3])
        after = tuple((best[at][0] - least, order.index(at)) if at in best else None for at in range(4))
        return after, least, tuple((best[at][3], best[at][2], best[at][4]) if at in best else None for at in range(4))

    def table(self, kinds: str) -> list[int]:
        """Cost and rank of a segment for each state it begins in (rows) and ends in; cost -1: no way."""
        out = []
        for entry in range(4):
            layer, total = _only(entry), 0
            for kind in kinds:
                layer, cost, _ = self.step(layer, kind)
                total += cost
            for held in layer:
                out += [-1, -1] if held is None else [total + held[0], held[1]]
        return out

    def edits(self, kinds: str, entry: int, end: int) -> list[tuple[str, str]]:
        """Per row its macro and the initials it writes, on the way from ``entry`` to ``end``."""
        layer, backs = _only(entry), []
        for kind in kinds:
            layer, _, back = self.step(layer, kind)
            backs.append(back)
        out, at = [], end
        for back in reversed(backs):
            at, macro, wrote = back[at]
            out.append((macro, wrote))
        return out[::-1]


def _only(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def joined(tables: list[list[int]]) -> tuple[int, list[int], str]:
    """The least cost over segments in order, the states between them (first and last included), the inserts behind the last row."""
    layer, backs = {0: (0, 0)}, []
    for table in tables:
        best: dict[int, tuple] = {}
        for before, (cost, rank) in layer.items():
            for at in range(4):
                more, inner = table[8 * before + 2 * at : 8 * before + 2 * at + 2]
                way = (cost + more, rank, inner, before)
                if more >= 0 and (at not in best or way < best[at]):
                    best[at] = way
        order = sorted(best, key=lambda at: best[at][1:3])
        layer = {at: (way[0], order.index(at)) for at, way in best.items()}
        backs.append({at: way[3] for at, way in best.items()})
    cost, _, last = min((cost + INSERT * len(_END[at]), rank, at) for at, (cost, rank) in layer.items())
    states = [last]
    for back in reversed(backs):
        states.append(back[states[-1]])
    return cost, states[::-1], _END[last]


_LAYERS = Layers()


def _tables(kinds: pa.Array) -> pa.Array:
    return pa.array([_LAYERS.table(k) for k in kinds.to_pylist()], pa.list_(pa.int64()))


_SOLVED = "struct<cost:long,ways:array<struct<block:long,entry:int,end:int,tail:string>>>"


def _solved(found: pa.Array) -> pa.Array:
    out = []
    for segments in found.to_pylist():
        cost, states, tail = joined([s["table"] for s in segments])
        last = len(segments) - 1
        out.append({"cost": cost, "ways": [{"block": s["block"], "entry": states[i], "end": states[i + 1], "tail": tail if i == last else ""} for i, s in enumerate(segments)]})
    way = pa.struct([("block", pa.int64()), ("entry", pa.int32()), ("end", pa.int32()), ("tail", pa.string())])
    return pa.array(out, pa.struct([("cost", pa.int64()), ("ways", pa.list_(way))]))


def _edits(kinds: pa.Array, entry: pa.Array, end: pa.Array, tail: pa.Array) -> pa.Array:
    out = []
    for k, a, b, t in zip(kinds.to_pylist(), entry.to_pylist(), end.to_pylist(), tail.to_pylist()):
        found = _LAYERS.edits(k, a, b)
        if t:  # inserts behind the last row
            wrote = "ua"[-len(t) :]
            found[-1] = (found[-1][0] + t, found[-1][1] + wrote)
        out.append([{"macro": m, "wrote": w} for m, w in found])
    return pa.array(out, pa.list_(pa.struct([("macro", pa.string()), ("wrote", pa.string())])))


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage: rows dropped, emptied, without ends, repeated or given to the user, by the checksum of their place; nulls become one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), (F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20).alias("__draw"))
    text = F.when(F.col("__draw") == 1, "").when(F.col("__draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("__draw") == 3, 2).otherwise(1)))
    kept = drawn.where("__draw != 0").select("conv_id", "turn", F.when(F.col("__draw") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("__copy"))
    return kept.drop("__copy")


def _visible(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.right(F.regexp_replace(text, f"[{SPACE_CLASS}]+$", ""), F.lit(1))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with their place in the order and their segment, written once.

    A conversation's rows go by turn, nulls first; those of one turn by role, then
    text; which of equal rows comes first doesn't show.
    """
    whole = rows.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row"))
    # sorted over all tasks; the row number lets equal rows fall into different tasks
    ordered = whole.orderBy("conv", F.asc_nulls_first("turn"), "role", "text", "row").drop("row")
    return materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "turns")


def _faults(turns: DataFrame) -> DataFrame:
    """(conv, block, at, kind, blank, duplicate, truncated): narrow rows with their first fault."""
    end = _visible(F.col("text"))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin(*INITIALS[:3]), F.instr(F.lit(INITIALS), initial) - 1).otherwise(3)
    narrow = turns.select("conv", "at", "role", F.sha2("text", 256).alias("said"), kind.alias("initial"), (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("open"))
    firsts = narrow.where("not blank").groupBy("conv", "role", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    marked = narrow.drop("role", "said").join(firsts, "at", "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    fault = F.when(F.col("blank") | duplicate, MUST_GO).when(F.col("open"), CUT_OFF).otherwise(SOUND)
    return marked.select("conv", F.expr(f"at div {SEGMENT}").alias("block"), "at", F.char(F.col("initial") * 3 + fault + 65).alias("kind"), "blank", duplicate.alias("duplicate"), (fault == CUT_OFF).alias("truncated"))


def _legal_pairs(kinds: Column) -> Column:
    """Adjacent rows of a string of kinds, counted where their initials don't follow one another."""
    initials = F.translate(kinds, "ABCDEFGHIJKL", "sssuuuaaaxxx")
    pairs = F.transform(F.sequence(F.lit(1), F.length(kinds)), lambda i: F.substring(initials, i, F.lit(2)))
    return F.size(F.filter(pairs, lambda p: (F.length(p) == 2) & ~p.isin("su", "ua", "au"))).cast("long")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cheapest repair of every conversation: its edits, and a summary.

    ``rows``: conv_id, turn, role, text and others, which are left aside.  The edits
    are (conv, at, k, edit, role, text): a row per edit in order of (at, k), with
    the role and text that it leaves (null for deletions).  The summary is (conv,
    gaps, blank, duplicate, truncated, illegal, cost, audit).  ``conv`` is a struct
    of the conv_id, so that the rows of a null conv_id meet as one conversation.
    Null roles and texts are one space; a conversation without rows isn't in either
    table; of equal rows all but the first are duplicates; texts of any length are
    read whole.  An audit is one string, so a conversation has less than 2^31 rows.
    """
    turns = small_batches(placed(rows))
    faults = _faults(turns)
    row = F.array_sort(F.collect_list(F.struct("at", "kind")))
    counted = [F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    grouped = faults.groupBy("conv", "block").agg(row.alias("rows"), *counted)
    kinds = F.array_join(F.col("rows.kind"), "")
    segments = materialize(
        grouped.select("conv", "block", F.col("rows.at").alias("at"), kinds.alias("kinds"), "blank", "duplicate", "truncated").withColumn("illegal", _legal_pairs(F.col("kinds"))).withColumn("table", F.arrow_udf(_tables, "array<long>")("kinds")),
        "segments",
    )
    part = F.struct("block", "table", F.left("kinds", F.lit(1)).alias("first"), F.right("kinds", F.lit(1)).alias("last"))
    totals = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")]
    whole = segments.groupBy("conv").agg(F.array_sort(F.collect_list(part)).alias("parts"), *totals)
    seams = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.when(i > 0, _legal_pairs(F.concat(F.get(F.col("parts"), i - 1)["last"], F.get(F.col("parts"), i)["first"]))).otherwise(0))
    plain = F.transform("parts", lambda p: F.struct(p["block"].alias("block"), p["table"].alias("table")))
    solved = materialize(
        whole.select("conv", "blank", "duplicate", "truncated", (F.col("illegal") + F.aggregate(seams, F.lit(0).cast("long"), lambda a, b: a + b)).alias("illegal"), F.arrow_udf(_solved, _SOLVED)(plain).alias("solved")),
        "solved",
    )
    ways = solved.select("conv", F.explode("solved.ways").alias("way")).select("conv", "way.*")
    written = segments.select("conv", "block", "at", "kinds").join(ways, ["conv", "block"]).withColumn("edits", F.arrow_udf(_edits, "array<struct<macro:string,wrote:string>>")("kinds", "entry", "end", "tail"))
    written = materialize(written.select("conv", "block", "at", "edits"), "edits")

    audit = written.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", F.array_join(F.col("edits.macro"), "").alias("audit")))).alias("audits")).select("conv", F.array_join(F.col("audits.audit"), "").alias("audit"))
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    summary = solved.join(gaps, "conv").join(audit, "conv")
    summary = summary.select("conv", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("solved.cost").alias("cost"), "audit")

    each = written.select(F.explode(F.arrays_zip("at", "edits")).alias("x")).select("x.at", "x.edits.macro", "x.edits.wrote")
    each = each.select("at", "wrote", F.posexplode(F.split("macro", "")).alias("k", "edit")).select("at", "k", "edit", F.substring("wrote", F.col("k") + 1, F.lit(1)).alias("wrote"))
    new = F.when(F.col("wrote") == "u", _ROLES["u"]).when(F.col("wrote") == "a", _ROLES["a"])
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("edit") != "D", new)
    text = F.when(F.col("edit").isin("K", "R"), F.col("text")).when(F.col("edit") == "I", F.lit(""))
    edits = each.join(turns.select("conv", "at", "role", "text"), "at").select("conv", "at", "k", "edit", role.alias("role"), text.alias("text"))
    return edits, summary


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, read in order and never held together."""
    key, found, schema = None, None, pa.schema([("conv", pa.struct([("conv_id", pa.int64())])), ("sha", pa.string())])

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"conv": key, "sha": found.hexdigest()}], schema)

    for batch in batches:
        done = []
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if found is None or conv != key:
                if found is not None:
                    done.append({"conv": key, "sha": found.hexdigest()})
                key, found = conv, hashlib.sha256(line.encode())
            else:
                found.update(b"\n" + line.encode())
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if found is not None:
        yield told()


def digest(originals: DataFrame, edits: DataFrame, summary: DataFrame) -> DataFrame:
    """The contract's columns for every conversation of ``originals``, those left without rows included."""
    lines = edits.where("edit != 'D'").select(F.struct(F.col("conv.conv_id").cast("long").alias("conv_id")).alias("conv"), F.concat_ws(":", "role", "text").alias("line"), "at", "k")
    hashes = lines.repartition("conv").sortWithinPartitions("conv", "at", "k").select("conv", "line").mapInArrow(_hashes, "conv struct<conv_id:long>, sha string")
    every = originals.select(F.struct(F.col("conv_id").cast("long").alias("conv_id")).alias("conv")).distinct()
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    known = every.join(summary, "conv", "left").join(hashes, "conv", "left")
    return known.select("conv.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
