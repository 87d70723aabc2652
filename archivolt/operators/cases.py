"""Cases for a model, answer keys for its evaluation, and what they say."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.operators import grouping, sampling
from archivolt.operators import values as V

#: The values of origin that mean a person.
PERSON = ("person", "person_via_system", "list")
#: Fixed value: templates of fewer messages are asked one by one.
TEMPLATE = 3
#: Ids of a range that are numbered in a task.
SPAN = 100_000


def with_origin(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """``messages`` with ``origin`` (effective, or null) and ``machine``: by origin, without one by the parser's flag."""
    effective = V.effective_message_values(messages, assignments.where("dimension = 'origin'"))
    rows = messages.join(effective.select(F.col("message_id").alias("id"), F.col("value").alias("origin")), "id", "left")
    return rows.withColumn("machine", F.coalesce(~F.col("origin").isin(*PERSON), "is_automated", F.lit(False)))


def _time(at: str = "received_at", late: bool = False) -> Column:
    """A sort key that puts missing times first, or last."""
    return F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(2**62 if late else -(2**62)))


def middles(rows: DataFrame, key: str, *, late: bool = False) -> DataFrame:
    """(key, id): the row at place (n + 1) / 2 of each key by time (missing times first, or late) and id.

    Counts per day find the day that holds the middle, and only that day's rows
    are ranked, so a key with most of the archive isn't sorted in one task.
    """
    day = F.coalesce(F.unix_date(F.col("received_at").cast("date")), F.lit(2**31 - 1 if late else -(2**31)))
    daily = rows.groupBy(key, day.alias("__day")).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, 0)
    placed = daily.withColumn("__to", F.sum("__n").over(upto)).withColumn("__want", F.floor((F.sum("__n").over(Window.partitionBy(key)) + 1) / 2))
    hit = placed.where("__to - __n < __want and __want <= __to").select(key, "__day", (F.col("__want") - F.col("__to") + F.col("__n")).alias("__place"))
    ranked = rows.withColumn("__day", day).join(hit, [key, "__day"])
    ranked = ranked.withColumn("__rank", F.row_number().over(Window.partitionBy(key, "__day").orderBy(_time(late=late), "id")))
    return ranked.where("__rank = __place").select(key, "id")


def machine_cases(rows: DataFrame, pattern: str) -> DataFrame:
    """(unit, unit_key, sample_no, anchor, n): three samples of each template (first, middle, last), the newest message of a smaller one."""
    place = F.struct(_time().alias("t"), F.col("id"))
    ends = rows.groupBy(pattern).agg(F.count("*").alias("n"), F.min(place)["id"].alias("first"), F.max(place)["id"].alias("last"))
    big = ends.where(F.col("n") >= TEMPLATE).join(middles(rows, pattern).withColumnRenamed("id", "middle"), pattern)
    samples = big.select(F.lit("template").alias("unit"), F.col(pattern).alias("unit_key"), F.posexplode(F.array("first", "middle", "last")).alias("sample_no", "anchor"), "n")
    tail = ends.where(F.col("n") < TEMPLATE).select(F.lit("tail").alias("unit"), F.col(pattern).alias("unit_key"), F.lit(0).alias("sample_no"), F.col("last").alias("anchor"), "n")
    return samples.unionByName(tail)


def person_cases(rows: DataFrame) -> DataFrame:
    """A case per thread, or per message without one, on its newest message."""
    place = F.struct(_time().alias("t"), F.col("id"))
    key = F.when(F.col("thread_id").isNotNull(), F.concat(F.lit("thread:"), F.col("thread_id"))).otherwise(F.concat(F.lit("message:"), F.col("id")))
    made = rows.groupBy(key.alias("unit_key")).agg(F.max(place)["id"].alias("anchor"), F.count("*").alias("n"))
    return made.select(F.lit("thread").alias("unit"), "unit_key", F.lit(0).alias("sample_no"), "anchor", "n")


def chat_cases(rows: DataFrame) -> DataFrame:
    """A case per window of a chat, on its newest incoming message, else on its newest."""
    place = F.struct(_time().alias("t"), F.col("id"))
    cut = grouping.sessions(rows.where("thread_id is not null"), ["thread_id"], "received_at", ["id"])
    made = cut.groupBy("thread_id", "session", "part").agg(
        F.min(place)["id"].alias("first"), F.coalesce(F.max(F.when(F.col("direction") == "in", place))["id"], F.max(place)["id"]).alias("anchor"), F.count("*").alias("n")
    )
    return made.select(F.lit("window").alias("unit"), F.concat_ws(":", F.lit("window"), "thread_id", "first").alias("unit_key"), F.lit(0).alias("sample_no"), "anchor", "n")


def select_cases(messages: DataFrame, assignments: DataFrame, pattern: Column) -> DataFrame:
    """(stage, unit, unit_key, sample_no, anchor, n): what a run over the whole archive would ask."""
    mail = with_origin(messages.where("direction = 'in' and medium = 'email'"), assignments).withColumn("__pattern", pattern)
    stages = {
        "machine": machine_cases(mail.where("machine"), "__pattern"),
        "person": person_cases(mail.where("not machine")),
        "chat": chat_cases(messages.where("medium <> 'email'")),
    }
    return reduce(DataFrame.unionByName, [rows.withColumn("stage", F.lit(stage)) for stage, rows in stages.items()])


def coverage(messages: DataFrame, assignments: DataFrame) -> DataFrame:
    """(account, medium, incoming, decided, undecided, undecided_machine, share): how far origin is settled."""
    rows = with_origin(messages.where("direction = 'in'"), assignments)
    made = rows.groupBy("account", "medium").agg(
        F.count("*").alias("incoming"), F.count("origin").alias("decided"), F.count_if(F.col("origin").isNull()).alias("undecided"), F.count_if(F.col("origin").isNull() & F.col("machine") & (F.col("medium") == "email")).alias("undecided_machine")
    )
    return made.withColumn("share", F.col("decided") / F.col("incoming"))


# --- answer keys ---------------------------------------------------------------------


def dealt(shares: dict[str, dict[str, float]], n: int, take: Callable[[str], bool]) -> dict[str, int]:
    """Items per group when ``take(group)`` draws one or tells that none is left.

    Each group draws its part of n in the order of ``shares``; what it lacks is
    drawn by turns from the others of its stratum, then from any.
    """
    strata = sampling.split_by_share({s: sum(groups.values()) for s, groups in shares.items()}, n)
    home = {g: s for s, groups in shares.items() for g in groups}
    want: dict[str, int] = {}
    for s, groups in shares.items():
        want |= sampling.split_by_share(groups, strata[s])
    got = dict.fromkeys(want, 0)
    for g in want:
        while got[g] < want[g] and take(g):
            got[g] += 1
    for same in (True, False):
        for g in want:
            givers, turn = [o for o in want if o != g and (not same or home[o] == home[g])], 0
            while want[g] > got[g] and givers:
                o = givers[turn % len(givers)]
                if not take(o):
                    givers.remove(o)
                    continue
                got[o], want[o], want[g], turn = got[o] + 1, want[o] + 1, want[g] - 1, turn + 1
    return got


def quotas(sizes: dict[str, int], shares: dict[str, dict[str, float]], n: int) -> dict[str, int]:
    """Items per group where all of a group's items are free."""
    left = dict(sizes)

    def take(g: str) -> bool:
        left[g] = left.get(g, 0) - 1
        return left[g] >= 0

    return dealt(shares, n, take)


class _Draw:
    """Groups' candidates in order of draw, page by page; only pages of about as many rows as are wanted leave the executors."""

    def __init__(self, pool: DataFrame, claims: list[str], groups: list[str], page: int):
        self.rows = pool.withColumn("__order", F.md5(F.col("id").cast("string"))).select("id", "group", "__order", *[F.col(c).alias(f"__c{i}") for i, c in enumerate(claims)])
        self.claims, self.page = [f"__c{i}" for i in range(len(claims))], page
        self.used: dict[str, set] = {c: set() for c in ("id", *self.claims)}
        first = Window.partitionBy("group").orderBy("__order", "id")
        found = self.rows.where(F.col("group").isin(groups)).withColumn("__rn", F.row_number().over(first)).where(F.col("__rn") <= page).orderBy("__rn").collect()
        self.held = {g: [r for r in found if r["group"] == g] for g in groups}
        self.last = {g: rows[-1] if len(rows) == page else None for g, rows in self.held.items()}  # None: nothing follows
        self.drawn: list[tuple] = []

    def _turn(self, g: str) -> None:
        """The next page: candidates that share no claim with what is drawn, so that each page gives one at least."""
        last = self.last[g]
        behind = F.struct("__order", "id") > F.struct(F.lit(last["__order"]).alias("__order"), F.lit(last["id"]).alias("id"))
        rows = self.rows.where((F.col("group") == g) & behind)
        for column, seen in self.used.items():  # as many values as are drawn
            if seen:
                rows = rows.where(F.col(column).isNull() | ~F.col(column).isin(sorted(seen)))
        self.held[g] = rows.orderBy("__order", "id").limit(self.page).collect()
        self.last[g] = self.held[g][-1] if len(self.held[g]) == self.page else None

    def take(self, g: str) -> bool:
        """Draw the group's next free candidate; False when none is left."""
        while True:
            while self.held[g]:
                row = self.held[g].pop(0)
                mine = {c: row[c] for c in self.used if row[c] is not None}
                if not any(v in self.used[c] for c, v in mine.items()):
                    self._claim(row, mine)
                    return True
            if self.last[g] is None:
                return False
            self._turn(g)

    def _claim(self, row, mine: dict) -> None:
        for c, v in mine.items():
            self.used[c].add(v)
        self.drawn.append((row["id"], row["group"], len(self.drawn) + 1))


def answer_key(pool: DataFrame, claims: list[str], shares: dict[str, dict[str, float]], n: int, *, page: int | None = None) -> DataFrame:
    """(id, group, position): n candidates, spread over the groups, drawn one after another.

    ``pool`` has id (unique in its group), group and the claims, null where there is
    nothing to claim.  A
    candidate that is drawn claims its id, thread, template, and so on; one that
    shares a claim with an earlier *drawn* one is passed over, while one that was
    itself passed over claims nothing.  The order within a group is a digest of the
    id, ties by id.  What a group lacks the others give (``dealt``); with too few
    free candidates the key is shorter.  Rows with a null id are in no group.
    """
    groups = [g for part in shares.values() for g in part]
    draw = _Draw(pool.where("id is not null"), claims, groups, page or max(16, 2 * n // max(1, len(groups))))
    dealt(shares, n, draw.take)
    kind = pool.schema["id"].dataType.simpleString()
    return pool.sparkSession.createDataFrame(draw.drawn, f"id {kind}, group string, position int")


def numbered(rows: DataFrame, key: str, into: str) -> DataFrame:
    """``rows`` with their place by an integer key that is unique, from 1: counts per range of keys, then places within a range."""
    spans = rows.withColumn("__span", F.floor(F.col(key) / SPAN))
    counts = spans.groupBy("__span").agg(F.count("*").alias("__n"))
    earlier = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__span", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("__span").orderBy(key)) + F.col("__before")
    return spans.join(bases, "__span").withColumn(into, place).drop("__span", "__before")


def check_sample(labels: DataFrame, labeller: str, owner: str, n: int) -> DataFrame:
    """(item, rank): n items that a labeller answered and the owner didn't, by a digest of the item."""
    theirs = labels.where((F.col("labeller") == labeller) & (F.col("field") != "note")).select("item").distinct()
    free = theirs.join(labels.where(F.col("labeller") == owner).select("item"), "item", "left_anti")
    first = free.withColumn("__order", F.md5(F.col("item").cast("string"))).orderBy("__order", "item").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("__order", "item"))).select("item", "rank")


def check_state(sample: DataFrame, labels: DataFrame, owner: str, fields: list[str]) -> DataFrame:
    """(item, rank, answered, checked): how many fields of each item of the sample the owner has answered."""
    mine = labels.where((F.col("labeller") == owner) & F.col("field").isin(fields)).groupBy("item").agg(F.count_distinct("field").alias("answered"))
    held = sample.join(mine, "item", "left").withColumn("answered", F.coalesce("answered", F.lit(0)))
    return held.withColumn("checked", F.col("answered") == len(fields))


def check_summary(sample: DataFrame, labels: DataFrame, labeller: str, owner: str) -> DataFrame:
    """(field, answered, kept, changed, rate): which of a labeller's answers the owner kept.

    ``labels``: item, field, labeller, values (an array), status.  Kept means the
    same set of values, and that the owner was sure.
    """
    rows = labels.join(sample.select("item"), "item", "left_semi")
    mine = rows.where(F.col("labeller") == owner).select("item", "field", F.col("values").alias("mine"), "status")
    theirs = rows.where(F.col("labeller") == labeller).select("item", "field", F.col("values").alias("theirs"))
    same = F.sort_array(F.array_distinct("mine")) == F.sort_array(F.array_distinct("theirs"))
    judged = mine.join(theirs, ["item", "field"], "left").withColumn("ok", F.coalesce(same & (F.col("status") == "set"), F.lit(False)))
    made = judged.groupBy("field").agg(F.count("*").alias("answered"), F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("changed"))
    return made.withColumn("rate", F.col("kept") / F.col("answered"))


# --- predictions ---------------------------------------------------------------------


def rule_predictions(messages: DataFrame, assignments: DataFrame, fields: list[str]) -> DataFrame:
    """(message_id, field, value): the strongest active rule value, the message's own before its thread's, then the newest."""
    rows = V.candidates(messages, assignments.where((F.col("source_kind") == "rule") & F.col("dimension").isin(fields)))
    place = F.struct(F.col("own").cast("int").alias("own"), _time("created_at").alias("t"), "assignment_id")
    return rows.groupBy("message_id", F.col("dimension").alias("field")).agg(F.max_by("value", place).alias("value"))


def run_predictions(messages: DataFrame, assignments: DataFrame, many: tuple[str, ...] = V.MANY) -> DataFrame:
    """(message_id, field, values, confidence): a model run's answers, proposed ones included.

    The message's own answers, else its thread's; in a field of one value the
    lowest id counts; the confidence is the lowest of the values that count.
    """
    named = assignments.where("source_kind = 'model' and status in ('proposed', 'active') and not startswith(value, 'hold:')").withColumn("status", F.lit("active"))
    rows = V.candidates(messages, named).withColumnRenamed("dimension", "field")
    rank = Window.partitionBy("message_id", "field")
    best = rows.withColumn("__own", F.max("own").over(rank)).where(F.col("own") == F.col("__own"))
    best = best.withColumn("__first", F.min("assignment_id").over(rank)).where(F.col("field").isin(*many) | (F.col("assignment_id") == F.col("__first")))
    return best.groupBy("message_id", "field").agg(F.sort_array(F.collect_set("value")).alias("values"), F.min("confidence").alias("confidence"))


def revealed(gold: DataFrame, predictions: DataFrame, items: DataFrame, fields: list[str], size: int = 25) -> DataFrame:
    """(round, field, compared, agreed) of the rounds whose every item has every field answered.

    ``items`` have item and position (from 1); a round is ``size`` items in order.
    """
    rounds = items.select("item", (F.floor((F.col("position") - 1) / size) + 1).alias("round"))
    given = gold.where(F.col("field").isin(fields))
    answered = given.groupBy("item").agg(F.count_distinct("field").alias("n"))
    ready = rounds.join(answered, "item", "left").groupBy("round").agg(F.min(F.coalesce("n", F.lit(0))).alias("least")).where(F.col("least") == len(fields)).select("round")
    rows = given.where("status = 'set'").join(rounds, "item").join(ready, "round", "left_semi")
    both = rows.join(predictions.select(F.col("message_id").alias("item"), "field", F.col("value").alias("guess")), ["item", "field"])
    return both.groupBy("round", "field").agg(F.count("*").alias("compared"), F.count_if(F.col("value") == F.col("guess")).alias("agreed"))


def activity(streams: dict[str, DataFrame], *, before: tuple[str, int, int] | None = None, limit: int = 50) -> DataFrame:
    """One page of several streams of (at, id, what), newest first; ``before`` is the (at, rank, id) of the last item seen.

    Every stream gives at most a page before they are merged; the order of the
    streams is their rank at equal times.
    """
    parts = []
    for rank, (kind, rows) in enumerate(streams.items()):
        made = rows.where(F.col("at").isNotNull()).select(F.col("at").cast("timestamp").alias("at"), F.lit(rank).alias("rank"), F.col("id"), F.lit(kind).alias("kind"), "what")
        if before is not None:
            at, seen_rank, seen_id = before
            made = made.where(F.struct("at", "rank", "id") < F.struct(F.lit(at).cast("timestamp").alias("at"), F.lit(seen_rank).alias("rank"), F.lit(seen_id).cast("long").alias("id")))
        parts.append(made.orderBy(F.desc("at"), F.desc("id")).limit(limit))
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("at"), F.desc("rank"), F.desc("id")).limit(limit)
