"""The placement report (C11) over all messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import placement
from archivolt.operators import structure as S
from archivolt.queries.conditions import RANKED
from archivolt.registry import Registry

registry = Registry()

_LISTS = S.Target("lists", "Root/N", "label", [{"field": "list_id", "set": True}])
_KEPT = S.Target("kept", "Inbox", "inbox", [{"field": "topic", "in": ["Travel", "BUILDING", "1-URGENT"]}])
_RECENT = S.Target("recent", "Mail/Recent", "label", [{"field": "age", "lt": 1600}, {"field": "is_automated", "is": False}])
_SEVEN = S.Target("labelled", "Mail/Kept/Seven", "leave", [{"field": "olds", "prefix": ["L5", "Root/A"]}])
#: The targets of each account, and what its old places are called now.
TARGETS = {"acc0": [_LISTS, _KEPT, _RECENT, _SEVEN], "acc1": [_RECENT, _LISTS], "acc2": []}
OLD = {"acc0": {"Root/A": "Mail/Recent", "L3": "Root/N"}, "acc1": {"Root/R": "Mail/Recent"}}

_TOPIC = "coalesce(topic in ('Travel', 'BUILDING', '1-URGENT'), false)"
_YOUNG = "coalesce(age < 1600, false)"
_OLDS = "coalesce(olds, []::varchar[])"
_PREFIX = f"len(list_filter({_OLDS}, lambda x: starts_with(x, 'L5') or starts_with(x, 'Root/A'))) > 0"
_PLACED = (
    f"{archive.ctes('message', 'assignment', 'location')}{RANKED}, tp as (select message_id, value as topic from eff where dimension = 'topic'),"
    " loc as (select message_id, list_sort(list_distinct(list_concat(list(distinct coalesce(folder_path, folder)), coalesce(list(distinct label) filter (where label is not null), [])))) as olds, bool_or(folder = 'INBOX') as in_inbox from location where present group by 1),"
    " f as (select m.id, m.account, m.received_at, m.list_id, m.is_automated, topic, coalesce(olds, []::varchar[]) as olds, coalesce(in_inbox, false) as in_inbox, date_diff('day', received_at, timestamp '2001-08-02') as age"
    " from message m left join tp on tp.message_id = m.id left join loc on loc.message_id = m.id),"
    f" c as (select *, case account when 'acc0' then case when list_id is not null then 'lists' when in_inbox and {_TOPIC} then 'kept' when {_YOUNG} and not is_automated then 'recent' when {_PREFIX} then 'labelled' else '(no rule)' end"
    f" when 'acc1' then case when {_YOUNG} and not is_automated then 'recent' when list_id is not null then 'lists' else '(no rule)' end else '(no rule)' end as rule_id from f),"
    " p as (select *, case rule_id when 'lists' then 'Root/N' when 'kept' then 'Inbox' when 'recent' then 'Mail/Recent' when 'labelled' then 'Mail/Kept/Seven' else 'To sort' end as target,"
    " case rule_id when 'kept' then 'inbox' when 'labelled' then 'leave' else 'label' end as place, in_inbox and rule_id not in ('kept', 'labelled') as leaves_inbox from c)"
)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, places = archive.messages(spark, sf_dir), archive.locations(spark, sf_dir)
    made = placement.features(rows, archive.assignments(spark, sf_dir).where("dimension = 'topic'"), places, ["topic"], archive.NOW)
    return S.with_locations(made, places)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.placed(_features(spark, sf_dir), TARGETS)


@registry.add(f"{_PLACED} select id, account, rule_id, target, place, in_inbox, leaves_inbox from p")
def c11_c10_first_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("id", "account", "rule_id", "target", "place", "in_inbox", "leaves_inbox")


def _test(rule: str, conditions: str) -> str:
    return f"concat('{rule}:', case when rule_id = '{rule}' then '!' else '' end, array_to_string(list_transform([{conditions}], lambda b: case when b then '1' else '0' end), ''))"


@registry.add(
    f"{_PLACED} select id, case account when 'acc0' then concat_ws(' ', {_test('lists', 'list_id is not null')}, {_test('kept', f'in_inbox, {_TOPIC}')}, {_test('recent', f'{_YOUNG}, not is_automated')}, {_test('labelled', _PREFIX)})"
    f" when 'acc1' then concat_ws(' ', {_test('recent', f'{_YOUNG}, not is_automated')}, {_test('lists', 'list_id is not null')}) else '' end as told from p"
)
def c11_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target of every message's account: which is first (!), and the truth of each of its conditions."""
    bits = lambda t: F.array_join(F.transform(t["conditions"], lambda c: c["ok"].cast("int").cast("string")), "")
    told = F.transform("tests", lambda t: F.concat(t["rule_id"], F.lit(":"), F.when(t["first"], "!").otherwise(""), bits(t)))
    return S.why(_features(spark, sf_dir), TARGETS).select("id", F.array_join(told, " ").alias("told"))


_MAPPED = " or ".join(f"(account = '{a}' and list_contains(olds, '{o}') and target = '{n}')" for a, pairs in OLD.items() for o, n in pairs.items())


@registry.add(
    f"{_PLACED} select account, count(*)::bigint as total, count(*) filter (where in_inbox)::bigint as inbox_before, count(*) filter (where in_inbox and not leaves_inbox)::bigint as inbox_after, count(*) filter (where leaves_inbox)::bigint as leaves_inbox,"
    f" count(*) filter (where target = 'To sort')::bigint as to_sort, count(*) filter (where place = 'leave')::bigint as left_alone, count(*) filter (where {_MAPPED})::bigint as same_place from p group by 1"
)
def c11_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.totals(_placed(spark, sf_dir), OLD)


@registry.add(f"{_PLACED} select account, target, place, rule_id, count(*)::bigint as n, count(*) filter (where in_inbox)::bigint as in_inbox, count(*) filter (where leaves_inbox)::bigint as leaves_inbox from p group by 1, 2, 3, 4")
def c11_report_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.by_target(_placed(spark, sf_dir))


_MAPS = "case " + " ".join(f"when account = '{a}' and old = '{o}' then '{n}'" for a, pairs in OLD.items() for o, n in pairs.items()) + " end"


@registry.add(
    f"{_PLACED}, o as (select account, target, unnest(olds) as old from p), k as (select account, old, target, count(*) as n, {_MAPS} as maps_to from o group by 1, 2, 3),"
    " r as (select *, row_number() over (partition by account, old order by n desc, target) as rn from k)"
    " select account, old, sum(n)::bigint as n, max(maps_to) as maps_to, coalesce(sum(n) filter (where target = maps_to), 0)::bigint as same, string_agg(concat(target, ' ', n), ', ' order by rn) filter (where rn <= 4) as targets from r group by 1, 2"
)
def c11_old_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old folders and labels, each with the targets that its messages go to."""
    found = S.old_places(_placed(spark, sf_dir), OLD)
    return found.withColumn("targets", F.array_join(F.transform("targets", lambda t: F.concat_ws(" ", t["target"], t["n"].cast("string"))), ", "))


@registry.add(
    f"{_PLACED}, n as (select account, target, count(*) as n, count(*) filter (where in_inbox) as i, count(*) filter (where leaves_inbox) as l from p group by 1, 2),"
    " e as (select account, target, n, i, l, unnest(range(1, len(string_split(target, '/')) + 1)) as depth from n)"
    " select account, array_to_string(string_split(target, '/')[1:depth], '/') as path, depth::int as depth, bool_or(depth = len(string_split(target, '/'))) as leaf, sum(n)::bigint as n, sum(i)::bigint as in_inbox, sum(l)::bigint as leaves_inbox from e group by 1, 2, 3"
)
def c11_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.tree(_placed(spark, sf_dir))


@registry.add(f"{_PLACED} select id, received_at, target, rule_id from p where account = 'acc0' and (target = 'Mail' or starts_with(target, 'Mail/')) order by received_at desc nulls last, id limit 25 offset 5")
def c11_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.examples(_placed(spark, sf_dir), "acc0", "Mail", offset=5)


_OPS = "ops as (select l_orderkey as message_id, case when l_linenumber % 2 = 0 then 'archive' else 'add_label' end as op, case when l_linenumber % 2 = 1 then case when l_partkey % 2 = 0 then 'To sort' else 'Mail/Recent' end end as label from lineitem where l_linestatus = 'O')"


@registry.add(
    f"{_PLACED}, {_OPS}, w as (select p.*, list_contains(olds, target) as labelled, exists (select 1 from ops where ops.message_id = p.id and op = 'add_label' and label = target) as wl, exists (select 1 from ops where ops.message_id = p.id and op = 'archive') as wa from p where place = 'label')"
    " select account, 'label' as step, target, count(*)::bigint as planned, count(*) filter (where labelled)::bigint as on_server, count(*) filter (where not labelled and wl)::bigint as waiting, count(*) filter (where not labelled and not wl)::bigint as to_prepare from w group by 1, 3"
    " union all select account, 'archive', '', count(*), count(*) filter (where in_inbox), count(*) filter (where in_inbox and wa), greatest(0, count(*) filter (where in_inbox and labelled) - count(*) filter (where in_inbox and wa)) from w where leaves_inbox group by 1"
)
def c11_checklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is planned, done, waiting and left to prepare, with the open line items as operations."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linestatus = 'O'")
    odd = F.col("l_linenumber") % 2 == 1
    label = F.when(odd, F.when(F.col("l_partkey") % 2 == 0, "To sort").otherwise("Mail/Recent"))
    operations = lines.select(F.col("l_orderkey").alias("message_id"), F.when(odd, "add_label").otherwise("archive").alias("op"), label.alias("label"))
    return S.checklist(_placed(spark, sf_dir), operations)
