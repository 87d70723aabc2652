"""Importance, patterns, profiles, origin, placement and plans over the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import placement, signals, values
from archivolt.plans import conditions as C
from archivolt.queries.conditions import RANKED
from archivolt.queries.texts import SKELETON
from archivolt.registry import Registry

registry = Registry()
_M = archive.ctes("message")
_MAP = archive.ctes("message", "assignment", "participant")
VIPS = ["user7@dom3.example.com", "dom5.example.com"]

IMPORTANCE = f"""{_MAP}{RANKED},
contact as (select lower(address) as sender, count(distinct p.message_id) as n from participant p join message o on o.id = p.message_id where o.direction = 'out' and o.received_at >= timestamp '2001-08-02' - interval 2 year group by 1),
tout as (select thread_id, max(received_at) as last_out from message where direction = 'out' and thread_id is not null group by 1),
rc as (select message_id, bool_or(role = 'to' and address = '{archive.OWNER}') as to_me, bool_or(role <> 'to' and address = '{archive.OWNER}') as cc_me, count(*) filter (where role = 'to') as n_to, count(*) filter (where role in ('to', 'cc')) as n_rcpt from participant group by 1),
v as (select message_id, max(value) filter (where lower(value) in ('notification')) as noise from eff where dimension = 'topic' group by 1),
f as (select m.*, coalesce(c.n, 0) as cn, coalesce(to_me, false) as tm, coalesce(cc_me, false) as cm, coalesce(n_to, 0) as nt, coalesce(n_rcpt, 0) as nr, last_out, noise,
  list_id is not null or coalesce(list_unsubscribe, '') <> '' as listed, not is_automated and from_address is not null and not starts_with(from_address, 'noreply@') as person,
  coalesce(lower(from_address) in ('user7@dom3.example.com') or split_part(from_address, '@', 2) in ('dom5.example.com'), false) as vip
  from message m left join contact c on c.sender = lower(m.from_address) left join tout t on t.thread_id = m.thread_id left join rc on rc.message_id = m.id left join v on v.message_id = m.id),
g as (select *, case when medium = 'teams_chat' then tm and nt <= 5 else tm and not listed and nr <= 10 end as direct, coalesce(last_out > received_at, false) as answered from f),
h as (select *, person and direct and (coalesce(contains(subject, 'can you'), false) or id % 7 = 3) as asks, id % 9 = 4 or id % 9 = 5 and coalesce(year(received_at + interval 10 day) = year(received_at), false) as due from g),
s as (select *, case when direction <> 'in' then '' else concat_ws(',', case when person then 'person' end, case when direct then 'direct' end, case when not direct and not listed and (cm or tm) then 'copied' end,
  case when cn >= 5 then 'replied_often' end, case when cn between 1 and 4 then 'replied' end, case when last_out is not null and medium <> 'teams_chat' then 'in_thread' end, case when asks and not answered then 'question' end,
  case when asks and answered then 'answered' end, case when due then 'deadline' end, case when vip then 'vip' end, case when noise is not null then 'filed_noise' end, case when listed then 'list' end, case when is_automated then 'automated' end) end as signals from h),
p as (select *, list_sum(list_transform(string_split(signals, ','), lambda x: case x when 'person' then 20 when 'direct' then 20 when 'copied' then 5 when 'replied_often' then 25 when 'replied' then 15 when 'in_thread' then 15
  when 'question' then 20 when 'deadline' then 10 when 'vip' then 50 when 'filed_noise' then -60 when 'list' then -40 when 'automated' then -30 else 0 end))::int as score from s)
select id, score, case when direction <> 'in' then 'low' when listed or is_automated or noise is not null then case when score >= 10 then 'low' else 'noise' end when score >= 70 then 'high' when score >= 45 then 'medium' when score >= 10 then 'low' else 'noise' end as level,
 signals, direction = 'in' and asks and not answered as waiting from p"""


@registry.add(IMPORTANCE)
def c4_x25_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir)
    effective = values.effective_message_values(rows, archive.assignments(spark, sf_dir).where("dimension = 'topic'"))
    # bodies with a question, an urgent word, and a date within and beyond the horizon
    body = F.when(F.col("id") % 7 == 3, "Har du tid i veckan").otherwise("See https://example.com/?a=1")
    dated = F.date_format(F.date_add("received_at", F.when(F.col("id") % 9 == 5, 10).otherwise(30)), "d/M")
    due = F.when(F.col("id") % 9 == 4, "this is urgent").when(F.col("id") % 9 > 4, dated)
    rows = rows.withColumn("text", F.concat_ws("\n", "subject", body, due))
    return signals.importance(rows, archive.participants(spark, sf_dir), effective, owner=archive.OWNER, vips=VIPS, now=archive.NOW, text="text")


@registry.add(f"{IMPORTANCE}".replace(" select id, score, case when", " select id, score, case when").rsplit("select id, score", 1)[0] + "select count(*) filter (where direction = 'in' and asks and not answered)::bigint as waiting, count(*)::bigint as n from p")
def c5_waiting_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c4_x25_importance(spark, sf_dir).agg(F.count_if("waiting").alias("waiting"), F.count("*").alias("n"))


@registry.add(
    f"{_M}, k as (select *, {SKELETON} as skeleton from message where medium = 'email'), r as (select *, lower(coalesce(from_address, '')) || '|' || skeleton as pattern_key from k),"
    " q as (select *, row_number() over (partition by pattern_key order by received_at nulls last, id) as rn, count(*) over (partition by pattern_key) as n from r)"
    " select pattern_key, count(*)::bigint as messages, count(distinct thread_id)::bigint as threads, string_agg(distinct account, ',' order by account) as accounts,"
    " string_agg(id::varchar, ',' order by rn) filter (where rn = 1 or rn = n or rn = (n + 1) // 2) as samples from q group by pattern_key, skeleton"
)
def c6_subject_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = signals.patterns(archive.messages(spark, sf_dir))
    return made.select("pattern_key", "messages", "threads", F.array_join("accounts", ",").alias("accounts"), F.array_join("samples", ",").alias("samples"))


_PROFILES = f"""{_MAP}, outp as (select o.account, p.address, count(distinct o.id) as n from message o join participant p on p.message_id = o.id where o.direction = 'out' group by 1, 2), outall as (select address, sum(n) as n from outp group by 1),
tout as (select distinct thread_id from message where direction = 'out' and thread_id is not null),
prof as (select m.account, m.from_address as address, count(*)::bigint as messages, count(distinct m.thread_id)::bigint as threads, count(distinct t.thread_id)::bigint as replied_threads, avg((coalesce(list_unsubscribe, '') <> '')::int)::double as unsubscribe_share,
 avg(is_automated::int)::double as automated_share, count(distinct {SKELETON})::bigint as templates, coalesce(max(op.n), 0)::bigint as written_to, coalesce(max(oa.n), 0)::bigint as written_to_all
 from message m left join tout t on t.thread_id = m.thread_id left join outp op on op.account = m.account and op.address = m.from_address left join outall oa on oa.address = m.from_address
 where m.direction = 'in' and m.from_address is not null group by 1, 2)"""


@registry.add(f"{_PROFILES} select * from prof")
def c7_sender_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.profiles(archive.messages(spark, sf_dir), archive.participants(spark, sf_dir))


@registry.add(
    f"{_PROFILES}, o as (select id, case when medium <> 'email' and is_automated then 'notification|teams_app' when medium = 'email' and coalesce(list_unsubscribe, '') <> '' and lower(coalesce(precedence, '')) in ('bulk', 'junk') and coalesce(written_to_all, 0) = 0 then 'marketing|bulk_mailer'"
    " when medium = 'email' and (starts_with(lower(coalesce(auto_submitted, '')), 'auto-replied') or trim(coalesce(return_path, '')) = '<>') then 'auto_reply|auto_reply' end as machine,"
    " case when medium <> 'email' and not is_automated then 'person|teams_user' when medium = 'email' and not is_automated and coalesce(list_unsubscribe, '') = '' and list_id is null and coalesce(written_to_all, 0) >= 2 and coalesce(replied_threads, 0) >= 1"
    " and greatest(coalesce(automated_share, 1), coalesce(unsubscribe_share, 1)) <= 0.1 then 'person|correspondent' end as person from message m left join prof p on p.account = m.account and p.address = m.from_address where direction = 'in')"
    " select id, machine, person, case when machine is not null and person is not null then null else coalesce(machine, person) end as value from o"
)
def c8_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir)
    return signals.origin(rows, signals.profiles(rows, archive.participants(spark, sf_dir)))


_TARGETS = [
    ("Lists", {"field": "list_id", "set": True}),
    ("Travel", {"field": "topic", "in": ["Travel"]}),
    ("Recent", {"all": [{"field": "age", "lt": 400}, {"field": "machine", "is": False}]}),
    ("Labelled", {"field": "labels", "prefix": ["L5"]}),
]
_ML = archive.ctes("message", "assignment", "location")


@registry.add(
    f"{_ML}{RANKED}, topic as (select message_id, value from eff where dimension = 'topic'), lab as (select message_id, list(distinct label) filter (where label is not null) as labels from location where present group by 1)"
    " select m.id, case when list_id is not null then 'Lists' when coalesce(t.value = 'Travel', false) then 'Travel' when coalesce(date_diff('day', received_at, timestamp '2001-08-02') < 400, false) and not is_automated then 'Recent'"
    " when len(list_filter(coalesce(labels, []), lambda x: starts_with(x, 'L5'))) > 0 then 'Labelled' else 'To sort' end as place from message m left join topic t on t.message_id = m.id left join lab l on l.message_id = m.id"
)
def c10_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir)
    features = placement.features(rows, archive.assignments(spark, sf_dir).where("dimension = 'topic'"), archive.locations(spark, sf_dir), ["topic"], archive.NOW)
    return placement.place(features.withColumn("machine", F.col("is_automated")), _TARGETS).select("id", "place")


@registry.add(
    f"{_ML}{RANKED}, topic as (select message_id, value from eff where dimension = 'topic') select account, case when list_id is not null then 'Lists' when coalesce(t.value = 'Travel', false) then 'Travel' when coalesce(date_diff('day', received_at, timestamp '2001-08-02') < 400, false) and not is_automated"
    " then 'Recent' else 'Rest' end as place, count(*)::bigint as n from message m left join topic t on t.message_id = m.id group by 1, 2"
)
def c11_placement_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir)
    features = placement.features(rows, archive.assignments(spark, sf_dir).where("dimension = 'topic'"), archive.locations(spark, sf_dir), ["topic"], archive.NOW)
    placed = placement.place(features.withColumn("machine", F.col("is_automated")), _TARGETS[:3], otherwise="Rest")
    return placed.groupBy("account", "place").agg(F.count("*").alias("n"))


@registry.add(
    f"{_M}, v as (select from_address, count(*) as n, count(distinct direction) as nv, min(direction) as v from message where from_address is not null and subject is not null group by 1) select from_address, v as value, n::bigint as n from v where nv = 1 and n >= 3"
)
def c31_rule_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders whose values agree without exception, often enough for a rule."""
    rows = archive.messages(spark, sf_dir).where("from_address is not null and subject is not null")
    return placement.unanimous(rows, "from_address", "direction", least=3)


@registry.add(
    f"{_M}, d as (select split_part(from_address, '@', 2) as domain, strftime(received_at, '%Y-%m') as month, count(*) as n from message where from_address is not null and received_at is not null group by 1, 2)"
    " select domain, count(*)::bigint as months, max(month) as last_month, sum(n)::bigint as n from d group by 1 having count(*) >= 3 and max(month) < '2001-08'"
)
def c34_a14_quiet_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.operators import search

    rows = archive.messages(spark, sf_dir).where("from_address is not null and received_at is not null")
    by = rows.groupBy(search.domain().alias("domain"), F.date_format("received_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    made = by.groupBy("domain").agg(F.count("*").alias("months"), F.max("month").alias("last_month"), F.sum("n").alias("n"))
    return made.where("months >= 3 and last_month < '2001-08'")


@registry.add(
    archive.ctes("message", "location") + ", l as (select message_id, bool_or(present) as held, bool_or(present and folder = 'INBOX') as inbox from location group by 1)"
    " select m.id, case when l.message_id is null or not held then 'skip:gone' when not inbox then 'skip:not_in_inbox' when has_attachments then 'skip:protected' else 'archive' end as op, case when held and inbox and not has_attachments then 'move_to_inbox' end as inverse from message m left join l on l.message_id = m.id"
)
def c40_changeset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.plan_archive(archive.messages(spark, sf_dir), archive.locations(spark, sf_dir))


@registry.add(
    archive.ctes("participant", "message") + " select p.address, count(*) filter (where m.direction = 'out')::bigint as sent, count(*) filter (where m.direction = 'in')::bigint as received from participant p join message m on m.id = p.message_id where p.address like 'p1%' group by 1 order by sent desc, received desc, address limit 20"
)
def c46_address_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = archive.participants(spark, sf_dir).where(F.startswith("address", F.lit("p1")))
    joined = people.join(archive.messages(spark, sf_dir).select(F.col("id").alias("message_id"), "direction"), "message_id")
    made = joined.groupBy("address").agg(F.count_if(F.col("direction") == "out").alias("sent"), F.count_if(F.col("direction") == "in").alias("received"))
    return made.orderBy(F.desc("sent"), F.desc("received"), "address").limit(20)
