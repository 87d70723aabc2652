"""Sender profiles and origin in full (C7, C8) over all incoming messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.functions import text as X
from archivolt.operators import origins as O
from archivolt.queries.texts import SKELETON
from archivolt.registry import Registry

registry = Registry()

# What the stated archive lacks, as expressions of both dialects over its messages.
_OVER = {
    "from_address": "case when id % 211 = 0 then 'quarantine@messaging.microsoft.com' when id % 223 = 0 then 'mailer-daemon@dom1.example.com' else from_address end",
    "from_name": "case when id % 43 = 0 then 'Anna Berg via Blocket' when id % 47 = 0 then 'NASA via X' else from_name end",
    "subject": "case when id % 62 = 0 then 'Undeliverable: hello' else subject end",
    "x_mailer": "case when id % 37 = 0 and id % 3 > 0 then 'MailChimp Mailer 1' end",
}
#: Whom the owner writes to besides.
_WRITTEN = "concat('user', cast(id % 1500 % 211 as varchar(10)), '@dom', cast(id % 1500 % 23 as varchar(10)), '.example.com')"
_KIND = "case when l_partkey % 2 = 0 then 'backup' else 'other' end"
_STATUS = "case when l_linestatus = 'O' then 'ok' else 'failed' end"
_TYPES = ["alert", "report", "receipt", "newsletter", "calendar_response", "notification", "chat"]

_SQL = (
    f"{archive.ctes('message', 'assignment', 'participant').replace('message as (', 'stated as (', 1)},"
    f" message as (select * replace ({', '.join(f'{e} as {c}' for c, e in _OVER.items() if c != 'x_mailer')}), {_OVER['x_mailer']} as x_mailer from stated),"
    " part as (select * from participant union all select id, 'sender', 'other@x.example', 0 from message where id % 59 = 0 union all select id, 'sender', from_address, 0 from message where id % 67 = 0"
    f" union all select id, 'to', {_WRITTEN}, 9 from message where direction = 'out' and id % 4 = 1),"
    f" event as (select l_orderkey as message_id, {_KIND} as kind, {_STATUS} as status from lineitem where l_suppkey % 9 = 0),"
    " r as (select *, list_filter([case when lower(coalesce(auto_submitted, '')) not in ('', 'no') then 'auto-submitted' end, case when lower(coalesce(precedence, '')) in ('bulk', 'list', 'junk') then 'precedence' end,"
    " case when list_id is not null or coalesce(list_unsubscribe, '') <> '' then 'list' end, case when regexp_matches(lower(split_part(from_address, '@', 1)), '^(no[-_.]?reply|do[-_.]?not[-_.]?reply|donotreply|notifications?|notify|alerts?|mailer-daemon|postmaster|bounces?|automated|robot)([+-].*)?$') then 'noreply-sender' end,"
    " case when trim(coalesce(return_path, '')) = '<>' then 'null-return-path' end], lambda x: x is not null) as reasons from message),"
    " outp as (select o.account, p.address, count(distinct o.id) as n, max(o.received_at) as last_at from message o join part p on p.message_id = o.id and p.role in ('to', 'cc', 'bcc') where o.direction = 'out' group by 1, 2),"
    " outall as (select address, sum(n) as n, max(last_at) as last_at from outp group by 1), tout as (select distinct thread_id from message where direction = 'out' and thread_id is not null),"
    " ev as (select message_id, bool_and(kind = 'backup' and status = 'ok') as report_only from event group by 1),"
    f" prof as (select m.account, m.from_address as address, count(*)::bigint as messages, count(distinct m.thread_id)::bigint as threads, count(distinct t.thread_id)::bigint as replied_threads, avg((coalesce(list_unsubscribe, '') <> '')::int)::double as unsubscribe_share,"
    f" avg(is_automated::int)::double as automated_share, count(distinct {SKELETON})::bigint as templates, coalesce(max(op.n), 0)::bigint as written_to, coalesce(max(oa.n), 0)::bigint as written_to_all, min(m.received_at) as first_at, max(m.received_at) as last_at, max(oa.last_at) as last_written_at, avg((ev.message_id is not null)::int)::double as event_share"
    " from message m left join tout t on t.thread_id = m.thread_id left join ev on ev.message_id = m.id left join outp op on op.account = m.account and op.address = m.from_address left join outall oa on oa.address = m.from_address where m.direction = 'in' and m.from_address is not null group by 1, 2),"
    f" pat as (select concat_ws('|', lower(coalesce(from_address, '')), {SKELETON}) as k, count(distinct thread_id) as n from message where medium = 'email' group by 1),"
    " ls as (select list_id, count(*) as senders, max(n) / sum(n) as top_share from (select list_id, from_address, count(*) as n from message where direction = 'in' and list_id is not null group by 1, 2) group by 1),"
    " sd as (select distinct p.message_id from part p join message m on m.id = p.message_id where p.role = 'sender' and p.address <> m.from_address),"
    f" ty as (select o_orderkey as message_id, {_TYPES}[o_custkey % 7 + 1] as value from orders where o_orderkey % 31 = 0),"
    f" f as (select m.*, ev.message_id is not null as event, coalesce(report_only, false) as report_only, ty.value as type, sd.message_id is not null as differs, tout.thread_id is not null as replied, coalesce(written_to_all, 0) as written, coalesce(replied_threads, 0) as rt,"
    f" greatest(coalesce(automated_share, 1), coalesce(unsubscribe_share, 1), coalesce(event_share, 1)) as shares, coalesce(pat.n, 0) as tt, coalesce(ls.senders, 0) as senders, coalesce(ls.top_share, 1) as top_share, coalesce(list_unsubscribe, '') <> '' as lu, lower(coalesce(precedence, '')) in ('bulk', 'junk') as bulk, coalesce(x_mailer, '') like 'MailChimp%' as mailer,"
    " starts_with(lower(coalesce(auto_submitted, '')), 'auto-replied') or list_contains(reasons, 'null-return-path') or starts_with(coalesce(from_address, ''), 'mailer-daemon@') as auto"
    f" from r m left join ev on ev.message_id = m.id left join ty on ty.message_id = m.id left join sd on sd.message_id = m.id left join tout on tout.thread_id = m.thread_id left join prof on prof.account = m.account and prof.address = m.from_address"
    f" left join pat on m.medium = 'email' and pat.k = concat_ws('|', lower(coalesce(m.from_address, '')), {SKELETON}) left join ls on ls.list_id = m.list_id where m.direction = 'in'"
    " and m.id not in (select entity_id from assignment where dimension = 'origin' and status = 'active' and source_kind = 'rule')),"
    " s as (select id, case when medium = 'email' and coalesce(from_address, '') = 'quarantine@messaging.microsoft.com' then 'mail_system|quarantine@1' when event and report_only then 'system_report|event@2' when event then 'alert|event@2'"
    " when type = 'alert' then 'alert|type@2' when type = 'report' then 'system_report|type@2' when type = 'receipt' then 'transactional|type@2' when type = 'newsletter' then 'marketing|type@2' when type = 'calendar_response' then 'auto_reply|type@2' when type = 'notification' then 'notification|type@2'"
    " when medium <> 'email' and is_automated then 'notification|teams_app@1' when medium = 'email' and lu and (bulk or mailer) and written = 0 and not regexp_matches(lower(coalesce(subject, '')), '\\b(invoice|order|ticket)') then 'marketing|bulk_mailer@1'"
    " when medium = 'email' and list_id is not null and senders >= 3 and top_share <= 0.5 and not list_contains(reasons, 'noreply-sender') and not bulk and not mailer then 'list|mailing_list@1'"
    " when medium = 'email' and auto and (starts_with(coalesce(from_address, ''), 'mailer-daemon@') or starts_with(coalesce(subject, ''), 'Undeliverable')) then 'mail_system|bounce@2' when medium = 'email' and auto then 'auto_reply|auto_reply@1' end as machine,"
    " case when medium <> 'email' and not is_automated then 'person|teams_user@1' when medium = 'email' and not lu and coalesce(from_name, '') = 'Anna Berg via Blocket' then 'person_via_system|via_name@1'"
    " when medium = 'email' and len(reasons) = 0 and not lu and list_id is null then case when differs and written > 0 then 'person_via_system|sender_header@1' when written > 0 and replied then 'person|thread_reply@1' when written >= 2 and rt >= 1 and shares <= 0.1 and tt < 3 then 'person|correspondent@1' end end as person from f)"
)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    stated = archive.messages(spark, sf_dir)
    rows = stated.withColumns({c: F.expr(e) for c, e in _OVER.items()})
    names = ("auto_submitted", "precedence", "list_id", "list_unsubscribe", "from_address", "return_path")
    rows = rows.withColumn("reasons", X.automated_reasons(*[F.col(n) for n in names]))
    people = archive.participants(spark, sf_dir)
    sender = lambda where, address: rows.where(where).select(F.col("id").alias("message_id"), F.lit("sender").alias("role"), address.alias("address"), F.lit(0).alias("ordinal"))
    people = people.unionByName(sender("id % 59 = 0", F.lit("other@x.example"))).unionByName(sender("id % 67 = 0", F.col("from_address")))
    written = rows.where("direction = 'out' and id % 4 = 1").select(F.col("id").alias("message_id"), F.lit("to").alias("role"), F.expr(_WRITTEN).alias("address"), F.lit(9).alias("ordinal"))
    people = people.unionByName(written)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_suppkey % 9 = 0")
    return rows, people, lines.select(F.col("l_orderkey").alias("message_id"), F.expr(_KIND).alias("kind"), F.expr(_STATUS).alias("status"))


@registry.add(f"{_SQL} select * from prof")
def c7_profiles_in_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.profiles(*_inputs(spark, sf_dir))


@registry.add(f"{_SQL} select id, machine, person, case when machine is null or person is null then split_part(coalesce(machine, person), '|', 1) end as value, case when machine is null or person is null then split_part(coalesce(machine, person), '|', 2) end as signal, case when machine is not null and person is not null then 'conflict' when machine is null and person is null then 'undecided' else 'decided' end as verdict from s")
def c8_origin_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen signals; a rule's origin wins, so its messages are left out."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 31 = 0")
    types = orders.select(F.col("o_orderkey").alias("message_id"), F.get(F.array(*[F.lit(t) for t in _TYPES]), (F.col("o_custkey") % 7).cast("int")).alias("value"))
    ruled = archive.assignments(spark, sf_dir).where("dimension = 'origin' and status = 'active' and source_kind = 'rule'").select(F.col("entity_id").alias("id"))
    return O.origin(*_inputs(spark, sf_dir), types, ruled)


@registry.add(f"{_SQL} select coalesce(case when machine is null or person is null then coalesce(machine, person) end, case when machine is not null and person is not null then 'conflict' else 'undecided' end) as pick, count(*)::bigint as n from s group by 1")
def c8_by_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages each signal decides."""
    found = c8_origin_signals(spark, sf_dir)
    pick = F.when(F.col("verdict") == "decided", F.concat_ws("|", "value", "signal")).otherwise(F.col("verdict"))
    return found.groupBy(pick.alias("pick")).agg(F.count("*").alias("n"))
