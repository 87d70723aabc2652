"""Clusters of machine mail with their state and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import clusters as C
from archivolt.operators import structure as S
from archivolt.queries import structure as Q
from archivolt.registry import Registry

registry = Registry()
NOW, LEAST = "1998-06-01 00:00:00", 4

_TOP = "(select string_agg(concat(v, ' ', n), ', ' order by rn) from (select v, n, row_number() over (order by n desc, v) as rn from (select {value} as v, count(*) as n from g x{more} where x.account = b.account and x.sender = b.sender and x.system is not distinct from b.system{where} group by 1)) where rn <= {top})"
_SQL = (
    f"{Q._PLACED}, m as (select p.id, p.account, lower(from_address) as sender, from_name as name, subject, p.received_at, topic as kind, precedence as type, p.target, loc.olds as held, loc.in_inbox as inbox, p.id % 8 as o"
    " from p join message on message.id = p.id left join loc on loc.message_id = p.id where medium = 'email' and direction = 'in' and from_address is not null and (message.is_automated or from_address like 'noreply%')),"
    " k as (select *, case o when 0 then 'Invoice' when 1 then '[Success]' when 2 then '… Down!' when 3 then 'Weekly' when 5 then 'Order' when 6 then '[Ticket #]Active' else '(no subject)' end as key, o in (1, 2, 6) as told from m),"
    " sh as (select account, sender, count(distinct key) filter (where told) >= 2 and count(*) filter (where told) >= 0.2 * count(*) as shared from k group by 1, 2),"
    " g as (select k.*, case when shared then key end as system from k join sh using (account, sender)),"
    " b as (select account, sender, system, count(*) as n, min(received_at) as first, max(received_at) as last, count(*) filter (where received_at >= timestamp '1998-06-01' - interval 90 day) as recent,"
    f" count(*) filter (where received_at >= timestamp '1998-06-01' - interval 365 day) as last_year, count(*) filter (where coalesce(inbox, false)) as in_inbox from g group by 1, 2, 3 having count(*) >= {LEAST}),"
    " st as (select *, case when last is null or last < timestamp '1998-06-01' - interval 365 day then 'dead' when last_year < 12 then 'quiet' else 'active' end as status from b),"
    " su as (select account, sender, system, regexp_replace(coalesce(subject, ''), '^(Re: SV: |Fw: )', '') as s, max_by(coalesce(subject, ''), [epoch_ms(coalesce(received_at, timestamp '1998-06-01'))::bigint, id]) as subject, max([epoch_ms(coalesce(received_at, timestamp '1998-06-01'))::bigint, id]) as seen from g group by 1, 2, 3, 4),"
    " ex as (select account, sender, system, string_agg(subject, ' / ' order by seen desc) as examples from (select *, row_number() over (partition by account, sender, system order by seen desc) as rn from su) where rn <= 2 group by 1, 2, 3)"
)


def _machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = Q._placed(spark, sf_dir)
    held = S.with_locations(archive.messages(spark, sf_dir).select("id"), archive.locations(spark, sf_dir).where("present")).where(F.size("olds") > 0)
    rows = placed.where("medium = 'email' and direction = 'in' and from_address is not null and (is_automated or from_address like 'noreply%')").drop("olds", "in_inbox").join(held, "id", "left")
    return rows.select("id", "account", F.lower("from_address").alias("sender"), F.col("from_name").alias("name"), "subject", "received_at", F.col("topic").alias("kind"), F.col("precedence").alias("type"), "target", "olds", "in_inbox")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clusters(_machine(spark, sf_dir), now=NOW, least=LEAST)


@registry.add(
    f"{_SQL} select b.account, b.sender, b.system, {_TOP.replace("concat(v, ' ', n)", 'v').format(value='name', more='', where=' and x.name is not null', top=1)} as name, n::bigint as n, first, last, recent::bigint as recent, last_year::bigint as last_year, status, in_inbox::bigint as in_inbox,"
    f" {_TOP.format(value='coalesce(kind, ' + chr(39) + '(none)' + chr(39) + ')', more='', where='', top=4)} as kinds, {_TOP.format(value='coalesce(type, ' + chr(39) + '(none)' + chr(39) + ')', more='', where='', top=3)} as types,"
    f" {_TOP.format(value='u.o', more=', unnest(coalesce(x.held, [' + chr(39) + C.GONE + chr(39) + '])) as u(o)', where='', top=3)} as places, {_TOP.format(value='target', more='', where='', top=3)} as plan, examples"
    " from st b left join ex on ex.account = b.account and ex.sender = b.sender and ex.system is not distinct from b.system"
)
def c16_machine_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its state, names, kinds, places, targets and newest subjects."""
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["value"], x["n"].cast("string"))), ", ")
    found = _found(spark, sf_dir)
    name = F.when(F.col("name").isNotNull(), F.col("name"))
    made = found.withColumns({c: said(c) for c in ("kinds", "types", "places", "plan")})
    return made.withColumn("name", name).withColumn("examples", F.array_join("examples", " / "))


@registry.add(
    f"{_SQL}, d as (select account, count(*) filter (where status = 'dead')::bigint as dead_clusters, coalesce(sum(n) filter (where status = 'dead'), 0)::bigint as dead_messages, coalesce(sum(in_inbox) filter (where status = 'dead'), 0)::bigint as dead_in_inbox from st group by 1),"
    " i as (select account, count(*) filter (where in_inbox)::bigint as inbox_now from p group by 1) select account, dead_clusters, dead_messages, dead_in_inbox, inbox_now, inbox_now - dead_in_inbox as inbox_after from d join i using (account)"
)
def c16_dead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cleaning the dead clusters would take from each account's inbox."""
    return C.summary(_found(spark, sf_dir), Q._placed(spark, sf_dir).select("account", "in_inbox"))
