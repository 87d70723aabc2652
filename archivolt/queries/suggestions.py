"""Drafted rules, their tree and their group rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import suggestions as S
from archivolt.operators import values
from archivolt.queries.conditions import RANKED
from archivolt.queries.texts import SKELETON
from archivolt.registry import Registry

registry = Registry()
DIMENSIONS, LEAST = ["topic", "origin", "sender_kind"], 2
_FAMILY = "case when dimension = 'topic' then case when value < '4' then 'Urgent' when value < 'A' then 'Later' else 'Other' end else value end"
_SQL = (
    f"{archive.ctes('message', 'assignment')}{RANKED}, mail as (select id, from_address as sender, {SKELETON} as skeleton from message where medium = 'email' and direction = 'in' and coalesce(from_address, '') <> ''),"
    f" often as (select sender from mail group by 1 having count(*) >= {LEAST}),"
    " acc as (select m.id, m.sender, m.skeleton, e.dimension, e.value from mail m semi join often using (sender) join eff e on e.message_id = m.id where e.source_kind in ('human', 'model') and e.dimension in ('topic', 'origin', 'sender_kind')),"
    " s as (select dimension, sender, count(*) as n, count(distinct value) as nv, min(value) as value from acc group by 1, 2),"
    " p as (select a.dimension, a.sender, a.skeleton, count(*) as n, count(distinct a.value) as nv, min(a.value) as value from acc a join s on s.dimension = a.dimension and s.sender = a.sender and s.nv > 1 group by 1, 2, 3),"
    f" sug as (select dimension, value, sender, null::varchar as skeleton, n::bigint as n from s where nv = 1 and n >= {LEAST} union all select dimension, value, sender, skeleton, n from p where nv = 1 and n >= {LEAST})"
)


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    messages = archive.messages(spark, sf_dir)
    given = archive.assignments(spark, sf_dir).where(F.col("dimension").isin(DIMENSIONS))
    effective = values.effective_message_values(messages.select("id", "thread_id"), given)
    return messages, S.accepted(messages, effective, DIMENSIONS, least=LEAST)


@registry.add(f"{_SQL} select * from sug")
def c31_drafted_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Senders, and templates of senders in conflict, whose accepted values agree."""
    return S.suggestions(_rows(spark, sf_dir)[1], least=LEAST)


@registry.add(f"{_SQL} select dimension, category, value, count(*)::bigint as suggestions, sum(n)::bigint as covered from (select *, {_FAMILY} as category from sug) group by rollup (dimension, category, value) having dimension is not null")
def c32_drafted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions and coverage by field, category and value."""
    return S.tree(S.suggestions(_rows(spark, sf_dir)[1], least=LEAST), F.expr(_FAMILY))


@registry.add(
    f"{_SQL}, met as (select g.dimension, g.value, m.id from mail m join sug g on g.sender = m.sender and (g.skeleton is null or g.skeleton = m.skeleton)),"
    " v as (select met.dimension, met.value, count(distinct met.id)::bigint as matched, count(*) filter (where acc.value <> met.value)::bigint as conflicting from met left join acc on acc.id = met.id and acc.dimension = met.dimension group by 1, 2),"
    " r as (select dimension, value, count(*)::bigint as members, count(*) filter (where skeleton is null)::bigint as senders, count(*) filter (where skeleton is not null)::bigint as pairs from sug group by 1, 2)"
    " select r.*, matched, conflicting from r join v using (dimension, value)"
)
def c32_group_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule for each value: its members, what it matches, and what carries another value."""
    messages, rows = _rows(spark, sf_dir)
    found = S.suggestions(rows, least=LEAST)
    rules = S.group_rules(found).withColumn("senders", F.size("senders").cast("long")).withColumn("pairs", F.size("pairs").cast("long"))
    return rules.join(S.preview(found, messages, rows), ["dimension", "value"])
