"""Effective values, facets, pages (W, L, C1, C3, C12–C15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import search, values
from archivolt.queries.conditions import RANKED
from archivolt.registry import Registry

registry = Registry()
_MA = archive.ctes("message", "assignment")
_M = archive.ctes("message")


@registry.add(f"{_MA}{RANKED} select message_id, dimension, value, source_kind, id as assignment_id, case when own then 'message' else 'thread' end as via from eff")
def w1_effective_message_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.effective_message_values(archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir)).drop("confidence")


@registry.add(
    f"{_MA}{RANKED}, best as (select message_id, first(value order by tier desc, (dimension = 'sender_kind') desc, own desc, created_at desc, id desc) as v from ranked where dimension in ('sender_kind', 'origin') group by 1)"
    " select m.id, case when b.v is null then m.is_automated else b.v in ('auto_reply', 'transactional', 'notification', 'alert', 'marketing', 'machine') end as machine from message m left join best b on b.message_id = m.id"
)
def w2_f30_machine_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.machine_made(archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir)).select("id", "machine")


@registry.add(
    archive.ctes("assignment") + " select entity_id, dimension, value, id as assignment_id from (select *, row_number() over (partition by entity_id, dimension, case when dimension = 'tag' then value end"
    " order by case source_kind when 'human' then 4 when 'rule' then 3 when 'model' then 2 else 1 end desc, created_at desc nulls last, id desc) as rn from assignment where status = 'active') where rn = 1"
)
def w3_effective_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.effective_values(archive.assignments(spark, sf_dir)).select("entity_id", "dimension", "value", "assignment_id")


@registry.add(f"{_M} select account, id from (select distinct on (account) account, id from message order by account, received_at desc nulls last, id)")
def w4_first_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("account").orderBy(F.desc_nulls_last("received_at"), "id")
    return archive.messages(spark, sf_dir).withColumn("rn", F.row_number().over(order)).where("rn = 1").select("account", "id")


RULES = [
    {"id": 1, "version": 2, "priority": 10, "dimension": "topic", "value": "Invoices", "conditions": [{"field": "subject", "op": "contains", "value": "invoice"}]},
    {"id": 2, "version": 1, "priority": 10, "dimension": "topic", "value": "Large", "conditions": [{"field": "size", "op": "gt", "value": 250000}]},
    {"id": 3, "version": 1, "priority": 5, "dimension": "topic", "value": "Lists", "conditions": [{"field": "list_id", "op": "is_set"}]},
    {"id": 4, "version": 1, "priority": 1, "dimension": "tag", "value": "auto", "conditions": [{"field": "is_automated", "op": "is_true"}]},
    {"id": 5, "version": 3, "priority": 2, "dimension": "tag", "value": "big", "conditions": [{"field": "size", "op": "gt", "value": 400000}]},
    {"id": 6, "version": 1, "priority": 3, "dimension": "tag", "value": "auto", "conditions": [{"field": "from_address", "op": "starts_with", "value": "noreply"}]},
]


@registry.add(
    f"{_M}, hits as (select id as message_id, 'topic' as dimension, 'Lists' as value, 'rule:3@1' as source_ref, 1 as o from message where coalesce(list_id, '') <> ''"
    " union all select id, 'topic', 'Invoices', 'rule:1@2', 2 from message where contains(lower(coalesce(subject, '')), 'invoice') union all select id, 'topic', 'Large', 'rule:2@1', 3 from message where size > 250000"
    " union all select id, 'tag', 'auto', 'rule:4@1', 1 from message where is_automated union all select id, 'tag', 'big', 'rule:5@3', 2 from message where size > 400000"
    " union all select id, 'tag', 'auto', 'rule:6@1', 3 from message where starts_with(lower(from_address), 'noreply'))"
    " select distinct on (message_id, dimension, case when dimension = 'tag' then value end) message_id, dimension, value, source_ref from hits order by message_id, dimension, case when dimension = 'tag' then value end, o"
)
def c1_apply_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.apply_rules(archive.messages(spark, sf_dir), RULES)


@registry.add(f"{_M}, hits as (select id, received_at from message where size > 250000) select id, (select count(*) from hits)::bigint as total from hits order by received_at desc nulls last, id desc limit 25")
def c2_w7_rule_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.plans.conditions import rule_column

    hits = archive.messages(spark, sf_dir).where(rule_column(RULES[1]["conditions"])).select("id", "received_at")
    return search.page(hits, limit=25).select("id").crossJoin(hits.agg(F.count("*").alias("total")))


@registry.add(
    archive.ctes("assignment") + ", h as (select *, row_number() over (partition by entity_id, dimension order by created_at desc, id desc) as rn from assignment where source_kind = 'human' and dimension = 'topic')"
    " select id, case when rn = 1 then 'active' else 'superseded' end as status from h"
)
def c3_supersede_human_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.operators.merge import supersede

    rows = archive.assignments(spark, sf_dir).where("source_kind = 'human' and dimension = 'topic'")
    return supersede(rows, ["entity_id", "dimension"], [F.desc("created_at"), F.desc("id")]).select("id", "status")


@registry.add(f"{_M} select id from message order by received_at desc nulls last, id desc limit 40 offset 20")
def l1_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(archive.messages(spark, sf_dir), limit=40, offset=20).select("id")


@registry.add(f"{_M} select id from message order by size div_by desc, received_at desc nulls last, id desc limit 30".replace("size div_by", "(size // 100000)"))
def l2_page_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.page(archive.messages(spark, sf_dir), rank=F.expr("size div 100000"), limit=30).select("id")


@registry.add(
    f"{_M}, k as (select *, coalesce(received_at, timestamp '0001-01-01') as t from message) select id from k where t < timestamp '1998-03-01' or t = timestamp '1998-03-01' and id < 5000 order by t desc, id desc limit 50"
)
def l3_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.after(archive.messages(spark, sf_dir), F.lit("1998-03-01 00:00:00"), F.lit(5000).cast("long")).select("id")


@registry.add(f"{_M} select lower(from_address) as value, count(*)::bigint as n from message where direction in ('in', 'self') and from_address is not null group by 1 order by n desc, value limit 12")
def c14_l5_top_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet(search.select_messages(archive.messages(spark, sf_dir), {"direction": "in"}), F.lower("from_address"))


@registry.add(f"{_M} select split_part(from_address, '@', 2) as value, count(*)::bigint as n from message where from_address is not null group by 1 order by n desc, value limit 12")
def c14_top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facet(archive.messages(spark, sf_dir), search.domain())


@registry.add(f"{_MA}{RANKED} select value, count(*)::bigint as n from eff where dimension = 'topic' group by 1")
def c14_facet_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.value_facet(archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir), "topic")


@registry.add(
    f"{_M}, p as (select thread_id, from_address, row_number() over (partition by thread_id order by min(case when received_at is null then 1 else 0 end), min(received_at), min(id)) as r from message"
    " where thread_id is not null and from_address is not null group by 1, 2)"
    " select m.thread_id, count(*)::bigint as matched, strftime(max(received_at), '%Y-%m-%d') as latest, bool_or(direction <> 'in') as mine,"
    " (select count(*) from p where p.thread_id = m.thread_id and r <= 6)::bigint as n_people from message m where m.thread_id is not null group by m.thread_id"
)
def c12_w9_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.threads(archive.messages(spark, sf_dir))
    return rows.select("thread_id", "matched", F.date_format("latest", "yyyy-MM-dd").alias("latest"), "mine", F.coalesce(F.size("people"), F.lit(0)).cast("long").alias("n_people"))


@registry.add(f"{_M} select strftime(received_at, '%Y-%m') as month, medium, count(*)::bigint as n, sum(size)::double as bytes, count(distinct thread_id)::bigint as threads from message where received_at is not null group by 1, 2")
def c15_a16_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir).where("received_at is not null")
    by = rows.groupBy(F.date_format("received_at", "yyyy-MM").alias("month"), "medium")
    return by.agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("bytes"), F.count_distinct("thread_id").alias("threads"))


@registry.add(
    f"{_MA}{RANKED} select message_id, case when source_kind = 'human' then 'fact' when c >= 0.95 - 1e-9 then 'certain' when c >= 0.85 - 1e-9 then 'confident' when c >= 0.7 - 1e-9 then 'likely' when c >= 0.5 - 1e-9 then 'maybe'"
    " when c >= 0.3 - 1e-9 then 'doubtful' else 'guess' end as level from (select *, case source_kind when 'human' then 1.0 when 'rule' then 0.97 when 'import' then 0.75 else coalesce(confidence, 0.75) end as c from eff where dimension = 'topic')"
)
def x21_sureness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values.effective_message_values(archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir).where("dimension = 'topic'"))
    return rows.select("message_id", values.level(F.col("source_kind"), F.col("confidence")).alias("level"))


@registry.add(
    f"{_MA}{RANKED} select message_id, max(value) filter (where dimension = 'topic') as topic, max(value) filter (where dimension = 'origin') as origin, max(value) filter (where dimension = 'sender_kind') as sender_kind"
    " from eff where dimension <> 'tag' group by 1"
)
def a8_pivoted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = archive.assignments(spark, sf_dir).where("dimension <> 'tag'")
    return values.pivot_values(values.effective_message_values(archive.messages(spark, sf_dir), given), ["topic", "origin", "sender_kind"])
