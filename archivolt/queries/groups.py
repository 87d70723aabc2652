"""Focused selections, trees of suggestions, neighbours, resolution and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import groups as G
from archivolt.registry import Registry

registry = Registry()
_M = archive.ctes("message")


@registry.add("select event_id from events where user_id in (select user_id from events where value < 0.05)")
def c24_focused_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.focus(spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("value") < 0.05, "user_id").select("event_id")


@registry.add(f"{_M} select account, concat_ws(',', case when coalesce(subject, '') = '' then 'subject' end, case when from_name is null then 'from_name' end, case when list_id is null then 'list_id' end) as missing, count(*)::bigint as n from message group by 1, 2")
def c33_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.missing_fields(archive.messages(spark, sf_dir), "account", ["subject", "from_name", "list_id"])


@registry.add(f"{_M} select account, medium, direction, count(*)::bigint as n from message group by rollup (account, medium, direction) having account is not null")
def c32_suggestion_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.suggestion_tree(archive.messages(spark, sf_dir), ["account", "medium", "direction"])


@registry.add("with m as (select distinct l_suppkey as id from lineitem where l_suppkey < 20), l as (select distinct l_suppkey as id, l_partkey as other from lineitem) select other, count(distinct l.id)::bigint as n from l join m on m.id = l.id where other not in (select id from m) group by 1 having count(distinct l.id) >= 4")
def c35_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    links = rows.select(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("other")).distinct()
    return G.common_links(links.where("id < 20").select("id").distinct(), links, least=4)


@registry.add(archive.ctes("assignment") + " select dimension, value, count(*) filter (where status = 'active')::bigint as active, count(*) filter (where status = 'proposed')::bigint as proposed, count(distinct entity_id)::bigint as entities from assignment group by 1, 2")
def c47_dimension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = archive.assignments(spark, sf_dir).groupBy("dimension", "value")
    return by.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "proposed").alias("proposed"), F.count_distinct("entity_id").alias("entities"))


@registry.add(
    "with c as (select o_orderkey as id, case when o_orderkey % 9 = 0 and o_orderkey > 0 then o_orderkey - 4 end as undo_of from orders), u as (select undo_of as id, min(id) as by from c where undo_of is not null group by 1)"
    " select c.id, case when u.by > c.id then 'undone' when c.undo_of is not null then 'undo' else 'done' end as state from c left join u on u.id = c.id"
)
def c53_undo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return G.undo_state(rows.withColumn("undo_of", F.when((F.col("id") % 9 == 0) & (F.col("id") > 0), F.col("id") - 4)))


@registry.add(
    f"{_M}, a as (select from_address as k, min(id) as e from message where id % 3 = 0 and from_address is not null group by 1), n as (select from_name as k, min(id) as e from message where from_name is not null and id % 5 = 0 group by 1)"
    " select m.id, coalesce(a.e, n.e, -1) as entity from message m left join a on a.k = m.from_address left join n on n.k = m.from_name"
)
def c54_entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By address, else by name."""
    rows = archive.messages(spark, sf_dir)
    by_address = rows.where("id % 3 = 0 and from_address is not null").select(F.col("from_address").alias("key"), F.col("id").alias("entity"))
    by_name = rows.where("from_name is not null and id % 5 = 0").select(F.col("from_name").alias("key"), F.col("id").alias("entity"))
    found = G.resolve(rows, [("from_address", by_address), ("from_name", by_name)])
    return found.select("id", F.coalesce("entity", F.lit(-1)).alias("entity"))


_MP = archive.ctes("message", "participant")


@registry.add(
    f"{_MP} select message_id, address from participant where lower(split_part(address, '@', 2)) not in (select lower(split_part(from_address, '@', 2)) from message where from_address is not null and account = 'acc1' and direction = 'self')"
)
def c55_never_seen_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = archive.messages(spark, sf_dir).where("from_address is not null and account = 'acc1' and direction = 'self'").select(F.col("from_address").alias("address"))
    return G.new_domains(archive.participants(spark, sf_dir), known).select("message_id", "address")
