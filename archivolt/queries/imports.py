"""Imports and their checks, reparses, states."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import export, imports, merge
from archivolt.registry import Registry
from archivolt.session import shared_dir

registry = Registry()
_MA = archive.ctes("message", "assignment")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


@registry.add(
    "with c as (select p_partkey as id, p_brand as conditions, p_type as action, p_name as name, 1 + p_size % 3 as version from part where p_partkey % 10 < 9),"
    " i as (select p_partkey as id, case when p_partkey % 5 = 0 then 'changed' else p_brand end as conditions, p_type as action, case when p_partkey % 7 = 0 then null else p_name end as name from part where p_partkey % 10 > 0)"
    " select id, case when i.id is null then 'absent' when c.id is null then 'created' when c.conditions is distinct from i.conditions then 'new version' when c.name is distinct from i.name then 'updated' else 'unchanged' end as state,"
    " (case when c.id is null then 1 when i.id is null then version when c.conditions is distinct from i.conditions then version + 1 else version end)::bigint as version from c full join i using (id)"
)
def s20_rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    base = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("conditions"), F.col("p_type").alias("action"), F.col("p_name").alias("name"), (1 + F.col("p_size") % 3).alias("version"))
    file = base.where("id % 10 > 0").withColumn("conditions", F.when(F.col("id") % 5 == 0, "changed").otherwise(F.col("conditions"))).withColumn("name", F.when(F.col("id") % 7 != 0, F.col("name")))
    return imports.rule_changes(base.where("id % 10 < 9"), file.drop("version"))


@registry.add(f"{_MA} select dimension, value, count(*)::bigint as uses from assignment where status = 'active' and dimension in ('topic', 'origin') and value <> 'Travel' and value not like '1-%' and value <> 'person' group by 1, 2")
def s21_taxonomy_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = archive.assignments(spark, sf_dir)
    now = given.where("dimension in ('topic', 'origin')").select("dimension", "value").distinct()
    return imports.values_in_use(now, now.where("value = 'Travel' or value like '1-%' or value = 'person'"), given)


@registry.add(
    "with l as (select o_custkey as item, o_orderstatus as topic, case when o_orderkey % 9 = 0 then '' else o_orderpriority end as origin, o_orderkey % 5 = 0 as lacks, o_orderkey % 18 = 0 as unsure, o_orderkey % 31 = 0 as more from orders),"
    " p as (select item, null as field, 'unknown item' as problem from l where item % 11 = 0 union all select item, null, 'answered twice' from l group by 1 having count(*) > 1 union all select item, 'topic', 'missing' from l where lacks"
    " union all select item, 'colour', 'unknown field' from l where more union all select item, 'origin', 'no value' from l where origin = '' and not unsure union all select item, 'topic', 'not allowed' from l where not lacks and topic = 'P'"
    " union all select item, 'origin', 'not allowed' from l where origin like '5%') select distinct * from p"
)
def s22_label_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems of an import; any row refuses the whole file."""
    rows = _orders(spark, sf_dir)
    label = lambda name, value: F.create_map(F.lit(name), value)
    none = F.create_map().cast("map<string,string>")
    labels = F.map_concat(
        label("origin", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderpriority"))),
        F.when(F.col("o_orderkey") % 5 == 0, none).otherwise(label("topic", F.col("o_orderstatus"))),
        F.when(F.col("o_orderkey") % 31 == 0, label("colour", F.lit("red"))).otherwise(none),
    )
    unsure = F.when(F.col("o_orderkey") % 18 == 0, F.array(F.lit("origin"))).otherwise(F.array().cast("array<string>"))
    items = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("item"))
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    allowed = spark.createDataFrame([("topic", v) for v in "FO"] + [("origin", v) for v in priorities], "field string, value string")
    return imports.label_problems(rows.select(F.col("o_custkey").alias("item"), labels.alias("labels"), unsure.alias("unsure")), items, allowed, ["topic", "origin"])


_DECIDED = "with d as (select o_custkey as case_id, case when o_orderkey % 4 > 0 then o_orderstatus end as value, case when o_orderkey % 8 = 0 then 'spam' when o_orderkey % 8 = 4 and o_orderkey % 3 = 0 then 'odd' end as hold from orders where o_orderkey % 6 < 4)"


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    hold = F.when(key % 8 == 0, "spam").when((key % 8 == 4) & (key % 3 == 0), "odd")
    return _orders(spark, sf_dir).where("o_orderkey % 6 < 4").select(F.col("o_custkey").alias("case_id"), F.when(key % 4 > 0, F.col("o_orderstatus")).alias("value"), hold.alias("hold"))


@registry.add(
    f"{_DECIDED} select distinct case_id, problem from (select case_id, case when case_id % 10 = 0 then 'not in the run' when hold = 'odd' then 'unknown hold' when hold is null and value is null then 'neither value nor hold' when hold is null and value = 'P' then 'not allowed' end as problem from d"
    " union all select case_id, 'answered twice' from d group by 1 having count(*) > 1) where problem is not null"
)
def s23_decision_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("case_id"))
    return imports.decision_problems(_decisions(spark, sf_dir), expected, ["F", "O"], ["spam"])


@registry.add(
    f"{_DECIDED}, k as (select * from d where value in ('F', 'O') or hold = 'spam') select c_custkey as case_id, case when hold is not null then 'tag' when value is not null then 'topic' end as dimension, case when hold is not null then 'hold:spam' else value end as value, case when k.case_id is null then 'unanswered' else 'proposed' end as status from customer left join k on k.case_id = c_custkey"
)
def s23_decision_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _decisions(spark, sf_dir).where("value in ('F', 'O') or hold = 'spam'")
    expected = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("case_id"))
    return imports.decision_proposals(good, expected, "topic")


@registry.add("select o_orderkey as id from orders where o_orderkey % 4 < 3 and o_orderkey > 100 order by 1 limit 200")
def s16_stale_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("parser_version"))
    return imports.stale(rows, 3, after=100).select("id")


@registry.add(
    "with c as (select o_orderkey as id, o_orderstatus as name, case when o_orderkey % 3 = 0 then 'yes' end as decision from orders where o_orderkey % 5 < 4), i as (select o_orderkey as id, o_orderpriority as name, case when o_orderkey % 2 = 0 then 'no' end as decision from orders where o_orderkey % 5 > 0)"
    " select id, coalesce(i.name, c.name) as name, coalesce(c.decision, i.decision) as decision, i.id is null as vanished from c full join i using (id)"
)
def s19_m8_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir).withColumnRenamed("o_orderkey", "id")
    now = rows.where("id % 5 < 4").select("id", F.col("o_orderstatus").alias("name"), F.when(F.col("id") % 3 == 0, "yes").alias("decision"))
    file = rows.where("id % 5 > 0").select("id", F.col("o_orderpriority").alias("name"), F.when(F.col("id") % 2 == 0, "no").alias("decision"))
    return merge.keep_decisions(now, file, ["id"])


@registry.add(
    "select o_orderkey as uid, case when o_orderkey % 5 = 4 then 'created' when o_orderkey % 5 = 0 then 'missing' when o_orderkey % 2 = 0 then 'unchanged' when o_orderkey % 3 = 0 then 'kept_edit' else 'updated' end as outcome from orders"
)
def m7_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as last imported, some edited since, against a file of which some changed."""
    rows = _orders(spark, sf_dir).select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("status"))
    printed = F.sha2(F.to_json(F.struct("status")), 256)
    now = rows.where("uid % 5 < 4").select("uid", "status", F.lit("a").alias("file_hash"), F.when(F.col("uid") % 3 == 0, "other").otherwise(printed).alias("fingerprint"))
    file = rows.where("uid % 5 > 0").select("uid", F.when(F.col("uid") % 2 == 0, "a").otherwise("b").alias("file_hash"))
    return merge.three_way(now, file, "uid", ["status"])


@registry.add(
    f"{_MA}, a as (select id, status, case id % 4 when 0 then 'accept' when 1 then 'reject' when 2 then 'replace' end as verdict, id % 7 = 0 as human from assignment)"
    " select id, case when status = 'proposed' and human then 'superseded' when status = 'proposed' and verdict = 'accept' then 'active' when status in ('proposed', 'active') and verdict = 'reject' then 'rejected' when status = 'active' and verdict = 'replace' then 'superseded' else status end as status from a"
)
def m5_status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.assignments(spark, sf_dir)
    turn = F.col("id") % 4
    verdict = F.when(turn == 0, "accept").when(turn == 1, "reject").when(turn == 2, "replace")
    return rows.select("id", imports.next_status(F.col("status"), verdict, F.col("id") % 7 == 0).alias("status"))


_TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@registry.add(" union all ".join(f"select '{t}' as name, count(*)::bigint as n from {t}" for t in _TABLES))
def k1_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whole tables written under a folder of their own and read back."""
    folder = f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}"
    export.snapshot({name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _TABLES}, folder, "20240101T000000")
    counted = [spark.read.parquet(f"{folder}/20240101T000000/{n}").agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in _TABLES]
    return merge.union_all(counted)


@registry.add("select o_orderkey, o_orderstatus from orders")
def k4_backup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compressed backup and what it restores to."""
    folder = f"{shared_dir(spark)}/backup-{uuid.uuid4().hex}"
    rows = _orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    export.backup({"orders": rows}, folder, "20240101")
    return spark.read.schema(rows.schema).json(f"{folder}/20240101/orders")


@registry.add(
    "with d as (select distinct o_custkey as account, o_orderdate::date as day from orders) select account, day, day >= date '2001-07-01' - 14 or row_number() over (partition by account order by day desc) <= 3 as kept from d"
)
def k4_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which daily backups of every customer stay: two weeks, and the newest three."""
    days = _orders(spark, sf_dir).select(F.col("o_custkey").alias("account"), F.to_date("o_orderdate").alias("day"))
    return export.retained(days, "account", "day", now="2001-07-01")


@registry.add("select sha256(text) as sha256, count(*)::bigint as copies, length(text)::bigint as chars from documents where text is not null group by 1, 3")
def k5_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals put into a vault twice, and read back by their digests."""
    vault = f"{shared_dir(spark)}/vault-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select(F.encode("text", "UTF-8").alias("raw"))
    export.put(rows, vault)
    if export.put(rows, vault):
        raise RuntimeError("the vault took an original twice")
    copies = rows.groupBy(F.sha2("raw", 256).alias("sha256")).agg(F.count("*").alias("copies"))
    back = export.get(copies.select("sha256"), vault).where(F.sha2("raw", 256) == F.col("sha256"))
    return copies.join(back, "sha256").select("sha256", "copies", F.length(F.decode("raw", "UTF-8")).cast("long").alias("chars"))
