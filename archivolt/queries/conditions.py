"""Rule and placement conditions, message filters (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import search, values
from archivolt.plans import conditions as C
from archivolt.registry import Registry

registry = Registry()
_M = archive.ctes("message")
_DOMAIN = "split_part(from_address, '@', 2)"


def _rule(spark: SparkSession, sf_dir: str, conditions: list) -> DataFrame:
    return archive.messages(spark, sf_dir).where(C.rule_column(conditions)).select("id")


def _rule_sql(where: str) -> str:
    return f"{_M} select id from message where {where}"


@registry.add(_rule_sql("lower(account) = 'acc1' and lower(direction) <> 'out' and lower(medium) in ('email', 'sms')"))
def f1_f11_f15_plain_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, [{"field": "account", "op": "is", "value": "ACC1"}, {"field": "direction", "op": "is_not", "value": "out"}, {"field": "medium", "op": "in", "value": ["Email", "sms"]}])


@registry.add(_rule_sql(f"lower({_DOMAIN}) in ('dom1.example.com', 'dom2.example.com')"))
def f2_from_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, [{"field": "from_domain", "op": "in", "value": ["dom1.example.com", "DOM2.example.com"]}])


@registry.add(_rule_sql("not contains(lower(coalesce(subject, '')), 'invoice') and contains(lower(coalesce(from_name, '')), 'user 1')"))
def f3_f12_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, [{"field": "subject", "op": "not_contains", "value": "Invoice"}, {"field": "from_name", "op": "contains", "value": "USER 1"}])


@registry.add(_rule_sql("starts_with(lower(coalesce(subject, '')), 'order ') and ends_with(lower(from_address), '.example.com')"))
def f13_starts_and_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, [{"field": "subject", "op": "starts_with", "value": "ORDER "}, {"field": "from_address", "op": "ends_with", "value": ".EXAMPLE.com"}])


@registry.add(_rule_sql("regexp_matches(coalesce(subject, ''), '(?i)\\b(invoice|order) [0-9]+')"))
def f14_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, [{"field": "subject", "op": "matches", "value": r"\m(INVOICE|order) [[:digit:]]+"}])


@registry.add(_rule_sql("coalesce(list_id, '') <> '' and not coalesce(is_automated, false) and has_attachments"))
def f16_f17_set_and_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(spark, sf_dir, [{"field": "list_id", "op": "is_set"}, {"field": "is_automated", "op": "is_false"}, {"field": "has_attachments", "op": "is_true"}])


@registry.add(_rule_sql("received_at > timestamp '1997-01-01' and received_at < timestamp '1999-01-01' and (size > 300000 or size < 5000 and lower(account) = 'acc0')"))
def f18_ranges_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule(
        spark,
        sf_dir,
        [
            {"field": "received", "op": "after", "value": "1997-01-01"},
            {"field": "received", "op": "before", "value": "1999-01-01"},
            {"any": [{"field": "size", "op": "gt", "value": 300000}, [{"field": "size", "op": "lt", "value": 5000}, {"field": "account", "op": "is", "value": "acc0"}]]},
        ],
    )


_MANY = archive.ctes("message", "location", "participant")


@registry.add(
    f"{_MANY} select id from message m where exists (select 1 from location l where l.message_id = m.id and l.present and lower(coalesce(folder_path, folder)) = 'root/a')"
    " and exists (select 1 from location l where l.message_id = m.id and l.present and starts_with(lower(label), 'l1'))"
    " and exists (select 1 from participant p where p.message_id = m.id and lower(p.address) = 'me@home.example.org')"
)
def f4_f5_f6_places_and_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.with_places(archive.messages(spark, sf_dir), archive.locations(spark, sf_dir), archive.participants(spark, sf_dir))
    wanted = [{"field": "folder", "op": "is", "value": "Root/A"}, {"field": "label", "op": "starts_with", "value": "L1"}, {"field": "recipient", "op": "is", "value": archive.OWNER}]
    return rows.where(C.rule_column(wanted)).select("id")


@registry.add(_rule_sql("lower(coalesce(precedence, '')) = 'bulk' or coalesce(return_path, '') <> ''"))
def f10_header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir).withColumn("headers", F.create_map(F.lit("precedence"), "precedence", F.lit("return_path"), "return_path"))
    wanted = [{"any": [{"field": "header:precedence", "op": "is", "value": "bulk"}, {"field": "header:return_path", "op": "is_set"}]}]
    return rows.where(C.rule_column(wanted)).select("id")


_PLACES = {
    "all": [
        {"any": [{"field": "account", "in": ["acc0", "acc2"]}, {"use": "old"}]},
        {"field": "list_id", "not_in": ["list1"]},
        {"field": "from_name", "prefix": ["User 1", "User 2"], "else": {"field": "is_automated", "is": True}},
        {"field": "subject", "set": True},
    ]
}


@registry.add(
    f"{_M} select id from message where (coalesce(account in ('acc0', 'acc2'), false) or coalesce(AGE < 1500 and AGE > 1000, false)) and not coalesce(list_id in ('list1'), false)"
    " and (case when from_name is not null then starts_with(from_name, 'User 1') or starts_with(from_name, 'User 2') else coalesce(is_automated, false) end) and subject is not null".replace(
        "AGE", "date_diff('day', received_at, timestamp '2001-08-02')"
    )
)
def f20_f25_placement_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit(archive.NOW).cast("timestamp"), F.col("received_at"))
    words = C.Vocabulary(
        scalars={n: F.col(n) for n in ("account", "list_id", "from_name", "subject")},
        booleans={"is_automated": F.col("is_automated")},
        numbers={"age": age},
        named={"old": {"field": "age", "lt": 1500, "gt": 1000}},
    )
    return archive.messages(spark, sf_dir).where(C.placement_column(_PLACES, words)).select("id")


@registry.add(
    archive.ctes("location")
    + ", l as (select message_id, coalesce(list(distinct label) filter (where label is not null), []) as labels from location where present group by 1)"
    " select message_id from l where list_has_any(labels, ['L1', 'L2']) and not list_has_any(labels, ['L3']) and len(list_filter(labels, lambda x: starts_with(x, 'L'))) > 0 and len(labels) > 0"
)
def f23_array_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.locations(spark, sf_dir).where("present").groupBy("message_id").agg(F.collect_set("label").alias("labels"))
    words = C.Vocabulary(arrays={"labels": F.col("labels")})
    wanted = {"all": [{"field": "labels", "in": ["L1", "L2"]}, {"field": "labels", "not_in": ["L3"]}, {"field": "labels", "prefix": ["L"]}, {"field": "labels", "set": True}]}
    return rows.where(C.placement_column(wanted, words)).select("message_id")


_FILTERS = {"medium": "email", "accounts": ["acc0", "acc1"], "exclude_domains": ["dom3.example.com"], "direction": "in", "has_attachments": False, "important": None}


@registry.add(
    f"{_M} select id from message where medium = 'email' and account in ('acc0', 'acc1') and coalesce({_DOMAIN}, '') not in ('dom3.example.com')"
    " and direction in ('in', 'self') and has_attachments = false"
)
def f27_f31_message_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.select_messages(archive.messages(spark, sf_dir), _FILTERS).select("id")


_MA = archive.ctes("message", "assignment")
RANKED = """, cand as (
  select m.id as message_id, a.*, true as own from message m join assignment a on a.entity_id = m.id where a.status = 'active'
  union all select m.id, a.*, false from message m join assignment a on a.entity_id = m.thread_id where a.status = 'active'),
ranked as (select *, case source_kind when 'human' then 4 when 'rule' then 3 when 'model' then 2 else 1 end as tier from cand),
eff as (select * from (select *, row_number() over (partition by message_id, dimension, case when dimension = 'tag' then value end
  order by tier desc, own desc, created_at desc nulls last, id desc) as rn from ranked) where rn = 1)"""


@registry.add(f"{_MA}{RANKED} select message_id as id from eff where dimension = 'topic' and value = 'Travel' or dimension = 'tag' and value = 'A' group by 1 having count(distinct dimension) = 2")
def f33_effective_value_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, given = archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir)
    return search.with_values(rows, given, [("topic", "Travel"), ("tag", "A")]).select("id")


@registry.add(
    f"{_MA}{RANKED}, prop as (select m.id as message_id, a.value, a.confidence, a.source_kind from message m join assignment a on a.entity_id = m.id where a.status = 'proposed' and a.dimension = 'topic'),"
    " sure as (select message_id, value from eff where dimension = 'topic' and (case source_kind when 'human' then 1.0 when 'rule' then 0.97 when 'import' then 0.75 else coalesce(confidence, 0.75) end) >= 0.85 - 1e-9)"
    " select message_id as id, value from sure union all select message_id, value from prop p where confidence >= 0.85 - 1e-9 and not exists (select 1 from sure s where s.message_id = p.message_id)"
)
def f35_sure_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the floor the effective value, else what the model proposes at the floor."""
    rows, given = archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir).where("dimension = 'topic'")
    floor = values.at_least("confident", F.col("source_kind"), F.col("confidence"))
    sure = values.effective_message_values(rows, given).where(floor).select("message_id", "value")
    offered = given.where("status = 'proposed'").join(rows.select(F.col("id").alias("entity_id")), "entity_id")
    offered = offered.where(values.at_least("confident", F.lit("model"), F.col("confidence"))).select(F.col("entity_id").alias("message_id"), "value")
    return sure.unionByName(offered.join(sure, "message_id", "left_anti")).select(F.col("message_id").alias("id"), "value")


@registry.add(
    archive.ctes("location")
    + " select message_id, case when not bool_or(present) then 'gone' when bool_and(coalesce(folder_path, folder) like 'Root/R%' or not present) then 'deleted' else 'here' end as state"
    " from location group by message_id"
)
def f37_removed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.removed_state(archive.locations(spark, sf_dir), bin_prefix="Root/R")


_DAYS = "generate_series(date '1997-03-01', date '1997-03-10', interval 1 day)"


@registry.add(f"select cast(d as date)::varchar as day, count(*)::bigint as n from (select unnest({_DAYS}) as d) s join lineitem on l_shipdate < d + interval 1 day and l_shipdate + to_days(cast(l_linenumber as int)) > d group by 1")
def f40_j15_window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries [ship date, ship date + line number days) that touch a day."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start, end = F.col("l_shipdate").cast("date"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int"))
    low, high = F.lit("1997-03-01").cast("date"), F.lit("1997-03-10").cast("date")
    clipped = rows.where((start <= high) & (end > low))
    days = F.explode(F.sequence(F.greatest(start, low), F.least(F.date_sub(end, 1), high))).alias("day")
    return clipped.select(days).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"))


@registry.add("select doc_id, quality in (1) and toxic in (0) as valid from labels")
def f41_valid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet")
    given = F.array(F.concat(F.lit("q"), F.col("quality")), F.concat(F.lit("t"), F.col("toxic")))
    return rows.select("doc_id", (F.size(F.array_except(given, F.array(F.lit("q1"), F.lit("t0")))) == 0).alias("valid"))
