"""Case selection, answer keys, predictions and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import cases as K
from archivolt.queries.conditions import RANKED
from archivolt.registry import Registry

registry = Registry()
_MA = archive.ctes("message", "assignment")
_ORIGIN = (
    f"{_MA}{RANKED}, og as (select message_id, value as origin from eff where dimension = 'origin'),"
    " mm as (select m.*, og.origin, coalesce(og.origin not in ('person', 'person_via_system', 'list'), m.is_automated, false) as machine from message m left join og on og.message_id = m.id where m.direction = 'in')"
)
_PATTERN = "concat_ws('|', lower(from_address), split_part(coalesce(subject, ''), ' ', 1))"


def _given(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir)


@registry.add(
    f"{_ORIGIN} select account, medium, count(*)::bigint as incoming, count(origin)::bigint as decided, count(*) filter (where origin is null)::bigint as undecided,"
    " count(*) filter (where origin is null and machine and medium = 'email')::bigint as undecided_machine, (count(origin) / count(*))::double as share from mm group by 1, 2"
)
def c9_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.coverage(*_given(spark, sf_dir))


@registry.add(
    f"{_ORIGIN}, p as (select {_PATTERN} as pk, count(*) as n, list(id order by received_at nulls first, id) as ids from mm where medium = 'email' and machine group by 1),"
    " t as (select coalesce(concat('thread:', thread_id), concat('message:', id)) as k, list(id order by received_at nulls first, id) as ids from (select case when thread_id is null then id end as lone, * from mm where medium = 'email' and not machine)"
    "  group by 1),"
    " c as (select *, case when lag(received_at) over w is null or received_at - lag(received_at) over w > interval 2 hour then 1 else 0 end as st from message where medium <> 'email' and thread_id is not null and received_at is not null window w as (partition by thread_id order by received_at, id)),"
    " cn as (select *, sum(st) over (partition by thread_id order by received_at, id rows unbounded preceding) as s from c),"
    " cp as (select *, (row_number() over (partition by thread_id, s order by received_at, id) - 1) // 30 as part from cn),"
    " w as (select thread_id, list(id order by received_at, id) as ids, list(id order by received_at, id) filter (where direction = 'in') as incoming from cp group by thread_id, s, part)"
    " select 'machine' as stage, 'template' as unit, pk as unit_key, sample_no::int as sample_no, ids[case sample_no when 0 then 1 when 1 then (n + 1) // 2 else n end] as anchor, n::bigint as n from p, (select unnest([0, 1, 2]) as sample_no) where n >= 3"
    " union all select 'machine', 'tail', pk, 0, ids[-1], n from p where n < 3"
    " union all select 'person', 'thread', k, 0, ids[-1], len(ids) from t"
    " union all select 'chat', 'window', concat('window:', thread_id, ':', ids[1]), 0, coalesce(incoming[-1], ids[-1]), len(ids) from w".replace("coalesce(concat('thread:', thread_id), concat('message:', id))", "case when thread_id is null then concat('message:', id) else concat('thread:', thread_id) end")
)
def c20_case_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.select_cases(*_given(spark, sf_dir), F.expr(_PATTERN))


#: Shares of the answer key by stratum and group.
SHARES = {"machine": {"bulk": 2.0, "plain": 1.0}, "person": {"recent": 2.0, "older": 1.0}, "chat": {"window": 2.0}}


_DRAWN_GROUPS = ("bulk", "plain", "recent", "older", "window")
_QUOTA = {"bulk": 16, "plain": 8, "recent": 16, "older": 8, "window": 16}


@registry.add(
    f"{_MA.replace('with ', 'with recursive ', 1)}, p as (select id, case when medium <> 'email' then 'window' when is_automated and from_name is null then 'bulk' when is_automated then 'plain' when received_at >= timestamp '1998-01-01' then 'recent' else 'older' end as grp,"
    f" case when medium = 'email' then thread_id end as thread_id, {_PATTERN} as pattern, md5(id::varchar) as o from message where direction = 'in'),"
    f" f as (select * from p qualify row_number() over (partition by grp order by o, id) <= 150),"
    f" c as (select row_number() over (order by list_position({list(_DRAWN_GROUPS)}, grp), o, id) as i, id, grp, list_filter([concat('t', thread_id), case when pattern is not null then concat('p', pattern) end], lambda x: x is not null and x <> 't') as claims from f),"
    f" q as (select unnest({list(_QUOTA)}) as grp, unnest({list(_QUOTA.values())}) as k),"
    " r(i, id, grp, drawn, used, n) as ("
    "  select 0::bigint, null::bigint, null::varchar, false, []::varchar[], 0"
    "  union all select c.i, c.id, c.grp,"
    "   (case when c.grp = r.grp then r.n else 0 end) < q.k and not list_has_any(r.used, c.claims),"
    "   case when (case when c.grp = r.grp then r.n else 0 end) < q.k and not list_has_any(r.used, c.claims) then list_concat(r.used, c.claims) else r.used end,"
    "   (case when c.grp = r.grp then r.n else 0 end) + case when (case when c.grp = r.grp then r.n else 0 end) < q.k and not list_has_any(r.used, c.claims) then 1 else 0 end"
    "  from r join c on c.i = r.i + 1 join q on q.grp = c.grp)"
    ' select id, grp as "group", (row_number() over (order by i))::int as position from r where drawn'
)
def c26_answer_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer key of 64 messages; each claims its thread (a chat only itself) and its pattern when it is drawn.

    The statement walks the candidates in order, one after another; it reads the
    first 150 of each group, more than the draw ever passes there.
    """
    group = (
        F.when(F.col("medium") != "email", "window")
        .when(F.col("is_automated") & F.col("from_name").isNull(), "bulk")
        .when(F.col("is_automated"), "plain")
        .when(F.col("received_at") >= F.lit("1998-01-01").cast("timestamp_ntz"), "recent")
        .otherwise("older")
    )
    thread = F.when(F.col("medium") == "email", F.col("thread_id"))
    pool = archive.messages(spark, sf_dir).where("direction = 'in'").select("id", group.alias("group"), thread.alias("thread_id"), F.expr(_PATTERN).alias("pattern"))
    return K.answer_key(pool, ["thread_id", "pattern"], SHARES, 64)


_LABELS = (
    "with l as (select o_custkey as item, case o_orderkey % 3 when 0 then 'topic' when 1 then 'origin' else 'note' end as field, case when o_orderkey % 7 < 4 then 'second' else 'owner' end as labeller,"
    " max(o_orderstatus) as value, min(case when o_orderkey % 13 = 0 then 'unsure' else 'set' end) as status from orders where o_custkey % 4 > 0 or o_orderkey % 7 < 4 group by 1, 2, 3)"
)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_custkey % 4 > 0 or o_orderkey % 7 < 4")
    field = F.when(F.col("o_orderkey") % 3 == 0, "topic").when(F.col("o_orderkey") % 3 == 1, "origin").otherwise("note")
    who = F.when(F.col("o_orderkey") % 7 < 4, "second").otherwise("owner")
    made = rows.groupBy(F.col("o_custkey").alias("item"), field.alias("field"), who.alias("labeller"))
    return made.agg(F.max("o_orderstatus").alias("value"), F.min(F.when(F.col("o_orderkey") % 13 == 0, "unsure").otherwise("set")).alias("status")).withColumn("values", F.array("value"))


@registry.add(f"{_LABELS} select item, row_number() over (order by md5(item::varchar), item)::int as rank from (select distinct item from l where labeller = 'second' and field <> 'note' and item not in (select item from l where labeller = 'owner')) qualify rank <= 20")
def c49_check_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.check_sample(_labels(spark, sf_dir), "second", "owner", 20)


_SAMPLE = f"{_LABELS}, s as (select item, row_number() over (order by item)::int as rank from (select distinct item from l where labeller = 'second' and field <> 'note'))"


def _sample(labels: DataFrame) -> DataFrame:
    return K.numbered(labels.where("labeller = 'second' and field <> 'note'").select("item").distinct(), "item", "rank")


@registry.add(f"{_SAMPLE} select item, rank, coalesce(n, 0)::bigint as answered, coalesce(n, 0) = 2 as checked from s left join (select item, count(distinct field) as n from l where labeller = 'owner' and field in ('topic', 'origin') group by 1) using (item)")
def c49_check_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return K.check_state(_sample(labels), labels, "owner", ["topic", "origin"])


@registry.add(
    f"{_SAMPLE} select m.field, count(*)::bigint as answered, count(*) filter (where m.status = 'set' and m.value = t.value)::bigint as kept, count(*) filter (where not coalesce(m.status = 'set' and m.value = t.value, false))::bigint as changed,"
    " (count(*) filter (where m.status = 'set' and m.value = t.value) / count(*))::double as rate from l m left join l t on t.item = m.item and t.field = m.field and t.labeller = 'second' where m.labeller = 'owner' and m.item in (select item from s) group by 1"
)
def c49_check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return K.check_summary(_sample(labels), labels, "second", "owner")


_RULED = f"{_MA}{RANKED}, rp as (select * from cand where source_kind = 'rule' and dimension in ('topic', 'origin') qualify row_number() over (partition by message_id, dimension order by own desc, created_at desc nulls last, id desc) = 1)"


@registry.add(f"{_RULED} select message_id, dimension as field, value from rp")
def c50_rule_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rule_predictions(*_given(spark, sf_dir), ["topic", "origin"])


@registry.add(
    f"{_MA}, c as (select m.id as message_id, a.*, a.entity_id = m.id as own from message m join assignment a on a.entity_id in (m.id, m.thread_id) where a.source_kind = 'model' and a.status in ('proposed', 'active')),"
    " b as (select * from c qualify own = bool_or(own) over (partition by message_id, dimension)), f as (select * from b qualify dimension = 'tag' or id = min(id) over (partition by message_id, dimension))"
    " select message_id, dimension as field, string_agg(distinct value, ',' order by value) as values, min(confidence) as confidence from f group by 1, 2"
)
def c50_run_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.run_predictions(*_given(spark, sf_dir)).withColumn("values", F.array_join("values", ","))


@registry.add(
    f"{_RULED}, it as (select id as item, row_number() over (order by id) as position from message), it2 as (select item, ((position - 1) // 25 + 1)::bigint as round from it),"
    " g as (select id as item, unnest(['topic', 'origin']) as field, unnest(['1-URGENT', 'person']) as value, case when id % 6 = 0 then 'unsure' else 'set' end as status, unnest([true, id % 157 <> 0]) as given from message),"
    " ok as (select round from it2 join (select item, count(*) filter (where given) as n from g group by 1) using (item) group by 1 having min(n) = 2)"
    " select round, g.field, count(*)::bigint as compared, count(*) filter (where g.value = rp.value)::bigint as agreed from g join it2 using (item) join rp on rp.message_id = g.item and rp.dimension = g.field where given and g.status = 'set' and round in (select round from ok) group by 1, 2"
)
def c50_revealed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, given = _given(spark, sf_dir)
    items = K.numbered(rows.select(F.col("id").alias("item")), "item", "position")
    answers = F.explode(F.array(F.struct(F.lit("topic").alias("field"), F.lit("1-URGENT").alias("value")), F.struct(F.lit("origin").alias("field"), F.lit("person").alias("value")))).alias("a")
    gold = items.select("item", answers).select("item", "a.*", F.when(F.col("item") % 6 == 0, "unsure").otherwise("set").alias("status")).where("field = 'topic' or item % 157 <> 0")
    return K.revealed(gold, K.rule_predictions(rows, given, ["topic", "origin"]), items, ["topic", "origin"])


@registry.add(
    "select * from (select o_orderdate as \"at\", 0 as rank, o_orderkey as id, 'created' as kind, o_orderstatus as what from orders union all select l_shipdate, 1, l_orderkey * 10 + l_linenumber, 'event', l_returnflag from lineitem)"
    " where \"at\" < timestamp '1998-01-01' or \"at\" = timestamp '1998-01-01' and (rank < 1 or rank = 1 and id < 5000) order by \"at\" desc, rank desc, id desc limit 40"
)
def c37_activity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("what"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").alias("at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("what"))
    page = K.activity({"created": orders, "event": lines}, before=("1998-01-01 00:00:00", 1, 5000), limit=40)
    return page.withColumn("at", F.col("at").cast("timestamp_ntz"))
