"""Model decisions and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import model as P
from archivolt.operators import values
from archivolt.queries.conditions import RANKED
from archivolt.registry import Registry

registry = Registry()
_S = (
    "with s as (select o_orderkey as id, (o_orderkey % 97) / 100.0E0 as a, (o_custkey % 53) / 100.0E0 as b, (o_orderkey % 7) / 20.0E0 as c from orders),"
    " l as (select id, unnest(['work', 'home', 'other']) as v, unnest([a, b, c]) as p from s), r as (select *, row_number() over (partition by id order by p desc, v) as rn from l),"
    " t as (select id, max(v) filter (where rn = 1) as top, max(p) filter (where rn = 1) as p1, max(p) filter (where rn = 2) as p2 from r group by 1)"
)


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = lambda c, m, d: (F.col(c) % m) / F.lit(d)
    made = F.create_map(F.lit("work"), part("o_orderkey", 97, 100.0), F.lit("home"), part("o_custkey", 53, 100.0), F.lit("other"), part("o_orderkey", 7, 20.0))
    return rows.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("unit"), made.alias("scores"))


@registry.add(f"{_S} select id, top, p1 as confidence, round(p1 - p2, 6) as margin, p1 >= 0.7 - 1e-9 and round(p1 - p2, 6) >= 0.15 - 1e-9 as decided from t")
def x23_route_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("id", P.route_one(F.col("scores")).alias("d")).select("id", "d.*")


@registry.add(f"{_S} select id, coalesce(string_agg(v, ',' order by v) filter (where p >= 0.5 - 1e-9), '') as selected, round(min(greatest(p, 1 - p)), 6) as confidence from l group by 1")
def x23_route_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).select("id", P.route_many(F.col("scores")).alias("d"))
    return rows.select("id", F.array_join("d.selected", ",").alias("selected"), "d.confidence")


@registry.add(
    f"{_S} select id, concat_ws(',', case when a >= 0.5 and id % 3 = 0 then 'ask:origin' end, case when b >= 0.3 and id % 3 = 1 then 'route:auto_reply' end, case when b >= 0.3 and id % 2 = 0 then 'route:topic' end) as fired"
    " from s".replace("id % 3 = 0 then 'ask", "id % 3 <> 2 then 'ask")
)
def x23_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.when(F.col("id") % 3 == 1, "auto_reply").when(F.col("id") % 3 == 2, "person").otherwise("alert")
    topic = F.when(F.col("id") % 2 == 1, "Work/Plans").otherwise("Home")
    fired = P.gates(origin, topic, F.col("scores")["work"] >= 0.5, F.col("scores")["home"] >= 0.3)
    return _scores(spark, sf_dir).select("id", F.array_join(fired, ",").alias("fired"))


@registry.add(f"{_S} select o_custkey as unit, min(top) as top, min(p1) as confidence, count(*)::bigint as samples from t join orders on o_orderkey = id group by 1 having min(top) = max(top)")
def c21_sample_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scores(spark, sf_dir).select("unit", P.route_one(F.col("scores")).alias("d")).select("unit", "d.top", "d.confidence")
    return P.agreed(rows, ["unit"], "top", "confidence")


_MA = archive.ctes("message", "assignment")


@registry.add(
    f"{_MA}{RANKED}, a as (select o_orderkey as message_id, case when o_orderkey % 2 = 0 then 'topic' else 'origin' end as field, (o_orderkey % 100) / 100.0E0 as confidence from orders),"
    " h as (select distinct message_id, dimension as field from eff where source_kind = 'human')"
    " select a.message_id, a.field, case when h.message_id is not null then 'superseded' when confidence >= case a.field when 'topic' then 0.7 else 0.9 end - 1e-9 then 'active' else 'proposed' end as status from a left join h using (message_id, field)".replace(
        "a.message_id, a.field, case when h.message_id", "a.message_id, a.field, case when h.field"
    ).replace("a left join h using (message_id, field)", "a left join h on h.message_id = a.message_id and h.field = a.field")
)
def c22_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.col("o_orderkey").alias("message_id"), F.when(F.col("o_orderkey") % 2 == 0, "topic").otherwise("origin").alias("field"), F.lit("x").alias("value"), ((F.col("o_orderkey") % 100) / F.lit(100.0)).alias("confidence")
    )
    effective = values.effective_message_values(archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir))
    return P.accept(answers, {"topic": 0.7, "origin": 0.9}, effective).select("message_id", "field", "status")


@registry.add("select o_orderkey as unit, case when o_orderkey % 4 = 0 then 'reuse' when sum(case when o_orderkey % 4 > 0 then o_totalprice end) over (order by o_orderkey) <= 1000000000 then 'ask' else 'trimmed' end as step from orders")
def c23_ask_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("unit"), "o_totalprice")
    return P.ask_plan(units, units.where("unit % 4 = 0"), "o_totalprice", 1000000000, ["unit"]).select("unit", "step")


@registry.add(
    "with v as (select o_custkey, count(*) filter (where o_orderstatus <> 'P') as agreed, count(*) as n from orders group by 1) select o_custkey, agreed::bigint as agreed, n::bigint as n, n >= 12 and agreed = n as lifted from v".replace(
        "n >= 12 and agreed = n",
        "n >= 12 and (agreed / n + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt(agreed / n * (1 - agreed / n) / n + 1.645 * 1.645 / (4 * n * n))) / (1 + 1.645 * 1.645 / n) >= 0.85 - 1e-9",
    )
)
def c19_lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("ok", F.col("o_orderstatus") != "P")
    return P.lifts(rows, ["o_custkey"]).drop("bound")


_QUALITY = "with p as (select l.doc_id, case when l.quality = 1 then 'good' else 'bad' end as gold, case when length(d.text) - length(translate(d.text, '#*$%&|<>', '')) > 0.02 * length(d.text) then 'bad' else 'good' end as guess, length(translate(d.text, '#*$%&|<>', '')) / length(d.text) as score from labels l join documents d using (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")
    plain = F.length(F.translate("text", "#*$%&|<>", ""))
    n = F.length("text")
    return rows.select(
        F.col("doc_id").alias("item"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"),
        F.when(n - plain > 0.02 * n, "bad").otherwise("good").alias("guess"),
        (plain / n).alias("score"),
    )


@registry.add(f"{_QUALITY}, v as (select unnest(['good', 'bad']) as value) select value, (select count(*) from p where gold = value)::bigint as labelled, (select count(*) from p where guess = value)::bigint as predicted, (select count(*) from p where guess = value and gold = value)::bigint as correct, (select count(*) filter (where gold = value) / count(*) from p where guess = value)::double as precision, (select count(*) filter (where guess = value) / count(*) from p where gold = value)::double as recall from v")
def c27_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _judged(spark, sf_dir)
    return P.compare(rows.select("item", F.col("gold").alias("value")), rows.select("item", F.col("guess").alias("value")))


@registry.add(f"{_QUALITY}, t as (select unnest([0.8, 0.9, 0.95, 0.99])::double as threshold) select threshold, count(*) filter (where score >= threshold - 1e-9)::bigint as decided, count(*) filter (where score >= threshold - 1e-9 and gold = 'good')::bigint as right from t cross join p group by 1")
def c29_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sweep(_judged(spark, sf_dir).withColumn("ok", F.col("gold") == "good"), [0.8, 0.9, 0.95, 0.99])


@registry.add(f"{_QUALITY} select least(9, greatest(0, floor(score * 10 + 1e-6)))::bigint as bucket, count(*)::bigint as n, count(*) filter (where gold = 'good')::bigint as right, round(avg(score), 6)::double as mean from p group by 1")
def c25_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.calibration(_judged(spark, sf_dir).withColumn("ok", F.col("gold") == "good")).withColumn("mean", F.round("mean", 6))


@registry.add("with l as (select o_custkey as item, o_orderpriority as labeller, max(o_orderstatus) as value from orders group by 1, 2) select a.labeller as a, b.labeller as b, count(*)::bigint as both, count(*) filter (where a.value = b.value)::bigint as same from l a join l b on a.item = b.item and a.labeller < b.labeller group by 1, 2")
def c28_labeller_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_custkey").alias("item"), F.col("o_orderpriority").alias("labeller")).agg(F.max("o_orderstatus").alias("value"))
    return P.agreement(rows)


@registry.add(f"{_MA}{RANKED} select account, medium, count(*) filter (where j.message_id is not null)::bigint as judged, count(*) filter (where j.message_id is null)::bigint as unjudged from message m left join (select distinct message_id from eff where dimension = 'origin') j on j.message_id = m.id group by 1, 2")
def c48_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir)
    judged = values.effective_message_values(rows, archive.assignments(spark, sf_dir).where("dimension = 'origin'")).select(F.col("message_id").alias("id")).distinct().withColumn("hit", F.lit(True))
    return rows.join(judged, "id", "left").groupBy("account", "medium").agg(F.count_if("hit").alias("judged"), F.count_if(F.col("hit").isNull()).alias("unjudged"))


@registry.add(
    f"{_MA}{RANKED}, g as (select from_address, min(id) as unit from message where from_address is not null group by 1), h as (select distinct message_id from eff where dimension = 'topic' and source_kind = 'human') select m.id, g.unit from message m join g using (from_address) where m.id not in (select message_id from h)"
)
def c51_group_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group's answer for its messages, never over a human value."""
    rows = archive.messages(spark, sf_dir)
    groups = rows.where("from_address is not null").groupBy("from_address").agg(F.min("id").alias("unit"))
    human = values.effective_message_values(rows, archive.assignments(spark, sf_dir).where("dimension = 'topic'")).where("source_kind = 'human'").select(F.col("message_id").alias("id"))
    return rows.join(groups, "from_address").join(human, "id", "left_anti").select("id", "unit")


@registry.add("with r as (select user_id, event_type, value > 5 as ok from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1), k as (select user_id from r group by 1 having count(*) = 5) select event_type, count(*)::bigint as items, count(*) filter (where ok)::bigint as right from r where user_id in (select user_id from k) group by 1")
def c52_runs_on_shared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of each run on the items that all runs answered."""
    first = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id", "event_type").agg(F.min_by(F.col("value") > 5, F.struct("ts", "event_id")).alias("ok"))
    shared = first.groupBy("user_id").agg(F.count("*").alias("n")).where("n = 5").select("user_id")
    return first.join(shared, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("items"), F.count_if("ok").alias("right"))
