"""The incremental plan (C23): messages since June 1997 against two earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import incremental as I
from archivolt.registry import Registry

registry = Registry()
NEW, RUNS = "1997-06-01", {"r0": "1996-01-01", "r1": "1997-06-01"}
FIELDS = ["origin", "type"]
BUDGET = 300

# Expressions of both dialects over messages and over an earlier case of n messages.
_STAGE = "case when medium <> 'email' then 'chat' when is_automated then 'machine' else 'person' end"
_UNIT = "case when medium <> 'email' then concat('w:', cust) when is_automated then concat('t:', cust % 400) when thread_id is null then concat('m:', id) else concat('p:', cust) end"
_VALUE = "concat('v', (n * 7 + case when n % 4 = 0 then sample else 0 end) % 3)"
_HELD = "not (field = 'type' and n % 11 = 0 and sample = 0)"
_FIXED = "field = 'origin' and n % 6 = 0"

_SQL = (
    f"{archive.ctes('message')}, u as (select m.id, direction, medium, is_automated, thread_id, received_at, o_orderdate as stored_at, o_custkey as cust from message m join orders on o_orderkey = m.id),"
    f" s as (select *, {_STAGE} as stage, {_UNIT} as unit from u),"
    f" c as (select stage, unit, count(*) as new, count(*) filter (where cust % 29 > 0) as plain, max(received_at) as latest from s where stored_at >= timestamp '{NEW}' and (direction = 'in' or medium <> 'email') group by 1, 2),"
    f" k as (select unit, stage, case when stored_at < timestamp '{RUNS['r0']}' then 'r0' else 'r1' end as run, count(*) as n, list(id) as members from s where stored_at < timestamp '{NEW}' group by 1, 2, 3),"
    " ks as (select *, unnest(case when stage = 'machine' and n >= 3 then [0, 1, 2] else [0] end) as sample, run = 'r0' or n >= 2 as whole from k),"
    " src as (select unit, max(run) as run from ks where whole group by 1),"
    " srcm as (select s.unit, s.run, max(members) as members, list_sort(list(distinct sample)) as samples from src s join ks on ks.unit = s.unit and ks.run = s.run group by 1, 2),"
    f" a as (select *, {_VALUE} as value, ((n + sample) % 10) / 10.0E0 as confidence, {_FIXED} as fixed from (select *, unnest(['origin', 'type']) as field from ks) where {_HELD}),"
    " na as (select a.* from a join src on src.unit = a.unit and a.run >= src.run qualify row_number() over (partition by a.unit, a.sample, a.field order by a.run desc) = 1),"
    " bf as (select unit, field, count(*) as n, count(distinct value) as nv, bool_or(fixed) as fixed, min_by(value, [case when fixed then -2.0 else coalesce(confidence, -1.0) end, sample::double]) as value from na group by 1, 2),"
    " wh as (select unit, count(*) filter (where nf = 2) as n, list_sort(list(sample)) as seen from (select unit, sample, count(distinct field) as nf from na group by 1, 2) group by 1),"
    " ag as (select bf.unit, string_agg(concat(field, '=', value), ',' order by field) as answers from bf join wh on wh.unit = bf.unit and wh.n = 3 and wh.seen = [0, 1, 2] join srcm on srcm.unit = bf.unit and srcm.samples = [0, 1, 2] group by 1 having count(*) filter (where bf.n < 3 or (not fixed and nv > 1)) = 0),"
    " co as (select unit, string_agg(concat(field, '=', value), ',' order by field) as answers from na where sample = 0 group by 1 having count(distinct field) = 2),"
    f" g as (select s.unit, count(*) filter (where s.stored_at > case src.run when 'r0' then timestamp '{RUNS['r0']}' else timestamp '{RUNS['r1']}' end) as later, count(*) filter (where not list_contains(members, s.id)) as outside from s join srcm src on src.unit = s.unit group by 1),"
    " z as (select unit, count(*) as size from s group by 1),"
    f" fl as (select unit, count(*) as tries from s where id % 50 = 0 and stored_at < timestamp '{NEW}' group by 1),"
    " p as (select c.stage, c.unit, c.new, c.latest, plain, size, src.unit is not null as known, coalesce(tries, 0) >= 3 as stuck, case when c.stage = 'machine' then ag.answers else co.answers end as answers, case when c.stage = 'person' then coalesce(later, 0) else coalesce(outside, 0) end as grown"
    "  from c left join src on src.unit = c.unit left join ag on ag.unit = c.unit left join co on co.unit = c.unit left join g on g.unit = c.unit left join z on z.unit = c.unit left join fl on fl.unit = c.unit),"
    " st as (select *, case when (stage = 'machine' and answers is not null) or (stage <> 'machine' and known and answers is not null and grown < 3) then 'reuse' when stage = 'machine' and plain = 0 then 'covered' when stuck then 'given_up' else 'ask' end as step from p),"
    " plan as (select stage, unit, step, case when step in ('ask', 'given_up') then case when stage = 'machine' then case when known then 'template split' when size >= 3 then 'new template' else 'tail' end when known then 'grown' else 'new' end end as why,"
    " new::bigint as new, (case when step <> 'ask' then 0 when stage = 'machine' and not known and size >= 3 then 3 else 1 end)::int as cases, latest, case when step = 'reuse' then answers end as answers from st)"
)


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.col("o_orderdate").alias("stored_at"))
    rows = archive.messages(spark, sf_dir).select("id", "direction", "medium", "is_automated", "thread_id", "received_at").join(orders, "id")
    rows = rows.withColumn("stage", F.expr(_STAGE)).withColumn("unit", F.expr(_UNIT))
    old = F.col("stored_at") < F.lit(NEW).cast("timestamp_ntz")
    candidates = rows.where(~old & ((F.col("direction") == "in") | (F.col("medium") != "email"))).withColumn("grouped", F.col("cust") % 29 == 0)
    run = F.when(F.col("stored_at") < F.lit(RUNS["r0"]).cast("timestamp_ntz"), "r0").otherwise("r1")
    made = rows.where(old).groupBy("unit", "stage", run.alias("run")).agg(F.count("*").alias("n"), F.collect_list("id").alias("members"))
    at = F.when(F.col("run") == "r0", F.lit(RUNS["r0"])).otherwise(RUNS["r1"]).cast("timestamp_ntz")
    samples = F.when((F.col("stage") == "machine") & (F.col("n") >= 3), F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    cases = made.select("unit", "run", at.alias("run_at"), at.alias("made_at"), "n", "members", ((F.col("run") == "r0") | (F.col("n") >= 2)).alias("full"), F.explode(samples).alias("sample"))
    each = cases.select("unit", "run", "run_at", "sample", "n", F.explode(F.array(*[F.lit(f) for f in FIELDS])).alias("field")).where(_HELD)
    answers = each.select("unit", "run", "run_at", "sample", "field", F.expr(_VALUE).alias("value"), (((F.col("n") + F.col("sample")) % 10) / F.lit(10.0)).alias("confidence"), F.expr(_FIXED).alias("fixed"))
    return candidates, rows.select("id", "unit", "stored_at"), cases.drop("n"), answers, rows.where(old & (F.col("id") % 50 == 0)).select("unit")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.plan(*_inputs(spark, sf_dir), {stage: FIELDS for stage in I.STAGES})


@registry.add(f"{_SQL} select * from plan")
def c23_incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every unit with new messages: earlier answers, the owner's, a question, or nothing any more."""
    return _plan(spark, sf_dir).withColumn("answers", F.array_join(F.transform("answers", lambda a: F.concat_ws("=", a["field"], a["value"])), ","))


# Sizes are one and three: when three don't fit any more, ones still may.
@registry.add(
    f"{_SQL}, o as (select stage, unit, cases, row_number() over (order by list_position(['person', 'chat', 'machine'], stage), coalesce(latest, timestamp '1970-01-01') desc, unit) as i from plan where step = 'ask'),"
    f" f as (select *, sum(cases) over (order by i) as run from o), b as (select coalesce(min(i), 1000000000) as stop from f where run > {BUDGET}), l as (select {BUDGET} - coalesce(max(run), 0) as room from f, b where i < stop)"
    " select stage, unit, cases from f, b where i < stop union all select stage, unit, cases from (select *, row_number() over (order by i) as k from f, b where i > stop and cases = 1), l where k <= room and room > 0 and exists (select 1 from f, b where i = stop and cases > 1)"
)
def c23_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The units that are asked within a budget of cases, whole units in order."""
    return I.trimmed(_plan(spark, sf_dir), BUDGET)
