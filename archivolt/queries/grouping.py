"""Sessions, clusters, intervals and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt import archive
from archivolt.operators import grouping as G
from archivolt.registry import Registry

registry = Registry()
NOW = "2024-01-31 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


_SESSIONS = """with s as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 2 hour then 1 else 0 end as st from events where ts is not null window w as (partition by user_id order by ts, event_id)),
n as (select *, sum(st) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)"""


@registry.add(f"{_SESSIONS} select event_id, session::bigint as session, ((row_number() over (partition by user_id, session order by ts, event_id) - 1) // 30)::bigint as part from n")
def w5_w6_sessions_and_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.sessions(_events(spark, sf_dir), ["user_id"], "ts", ["event_id"])
    return rows.select("event_id", F.col("session").cast("long").alias("session"), "part")


@registry.add(f"{_SESSIONS} select user_id, count(distinct session)::bigint as sessions, count(*)::bigint as n from n group by 1")
def t2_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions by the built-in session window."""
    rows = _events(spark, sf_dir).groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.count("*").alias("c"))
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("c").alias("n"))


@registry.add(
    "with s as (select *, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute then 1 else 0 end as st from events window w as (partition by user_id order by ts, event_id)),"
    " n as (select *, sum(st) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)"
    " select user_id, session::bigint as session, count(*)::bigint as labelled, (epoch_us(max(ts)) - epoch_us(min(ts)))::bigint as micros from n group by 1, 2"
)
def c30_labelling_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.sessions(_events(spark, sf_dir), ["user_id"], "ts", ["event_id"], gap_seconds=1800)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("labelled"), (F.max(at) - F.min(at)).alias("micros"))


@registry.add(
    "select user_id, event_type, count(*)::bigint as n, count(*) filter (where ts >= timestamp '2024-01-31' - interval 365 day)::bigint as last_year,"
    " case when max(ts) < timestamp '2024-01-31' - interval 365 day then 'dead' when count(*) filter (where ts >= timestamp '2024-01-31' - interval 365 day) < 12 then 'quiet' else 'active' end as status from events group by 1, 2"
)
def c16_x26_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.clusters(_events(spark, sf_dir), ["user_id", "event_type"], "ts", NOW).drop("last")


@registry.add("select * from (select user_id, event_type, count(*)::bigint as count, row_number() over (partition by user_id order by count(*) desc, event_type)::bigint as rank from events group by 1, 2) where rank <= 3")
def a20_w8_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_values(_events(spark, sf_dir), ["user_id"], "event_type", 3).withColumn("rank", F.col("rank").cast("long"))


@registry.add(
    archive.ctes("message") + ", h as (select from_address, split_part(subject, ' ', 1) as head, starts_with(subject, '[') as tagged from message where from_address is not null and coalesce(subject, '') <> ''),"
    " t as (select from_address, count(distinct head) filter (where tagged) >= 1 and avg(tagged::int) >= 0.2 as split from h group by 1)"
    " select from_address, case when split then head end as head, count(*)::bigint as n from h join t using (from_address) group by 1, 2"
)
def c17_sender_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir).where("from_address is not null and coalesce(subject, '') <> ''")
    rows = rows.withColumn("head", F.split_part("subject", F.lit(" "), F.lit(1)))
    return G.split_senders(rows, "from_address", "head", F.startswith("subject", F.lit("[")), least_heads=1)


@registry.add(
    "with i as (select l_suppkey, l_shipdate as s, l_shipdate + to_days(cast(l_linenumber as int)) as e from lineitem),"
    " b as (select *, max(e) over (partition by l_suppkey order by s, e rows between unbounded preceding and 1 preceding) as m from i)"
    " select l_suppkey, sum(greatest(0, epoch(e) - greatest(epoch(s), coalesce(epoch(m), epoch(s)))))::double as seconds from b group by 1"
)
def a18_c38_busy_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    timed = rows.select("l_suppkey", F.col("l_shipdate").alias("s"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber").cast("int")).cast("timestamp_ntz").alias("e"))
    return G.busy_seconds(timed, ["l_suppkey"], "s", "e")


@registry.add("select event_id, count(*) over (partition by user_id order by ts range between interval 6 hour preceding and current row)::bigint as recent from events")
def t5_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sliding_counts(_events(spark, sf_dir), ["user_id"], "ts", 6 * 3600).select("event_id", "recent")


@registry.add("select event_type, strftime(ts, '%Y-%m-%d') as day, count(*) filter (where value >= 10)::bigint as ok, count(*) filter (where value < 10)::bigint as failed from events group by 1, 2")
def a17_t6_daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _events(spark, sf_dir).groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return by.agg(F.count_if(F.col("value") >= 10).alias("ok"), F.count_if(F.col("value") < 10).alias("failed"))


@registry.add(
    "with last as (select user_id, max(ts) as t, arg_max(value, (ts, event_id)) as v from events group by 1)"
    " select user_id, case when user_id % 10 = 0 then 'paused' when v < 1 then 'failing' when timestamp '2024-01-31' < t + interval 1 day then 'up' when timestamp '2024-01-31' < t + interval 2 day then 'late' else 'down' end as status from last"
)
def c41_x26_monitor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service is late a day after its last check-in and down after two."""
    from archivolt.operators.monitor import status

    last = _events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("t"), F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    paused, ok = F.col("user_id") % 10 == 0, F.col("v") >= 1
    return last.select("user_id", status(paused, F.col("t"), ok, F.col("t"), F.lit(86400), F.lit(NOW).cast("timestamp")).alias("status"))


@registry.add(
    "with d as (select unnest(generate_series(date '2024-01-17', date '2024-01-30', interval 1 day))::date as day), s as (select distinct event_type from events)"
    " select event_type, day::varchar as day, count(e.event_id)::bigint as n from s cross join d left join (select *, ts::date as d2 from events where event_type is not null) e on e.d2 = d.day and e.event_type = s.event_type group by 1, 2".replace(
        "select event_type, day", "select s.event_type, day"
    )
)
def c57_dense_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen days for every service, days without a check-in too."""
    from archivolt.operators.monitor import dense_days

    return dense_days(_events(spark, sf_dir), "event_type", "ts", "2024-01-30", 14).withColumn("day", F.col("day").cast("string"))


@registry.add(
    "with f as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from events where value < 1) select event_type, event_id from f where rn <= 3"
)
def w8_newest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return _events(spark, sf_dir).where("value < 1").withColumn("rn", F.row_number().over(order)).where("rn <= 3").select("event_type", "event_id")


@registry.add(
    "with f as (select user_id, min(ts) as failed from events where event_type = 'error' group by 1), o as (select user_id, max(ts) as last_out from events where event_type = 'purchase' group by 1)"
    " select e.event_id, coalesce(o.last_out > e.ts, false) as answered from events e left join o using (user_id) where e.event_type = 'error'"
)
def j10_answered_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    last = rows.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last_out"))
    return rows.where("event_type = 'error'").join(last, "user_id", "left").select("event_id", F.coalesce(F.col("last_out") > F.col("ts"), F.lit(False)).alias("answered"))


@registry.add(
    "with r as (select o_orderkey, list_filter([case when o_orderdate < timestamp '1996-01-01' then 'overdue' end, case when o_totalprice > 400000 then 'large' end, case when o_orderstatus = 'P' then 'waiting' end], lambda x: x is not null) as reasons from orders)"
    " select o_orderkey, reasons[1] as reason, list_position(['overdue', 'waiting', 'large'], reasons[1])::bigint as place from r where len(reasons) > 0"
)
def c39_l7_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason a work item asks for attention, and its place in a fixed order."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    given = F.array_compact(
        F.array(F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "overdue"), F.when(F.col("o_totalprice") > 400000, "large"), F.when(F.col("o_orderstatus") == "P", "waiting"))
    )
    found = rows.select("o_orderkey", given.alias("reasons")).where(F.size("reasons") > 0).withColumn("reason", F.col("reasons")[0])
    ranks = F.array(F.lit("overdue"), F.lit("waiting"), F.lit("large"))
    return found.select("o_orderkey", "reason", F.array_position(ranks, F.col("reason")).cast("long").alias("place"))


@registry.add(
    archive.ctes("message") + ", u as (select from_address, f, case f when 'topic' then coalesce(subject, '') = '' when 'list' then list_id is null else from_name is null end as open from message, (select unnest(['topic', 'list', 'name']) as f) where from_address is not null)"
    " select from_address, count(*) filter (where open)::bigint as unsettled, count(*)::bigint as cells from u group by 1 having count(*) filter (where open) >= 3"
)
def c18_j12_unsettled_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of mail by how many of their fields are still unsettled."""
    rows = archive.messages(spark, sf_dir).where("from_address is not null")
    open_ = F.array(F.coalesce("subject", F.lit("")) == "", F.col("list_id").isNull(), F.col("from_name").isNull())
    cells = rows.select("from_address", F.explode(open_).alias("open"))
    return cells.groupBy("from_address").agg(F.count_if("open").alias("unsettled"), F.count("*").alias("cells")).where("unsettled >= 3")


@registry.add(
    "with i as (select l_suppkey, l_shipdate + interval 9 hour as s, l_shipdate + interval 9 hour + to_hours(cast(l_linenumber * 7 as int)) as e from lineitem), d as (select cast(unnest(generate_series(date '1997-03-01', date '1997-03-10', interval 1 day)) as date) as day),"
    " c as (select l_suppkey, day, greatest(s, day::timestamp) as s, least(e, day::timestamp + interval 1 day) as e from i join d on s < day::timestamp + interval 1 day and e > day::timestamp),"
    " b as (select *, max(e) over (partition by l_suppkey, day order by s, e rows between unbounded preceding and 1 preceding) as m from c)"
    " select l_suppkey, day::varchar as day, sum(greatest(0, epoch(e) - greatest(epoch(s), coalesce(epoch(m), epoch(s)))))::double as seconds from b group by 1, 2"
)
def c38_day_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    start = F.col("l_shipdate") + F.make_dt_interval(hours=F.lit(9))
    timed = rows.select("l_suppkey", start.alias("s"), (start + F.make_dt_interval(hours=(F.col("l_linenumber") * 7).cast("int"))).alias("e"))
    return G.day_load(timed, ["l_suppkey"], "s", "e", "1997-03-01", "1997-03-10").withColumn("day", F.col("day").cast("string"))


@registry.add(archive.ctes("message") + " select id from message where is_automated and id not in (select l_orderkey from lineitem where l_returnflag = 'R' and l_linenumber >= 3)")
def c36_unread_by_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine mail that the extractor's present version has yet to read."""
    done = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("message_id"), F.col("l_returnflag").alias("extractor"), F.col("l_linenumber").alias("version"))
    return G.unread(archive.messages(spark, sf_dir).where("is_automated"), done, "R", 3).select("id")
