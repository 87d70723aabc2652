"""Sources, catch-up, cursors and streams over the driver's tables (S, T, X32)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.operators import export, grouping, imports, merge
from archivolt.registry import Registry
from archivolt.session import shared_dir
from archivolt.sources import calendar, chat, mail, notes
from archivolt.streaming import jobs

registry = Registry()


@registry.add("select o_orderkey from orders where o_orderkey <= (select max(l_orderkey) from lineitem where l_returnflag = 'R') and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R') and o_orderkey % 50 <> 0")
def s10_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids up to the cursor that are neither held nor known to fail."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    held = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    failed = orders.where("o_orderkey % 50 = 0")
    cursor = held.agg(F.max("o_orderkey").alias("n")).first()["n"] or 0
    return orders.where(F.col("o_orderkey") <= cursor).join(held, "o_orderkey", "left_anti").join(failed, "o_orderkey", "left_anti")


@registry.add("select account, max(id)::bigint as last_id, count(*)::bigint as n from (select concat('acc', (o_orderkey % 3)::varchar) as account, o_orderkey as id from orders) group by 1")
def s7_c56_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("acc"), (F.col("o_orderkey") % 3).cast("string")).alias("account"), F.col("o_orderkey").alias("id"))
    return imports.cursors(rows, "account", "id")


@registry.add("select event_id, event_type from events")
def t1_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events through a stream into a table, twice: the second run adds nothing."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    for run in ("first", "again"):
        stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
        jobs.ingest(stream, f"{base}/table", f"{base}/{run}", ["event_id"]).awaitTermination()
    return spark.read.parquet(f"{base}/table").select("event_id", "event_type")


# --- sources, stated over the driver's tables


@registry.add(
    "with o as (select o_orderkey as k, o_orderdate as d, unnest([0, 1, 2]) as i from orders) select k::varchar as uid, case when i > 0 then strftime(d + to_days(i::int * 7), '%Y-%m-%d %H:%M') end as occurrence, case when i = 2 and k % 2 = 0 then 'moved' else 'series' end as summary, strftime(d + to_days(i::int * 7) + case when i = 2 and k % 2 = 0 then interval 3 hour else interval 0 hour end, '%Y-%m-%d %H:%M') as starts from o"
)
def s6_series_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series and two of its occurrences under one uid, the second moved by a later version for every other order."""
    day = lambda k: F.date_format(F.col("o_orderdate") + F.make_dt_interval(days=F.lit(7 * k)), "yyyyMMdd")
    event = lambda *parts: F.concat(F.lit("BEGIN:VEVENT\nUID:"), "o_orderkey", *parts, F.lit("\nEND:VEVENT\n"))
    at = lambda name, k, hour: F.concat(F.lit(f"\n{name}:"), day(k), F.lit(f"T{hour}0000Z"))
    plain = F.lit("\nSUMMARY:series")
    moved = event(F.lit("\nSEQUENCE:1\nSUMMARY:moved"), at("RECURRENCE-ID", 2, "00"), at("DTSTART", 2, "03"))
    text = F.concat(
        F.lit("BEGIN:VCALENDAR\n"),
        F.when(F.col("o_orderkey") % 2 == 0, moved).otherwise(""),
        event(plain, at("DTSTART", 0, "00"), F.lit("\nRRULE:FREQ=WEEKLY")),
        *[event(plain, at("RECURRENCE-ID", k, "00"), at("DTSTART", k, "00")) for k in (1, 2)],
        F.lit("END:VCALENDAR\n"),
    )
    made = calendar.entries(spark.read.parquet(f"{sf_dir}/orders.parquet").select(text.alias("text")))
    return made.select("uid", F.date_format("occurrence", "yyyy-MM-dd HH:mm").alias("occurrence"), "summary", F.date_format("starts_at", "yyyy-MM-dd HH:mm").alias("starts"))



@registry.add(
    "select sha256(concat('From: Ann Lee <ANN', o_custkey, '@X.example>', chr(10), 'To: b@y.example, C <c@z.example>', chr(10), 'Subject: Order ', o_orderkey, chr(10), 'Message-ID: <', o_orderkey, '@x>', chr(10), case when o_orderkey % 3 = 0 then concat('References: <1@x> <2@x>', chr(10)) else '' end, chr(10), o_orderstatus, chr(10))) as sha256,"
    " concat('<', o_orderkey, '@x>') as message_id, concat('Order ', o_orderkey) as subject, 'Ann Lee' as from_name, concat('ann', o_custkey, '@x.example') as from_address, 'to:b@y.example,to:c@z.example' as recipients, case when o_orderkey % 3 = 0 then 2 else 0 end::int as refs, concat(o_orderstatus, chr(10)) as body from orders"
)
def s11_s14_mime_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw messages parsed; those with an error would go to quarantine."""
    text = F.concat(
        F.lit("From: Ann Lee <ANN"), "o_custkey", F.lit("@X.example>\nTo: b@y.example, C <c@z.example>\nSubject: Order "), "o_orderkey", F.lit("\nMessage-ID: <"), "o_orderkey", F.lit("@x>\n"),
        F.when(F.col("o_orderkey") % 3 == 0, "References: <1@x> <2@x>\n").otherwise(""), F.lit("\n"), "o_orderstatus", F.lit("\n"),
    )
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.sha2(text, 256).alias("sha256"), F.concat(F.lit("m/"), "o_orderkey").alias("path"), F.encode(text, "UTF-8").alias("raw"))
    raw = raw.repartition(spark.sparkContext.defaultParallelism, "sha256")  # the stated mail comes from one small file; a scan of mail has parts of its own
    good, _ = mail.split_quarantine(mail.parsed(raw))
    people = F.array_join(F.transform("recipients", lambda r: F.concat_ws(":", r["role"], r["address"])), ",")
    return good.select("sha256", "message_id", "subject", "from_name", "from_address", people.alias("recipients"), F.size("refs").alias("refs"), "body")


@registry.add("select concat('<', o_orderkey, '@x>') as message_id, concat(o_orderstatus, chr(10)) as body, o_orderkey % 5 = 0 as retried from orders")
def s15_retried_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals whose fetch failed at first: quarantined, and parsed once their content is there."""
    text = F.concat(F.lit("Message-ID: <"), "o_orderkey", F.lit("@x>\n\n"), "o_orderstatus", F.lit("\n"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.sha2(text, 256).alias("sha256"), F.lit("m").alias("path"), F.encode(text, "UTF-8").alias("raw"))
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "sha256")
    first = rows.withColumn("raw", F.when(F.col("o_orderkey") % 5 > 0, F.col("raw")))
    good, bad = mail.split_quarantine(mail.parsed(first.drop("o_orderkey")))
    again = mail.retried(bad, rows.drop("o_orderkey"))
    return good.select("message_id", "body", F.lit(False).alias("retried")).unionByName(again.select("message_id", "body", F.lit(True).alias("retried")))


@registry.add(
    "with v as (select user_id::varchar as key, row_number() over (partition by user_id order by ts, event_id) as n, count(*) over (partition by user_id) as total, event_id, event_type from events)"
    " select key, max(total)::bigint as versions, arg_max(event_type, n) filter (where n % 4 > 0) as text, bool_or(n % 4 = 0) filter (where n = total) as deleted from v group by 1"
)
def s5_s12_chat_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits and deletions of chat messages: the newest state with the newest text that isn't empty."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("n", F.row_number().over(order))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n"))
    gone = F.col("n") % 4 == 0
    state = F.col("user_id").cast("string")
    body = F.struct(F.lit("text").alias("contentType"), F.when(gone, "").otherwise(F.col("event_type")).alias("content"))
    raw = rows.select(
        state.alias("id"), F.lit("message").alias("messageType"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("createdDateTime"), at.alias("lastEditedDateTime"), F.when(gone, at).alias("deletedDateTime"), F.lit(None).cast("string").alias("replyToId"),
        F.lit(None).cast("struct<user:struct<id:string,displayName:string>,application:struct<displayName:string>>").alias("from"), body.alias("body"), F.array().cast("array<string>").alias("attachments"),
    )
    versions = chat.messages(raw)
    counted = versions.groupBy("key").agg(F.count("*").alias("versions"))
    return chat.latest(versions).join(counted, "key").select("key", "versions", "text", "deleted")


@registry.add(
    "select o_orderkey::varchar as uid, concat('Order, ', o_orderpriority) as summary, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderkey % 2 = 0 as all_day, case when o_orderstatus = 'P' then 'cancelled' when o_orderkey % 3 = 0 then 'free' else 'busy' end as show_as from orders"
    " union all select concat('n', o_orderkey), 'new', strftime(o_orderdate + interval 1 day, '%Y-%m-%d'), false, 'busy' from orders"
)
def s6_calendar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar texts of two events each, one of them in two versions."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    start = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), day)).otherwise(F.concat(F.lit("DTSTART:"), day, F.lit("T101500Z")))
    flags = F.concat(F.when(F.col("o_orderstatus") == "P", "STATUS:CANCELLED\r\n").otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, "TRANSP:TRANSPARENT\r\n").otherwise(""))
    text = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), "o_orderkey", F.lit("\r\nSUMMARY:Order\\, \r\n "), "o_orderpriority", F.lit("\r\n"), start, F.lit("\r\n"), flags, F.lit("END:VEVENT\r\n"))
    at = F.concat(F.lit("DTSTART;TZID=Europe/Stockholm:"), F.date_format(F.date_add("o_orderdate", 1), "yyyyMMdd"), F.lit("T120000\r\n"))
    other = [F.concat(F.lit("BEGIN:VEVENT\r\nUID:n"), F.col("o_orderkey"), F.lit(f"\r\nSUMMARY:{said}\r\nSEQUENCE:{version}\r\n"), at, F.lit("END:VEVENT\r\n")) for said, version in (("new", 2), ("old", 1))]
    text = F.concat(F.lit("BEGIN:VCALENDAR\r\n"), text, *other, F.lit("END:VCALENDAR\r\n"))
    made = calendar.entries(spark.read.parquet(f"{sf_dir}/orders.parquet").select(text.alias("text")))
    return made.select("uid", "summary", F.date_format("starts_at", "yyyy-MM-dd").alias("day"), "all_day", "show_as")


@registry.add("select o_orderkey as id, case o_orderkey % 4 when 0 then 'unsupported' when 1 then 'empty' when 2 then case when o_custkey % 2 = 0 then 'truncated' else 'ok' end else 'ok' end as status, case o_orderkey % 4 when 2 then case when o_custkey % 2 = 0 then 'åäö1-' else 'åäö' end when 3 then left(o_orderpriority, 5) end as text from orders where o_orderkey % 4 < 3 or o_orderpriority = '5-LOW'")
def s13_attachment_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey") % 4
    content = F.when(key == 1, " ").when(key == 2, F.when(F.col("o_custkey") % 2 == 0, "åäö1-URGENT").otherwise("åäö")).otherwise(F.col("o_orderpriority"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 4 < 3 or o_orderpriority = '5-LOW'")
    files = rows.select(F.col("o_orderkey").alias("id"), F.when(key == 0, "application/pdf").otherwise("Text/Plain").alias("type"), F.encode(content, "UTF-8").alias("content"))
    return mail.attachment_text(files, limit=5).select("id", "status", "text")


@registry.add("select o_custkey % 50 as run, count(*)::bigint as seen, count(*) filter (where o_orderkey % (2 + o_custkey % 50) = 0)::bigint as failed, case when count(*) filter (where o_orderkey % (2 + o_custkey % 50) = 0) = 0 then 'ok' when bool_and(o_orderkey % (2 + o_custkey % 50) = 0) then 'failed' else 'partial' end as outcome from orders group by 1")
def s8_run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("o_orderkey") % (2 + F.col("o_custkey") % 50) == 0, "no header")
    return imports.run_outcomes(spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 50).alias("run"), error.alias("error")), "run", "error")


@registry.add("select id, title, fields, body from (select o_orderkey as id, o_orderpriority as title, case when o_orderkey % 2 = 0 then 2 else 0 end::int as fields, concat('Body of ', o_orderkey) as body from orders)".replace("o_orderpriority as title", "case when o_orderkey % 2 = 0 then o_orderpriority end as title"))
def s18_note_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('---\nuid: old\ntitle: "'), "o_orderpriority", F.lit('"\nuid: new\n---\n'))).otherwise(""), F.lit("Body of "), "o_orderkey")
    made = notes.parsed(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("path"), text.alias("text")))
    return made.select(F.col("path").alias("id"), F.col("fields")["title"].alias("title"), F.size("fields").alias("fields"), "body")


@registry.add("select o_orderkey as id, n::int as ordinal, heading, body from orders, (select unnest([0, 1, 2]) as n, unnest([null, 'First', 'Second part']) as heading, unnest(['intro', 'a', 'b']) as body) where n > 0 or o_orderkey % 2 = 0")
def s24_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "intro\n").otherwise(""), F.lit("## First\na\n\n##  Second part \n\nb\n"))
    return notes.sections(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("path"), text.alias("text"))).withColumnRenamed("path", "id")


@registry.add(
    "with a as (select o_custkey, min(o_orderkey) as anchor from orders group by 1), n as (select a.anchor, o.o_orderkey as id, left(o.o_orderpriority, 6) as t, epoch_us(o.o_orderdate) - epoch_us(b.o_orderdate) as away from a join orders b on b.o_orderkey = a.anchor join orders o on o.o_custkey = a.o_custkey),"
    " s as (select *, coalesce(sum(length(t)) over (partition by anchor order by (id <> anchor)::int, abs(away), away, id rows between unbounded preceding and 1 preceding), 0) as spent from n) select anchor, id, left(t, (20 - spent)::bigint) as text from s where spent < 20"
)
def x32_record_nearest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    anchors = rows.groupBy("o_custkey").agg(F.min("o_orderkey").alias("anchor"))
    return export.nearest_first(rows, anchors, "o_custkey", "o_orderdate", "o_orderkey", "o_orderpriority", characters=20, each=6)


@registry.add("select o_custkey, count(*)::bigint as n, max(o_orderdate) as latest from orders group by 1")
def t4_dirty_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows recompute their own threads: the same as computing all."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    summed = lambda r: r.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    late = rows.where("o_orderkey % 20 = 0")
    fresh = summed(rows.join(late.select("o_custkey").distinct(), "o_custkey", "left_semi"))
    return merge.refresh(summed(rows.where("o_orderkey % 20 > 0")), late, fresh, ["o_custkey"])


@registry.add("select event_id from (select *, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) as rn from events) where rn <= 3")
def t3_capped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three events of a user's day."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return grouping.capped(rows, ["user_id", F.to_date("ts")], ["ts", "event_id"], 3).select("event_id")


_PARTS = (
    "with s as (select *, case when lag(ts) over w is null or epoch_ms(ts) - epoch_ms(lag(ts) over w) > 7200000 then 1 else 0 end as st from events window w as (partition by user_id order by ts, event_id)),"
    " n as (select *, sum(st) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from s)"
)


@registry.add(
    f"{_PARTS} select event_id, user_id, first_value(event_id) over w::varchar as window, ((row_number() over w - 1) // 3)::bigint as part from n window w as (partition by user_id, k order by ts, event_id)"
)
def t3_windows_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of two hours in parts of at most three events, from a stream that is drained three times as thirds of the time arrive."""
    base = f"{shared_dir(spark)}/capped-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    bounds = events.agg(F.unix_micros(F.min("ts")).alias("first"), F.unix_micros(F.max("ts")).alias("last")).first()
    # by the whole time, not by days of a month: rows that come behind a later third would be late, and late rows are dropped
    third = F.least(F.floor((F.unix_micros("ts") - F.lit(bounds["first"] or 0)) * 3 / F.lit((bounds["last"] or 0) - (bounds["first"] or 0) + 1)), F.lit(2))
    for arrived in range(3):
        events.where(third == arrived).write.mode("append").parquet(f"{base}/in")
        stream = jobs.event_stream(spark, f"{base}/in", events.schema, files=1_000_000)
        windows = jobs.capped_windows(stream, key="user_id", at="ts", id_="event_id", gap=7200, cap=3)
        jobs.to_parquet(windows, f"{base}/out", f"{base}/run").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@registry.add("select true as within, sum(floor(o_totalprice)::bigint)::bigint as size from orders")
def s9_size_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every batch keeps to both bounds, and that none of the size is lost."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor("o_totalprice").alias("size"))
    made = imports.size_batches(rows, "o_orderkey", 100, "size", 1_000_000)
    batches = made.groupBy("batch").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    return batches.agg(F.bool_and((F.col("n") <= 100) & ((F.col("size") <= 1_000_000) | (F.col("n") == 1))).alias("within"), F.sum("size").alias("size"))
