"""Text functions (X)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.functions import text as X
from archivolt.registry import Registry

registry = Registry()
_M = archive.ctes("message")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


SKELETON = (
    "trim(regexp_replace(regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(subject, '')),"
    " '^(\\s*(re|sv|fw|fwd|vb|aw|wg|tr|rv|vs|antw)\\s*(\\[[0-9]+\\]|\\([0-9]+\\))?\\s*:\\s*)+', ''), '\\S*[0-9]\\S*', '#', 'g'), '[^\\p{L}\\p{N}#\\s]+', '', 'g'), '#(\\s+#)+', '#', 'g'), '^\\s*(\\S+(\\s+\\S+){0,2})', 1), '\\s+', ' ', 'g'))"
)


@registry.add(f"{_M} select id, {SKELETON} as skeleton, concat(lower(coalesce(from_address, '')), '|', {SKELETON}) as pattern_key from message")
def x6_x7_subject_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.messages(spark, sf_dir).select("id", X.skeleton(F.col("subject")).alias("skeleton"), X.pattern_key(F.col("from_address"), F.col("subject")).alias("pattern_key"))


#: Local parts of several kinds, so that the list of machine senders decides.
_SENDER = "case id % 11 when 0 then 'newsletter' when 1 then 'Alerts+x' when 2 then 'do_not_reply' when 3 then 'digest-1' when 4 then 'donotreply' when 5 then 'MAILER-DAEMON' when 6 then 'marketing' when 7 then 'robot-7' when 8 then 'bouncesx' else split_part(from_address, '@', 1) end"
_MACHINES = "'^(no[-_.]?reply|do[-_.]?not[-_.]?reply|donotreply|notifications?|notify|alerts?|mailer-daemon|postmaster|bounces?|automated|robot)([+-].*)?$'"


@registry.add(
    f"{_M} select id, concat_ws(',', case when lower(coalesce(auto_submitted, '')) not in ('', 'no') then 'auto-submitted' end, case when lower(coalesce(precedence, '')) in ('bulk', 'list', 'junk') then 'precedence' end,"
    f" case when list_id is not null or coalesce(list_unsubscribe, '') <> '' then 'list' end, case when regexp_matches(lower({_SENDER}), {_MACHINES}) then 'noreply-sender' end, case when trim(coalesce(return_path, '')) = '<>' then 'null-return-path' end) as reasons from message"
)
def x10_automated_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("auto_submitted", "precedence", "list_id", "list_unsubscribe", "from_address", "return_path")
    rows = archive.messages(spark, sf_dir).withColumn("from_address", F.concat(F.expr(_SENDER), F.lit("@dom1.example.com")))
    return rows.select("id", F.array_join(X.automated_reasons(*[F.col(n) for n in names]), ",").alias("reasons"))


@registry.add(
    f"{_M} select id, case when contains(subject, '[Success]') then 'ok' when contains(subject, 'errors: 0') then 'info' when has_attachments then 'failed' else 'info' end as status from message"
)
def x11_c36_event_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("has_attachments"), "the job has failed").otherwise("Failed: 0, 0 warnings")
    rows = archive.messages(spark, sf_dir)
    return rows.select("id", F.when(F.contains("subject", F.lit("errors: 0")), X.event_status(F.col("subject"), F.lit(""))).otherwise(X.event_status(F.col("subject"), body)).alias("status"))


@registry.add(
    f"{_M} select id, case o when 0 then 'Invoice' when 1 then '[Success]' when 2 then '… Down!' when 3 then 'Weekly' when 5 then 'Order' when 6 then '[Ticket #]Active' else '(no subject)' end as system from (select id, id % 8 as o from message)"
)
def x12_system_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.messages(spark, sf_dir).select("id", X.system_key(F.col("subject")).alias("system"))


@registry.add(
    "select doc_id, sha256(trim(regexp_replace(lower(text), '[\\s]+', ' ', 'g'))) as text_key, ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint < 4294967296 * 0.3 as held from documents"
)
def x17_x18_text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 8), 16, 10).cast("long")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(X.normalized(F.col("text")), 256).alias("text_key"), (share < 4294967296 * 0.3).alias("held"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


@registry.add(
    f"with w as (select doc_id, {_WORDS} as w from documents) select doc_id, len(list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))))::bigint as shingles from w"
)
def x19_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("w", X.tokens(F.col("text"))).select("doc_id", F.size(X.shingles(F.col("w"), 5)).cast("long").alias("shingles"))


@registry.add(
    "with l as (select unnest(string_split(text, chr(10))) as line from documents), w as (select list_filter(regexp_split_to_array(lower(line), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from l),"
    " g as (select unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) as gram from w, (select unnest([2, 3, 4]) as n) where len(w) >= n)"
    " select gram, count(*)::bigint as n from g group by 1 having count(*) >= 20"
)
def x20_line_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word n-grams of two to four within lines, those seen twenty times or more."""
    lines = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    grams = lines.select(F.explode(X.let(X.tokens(F.col("line")), lambda w: F.concat(*[_grams(w, n) for n in (2, 3, 4)]))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where("n >= 20")


def _grams(w, n: int):
    """The n-grams of a line's words; a shorter line has none."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))


@registry.add(
    "with v as (select user_id, count(*) filter (where value > 5) as a, count(*) as n from events group by 1), p as (select *, a / n as p from v)"
    " select user_id, greatest(0, (p + 1.645 * 1.645 / (2 * n) - 1.645 * sqrt(p * (1 - p) / n + 1.645 * 1.645 / (4 * n * n))) / (1 + 1.645 * 1.645 / n))::double as bound from p"
)
def x22_wilson_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count_if(F.col("value") > 5).alias("a"), F.count("*").alias("n"))
    return votes.select("user_id", X.wilson_lower(F.col("a"), F.col("n")).alias("bound"))


@registry.add(f"{_M} select id, list_contains(w, 'invoice') and list_contains(w, 'acme') as every, contains(' ' || array_to_string(w, ' ') || ' ', ' status report ') as phrase, len(list_filter(w, lambda x: starts_with(x, 'repo'))) > 0 as prefix from (select id, list_filter(regexp_split_to_array(lower(coalesce(subject, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') as w from message)")
def x1_x2_x4_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir).withColumn("w", X.tokens(F.col("subject")))
    return rows.select("id", X.all_words(F.col("w"), ["invoice", "acme"]).alias("every"), X.phrase_match(F.col("w"), ["status", "report"]).alias("phrase"), X.prefix_match(F.col("w"), X.prefixes("report")).alias("prefix"))


@registry.add("select event_id, json_extract(props, '$.k')::bigint as k from events")
def x28_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@registry.add(
    "with p as (select o_custkey, list(distinct o_orderpriority) filter (where o_orderstatus = 'F') as a, list(distinct o_orderpriority) filter (where o_orderstatus = 'O') as b from orders group by 1), q as (select o_custkey, coalesce(a, []) as a, coalesce(b, []) as b from p)"
    " select o_custkey, case when len(list_distinct(list_concat(a, b))) = 0 then 1.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end::double as overlap from q"
)
def x31_label_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(of("F").alias("a"), of("O").alias("b"))
    return rows.select("o_custkey", X.jaccard(F.col("a"), F.col("b")).cast("double").alias("overlap"))


@registry.add(
    """select doc_id, regexp_replace(text, '(?i)\\b((?:https?|ftp)://|www\\.)([a-z0-9.-]+(?::[0-9]+)?)(?:/[^\\s<>"'')\\]]+|[?#][^\\s<>"'')\\]]*)', '\\1\\2/…', 'g') as masked from documents"""
)
def x16_masked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.masked_urls(F.col("text")).alias("masked"))


@registry.add()
def x16_masked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of masking; checksums are beyond plain SQL, so a test compares it with a plain version."""
    return _docs(spark, sf_dir).select("doc_id", X.masked(F.col("text")).alias("masked"))


@registry.add("select doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 200) as snippet from documents")
def x15_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@registry.add("select o_orderkey, (epoch_us(timestamp '2001-08-02') - epoch_us(o_orderdate)) / 8.64e10 as age_days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month from orders")
def x27_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    age = (F.unix_micros(F.lit(archive.NOW).cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / 8.64e10
    return rows.select("o_orderkey", age.alias("age_days"), F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM-dd").alias("month"))
