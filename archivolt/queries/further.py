"""Checks of conditions, filters from query strings, confusions, splits, headers, timers and kept tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.operators import export, sampling, search
from archivolt.operators import model as P
from archivolt.plans import conditions as C
from archivolt.queries.signals import IMPORTANCE, c4_x25_importance
from archivolt.registry import Registry
from archivolt.session import shared_dir
from archivolt.sources import mail
from archivolt.streaming import jobs

registry = Registry()
_M = archive.ctes("message")

_ASKED = [
    ("a pattern", [{"field": "subject", "op": "matches", "value": r"\m(invoice|order)\M"}], False),
    ("a broken pattern", [{"field": "subject", "op": "matches", "value": "(invoice"}], True),
    ("a broken pattern in a group", [{"any": [{"field": "account", "op": "is", "value": "acc1"}, [{"field": "subject", "op": "matches", "value": "*a"}]]}], True),
    ("no such field", [{"field": "colour", "op": "is", "value": "red"}], True),
    ("no such operator", [{"field": "subject", "op": "near", "value": "x"}], True),
    ("a day that isn't one", [{"field": "received", "op": "before", "value": "1997-13-45"}], True),
    ("a range", [{"field": "received", "op": "after", "value": "1997-01-01"}, {"field": "size", "op": "gt", "value": 5}], False),
]


@registry.add("select * from (values " + ", ".join(f"('{name.replace(chr(39), chr(39) * 2)}', {refused})" for name, _, refused in _ASKED) + ") v(name, refused)")
def f19_condition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which conditions are refused before they are used."""
    rows = archive.messages(spark, sf_dir)
    return spark.createDataFrame([(name, C.problem(rows, asked) is not None) for name, asked, _ in _ASKED], "name string, refused boolean")


#: A condition for every customer, as it is stored, and what it says in words.
_STORED = (
    "case c_custkey % 4 when 0 then concat('{\"field\": \"account\", \"in\": [\"acc', c_nationkey, '\", \"', c_mktsegment, '\"]}')"
    " when 1 then concat('{\"all\": [{\"field\": \"list_id\", \"set\": true}, {\"any\": [{\"use\": \"old\"}, {\"field\": \"age\", \"lt\": ', c_custkey, '}]}]}')"
    " when 2 then concat('{\"field\": \"from_name\", \"prefix\": [\"', c_mktsegment, '\"], \"else\": {\"field\": \"machine\", \"is\": true}}') else '{\"any\": []}' end"
)


@registry.add(
    "select c_custkey as id, case c_custkey % 4 when 0 then concat('account in acc', c_nationkey, ', ', c_mktsegment) when 1 then concat('(list_id set True and (as in old or age lt ', c_custkey, '))')"
    " when 2 then concat('from_name prefix ', c_mktsegment, ', or without it machine is True') else 'never' end as words from customer"
)
def f26_conditions_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored condition of every customer as a sentence."""
    told = F.pandas_udf(lambda c: c.map(lambda text: C.in_words(json.loads(text))), "string")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), told(F.expr(_STORED)).alias("words"))


@registry.add(f"select id from ({IMPORTANCE}) where level in ('high', 'medium')")
def f36_important(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.important(archive.messages(spark, sf_dir), c4_x25_importance(spark, sf_dir)).select("id")


@registry.add(f"{_M} select id from message where medium = 'email' and account = 'acc1' and coalesce(split_part(from_address, '@', 2), '') not in ('dom3.example.com', 'dom4.example.com') and direction in ('in', 'self') and has_attachments")
def f38_query_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search.filters_from("medium=email&account=acc1&exclude_domains=dom3.example.com,dom4.example.com&direction=in&has_attachments=true&q=")
    return search.select_messages(archive.messages(spark, sf_dir), asked).select("id")


_ANSWERS = "select concat('f', (o_custkey % 3)::varchar) as field, o_orderpriority as guess, case when o_orderkey % 10 < 3 then (['1-URGENT', '2-HIGH', '3-MEDIUM'])[1 + o_orderkey % 3] else o_orderpriority end as gold from orders"


@registry.add(
    f"with recursive t as (select field, guess, gold, count(*) as n from ({_ANSWERS}) where guess <> gold group by 1, 2, 3 qualify row_number() over (partition by field order by n desc, guess, gold) <= 4),"
    " e as (select field, guess as a, gold as b from t union select field, gold, guess from t), r(field, x, y) as (select field, a, a from e union select r.field, r.x, e.b from r join e on e.field = r.field and e.a = r.y),"
    " c as (select field, x, min(y) as root from r group by 1, 2), v as (select field, root, string_agg(x, ',' order by x) as values from c group by 1, 2)"
    " select v.field, v.values, sum(t.n)::bigint as items from v join c on c.field = v.field and c.root = v.root join t on t.field = c.field and t.guess = c.x group by 1, 2"
)
def a22_confused_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    other = F.element_at(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM")), (1 + key % 3).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    answers = rows.select(F.concat(F.lit("f"), F.col("o_custkey") % 3).alias("field"), F.col("o_orderpriority").alias("guess"), F.when(key % 10 < 3, other).otherwise(F.col("o_orderpriority")).alias("gold"))
    return P.confused(answers, most=4).select("field", F.array_join("values", ",").alias("values"), "items")


@registry.add(
    "with w as (select o_orderpriority as value, count(*) as n from orders group by 1), x as (select value, n, floor(97 * n / sum(n) over ())::bigint as whole, 97 * n / sum(n) over () - floor(97 * n / sum(n) over ()) as rest from w)"
    " select value, (whole + (row_number() over (order by rest desc, value) <= 97 - sum(whole) over ())::int)::bigint as places from x"
)
def l11_proportional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by largest remainder; only a count per value reaches the driver."""
    weights = {r["value"]: r["n"] for r in spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n")).collect()}
    return spark.createDataFrame(sorted(sampling.split_by_share(weights, 97).items()), "value string, places long")


@registry.add(
    "select concat('<', o_orderkey, '@x>') as message_id, 'Åsa B' as from_name, 'asa@x.example' as from_address, case when 1980 + o_orderkey % 140 between 1990 and 2100 then concat(1980 + o_orderkey % 140, '-07-01 08:00') end as sent_at,"
    " case when o_orderkey % 2 = 0 then 'caf' || chr(233) else 'plain' end as body from orders"
)
def x34_mail_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded names, dates outside the years that are believed, and a character set that isn't known."""
    key = F.col("o_orderkey")
    head = F.concat(
        F.lit("From: =?utf-8?q?=C3=85sa_B?= <ASA@X.example>\nTo: b@y.example\nMessage-ID: <"), key, F.lit("@x>\nDate: 01 Jul "), (F.lit(1980) + key % 140).cast("string"),
        F.lit(" 10:00:00 +0200\nContent-Type: text/plain; charset="), F.when(key % 2 == 0, "x-unknown").otherwise("utf-8"), F.lit("\n\n"), F.when(key % 2 == 0, "café").otherwise("plain"),
    )
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.sha2(head, 256).alias("sha256"), F.lit("m").alias("path"), F.encode(head, "ISO-8859-1").alias("raw"))
    made = mail.parsed(raw.repartition(spark.sparkContext.defaultParallelism, "sha256"))
    return made.select("message_id", "from_name", "from_address", F.date_format("sent_at", "yyyy-MM-dd HH:mm").alias("sent_at"), "body")


@registry.add(
    "with l as (select user_id::varchar as service, epoch_ms(max(ts)) as last from events group by 1), m as (select epoch_ms(max(ts)) as mark from events)"
    " select service, case when mark >= last + 3 * 86400000 then 'down' else 'late' end as status from l, m where mark >= last + 2 * 86400000"
)
def t7_silent_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services that missed their daily check-in by a grace of a day, or two, when the stream ends."""
    base = f"{shared_dir(spark)}/silent-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").cast("string").alias("service"), F.col("ts").cast("timestamp").alias("ts"))
    jobs.to_parquet(jobs.silences(stream, every=86_400, grace=86_400), f"{base}/told", f"{base}/run").awaitTermination()
    return spark.read.schema("service string, last timestamp, status string").parquet(f"{base}/told").select("service", "status")


@registry.add("select o_orderpriority as value, count(*)::bigint as n from orders group by 1")
def t8_remembered_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is computed once for its input, and read the second time."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority")
    folder, made = f"{shared_dir(spark)}/kept-{uuid.uuid4().hex}", []

    def make() -> DataFrame:
        made.append(1)
        return rows.groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))

    for _ in range(2):
        kept = export.remembered(spark, folder, export.fingerprint(rows), make)
    if len(made) != 1:
        raise RuntimeError("the kept table was made again")
    return kept


@registry.add("select event_type, count(*)::bigint as n from events where value > 5 group by 1")
def t9_steps_after_a_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps behind an ingest, one after another: the second reads what the first has written."""
    base = f"{shared_dir(spark)}/steps-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema

    def rules(batch: DataFrame) -> None:
        batch.where("value > 5").select("event_id", "event_type").write.mode("append").parquet(f"{base}/flagged")

    def rollup(_: DataFrame) -> None:
        spark.read.parquet(f"{base}/flagged").groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{base}/rollup")

    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    jobs.ingest(stream, f"{base}/table", f"{base}/run", ["event_id"], then=jobs.in_order(rules, rollup)).awaitTermination()
    return spark.read.schema("event_type string, n long").parquet(f"{base}/rollup")
