"""More fields, filters, facets and text functions (F, J3, A4, A9, W10, X, G4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt import archive
from archivolt.functions import text as X
from archivolt.operators import graph, imports, search, values, work
from archivolt.operators import model as P
from archivolt.plans import conditions as C
from archivolt.queries.conditions import RANKED
from archivolt.queries.texts import SKELETON
from archivolt.registry import Registry

registry = Registry()
_M = archive.ctes("message")
_MA = archive.ctes("message", "assignment")


@registry.add(
    f"{archive.ctes('message')}, a as (select l_orderkey as id, list(l_returnflag) as kinds, list(concat('file', l_linenumber, '.pdf')) as names from lineitem group by 1)"
    " select id from message join a using (id) where list_contains(kinds, 'R') and len(list_filter(names, lambda x: starts_with(x, 'file5'))) > 0"
)
def f7_attachment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments by type and name, gathered once per message."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    held = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("attachment_types"), F.collect_set(F.concat(F.lit("file"), "l_linenumber", F.lit(".pdf"))).alias("attachment_names"))
    fields = C.message_fields() | {"attachment_type": C.Field(F.col("attachment_types"), many=True), "attachment_name": C.Field(F.col("attachment_names"), many=True)}
    wanted = [{"field": "attachment_type", "op": "is", "value": "r"}, {"field": "attachment_name", "op": "starts_with", "value": "File5"}]
    return archive.messages(spark, sf_dir).join(held, "id").where(C.rule_column(wanted, fields)).select("id")


@registry.add(f"{_M} select id from message where starts_with(from_address, 'noreply@') or lower(coalesce(precedence, '')) in ('bulk', 'list', 'junk')")
def f8_automated_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("auto_submitted", "precedence", "list_id", "list_unsubscribe", "from_address", "return_path")
    rows = archive.messages(spark, sf_dir).withColumn("reasons", X.automated_reasons(*[F.col(n) for n in names]))
    fields = {"automated_reason": C.Field(F.col("reasons"), many=True)}
    return rows.where(C.rule_column([{"field": "automated_reason", "op": "in", "value": ["noreply-sender", "precedence"]}], fields)).select("id")


@registry.add(f"{_M} select id from message where list_contains(regexp_split_to_array(lower(coalesce(subject, '')), '[^\\p{{L}}\\p{{N}}]+'), 'backup') or len(list_filter(regexp_split_to_array(lower(coalesce(subject, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: starts_with(w, 'invo'))) > 0")
def f9_body_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = X.tokens(F.col("subject"))
    return archive.messages(spark, sf_dir).where(X.all_words(words, ["backup"]) | X.prefix_match(words, ["invo"])).select("id")


@registry.add(f"{_M} select id from message where (starts_with(coalesce(from_address, ''), 'user1') or starts_with(coalesce(from_address, ''), 'noreply')) and list_id is null and is_automated = false and coalesce(size > 5000, false)")
def f21_f22_f24_prefix_set_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = C.Vocabulary(scalars={n: F.col(n) for n in ("from_address", "list_id")}, booleans={"is_automated": F.col("is_automated")}, numbers={"size": F.col("size")})
    wanted = {"all": [{"field": "from_address", "prefix": ["user1", "noreply"]}, {"field": "list_id", "set": False}, {"field": "is_automated", "is": False}, {"field": "size", "gt": 5000}]}
    return archive.messages(spark, sf_dir).where(C.placement_column(wanted, words)).select("id")


@registry.add(
    f"{_M} select id from message where account in ('acc1', 'acc2') and coalesce(account, '') not in ('acc2') and coalesce(lower(from_address), '') not in ('user5@dom5.example.com') and (medium = 'email' and direction in ('in', 'self') or medium <> 'email' and direction in ('out', 'self'))"
)
def f28_f29_accounts_and_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail that came in and chats that went out; the owner's notes to self belong to both."""
    rows = search.select_messages(archive.messages(spark, sf_dir), {"accounts": ["acc1", "acc2"], "exclude_accounts": ["acc2"], "exclude_senders": ["user5@dom5.example.com"]})
    wanted = F.when(F.col("medium") == "email", "in").otherwise("out")
    return rows.where((F.col("direction") == wanted) | (F.col("direction") == "self")).select("id")


@registry.add(archive.ctes("message", "location") + " select id from message where exists (select 1 from location where message_id = id and present and label = 'L2')")
def f32_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = archive.locations(spark, sf_dir).where("present and label = 'L2'").select(F.col("message_id").alias("id"))
    return archive.messages(spark, sf_dir).join(held, "id", "left_semi").select("id")


@registry.add(f"{_MA}{RANKED} select from_address, bool_and(coalesce(e.value = 'Travel', false)) as all_travel, bool_or(coalesce(e.value = 'Travel', false)) as any_travel from message m left join (select * from eff where dimension = 'topic') e on e.message_id = m.id where from_address is not null group by 1")
def f34_grouped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all or any messages of a sender have a value."""
    rows = archive.messages(spark, sf_dir).where("from_address is not null")
    effective = values.effective_message_values(rows, archive.assignments(spark, sf_dir).where("dimension = 'topic'")).select(F.col("message_id").alias("id"), "value")
    held = F.coalesce(F.col("value") == "Travel", F.lit(False))
    return rows.join(effective, "id", "left").groupBy("from_address").agg(F.bool_and(held).alias("all_travel"), F.bool_or(held).alias("any_travel"))


_ITEMS = "with w as (select o_orderkey as id, case o_orderstatus when 'F' then 'done' when 'O' then 'next' else 'blocked' end as status, case when o_custkey % 3 > 0 then o_custkey end as home_id, o_orderkey % 4 = 0 as focus, cast(o_orderdate as date) as due, o_orderpriority as title, 'x' as body from orders)"


@registry.add(f"{_ITEMS} select id, coalesce(status <> 'done' and due < date '1998-01-01', false) as overdue from w where status in ('next', 'blocked') and home_id is null and not focus and contains(lower(title), 'high')")
def f39_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    items = rows.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "next").otherwise("blocked").alias("status"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("home_id"),
        (F.col("o_orderkey") % 4 == 0).alias("focus"),
        F.col("o_orderdate").cast("date").alias("due"),
        F.col("o_orderpriority").alias("title"),
        F.lit("x").alias("body"),
    )
    return work.select_items(items, today="1998-01-01", status=["next", "blocked"], home="none", focus=False, q=" High ").select("id", "overdue")


@registry.add(f"{_MA}, c as (select m.id as message_id, a.dimension, a.value, a.entity_id = m.id as own from message m join assignment a on a.entity_id in (m.id, m.thread_id) where a.status = 'active') select message_id, count(*)::bigint as n, count(*) filter (where own)::bigint as own from c group by 1")
def j3_own_and_thread_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = values.candidates(archive.messages(spark, sf_dir), archive.assignments(spark, sf_dir))
    return rows.groupBy("message_id").agg(F.count("*").alias("n"), F.count_if("own").alias("own"))


@registry.add(f"{_M} select lower(from_address) as sender, count(*)::bigint as n, arg_max(from_name, (coalesce(received_at, timestamp '0001-01-01'), id)) filter (where from_name is not null and from_name <> '') as name from message where from_address is not null group by 1")
def a4_any_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sender's name: the newest that isn't empty, so that a run again says the same."""
    rows = archive.messages(spark, sf_dir).where("from_address is not null")
    name = F.nullif("from_name", F.lit(""))
    at = F.when(name.isNotNull(), F.struct(F.coalesce(F.col("received_at"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), "id"))
    return rows.groupBy(F.lower("from_address").alias("sender")).agg(F.count("*").alias("n"), F.max_by(name, at).alias("name"))


@registry.add(f"{_M} select account, string_agg(concat(medium, '=', n), ',' order by medium) as counts from (select account, medium, count(*) as n from message group by 1, 2) group by 1")
def a9_counts_as_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = archive.messages(spark, sf_dir).groupBy("account", "medium").agg(F.count("*").alias("n"))
    made = counted.groupBy("account").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("medium", "n")))).alias("m"))
    return made.select("account", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@registry.add(
    f"{_MA}, c as (select m.id as message_id, a.*, a.entity_id = m.id as own from message m join assignment a on a.entity_id in (m.id, m.thread_id) where a.status = 'active' and a.dimension = 'topic' and a.source_kind in ('rule', 'human'))"
    " select message_id, value, source_kind from c qualify row_number() over (partition by message_id order by source_kind = 'rule' desc, own desc, created_at desc nulls last, id desc) = 1"
)
def w10_rule_before_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules say of a group's messages, the owner's value where they say nothing."""
    given = archive.assignments(spark, sf_dir).where("dimension = 'topic' and source_kind in ('rule', 'human')")
    place = F.struct((F.col("source_kind") == "rule").cast("int").alias("r"), F.col("own").cast("int").alias("o"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62))).alias("t"), "assignment_id")
    best = values.candidates(archive.messages(spark, sf_dir), given).groupBy("message_id").agg(F.max_by(F.struct("value", "source_kind"), place).alias("v"))
    return best.select("message_id", "v.value", "v.source_kind")


_WORDS = "regexp_split_to_array(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+')"


@registry.add(
    f"{_M} select id, (len(list_filter({_WORDS.format('subject')}, lambda w: w in ('backup', 'user', 'invoice'))) * 1.0::double + len(list_filter({_WORDS.format('from_name')}, lambda w: w in ('backup', 'user', 'invoice'))) * 0.25::double)::double as score from message"
)
def x3_weighted_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = ["backup", "user", "invoice"]
    return archive.messages(spark, sf_dir).select("id", X.weighted_score([(X.tokens(F.col("subject")), 1.0), (X.tokens(F.col("from_name")), 0.25)], asked).alias("score"))


@registry.add(f"{_M} select id from message where subject ilike '%BACKUP%' or from_address ilike '%User10%'")
def x5_literal_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.select_messages(archive.messages(spark, sf_dir), {"q": "BackUp"}).union(search.select_messages(archive.messages(spark, sf_dir), {"q": "user10"})).select("id").distinct()


@registry.add(f"{_M} select id, {SKELETON} as skeleton from message where {SKELETON} in ('invoice # from', 'backup job', '', 'active errors #', 'success backup job')")
def x8_skeleton_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects found by the pattern of a skeleton."""
    rows = archive.messages(spark, sf_dir)
    keys = ["invoice # from", "backup job", "", "active errors #", "success backup job"]
    named = C.first_match([(k, F.rlike(F.coalesce("subject", F.lit("")), F.lit(X.skeleton_regex(k)))) for k in keys])
    return rows.select("id", named.alias("skeleton")).where("skeleton is not null")


@registry.add(f"{_M} select id from message where regexp_matches(coalesce(subject, ''), '(?i)\\bjob [0-9]{{2}}|\\b[A-Z]c[0-9]')")
def x9_regex_dialect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.messages(spark, sf_dir).where(F.rlike(F.coalesce("subject", F.lit("")), F.lit(C.java_regex(r"\mjob [[:digit:]]{2}\M|\m[[:alpha:]]c[[:digit:]]")))).select("id")


_SAID = (
    "case o_orderkey % 7 when 0 then concat('Meet ', cast(cast(o_orderdate as date) as varchar(20))) when 1 then concat('Meet ', cast(o_orderkey % 35 as varchar(9)), '/', cast(o_orderkey % 14 as varchar(9))) when 2 then concat(cast(o_orderkey % 33 as varchar(9)), ' september, ok')"
    " when 3 then 'see http://x.example/?a' when 4 then 'Could you look?' when 5 then 'Please reply by Friday' else null end"
)
_DM = "try_strptime(concat(y, '-', split_part(regexp_extract(said, '\\b([0-3]?[0-9]/[01]?[0-9])\\b', 1), '/', 2), '-', split_part(regexp_extract(said, '\\b([0-3]?[0-9]/[01]?[0-9])\\b', 1), '/', 1)), '%Y-%m-%d')::date"


@registry.add(
    f"with s as (select o_orderkey as id, {_SAID} as said, cast(o_orderdate as date) as d, year(o_orderdate) as y from orders), n as (select *, case id % 7 when 0 then case when y >= 2000 then d end when 1 then {_DM}"
    " when 2 then try_strptime(concat(y, '-9-', id % 33), '%Y-%m-%d')::date end as named from s)"
    " select id, coalesce(named between d and d + 14, false) or coalesce(contains(said, 'by Friday'), false) as deadline from n"
)
def x13_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as id", f"{_SAID} as said", "o_orderdate as at")
    return rows.select("id", X.names_deadline(F.col("said"), F.col("at")).alias("deadline"))


@registry.add(f"with s as (select o_orderkey as id, {_SAID} as said, case when o_orderkey % 5 = 0 then 'Accepterat: möte' when o_orderkey % 5 = 1 then ' Canceled : x' when o_orderkey % 5 = 2 then 'Not accepted: x' end as subject from orders) select id, id % 7 in (4, 5) as asks, id % 5 in (0, 1) as meeting from s")
def x14_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    subject = "case when o_orderkey % 5 = 0 then 'Accepterat: möte' when o_orderkey % 5 = 1 then ' Canceled : x' when o_orderkey % 5 = 2 then 'Not accepted: x' end"
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as id", f"{_SAID} as said", f"{subject} as subject")
    return rows.select("id", X.asks(F.col("said")).alias("asks"), X.meeting_reply(F.col("subject")).alias("meeting"))


@registry.add(
    "with s as (select o_orderkey as id, (o_orderkey % 60) / 100.0E0 as a, (o_custkey % 40) / 100.0E0 as b, (o_orderkey % 50) / 100.0E0 as c from orders), t as (select id, round(b, 6) as machine, round(a + c, 6) as people from s)"
    " select id, case when people > machine then 'people' else 'machine' end as side, greatest(people, machine) as probability, round(abs(people - machine), 6) as margin, greatest(people, machine) >= 0.9 - 1e-9 as decided from t"
)
def x24_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = lambda c, m: (F.col(c) % m) / F.lit(100.0)
    scores = F.create_map(F.lit("person"), part("o_orderkey", 60), F.lit("alert"), part("o_custkey", 40), F.lit("list"), part("o_orderkey", 50), F.lit("none"), F.lit(0.5))
    return rows.select(F.col("o_orderkey").alias("id"), P.boundary(scores, {"person": "people", "list": "people", "alert": "machine"}).alias("b")).select("id", "b.*")


@registry.add(
    f"{_M} select id, split_part(split_part(from_address, '@', 2), '.', -2) as root, case when size < 1024 then concat(size, ' B') when size < 1048576 then printf('%.1f kB', size / 1024.0E0) else printf('%.1f MB', size / 1048576.0E0) end as bytes,"
    " case when id < 48 then concat(greatest(1, id), case when id <= 1 then ' hour' else ' hours' end) else concat(round_even(id / 24.0E0, 0)::bigint, ' days') end as age, round_even(length(coalesce(subject, '')) * 0.345::double, 0)::bigint as tokens from message where from_address is not null"
)
def x30_x33_words_for_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive.messages(spark, sf_dir).where("from_address is not null")
    return rows.select("id", X.domain_root(search.domain()).alias("root"), X.human_bytes(F.col("size")).alias("bytes"), X.age_words(F.col("id") * 3600).alias("age"), X.estimated_tokens(F.col("subject")).alias("tokens"))


@registry.add("with recursive e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 0), d(root, id) as (select r, r from (select unnest([3, 5]::bigint[]) as r) union select root, child from e join d on e.parent = d.id) select c as child, p as parent, c = p or exists (select 1 from d where root = c and id = p) as refused from (select unnest([3, 3, 5, 5, 5]::bigint[]) as c, unnest([6, 4, 5, 11, 2]::bigint[]) as p)")
def g4_refused_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    wanted = spark.createDataFrame([(3, 6), (3, 4), (5, 5), (5, 11), (5, 2)], "child long, parent long")
    return imports.refuses_cycle(wanted, graph.reachable(edges, wanted.select(F.col("child").alias("root"))))
