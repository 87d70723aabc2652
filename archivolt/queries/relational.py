"""Joins, aggregates, sets, orders, merges and graphs (J, A, U, L, M, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt import archive
from archivolt.operators import graph, merge, sampling
from archivolt.registry import Registry

registry = Registry()
#: Rows whose pairs are counted in one task.
COUNTED_ROWS = 200_000


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@registry.add(
    "select n_name, r_name, count(*)::bigint as n, sum(o_totalprice::decimal(18, 2))::double as total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2"
)
def j1_a1_inner_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    joined = joined.join(_t(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(_t(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@registry.add("select c_custkey, coalesce(n, 0)::bigint as n, coalesce(big, false) as big from customer left join (select o_custkey, count(*) as n, bool_or(o_totalprice > 450000) as big from orders group by 1) on o_custkey = c_custkey")
def j2_a3_outer_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.bool_or(F.col("o_totalprice") > 450000).alias("big"))
    return _t(spark, sf_dir, "customer").join(made, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("big", F.lit(False)).alias("big"))


@registry.add("select o_orderkey, exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') as returned from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_nationkey = 3)")
def j4_j5_semi_and_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").join(_t(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti")
    back = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return orders.join(back, "o_orderkey", "left").select("o_orderkey", F.coalesce("hit", F.lit(False)).alias("returned"))


@registry.add("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 2")
def j7_lateral_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return _t(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(order)).where("rn <= 2").select("o_custkey", "o_orderkey")


@registry.add("select p_partkey, word, pos::bigint as pos from (select p_partkey, unnest(string_split(p_name, ' ')) as word, generate_subscripts(string_split(p_name, ' '), 1) - 1 as pos from part)")
def j8_x29_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


@registry.add(
    "with g as (select o_custkey, list(o_orderkey order by o_orderkey) as members from orders where o_totalprice > 480000 group by 1) select o_orderkey from orders where not exists (select 1 from g where list_contains(members, o_orderkey))"
)
def j9_array_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are in no group's member list: members are exploded and joined on equality."""
    orders = _t(spark, sf_dir, "orders")
    groups = orders.where("o_totalprice > 480000").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("members"))
    return orders.select("o_orderkey").join(groups.select(F.explode("members").alias("o_orderkey")), "o_orderkey", "left_anti")


@registry.add(
    "with r(brand, rx) as (values ('Brand#1', '^red'), ('Brand#2', 'ring$'), ('Brand#3', 'bolt')) select p_partkey, rx from part join r on p_brand = brand and regexp_matches(p_name, '(?i)' || rx)"
)
def j11_regex_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on the brand; the pattern is a residual condition."""
    rules = spark.createDataFrame([("Brand#1", "^red"), ("Brand#2", "ring$"), ("Brand#3", "bolt")], "brand string, rx string")
    return _t(spark, sf_dir, "part").join(F.broadcast(rules), (F.col("p_brand") == F.col("brand")) & F.expr("p_name rlike concat('(?i)', rx)")).select("p_partkey", "rx")


@registry.add(
    "select a.l_suppkey as low, b.l_suppkey as high, count(distinct a.l_orderkey)::bigint as shared from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_suppkey < b.l_suppkey group by 1, 2 having count(distinct a.l_orderkey) >= 4"
)
def j13_shared_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers that meet in at least four orders."""
    lines = _t(spark, sf_dir, "lineitem").where("l_orderkey is not null and l_suppkey is not null").select("l_orderkey", "l_suppkey")
    # a task counts the pairs of so many rows, however few partitions a shuffle has; nearly every pair is another one
    parts = max(1, -(-lines.count() // COUNTED_ROWS))
    each = lines.repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("met"))
    pairs = each.select("met", F.explode("met").alias("low")).select("low", F.explode(F.filter("met", lambda x: x > F.col("low"))).alias("high"))
    return pairs.repartition(parts, "low", "high").groupBy("low", "high").agg(F.count("*").alias("shared")).where("shared >= 4")


@registry.add("select user_id, event_type, arg_max(value, (ts, event_id)) as value from events group by 1, 2")
def j16_latest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@registry.add(archive.ctes("message") + " select coalesce(thread_id, -id) as unit, count(*)::bigint as n from message group by 1")
def j17_units_with_null_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.messages(spark, sf_dir).groupBy(F.coalesce("thread_id", -F.col("id")).alias("unit")).agg(F.count("*").alias("n"))


@registry.add(
    "select o_custkey, count(*) filter (where o_orderstatus = 'F')::bigint as f, avg((o_orderstatus = 'O')::int)::double as open_share, max(o_totalprice)::double as top, quantile_cont(o_totalprice, 0.5)::double as middle,"
    " string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as best from orders group by 1 having count(*) >= 8"
)
def a2_a7_a10_a11_a12_a14_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("f"),
        F.avg((F.col("o_orderstatus") == "O").cast("int")).alias("open_share"),
        F.max("o_totalprice").alias("top"),
        F.percentile("o_totalprice", 0.5).alias("middle"),
        F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("priorities"),
        F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"),
        F.count("*").alias("n"),
    )
    return made.where("n >= 8").drop("n")


@registry.add("select l_orderkey, list(distinct l_suppkey order by l_suppkey)::varchar as suppliers, list(l_partkey order by l_linenumber, l_partkey)::varchar as parts from lineitem group by 1")
def a5_a6_ordered_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = lambda x: F.concat(F.lit("["), F.array_join(x, ", "), F.lit("]"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(written(F.sort_array(F.collect_set("l_suppkey"))).alias("suppliers"), written(ordered).alias("parts"))


@registry.add("with c as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2) select c_nationkey, count(*)::bigint as kinds, (max(n) / sum(n))::double as top_share from c group by 1")
def a13_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _t(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return two.groupBy("c_nationkey").agg(F.count("*").alias("kinds"), (F.max("n") / F.sum("n")).alias("top_share"))


@registry.add("select least(9, greatest(0, floor(l_discount * 100 + 1e-6)))::bigint as bucket, l_returnflag = 'R' as returned, count(*)::bigint as n from lineitem group by 1, 2")
def a15_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col("l_discount") * 100 + 1e-6))).cast("long")
    return _t(spark, sf_dir, "lineitem").groupBy(bucket.alias("bucket"), (F.col("l_returnflag") == "R").alias("returned")).agg(F.count("*").alias("n"))


@registry.add("select user_id, round(sum(case event_type when 'purchase' then 0.6 when 'signup' then 0.3 when 'click' then 0.1 else 0 end * value), 6)::double as mass from events group by 1")
def a21_j14_mass_per_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = spark.createDataFrame([("purchase", 0.6), ("signup", 0.3), ("click", 0.1)], "event_type string, weight double")
    rows = _t(spark, sf_dir, "events").join(F.broadcast(sides), "event_type", "left")
    return rows.groupBy("user_id").agg(F.round(F.sum(F.coalesce("weight", F.lit(0.0)) * F.col("value")), 6).alias("mass"))


@registry.add(archive.ctes("message") + " select split_part(from_address, '@', 2) as domain, strftime(received_at, '%Y') as year, count(*)::bigint as n from message where direction in ('in', 'self') and received_at is not null and from_address is not null group by 1, 2 order by n desc, domain, year limit 12")
def a19_saved_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from archivolt.operators import search

    rows = search.select_messages(archive.messages(spark, sf_dir), search.filters_from("direction=in")).where("received_at is not null and from_address is not null")
    by = rows.groupBy(search.domain().alias("domain"), F.date_format("received_at", "yyyy").alias("year")).agg(F.count("*").alias("n"))
    return by.orderBy(F.desc("n"), "domain", "year").limit(12)


# --- orders and samples


@registry.add(
    "with e as (select o_orderdate as t, 1 as rank, o_orderkey as id from orders union all select l_shipdate, 2, l_orderkey * 10 + l_linenumber from lineitem) select rank, id from e where row(t, rank, id) < row(timestamp '1998-05-01', 2, 50000::bigint) order by t desc, rank desc, id desc limit 40"
)
def l4_merged_stream_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at"), F.lit(1).alias("rank"), F.col("o_orderkey").alias("id"))
    items = _t(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("at"), F.lit(2).alias("rank"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    key = F.struct("at", "rank", "id")
    place = F.struct(F.lit("1998-05-01 00:00:00").cast("timestamp_ntz").alias("at"), F.lit(2).alias("rank"), F.lit(50000).cast("long").alias("id"))
    return orders.unionByName(items).where(key < place).orderBy(F.desc(key)).limit(40).select("rank", "id")


@registry.add("(select o_orderkey, 'above' as side from orders where o_totalprice >= 250000 order by o_totalprice, o_orderkey limit 5) union all (select o_orderkey, 'below' from orders where o_totalprice < 250000 order by o_totalprice desc, o_orderkey limit 5)")
def l6_nearest_to_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders")
    above = rows.where("o_totalprice >= 250000").orderBy("o_totalprice", "o_orderkey").limit(5).select("o_orderkey", F.lit("above").alias("side"))
    return above.unionByName(rows.where("o_totalprice < 250000").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5).select("o_orderkey", F.lit("below").alias("side")))


@registry.add("select o_orderkey from orders order by md5(o_orderkey::varchar), o_orderkey limit 50")
def l8_stable_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stable(_t(spark, sf_dir, "orders"), "o_orderkey", 50).select("o_orderkey")


@registry.add(
    "with u as (select o_orderkey, o_totalprice, (('0x' || substr(md5(o_orderkey::varchar), 1, 8))::bigint + 0.5) / 4294967296.0 as u from orders) select o_orderkey from u order by ln(u) / o_totalprice desc, o_orderkey limit 50"
)
def l9_weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted(_t(spark, sf_dir, "orders"), "o_orderkey", F.col("o_totalprice"), 50).select("o_orderkey")


@registry.add(
    "select o_orderkey from (select *, row_number() over (partition by o_orderpriority order by sha256(o_orderkey::varchar), o_orderkey) as rn, count(*) over (partition by o_orderpriority) as n, count(*) over () as total from orders) where rn <= greatest(1, round(200.0 * n / total))"
)
def l10_stratified_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(_t(spark, sf_dir, "orders"), "o_orderpriority", "o_orderkey", 200).select("o_orderkey")


# --- sets and merges


@registry.add("select o_custkey as k from orders where o_totalprice > 490000 union select c_custkey from customer where c_nationkey = 1")
def u1_u3_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").where("o_totalprice > 490000").select(F.col("o_custkey").alias("k")).union(_t(spark, sf_dir, "customer").where("c_nationkey = 1").select("c_custkey")).distinct()


@registry.add("select 'order' as kind, count(*)::bigint as n from orders union all select 'line', count(*) from lineitem union all select 'event', count(*) from events")
def u2_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.union_all([_t(spark, sf_dir, t).agg(F.lit(k).alias("kind"), F.count("*").alias("n")) for k, t in (("order", "orders"), ("line", "lineitem"), ("event", "events"))])


@registry.add("select c_custkey from customer except select o_custkey from orders where o_orderstatus = 'F'")
def u4_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey").join(_t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@registry.add(
    "with w as (select p_partkey, string_split(p_name, ' ') as w from part) select p_partkey, list_has_any(w, ['red', 'blue']) as hit, len(list_distinct(list_concat(w, ['red'])))::bigint as joined, len(list_filter(list_distinct(w), lambda x: x <> 'red'))::bigint as without_red from w"
)
def u5_array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split("p_name", " ")
    red = F.array(F.lit("red"))
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        F.arrays_overlap(words, F.array(F.lit("red"), F.lit("blue"))).alias("hit"),
        F.size(F.array_union(words, red)).cast("long").alias("joined"),
        F.size(F.array_except(words, red)).cast("long").alias("without_red"),
    )


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("p"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_totalprice")).alias("v"))
    fresh = rows.where("id % 3 > 0").unionByName(rows.where("id % 50 = 0").withColumn("id", -F.col("id") - 1)).withColumn("v", F.when(F.col("id") % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("v")))
    return rows, fresh


_PAIR = (
    "with cur as (select o_orderkey as id, o_orderpriority as p, case when o_orderkey % 7 > 0 then o_totalprice end as v from orders),"
    " inc as (select id, p, case when id % 5 = 0 then null else v end as v from (select id, p, v from cur where id % 3 > 0 union all select -id - 1, p, v from cur where id % 50 = 0))"
)


@registry.add(
    f"{_PAIR} select coalesce(i.id, c.id) as id, case when i.id is null then c.v else i.v end as v, case when c.id is null then 'added' when i.id is null then 'kept' when c.p is distinct from i.p or c.v is distinct from i.v then 'changed' else 'unchanged' end as change"
    " from cur c full join inc i on c.id = i.id"
)
def m1_j6_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(*_tables(spark, sf_dir), ["id"]).select("id", "v", "change")


@registry.add(f"{_PAIR} select id, v from cur union all select id, v from inc where id not in (select id from cur)")
def m2_insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.insert_missing(*_tables(spark, sf_dir), ["id"]).select("id", "v")


@registry.add(f"{_PAIR} select id, id not in (select id from inc) as gone from cur")
def m3_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.mark_gone(*_tables(spark, sf_dir), ["id"]).select("id", "gone")


@registry.add(f"{_PAIR} select id, p from cur where not starts_with(p, '1-') union all select id, p from inc where starts_with(p, '1-')")
def m4_replace_own_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, fresh = _tables(spark, sf_dir)
    return merge.replace_own(current, fresh.where(F.startswith("p", F.lit("1-"))), "p", "1-").select("id", "p")


@registry.add("with s as (select user_id, event_type, value, bool_or(value > 100) over (partition by user_id, event_type) as late, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) select user_id, event_type, value, late from s where rn = 1")
def m9_sticky_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").withColumn("late", F.col("value") > 100)
    return merge.sticky_labels(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")], "late").select("user_id", "event_type", "value", "late")


# --- graphs

_TREE = "with recursive e as (select p_partkey as child, p_partkey // 2 as parent from part where p_partkey > 0)"


@registry.add(f"{_TREE}, d(id) as (select 3::bigint union select child from e join d on e.parent = d.id) select id from d")
def g1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    return graph.descendants(edges, spark.createDataFrame([(3,)], "id long")).select("id")


@registry.add(
    f"{_TREE}, d(id, depth, path) as (select 3::bigint, 0, [3::bigint] union all select child, depth + 1, list_append(path, child) from e join d on e.parent = d.id where not list_contains(path, child) and child not in (13, 7)) select id, depth::bigint as depth, path::varchar as path from d"
)
def g2_tree_with_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    found = graph.tree(edges, spark.createDataFrame([(3,)], "id long"), excluded=[13, 7])
    return found.select("id", F.col("depth").cast("long").alias("depth"), F.concat(F.lit("["), F.array_join("path", ", "), F.lit("]")).alias("path"))


@registry.add(
    f"{_TREE}, d(id) as (select 5::bigint union select child from e join d on e.parent = d.id), own as (select p_partkey as id, 'query' as via from part where p_size = 11 and p_partkey < 500), u as (select id, 'nested' as via from d union all select id, via from own)"
    " select id, min(via) as via from u where id not in (select p_partkey from part where p_brand = 'Brand#1') group by 1"
)
def g3_c45_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    edges = part.where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.expr("p_partkey div 2").alias("parent"))
    nested = graph.descendants(edges, spark.createDataFrame([(5,)], "id long"))
    queried = part.where("p_size = 11 and p_partkey < 500").select(F.col("p_partkey").alias("id"))
    excluded = part.where("p_brand = 'Brand#1'").select(F.col("p_partkey").alias("id"))
    return graph.members({"nested": nested.select("id"), "query": queried}, excluded)


@registry.add(
    "with recursive ed as (select l_orderkey as a, l_orderkey // 8 * 8 + l_suppkey % 8 as b from lineitem), sym as (select a, b from ed union select b, a from ed), n as (select distinct a as x from sym),"
    " r(x, y) as (select x, x from n union select r.x, sym.b from r join sym on sym.a = r.y) select x as id, min(y) as root from r group by 1"
)
def g5_thread_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between messages as threads: connected components."""
    rows = _t(spark, sf_dir, "lineitem")
    return graph.connected(rows.select(F.col("l_orderkey").alias("a"), F.expr("l_orderkey div 8 * 8 + l_suppkey % 8").alias("b")))
