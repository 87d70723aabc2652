"""Threads of arriving messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import graph
from archivolt.registry import Registry

registry = Registry()
#: Arrivals of one batch: three batches of the orders by key.
_BATCH = "case when o_orderkey % 7 < 3 then 0 when o_orderkey % 7 < 5 then 1 else 2 end"
_SQL = (
    f"with recursive m as (select o_orderkey as id, o_custkey % 3 as account, concat('<', o_orderkey // 2, '@x>') as message_id, case when o_orderkey % 5 = 0 then concat('p', o_custkey % 40) end as provider, case when o_orderkey % 101 <> 0 then o_orderdate end as received_at, {_BATCH} * 100000000000 + o_orderkey as arrived from orders),"
    " r as (select distinct l_orderkey as id, concat('<', (l_orderkey // 16 * 16 + l_suppkey % 16) // 2, '@x>') as message_id from lineitem),"
    " f as (select account, provider, min_by(id, arrived) as head from m where provider is not null group by 1, 2),"
    " p as (select m.id, f.head as parent from m join f using (account, provider)"
    "  union all select id, parent from (select a.id, b.id as parent, row_number() over (partition by a.id order by b.received_at nulls last, b.arrived) as rn from m a join r on r.id = a.id join m b on b.message_id = r.message_id and b.account = a.account and b.arrived < a.arrived where a.provider is null) where rn = 1),"
    " w(id, top) as (select id, id from m union all select w.id, p.parent from w join p on p.id = w.top where p.parent <> w.top)"
    " select id, top as thread from w where not exists (select 1 from p where p.id = w.top and p.parent <> w.top)"
)


@registry.add(_SQL)
def g5_threads_on_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads of all orders, taken in by three batches; the statement walks them one by one."""
    orders, lines = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = lambda n: F.concat(F.lit("<"), F.expr(f"({n}) div 2"), F.lit("@x>"))
    batch = F.expr(_BATCH)
    rows = orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") % 3).alias("account"),
        name("o_orderkey").alias("message_id"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string"))).alias("provider"),
        F.when(F.col("o_orderkey") % 101 != 0, F.col("o_orderdate")).alias("received_at"),
        (batch * F.lit(100_000_000_000) + F.col("o_orderkey")).alias("arrived"),
        batch.alias("batch"),
    )
    stored = rows.drop("batch").withColumn("thread", F.col("id")).limit(0)
    for k in range(3):
        came = rows.where(F.col("batch") == k).drop("batch")
        theirs = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").where(batch == k)
        refs = theirs.groupBy(F.col("o_orderkey").alias("id")).agg(F.collect_set(name("o_orderkey div 16 * 16 + l_suppkey % 16")).alias("refs"))
        threads = graph.threads_on_arrival(came.join(refs, "id", "left"), stored)
        stored = stored.unionByName(graph.written(came.join(threads, "id"), "stored"))
    return stored.select("id", "thread")


@registry.add(
    "with recursive ed as (select l_orderkey as a, l_orderkey // 8 * 8 + l_suppkey % 8 as b from lineitem), sym as (select a, b from ed union select b, a from ed), n as (select distinct a as x from sym),"
    " r(x, y) as (select x, x from n union select r.x, sym.b from r join sym on sym.a = r.y) select x as id, min(y) as root from r group by 1"
)
def g5_components_by_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References as components, kept up to date over three batches of new references."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    edges = lines.select(F.col("l_orderkey").alias("a"), F.expr("l_orderkey div 8 * 8 + l_suppkey % 8").alias("b"), (F.col("l_linenumber") % 3).alias("batch"))
    labels = edges.select(F.col("a").alias("id"), F.col("a").alias("root")).limit(0)
    for k in range(3):
        labels = graph.written(graph.extended(labels, edges.where(F.col("batch") == k)), "labels")
    return labels
