"""Membership graphs: descendants, trees with exclusions, members, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.session import shared_dir

#: Levels of nesting that are followed; deeper graphs are an error, not a shorter answer.
MOST_DEPTH = 64


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to = path
    return made


def removed(*tables: DataFrame) -> None:
    """Remove written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _too_deep(most_depth: int) -> RecursionError:
    return RecursionError(f"the graph goes deeper than most_depth={most_depth}")


def descendants(edges: DataFrame, roots: DataFrame, *, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(id, depth): everything below the roots, roots included, each once at its least depth."""
    found = frontier = written(roots.select("id").distinct().withColumn("depth", F.lit(0)), "descendants")
    for depth in range(1, most_depth + 2):
        below = edges.join(frontier.select(F.col("id").alias("parent")), "parent").select(F.col("child").alias("id")).distinct()
        frontier = written(below.join(found, "id", "left_anti").withColumn("depth", F.lit(depth)), "descendants")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise _too_deep(most_depth)


def reachable(edges: DataFrame, roots: DataFrame, *, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(root, id): what lies below each root, the root included, each pair once; a ring ends by itself."""
    found = frontier = written(roots.select("root", F.col("root").alias("id")).distinct(), "reachable")
    for _ in range(most_depth + 1):
        below = edges.join(frontier.select("root", F.col("id").alias("parent")), "parent").select("root", F.col("child").alias("id")).distinct()
        frontier = written(below.join(found, ["root", "id"], "left_anti"), "reachable")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise _too_deep(most_depth)


def tree(edges: DataFrame, roots: DataFrame, *, excluded: list[int] | None = None, most_depth: int = MOST_DEPTH) -> DataFrame:
    """(id, depth, path): every way down that meets no node twice and no excluded one."""
    level = written(roots.select("id", F.lit(0).alias("depth"), F.array("id").alias("path")), "tree")
    found = level
    for _ in range(most_depth + 1):
        step = edges.join(level.withColumnRenamed("id", "parent"), "parent").where(~F.array_contains("path", F.col("child")))
        if excluded:
            step = step.where(~F.col("child").isin(excluded))
        level = written(step.select(F.col("child").alias("id"), (F.col("depth") + 1).alias("depth"), F.array_append("path", F.col("child")).alias("path")), "tree")
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise _too_deep(most_depth)


def would_cycle(edges: DataFrame, child: int, parent: int) -> bool:
    """Whether putting ``child`` under ``parent`` closes a ring."""
    spark = edges.sparkSession
    return not descendants(edges, spark.createDataFrame([(child,)], "id long")).where(F.col("id") == parent).isEmpty()


def members(ways: dict[str, DataFrame], excluded: DataFrame) -> DataFrame:
    """(id, via): members by any way, less the excluded; the first way by name is told."""
    rows = None
    for via, ids in ways.items():
        part = ids.select("id", F.lit(via).alias("via"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(excluded.select("id"), "id", "left_anti").groupBy("id").agg(F.min("via").alias("via"))


def _to_the_top(near: DataFrame) -> DataFrame:
    """(id, root) of a forest (id, root): ways up are doubled until every root is its own."""
    while True:
        above = near.select(F.col("id").alias("root"), F.col("root").alias("top"))
        made = written(near.join(above, "root").select("id", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), "roots")
        removed(near)
        if made.where("moved").isEmpty():
            return made.select("id", "root")
        near = made.select("id", "root")
        near.written_to = made.written_to


def connected(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(id, root): each node with the smallest node it is connected to.

    Every round hangs nodes on their smallest neighbour, follows these ways to
    their tops, and goes on with the edges between tops alone, at most half as many
    nodes; rounds are joins over edges, never a collected component.
    """
    low, high = F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")
    links = written(edges.where("a is not null and b is not null").select(low, high).distinct(), "links")
    rounds = []
    for _ in range(most_rounds):
        sides = links.select(F.explode(F.array("low", "high")).alias("id"), F.col("low").alias("root"))
        root = _to_the_top(written(sides.groupBy("id").agg(F.min("root").alias("root")), "roots"))
        rounds.append(root)
        of = lambda c: root.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        ends = links.where("low <> high").join(of("low"), "low").join(of("high"), "high").where("low_root <> high_root")
        left = written(ends.select(F.least("low_root", "high_root").alias("low"), F.greatest("low_root", "high_root").alias("high")).distinct(), "links")
        removed(links)
        links = left
        if links.isEmpty():
            found = rounds.pop()
            while rounds:
                found = rounds.pop().join(found.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
            return found
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root) after new edges (a, b): what ``connected`` over all edges so far would give.

    Only the new edges are walked: their ends are replaced by the roots they have
    already, the small graph between roots is connected, and labels follow the root
    they merged into.  The earlier edges aren't read again.
    """
    both = edges.where("a is not null and b is not null").select("a", "b")
    known = labels.select("id", "root")
    ends = both.select(F.col("a").alias("id")).unionByName(both.select(F.col("b").alias("id"))).distinct()
    rooted = written(ends.join(known, "id", "left").withColumn("root", F.coalesce("root", "id")), "ends")
    of = lambda c: rooted.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
    between = both.join(of("a"), "a").join(of("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
    merged = connected(between).select(F.col("id").alias("root"), F.col("root").alias("into"))
    new = rooted.join(known.select("id"), "id", "left_anti")
    return known.unionByName(new).join(merged, "root", "left").select("id", F.coalesce("into", "root").alias("root"))


def threads_on_arrival(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, thread) of arriving messages, as if they came one by one.

    A message with a provider's thread joins the first of its account with the same;
    another the thread of the earliest received message it refers to among those that came
    before it; else it begins a thread, named by its id.  ``batch``: id, account, message_id,
    provider, refs (an array), received_at, arrived (unique).  ``stored``: the same without refs,
    and thread.  Ties in time go to the earlier arrival, missing times come last;
    threads are followed to their beginning in as many rounds as a chain has doublings.
    """
    columns = ["id", "account", "message_id", "provider", "received_at", "arrived"]
    new = written(batch.select(*columns, "refs"), "arrivals")
    pool = new.select(*columns, F.lit(None).cast(stored.schema["thread"].dataType).alias("thread")).unionByName(stored.select(*columns, "thread"))

    given = new.where("provider is not null")
    first = pool.where("provider is not null").groupBy("account", "provider").agg(F.min_by(F.struct("id", "thread"), "arrived").alias("head"))
    by_provider = given.join(first, ["account", "provider"]).select("id", F.col("head.id").alias("parent"), F.col("head.thread").alias("thread"))

    asked = new.where("provider is null").select("id", "account", "arrived", F.explode(F.array_distinct("refs")).alias("message_id"))
    place = F.struct(F.col("received_at").isNull().alias("late"), "received_at", "before")
    earlier = pool.select("account", "message_id", "received_at", F.col("arrived").alias("before"), F.struct("id", "thread").alias("found"))
    best = asked.join(earlier, ["account", "message_id"]).where("before < arrived").groupBy("id").agg(F.min_by("found", place).alias("found"))
    by_reference = best.select("id", F.col("found.id").alias("parent"), F.col("found.thread").alias("thread"))

    linked = by_provider.unionByName(by_reference)
    alone = new.join(linked.select("id"), "id", "left_anti").select("id", F.col("id").alias("parent"), F.lit(None).cast(stored.schema["thread"].dataType).alias("thread"))
    # a message that begins a thread, or whose thread is stored, is done; others point at one of this batch
    begins = F.when(F.col("parent") == F.col("id"), F.col("id"))
    walk = written(linked.unionByName(alone).select("id", "parent", F.coalesce("thread", begins).alias("thread")), "walk")
    found = done = walk.where("thread is not null").select("id", "thread")
    still = walk.where("thread is null").select("id", "parent")
    # those that wait point at one that waits as well or was done last, so a round reads these alone
    while not still.isEmpty():
        step = written(still.join(done.withColumnRenamed("id", "parent"), "parent", "left").select("id", "parent", "thread"), "step")
        done = step.where("thread is not null").select("id", "thread")
        found = found.unionByName(done)
        left = step.where("thread is null").select("id", "parent")
        above = left.select(F.col("id").alias("parent"), F.col("parent").alias("further"))
        before, still = still, written(left.join(above, "parent", "left").select("id", F.coalesce("further", "parent").alias("parent")), "waiting")
        if hasattr(before, "written_to"):
            removed(before)
    return found
