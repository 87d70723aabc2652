"""Connected components of a link table, by alternating stars.

Each round links all neighbours of a node to the smallest of them (large star),
then all smaller neighbours to the smallest (small star), until nothing moves.
Rounds are joins and minimum aggregations over edges; no component is gathered
in a task, and each round is written to the shared folder, in place of the one
before it, to cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archivolt.llm.common import written


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), roots excluded.

    ``root`` is the smallest node that can be reached.  Null ends, loops and
    repeated edges add nothing; no edges give no rows.
    """
    now = (
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    (now, path), state = written(now, "edges"), None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == state or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = (mark["n"], mark["h"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where(F.col("a") != F.col("b")).distinct()
        small_m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_m, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now, path = written(small.unionByName(small_m.select("a", F.col("m").alias("b"))).distinct(), "edges", instead_of=path)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
