"""Exact nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query vectors broadcast at a time, and queries and rows that meet in one matrix product.
BLOCK, SIDE, SLICE = 16_384, 1024, 1024


def nearest(queries: DataFrame, rows: DataFrame, *, k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, id, rank): the k most similar other rows of each query by cosine, ties by id.

    Each batch of rows meets a block of queries as one matrix product and keeps
    its own k best, so what is shuffled is k rows a query and batch.
    """
    spark = rows.sparkSession
    held = queries.select(id_, vector).where(F.col(vector).isNotNull()).orderBy(id_)
    out, block = None, []

    def against(block: list) -> DataFrame:
        ids = np.array([b[0] for b in block], np.int64)
        q = np.array([b[1] for b in block], np.float64)
        shared = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def best(batches):
            ids, q = shared.value
            for batch in batches:
                x = np.array(batch[vector].tolist(), np.float64)
                if not len(x):
                    continue
                own = batch[id_].to_numpy(np.int64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                for at in range(0, len(x), SLICE):
                    mine, those = own[at : at + SLICE], x[at : at + SLICE].T
                    for first in range(0, len(q), SIDE):
                        asked = ids[first : first + SIDE]
                        like = np.round(q[first : first + SIDE] @ those, 9)
                        like[asked[:, None] == mine[None, :]] = -np.inf
                        # the k-th best value of each query and all that reach it, so that ties are cut by id
                        least = np.partition(like, -k, axis=1)[:, -k] if like.shape[1] > k else np.full(len(like), -np.inf)
                        who, where = np.nonzero((like >= least[:, None]) & np.isfinite(like))
                        value = like[who, where]
                        order = np.lexsort((mine[where], -value, who))
                        who, where, value = who[order], where[order], value[order]
                        starts = np.searchsorted(who, who)
                        kept = np.arange(len(who)) - starts < k
                        yield pd.DataFrame({"query": asked[who[kept]], id_: mine[where[kept]], "like": value[kept]})

        return rows.select(id_, vector).where(F.col(vector).isNotNull()).mapInPandas(best, f"query long, {id_} long, like double")

    for r in held.toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            part, block = against(block), []
            out = part if out is None else out.unionByName(part)
    if block or out is None:
        part = against(block) if block else spark.createDataFrame([], f"query long, {id_} long, like double")
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("like"), id_)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", id_, "rank")
