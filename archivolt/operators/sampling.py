"""Reproducible samples: the draw comes from a hash of the row's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def stable(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows in the order of a digest of the key."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def weighted(rows: DataFrame, key: str, weight: Column, n: int) -> DataFrame:
    """n rows without replacement, likelier with more weight: the largest u ** (1 / weight)."""
    u = (F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296.0
    return rows.where(weight > 0).orderBy(F.desc(F.log(u) / weight), key).limit(n)


def stratified(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """About n rows, each stratum by its share and with one row at least."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("__size"))
    total = sizes.agg(F.sum("__size").alias("__total"))
    quota = F.greatest(F.lit(1.0), F.round(F.lit(float(n)) * F.col("__size") / F.col("__total")))
    order = Window.partitionBy(stratum).orderBy(F.sha2(F.col(key).cast("string"), 256), key)
    shares = sizes.join(F.broadcast(total)).select(stratum, quota.alias("__quota"))
    return rows.join(shares, stratum).withColumn("__rn", F.row_number().over(order)).where("__rn <= __quota").drop("__rn", "__quota")


def split_by_share(weights: dict[str, float], n: int) -> dict[str, int]:
    """n whole places by weight, largest remainders first."""
    total = sum(weights.values())
    if total <= 0:
        return dict.fromkeys(weights, 0)
    exact = {k: n * w / total for k, w in weights.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(weights, key=lambda k: (out[k] - exact[k], k))[: n - sum(out.values())]:
        out[k] += 1
    return out
