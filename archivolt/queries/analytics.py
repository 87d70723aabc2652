"""Records, exports and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import export, vectors
from archivolt.registry import Registry

registry = Registry()


@registry.add(
    "with c as (select *, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations),"
    " k as (select conv_id, turn, substr(text, 1, greatest(0, 1000 - before)::bigint) as t from c where before < 1000) select conv_id, count(*)::bigint as turns, sum(length(t))::bigint as chars, sha256(string_agg(t, chr(10) order by turn)) as digest from k group by 1"
)
def k2_w11_budgeted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = export.budgeted(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "text", 1000)
    return export.joined(rows, "conv_id", "turn", "text")


@registry.add("select conv_id, count(*)::bigint as turns, string_agg(role, ',' order by turn) as roles from conversations group by 1")
def c13_k3_thread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.thread_records(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role")


@registry.add(
    "with q as (select vec_id as query, embedding as e from embeddings where vec_id % 20 = 0), p as (select query, vec_id, list_cosine_similarity(q.e::double[], v.embedding::double[]) as s from q join embeddings v on v.vec_id <> q.query),"
    " r as (select *, row_number() over (partition by query order by round(s, 9) desc, vec_id) as rank from p) select query, vec_id, rank::bigint as rank from r where rank <= 5"
)
def v1_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query vectors, in blocks, against all vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return vectors.nearest(rows.where("vec_id % 20 = 0"), rows, k=5).withColumn("rank", F.col("rank").cast("long"))
