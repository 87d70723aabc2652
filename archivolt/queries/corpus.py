"""Corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.operators import corpus as K
from archivolt.registry import Registry

registry = Registry()
_TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("doc_id", "id")


@registry.add("with k as (select doc_id as id, sha256(trim(regexp_replace(lower(text), '[\\s]+', ' ', 'g'))) as k from documents) select id, case when min(id) over (partition by k) < id then min(id) over (partition by k) else -1 end as dup_of from k")
def c42_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.exact_copies(_docs(spark, sf_dir)).select("id", F.coalesce("dup_of", F.lit(-1)).alias("dup_of"))


@registry.add()
def c42_x19_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.near_copies(_docs(spark, sf_dir))


@registry.add(
    f"with s as (select doc_id, source, toxic = 1 as target, {_TOKENS} as w from documents join labels using (doc_id)), g as (select doc_id, source, target, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as gram from s where len(w) >= 3),"
    " p as (select gram, source, count(*) filter (where target) as hit, count(*) filter (where not target) as plain from g group by 1, 2)"
    " select gram, sum(hit)::bigint as support, count(*) filter (where hit > 0)::bigint as sources, (max(hit) / sum(hit))::double as top_share from p group by 1 having sum(plain) = 0 and sum(hit) >= 2 and count(*) filter (where hit > 0) >= 2 and max(hit) / sum(hit) <= 0.8"
)
def c43_mined_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "id"), "id")
    return K.mine_phrases(rows.select("id", "source", (F.col("toxic") == 1).alias("target"), "text"), least=2)


@registry.add()
def c43_rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases by greedy cover, with their hits on held-back samples; rounds are beyond SQL, so a test compares with a plain version."""
    rows = _docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "id"), "id")
    return K.rule_candidates(rows.select("id", "source", (F.col("toxic") == 1).alias("target"), "text"), least=2)


@registry.add("select source, lang, count(*) filter (where toxic = 1)::bigint as attacks, count(*) filter (where toxic = 1 and quality = 0)::bigint as caught, count(*) filter (where toxic = 0)::bigint as ordinary, count(*) filter (where toxic = 0 and quality = 0)::bigint as alarms from documents join labels using (doc_id) group by 1, 2")
def c44_screening_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("doc_id", "id"), "id")
    return K.screening_report(rows.withColumn("attack", F.col("toxic") == 1).withColumn("flagged", F.col("quality") == 0), ["source", "lang"])


@registry.add("with l as (select doc_id as id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents) select id, (pos // 60)::bigint as chunk, string_agg(line, chr(10) order by pos) as text from l group by 1, 2")
def s17_text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.chunks(_docs(spark, sf_dir))
