"""The corpus pipeline: five operators over ``documents``, one after another.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept.  All but the last return the columns of the documents, whatever further
columns these have; the last returns the places of their pieces in training
sequences.  Equal rows fare alike, and every stage leaves an empty table empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.llm import decontaminate, language, packing, pii, simhash
from archivolt.llm.common import materialize, table


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` after a stage that changes texts; null texts keep theirs."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go, those of null texts and without a letter among them."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays; rows with a null id stay."""
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are little else go; null and empty texts stay as they are."""
    return _recounted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind; null and empty texts stay as they are."""
    return _recounted(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its training sequence and offset; a null or empty text is one piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("personal_data", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the model, nor the fingerprints, nor the tokens: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
