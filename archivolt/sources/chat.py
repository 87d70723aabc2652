"""Chat messages from JSON files with a fixed schema, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "id string, messageType string, createdDateTime timestamp, lastEditedDateTime timestamp, deletedDateTime timestamp, subject string, replyToId string, importance string, "
    "`from` struct<user:struct<id:string,displayName:string>,application:struct<displayName:string>>, body struct<contentType:string,content:string>, "
    "attachments array<struct<contentType:string,contentUrl:string,name:string,content:string>>"
)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(folder)


def stream(spark: SparkSession, folder: str, *, files: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).json(folder)


def messages(raw: DataFrame) -> DataFrame:
    """Message rows; an edit is a row of its own, so a deleted text can be restored from the one before."""
    body = F.when(F.col("body.contentType") == "html", F.regexp_replace("body.content", "<[^>]*>", " ")).otherwise(F.col("body.content"))
    return raw.where("messageType = 'message'").select(
        F.col("id").alias("key"),
        F.coalesce("replyToId", "id").alias("thread"),
        F.coalesce("from.user.displayName", "from.application.displayName").alias("from_name"),
        F.col("from.application").isNotNull().alias("is_automated"),
        F.col("createdDateTime").alias("received_at"),
        F.coalesce("deletedDateTime", "lastEditedDateTime", "createdDateTime").alias("version_at"),
        F.col("deletedDateTime").isNotNull().alias("deleted"),
        F.when(F.trim(body) != "", F.trim(body)).alias("text"),
        F.coalesce(F.size("attachments"), F.lit(0)).alias("attachments"),
    )


def latest(rows: DataFrame) -> DataFrame:
    """A row per message: its newest state with the newest text that isn't empty."""
    newest = F.max_by(F.struct("thread", "from_name", "is_automated", "received_at", "deleted", "attachments"), "version_at")
    text = F.max_by("text", F.when(F.col("text").isNotNull(), F.col("version_at")))
    return rows.groupBy("key").agg(newest.alias("n"), text.alias("text")).select("key", "n.*", "text")
