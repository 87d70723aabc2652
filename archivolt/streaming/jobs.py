"""Streams over message and event folders: idempotent ingest, rollups, sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from archivolt.streaming.states import capped_windows, silences  # noqa: F401


def event_stream(spark: SparkSession, folder: str, schema: str, *, files: int | None = 16, size: str | None = None) -> DataFrame:
    """A folder of events in batches bounded by a number of files or by their size (such as 64m)."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxBytesPerTrigger", size) if size else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


def daily_rollup(events: DataFrame, *, at: str = "ts", late: str = "1 day") -> DataFrame:
    """(event_type, day, ok, failed): tumbling days behind a watermark."""
    by = events.withWatermark(at, late).groupBy("event_type", F.window(at, "1 day").alias("w"))
    return by.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")).select("event_type", F.to_date("w.start").alias("day"), "ok", "failed")


def sessions(events: DataFrame, *, key: str = "user_id", at: str = "ts", gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(key, started, ended, n): a session ends after a gap longer than ``gap``."""
    made = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n"))
    return made.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def append_new(batch: DataFrame, target: str, keys: list[str]) -> None:
    """Add the rows whose keys the target lacks; running a batch twice changes nothing."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(keys)
    try:
        known = spark.read.parquet(target).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    else:
        fresh = fresh.join(known, keys, "left_anti")
    fresh.write.mode("append").parquet(target)


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: list[str], *, then: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Drain the stream into ``target``, exactly once by key, then run what follows on each batch."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(batch, target, keys)
        if then is not None:
            then(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_order(*steps: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    """One step after another on each batch; one that fails stops those behind it, and the batch is run again."""

    def run(batch: DataFrame) -> None:
        for step in steps:
            step(batch)

    return run


def to_parquet(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
