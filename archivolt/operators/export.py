"""Snapshots and records for other tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def budgeted(rows: DataFrame, key: str, order: str, text: str, characters: int) -> DataFrame:
    """``rows`` cut so that the texts of a key stay within a number of characters, in order."""
    earlier = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.length(text)).over(earlier), F.lit(0))
    held = rows.withColumn("__spent", spent).where(F.col("__spent") < characters)
    return held.withColumn(text, F.substring(text, F.lit(1), (F.lit(characters) - F.col("__spent")).cast("int"))).drop("__spent")


def joined(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, turns, chars, digest) of the joined texts."""
    made = rows.groupBy(key).agg(F.count("*").alias("turns"), F.sum(F.length(text)).alias("chars"), F.sort_array(F.collect_list(F.struct(order, text))).alias("r"))
    return made.select(key, "turns", "chars", F.sha2(F.array_join(F.transform("r", lambda x: x[text]), "\n"), 256).alias("digest"))


def snapshot(tables: dict[str, DataFrame], folder: str, stamp: str) -> list[str]:
    """Each table as Parquet under a folder of its own; an earlier snapshot is never overwritten."""
    paths = []
    for name, rows in sorted(tables.items()):
        path = f"{folder.rstrip('/')}/{stamp}/{name}"
        rows.write.mode("errorifexists").parquet(path)
        paths.append(path)
    return paths


def thread_lines(messages: DataFrame, folder: str, *, key: str = "thread_id", order: str = "received_at", text: str = "text", characters: int = 8000) -> None:
    """A JSON line per thread with its texts within the budget."""
    rows = budgeted(messages, key, order, text, characters)
    made = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("messages"))
    made.write.mode("errorifexists").json(folder)


def backup(tables: dict[str, DataFrame], folder: str, stamp: str) -> None:
    """The owner's own work as compressed JSON lines."""
    for name, rows in sorted(tables.items()):
        rows.write.mode("errorifexists").option("compression", "gzip").json(f"{folder.rstrip('/')}/{stamp}/{name}")


# Days that a backup is kept, and how many are kept whatever their age.
KEPT_DAYS, KEPT_LEAST = 14, 3


def retained(backups: DataFrame, key: str, day: str, *, now: str) -> DataFrame:
    """``backups`` (key, day) with ``kept``: not older than ``KEPT_DAYS``, or one of the newest ``KEPT_LEAST`` of its key; a null day is as old as can be."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(day)))
    young = F.coalesce(F.col(day) >= F.date_sub(F.lit(now).cast("date"), KEPT_DAYS), F.lit(False))
    return backups.distinct().withColumn("__newest", newest).withColumn("kept", young | (F.col("__newest") <= KEPT_LEAST)).drop("__newest")


def prune(spark: SparkSession, folder: str, *, now: str) -> list[str]:
    """Remove the backups of a folder, named by their days (yyyymmdd), that ``retained`` doesn't keep; their names."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(place)]  # a name a day
    rows = spark.createDataFrame([(0, n) for n in names], "folder int, name string").withColumn("day", F.to_date("name", "yyyyMMdd"))
    gone = sorted(r["name"] for r in retained(rows, "folder", "day", now=now).where("not kept").collect())
    for name in gone:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}"), True)
    return gone


def fingerprint(rows: DataFrame) -> str:
    """A digest of a table's rows whatever their order: count, sum and xor of row hashes, in one pass."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    found = rows.agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{found['n']:x}-{int(found['s'] or 0) % 2**64:x}-{(found['x'] or 0) % 2**64:x}"


def remembered(spark: SparkSession, folder: str, stamp: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A computed table kept under the fingerprint of what it was made from; made anew only for a new one."""
    path = f"{folder.rstrip('/')}/{stamp}"
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    made = make()
    made.write.mode("errorifexists").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def nearest_first(rows: DataFrame, anchors: DataFrame, key: str, at: str, id_: str, text: str, *, characters: int, each: int) -> DataFrame:
    """(anchor, id, text): the record around an anchor message within a number of characters.

    ``anchors``: the key and ``anchor``, the id of a message of it.  The anchor comes
    first, then its neighbours by distance in time (earlier before later, then by
    id); every text is cut to ``each`` characters, the last one to what is left.
    """
    placed = anchors.join(rows.select(F.col(key), F.col(id_).alias("anchor"), F.unix_micros(F.col(at).cast("timestamp")).alias("__at")), [key, "anchor"])
    near = rows.join(placed, key).withColumn("__cut", F.substring(F.coalesce(text, F.lit("")), 1, each))
    away = F.unix_micros(F.col(at).cast("timestamp")) - F.col("__at")
    order = Window.partitionBy("anchor").orderBy(F.when(F.col(id_) == F.col("anchor"), 0).otherwise(1), F.abs(away).asc_nulls_last(), away, F.col(id_))
    spent = F.coalesce(F.sum(F.length("__cut")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = near.withColumn("__spent", spent).where((F.col("__spent") < characters) & (F.length("__cut") > 0))
    return held.select("anchor", F.col(id_).alias("id"), F.substring("__cut", F.lit(1), (F.lit(characters) - F.col("__spent")).cast("int")).alias("text"))


def thread_records(rows: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """(key, turns, roles): a record per thread, the roles in order."""
    made = rows.groupBy(key).agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct(order, role))).alias("r"))
    return made.select(key, "turns", F.array_join(F.transform("r", lambda x: x[role]), ",").alias("roles"))


def put(originals: DataFrame, vault: str) -> int:
    """Keep originals (raw) under their digest, each content once; what is there is never written again.  The number of new ones."""
    found = originals.select(F.sha2("raw", 256).alias("sha256"), "raw").groupBy("sha256").agg(F.any_value("raw").alias("raw"))
    known = held(found.sparkSession, vault)
    fresh = found if known is None else found.join(known.select("sha256"), "sha256", "left_anti")
    before = 0 if known is None else known.count()
    fresh.repartitionByRange("sha256").withColumn("lane", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("lane").parquet(vault)
    return held(found.sparkSession, vault).count() - before


def held(spark: SparkSession, vault: str) -> DataFrame | None:
    """What the vault holds (sha256, raw, lane); None before the first original."""
    try:
        return spark.read.schema("sha256 string, raw binary, lane string").parquet(vault)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def get(wanted: DataFrame, vault: str) -> DataFrame:
    """(sha256, raw) of the digests that are held; only their lanes are read."""
    lanes = wanted.withColumn("lane", F.substring("sha256", 1, 2))
    return held(wanted.sparkSession, vault).join(lanes, ["lane", "sha256"], "left_semi").select("sha256", "raw")
