"""Helpers that several operators share: inputs, written tables, batch sizes."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the word definitions, as the inside of a regex class.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine, and where the session names none, a temporary one is
    made; on a cluster executors would write where nobody reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="archivolt-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: The paths that this process has written and not yet removed.
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str, instead_of: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; the table read back, and its path.

    The lineage ends at the files, so a lost executor costs a re-read and not a
    recomputation.  ``instead_of`` is removed afterwards: a table that nothing
    reads any more.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    if instead_of is not None:
        _remove(spark, instead_of)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``written`` for tables that results read lazily; they stay until ``clear``."""
    return written(df, name)[0]


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _WRITTEN.remove(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this process has written; results that read them have to be consumed before."""
    for path in list(_WRITTEN):
        _remove(spark, path)


def small_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """Bound what a Python worker holds at once.

    Documents can be very long, so an Arrow batch is limited by rows as well as
    by Spark's own byte limit.  Spark reads the setting when the plan runs, so it
    stays set for the session; later queries only get smaller batches by it.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside ``body`` the value is a lambda variable, so uses of it in further
    lambdas don't evaluate the expression again for every element.
    """
    return F.transform(F.array(value), body).getItem(0)


#: Code points of a block of ``blocks``.
BLOCK = 1024


def blocks(text: Column) -> Column:
    """The text in blocks of ``BLOCK`` code points, the last one shorter; for ``cut`` to look places up in."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(held: Column, start: Column, end: Column) -> Column:
    """The code points start..end of the text whose ``blocks`` are held.

    ``substring`` counts from the start of a text, which is quadratic where many
    spans are cut from a long one; here a cut costs a block and its own length.
    """
    first, last = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
    at = lambda i: F.coalesce(F.get(held, i), F.lit(""))
    within = F.substring(at(first), start % BLOCK + 1, end - start)
    across = F.concat(
        F.substring(at(first), start % BLOCK + 1, F.lit(BLOCK)),
        F.array_join(F.slice(held, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
        F.substring(at(last), F.lit(1), end % BLOCK),
    )
    return F.when(first == last, within).otherwise(across)


def running(values: Column, combine) -> Column:
    """The inclusive running ``combine`` of an array, in log2(n) passes of doubled reach.

    An ``aggregate`` that appends to an array copies it at every step.
    """
    size = F.size(values)
    passes = F.array_repeat(F.lit(0), F.ceil(F.log2(F.greatest(size, F.lit(1)))).cast("int"))

    def double(acc: Column, _: Column) -> Column:
        held, reach = acc["held"], acc["reach"]
        further = F.transform(held, lambda x, i: F.when(i < reach, x).otherwise(combine(F.get(held, i - reach), x)))
        return F.struct(further.alias("held"), (reach * 2).alias("reach"))

    return F.aggregate(passes, F.struct(values.alias("held"), F.lit(1).alias("reach")), double, lambda acc: acc["held"])


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
