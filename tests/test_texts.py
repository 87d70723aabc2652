"""Texts are read once by the queries over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from archivolt.functions import text as X
from archivolt.queries import texts

SF = "/root/testdata/sf0.001"


def test_each_kind_is_masked_from_one_text(spark):
    """Every step read the text before it twice, so the first was made sixteen times."""
    assert str(X.masked(F.col("only_here"))).count("only_here") == 1
    said = "se https://x.example/a?b på +46 70 123 45 67, 4111 1111 1111 1111, SE45 5000 0000 0583 9825 7466 och 811228-9874"
    row = spark.createDataFrame([(said,), (None,), ("",)], "t string").select(X.masked(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in row] == ["se https://x.example/… på [phone], [card], [iban] och [personnummer]", "", ""]


def test_ngrams_read_lines_once(spark):
    plan = texts.registry.queries["x20_line_ngrams"](spark, SF)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation ") == 1
