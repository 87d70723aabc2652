"""Backups that stay."""

from __future__ import annotations

import os

from archivolt.operators import export


def test_prune_keeps_two_weeks_and_the_newest_three(spark, tmp_path):
    rows = spark.createDataFrame([(1,)], "id int")
    for stamp in ("20240101", "20240105", "20240110", "20240220", "20240301"):
        export.backup({"t": rows}, str(tmp_path / "b"), stamp)
    assert export.prune(spark, str(tmp_path / "b"), now="2024-03-02") == ["20240101", "20240105"]  # the third newest is old but stays
    assert sorted(os.listdir(tmp_path / "b")) == ["20240110", "20240220", "20240301"]
    assert export.prune(spark, str(tmp_path / "b"), now="2024-03-02") == []


def test_young_backups_all_stay_and_unreadable_days_are_old(spark):
    days = [("a", f"2024-02-{d:02d}") for d in range(10, 25)] + [("b", None), ("b", "2020-01-01"), ("b", "2020-01-02"), ("b", "2020-01-03")]
    rows = spark.createDataFrame(days, "k string, d string").selectExpr("k", "cast(d as date) as d")
    got = export.retained(rows, "k", "d", now="2024-02-24").where("not kept").collect()
    assert [(r["k"], r["d"]) for r in got] == [("b", None)]
