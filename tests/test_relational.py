"""Joins and aggregates on rows made for them."""

from __future__ import annotations

import duckdb

from archivolt.queries import relational


def test_pairs_are_counted_by_tasks_of_so_many_rows(spark, tmp_path, monkeypatch):
    """The tasks grow with the rows, not with what a shuffle is set to; missing keys meet nobody."""
    con = duckdb.connect()
    con.execute(f"copy (select case when i % 50 = 0 then null else i // 6 end as l_orderkey, case when i % 41 = 0 then null else i * 7 % 17 end as l_suppkey from range(3000) r(i)) to '{tmp_path}/lineitem.parquet'")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    monkeypatch.setattr(relational, "COUNTED_ROWS", 100, raising=False)
    got = relational.registry.queries["j13_shared_threads"](spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = con.execute(relational.registry.oracles["j13_shared_threads"]).fetchall()
    assert sorted(tuple(r) for r in got.select("low", "high", "shared").collect()) == sorted(want) and len(want) > 20
