"""What the importance of messages deals out."""

from __future__ import annotations

import re

from archivolt.queries import signals

SF = "/root/testdata/sf0.001"


def test_no_text_is_dealt_out(spark):
    """Texts were carried through four joins; what they say is read before them."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = signals.c5_waiting_counts(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joined = plan[: plan.rindex("Join LeftOuter")]  # what stands above the lowest of the joins
    assert not re.search(r"\b(text|subject)#", joined)
