"""Work items: selections for a board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the board in order.
STATUSES = ("inbox", "next", "doing", "blocked", "someday", "done")


def overdue(today: Column) -> Column:
    return F.coalesce((F.col("status") != "done") & (F.col("due") < today), F.lit(False))


def select_items(items: DataFrame, *, today: str, status: list[str] | None = None, home: int | str | None = None, focus: bool | None = None, late: bool | None = None, q: str | None = None) -> DataFrame:
    """``items`` with ``overdue``: by status, home ("none": without one), focus, lateness and a literal text in title or body."""
    found = items.withColumn("overdue", overdue(F.lit(today).cast("date")))
    if status:
        unknown = [s for s in status if s not in STATUSES]
        if unknown:
            raise ValueError(f"no status {unknown[0]!r}")
        found = found.where(F.col("status").isin(status))
    if home == "none":
        found = found.where("home_id is null")
    elif home is not None:
        found = found.where(F.col("home_id") == int(home))
    if focus is not None:
        found = found.where(F.col("focus") == focus)
    if late is not None:
        found = found.where(F.col("overdue") == late)
    if q and q.strip():
        asked = F.lit(q.strip().lower())
        found = found.where(F.contains(F.lower("title"), asked) | F.contains(F.lower("body"), asked))
    return found
