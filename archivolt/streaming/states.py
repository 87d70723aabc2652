"""Streams with a state of their own per key: capped session windows and silent services.

Both keep one small value per key in RocksDB and set timers on the watermark, so
a replay tells the same; a key's state goes when nothing can follow from it any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_SETTING = "spark.sql.streaming.stateStore.providerClass"


def _stateful(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """The processor over a stream; processors of this kind need the RocksDB store, which the session's streams then use."""
    rows.sparkSession.conf.set(PROVIDER_SETTING, PROVIDER)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def _micros(at: pd.Series) -> list[int]:
    """Microseconds, all that a timestamp holds: a float of seconds isn't exact, and rows of one millisecond have an order."""
    return pd.to_datetime(at).astype("datetime64[us]").astype("int64").to_list()


def _millis(at: pd.Series) -> list[int]:
    return [x // 1000 for x in _micros(at)]


class _Timed(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.SCHEMA)

    def alarm(self, at: int, mark: int) -> None:
        """One timer a key: at a time, or as soon as the watermark moves."""
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(at, mark + 1))

    def close(self) -> None:
        pass


class CappedWindows(_Timed):
    """Session windows that are split after so many rows."""

    SCHEMA = "last long, part long, first string, size long"

    def __init__(self, key: str, at: str, id_: str, gap: int, cap: int):
        self.key, self.at, self.id, self.gap, self.cap = key, at, id_, gap * 1000, cap

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        batch = pd.concat(list(rows))
        batch = batch.assign(__at=_micros(batch[self.at])).sort_values(["__at", self.id])
        last, part, first, size = self.value.get() if self.value.exists() else (None, 0, "", 0)
        windows, parts = [], []
        for at, id_ in zip(batch["__at"], batch[self.id]):
            if last is None or at // 1000 - last // 1000 > self.gap:
                part, first, size = 0, str(id_), 0
            elif size == self.cap:
                part, size = part + 1, 0
            size, last = size + 1, at if last is None else max(last, at)
            windows.append(first)
            parts.append(part)
        self.value.update((last, part, first, size))
        self.alarm(last // 1000 + self.gap + 1, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({self.key: key[0], self.id: batch[self.id].to_list(), "window": windows, "part": parts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.value.clear()  # whatever is not late by now starts a new window
        return iter(())


class Silence(_Timed):
    """Whether a service has missed its check-in by one grace, and by two."""

    SCHEMA = "last long, told boolean"

    def __init__(self, key: str, at: str, every: int, grace: int):
        self.key, self.at, self.step, self.rest = key, at, every * 1000, grace * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, told = self.value.get() if self.value.exists() else (0, False)
        newest = max([last, *(x for batch in rows for x in _millis(batch[self.at]))])
        self.value.update((newest, told and newest == last))
        self.alarm(newest + self.step + self.rest, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.value.exists():
            return
        mark = timerValues.getCurrentWatermarkInMs()
        last, told = self.value.get()
        down = mark >= last + self.step + 2 * self.rest
        if down:
            self.value.clear()
        else:
            self.value.update((last, True))
            self.alarm(last + self.step + 2 * self.rest, mark)
        if down or not told:
            yield pd.DataFrame({self.key: [key[0]], "last": [pd.Timestamp(last, unit="ms")], "status": ["down" if down else "late"]})


def capped_windows(rows: DataFrame, *, key: str, at: str, id_: str, gap: int, cap: int, late: str = "0 seconds") -> DataFrame:
    """(key, id, window, part): each row's session, named by its first id, and its part of at most ``cap`` rows.

    A session ends after a gap of more than ``gap`` seconds.  Rows of a key come in
    order of time over the batches, as a reader of folders by day gives them; within a batch they
    are sorted by time, then id, and one that comes behind a later one joins the open session.
    """
    found = dict(rows.dtypes)
    return _stateful(rows.select(key, id_, at).withWatermark(at, late), key, CappedWindows(key, at, id_, gap, cap), f"{key} {found[key]}, {id_} {found[id_]}, window string, part long")


def silences(checkins: DataFrame, *, every: int, grace: int, key: str = "service", at: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(key, last, status): a service that keeps silent is late a grace after its next check-in was due, down two graces after.

    The state is one time per service; a service that is down loses it until it checks in again.
    """
    return _stateful(checkins.select(key, at).withWatermark(at, late), key, Silence(key, at, every, grace), f"{key} string, last timestamp, status string")
