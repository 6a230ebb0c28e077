"""Keyed state with timers: operators that Structured Streaming's aggregates cannot express.

State of a key is a few numbers whatever its history, kept in RocksDB, so neither memory nor a checkpoint grows with the
number of days seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting returns afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class DayRun:
    """The run of consecutive days that ends at the newest day, in three numbers.

    Bit i of ``seen`` stands for the day i days before ``newest``, for up to ``late`` days; ``below`` is the length of the
    run that ends just before those.  Days may come in any order and repeatedly while they are at most ``late`` days old.
    """

    def __init__(self, late: int, newest: int | None = None, seen: int = 0, below: int = 0):
        self.late, self.newest, self.seen, self.below = late, newest, seen, below

    def add(self, day: int) -> None:
        if self.newest is None:
            self.newest, self.seen = day, 1
        elif day > self.newest:
            ahead = day - self.newest
            for i in range(min(ahead, self.late + 1)):  # the oldest days leave the window
                self.below = self.below + 1 if self.seen >> (self.late - i) & 1 else 0
            if ahead > self.late + 1:
                self.below = 0
            self.seen = (self.seen << ahead if ahead <= self.late else 0) & ((1 << self.late + 1) - 1) | 1
            self.newest = day
        elif self.newest - day <= self.late:
            self.seen |= 1 << (self.newest - day)

    @property
    def length(self) -> int:
        whole = (1 << self.late + 1) - 1
        if self.seen == whole:
            return self.late + 1 + self.below
        missing = ~self.seen & whole
        return (missing & -missing).bit_length() - 1


class StreakState(StatefulProcessor):
    def __init__(self, key: str, late: int):
        self.key, self.late = key, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "newest int, seen long, below long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days: set[int] = set()
        for part in rows:
            days.update(part["day"].unique().tolist())
        state = DayRun(self.late, *self.run.get()) if self.run.exists() else DayRun(self.late)
        for day in sorted(days):
            state.add(int(day))
        self.run.update((state.newest, state.seen, state.below))
        yield pd.DataFrame({self.key: [key[0]], "day": [state.newest], "days": [state.length]})

    def close(self) -> None:
        pass


def streak(stream: DataFrame, time: str, key: str, late: int = 31) -> DataFrame:
    """(key, last_day, days): running length of the consecutive-day run ending at the newest day (update mode).

    Days up to ``late`` days older than the newest one of their key count, in any order; older ones come too late, for
    the run they belong to is only known by its length.  Rows without a time are left out; a missing key is a key.
    """
    if not 0 <= late <= 61:
        raise ValueError("late must be 0 to 61 days")
    kind = stream.schema[key]
    days = stream.where(F.col(time).isNotNull()).select(key, F.unix_date(F.to_date(time)).alias("day"))
    out = T.StructType([T.StructField(key, kind.dataType), T.StructField("day", T.IntegerType()), T.StructField("days", T.LongType())])
    runs = days.groupBy(key).transformWithStateInPandas(StreakState(key, late), out, "Update", "None")
    return runs.select(key, F.date_from_unix_date("day").alias("last_day"), "days")


class GridState(StatefulProcessor):
    """Which slots of each open day arrived; a timer closes the days in order, with or without rows."""

    def __init__(self, key: str, points: int, grace_ms: int):
        self.key, self.points, self.grace_ms = key, points, grace_ms

    def _closes(self, day: int) -> int:
        return (day + 1) * DAY_MS + self.grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "day int")
        self.slots = handle.getMapState("slots", "day int", "seen string")

    def _open(self, day: int) -> None:
        self.next.update((day,))
        self.handle.registerTimer(self._closes(day))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._open(int(initialState["day"].min()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, int] = {}
        for part in rows:
            for day, slot in part[["day", "slot"]].drop_duplicates().itertuples(index=False):
                found[int(day)] = found.get(int(day), 0) | 1 << int(slot)
        if not self.next.exists():
            self._open(min(found))
        first = self.next.get()[0]
        for day, seen in found.items():
            if day >= first:
                old = int(self.slots.getValue((day,))[0], 16) if self.slots.containsKey((day,)) else 0
                self.slots.updateValue((day,), (f"{old | seen:x}",))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        day, reached, short = self.next.get()[0], timerValues.getCurrentWatermarkInMs(), []
        while self._closes(day) <= reached:
            seen = int(self.slots.getValue((day,))[0], 16) if self.slots.containsKey((day,)) else 0
            if seen.bit_count() < self.points:
                short.append((key[0], day, seen.bit_count()))
            self.slots.removeKey((day,))
            day += 1
        self._open(day)
        if short:
            yield pd.DataFrame(short, columns=[self.key, "day", "points"])

    def close(self) -> None:
        pass


def incomplete_grids(stream: DataFrame, roster: DataFrame, points: int, close_minutes: int = 45, time: str = "ts", arrived: str | None = None,
                     slot_seconds: int = 3600, key: str = "asset_id") -> DataFrame:
    """(key, day, points, code): one issue for each day of a roster key whose grid is incomplete when the day closes.

    A day closes ``close_minutes`` after its end.  The clock is the newest ``arrived`` time of any key, and rows count
    whatever their own time until their day closes; without such a column it is the newest ``time``, and rows more than
    ``close_minutes`` behind it are late.  ``roster`` holds ``key`` and ``first_day``: its keys are watched from that day on
    even if they never send a row; a key that is not in it is watched from its first day.  Repeated slots count once; rows
    that come after their day closed change nothing.  Rows without a time are left out.
    """
    clock, delay = (arrived, "0 seconds") if arrived else (time, f"{close_minutes} minutes")
    timed = stream.withColumns({c: F.col(c).cast("timestamp") for c in {clock, time}}).withWatermark(clock, delay)
    rows = timed.where(F.col(time).isNotNull()).select(
        key, clock, F.unix_date(F.to_date(time)).alias("day"), F.floor(F.unix_seconds(time) % 86_400 / slot_seconds).cast("int").alias("slot"))
    start = roster.select(key, F.unix_date(F.to_date("first_day")).alias("day")).groupBy(key)
    out = T.StructType([T.StructField(key, stream.schema[key].dataType), T.StructField("day", T.IntegerType()), T.StructField("points", T.LongType())])
    watch = GridState(key, points, close_minutes * 60_000 if arrived else 0)
    short = rows.groupBy(key).transformWithStateInPandas(watch, out, "Append", "EventTime", initialState=start)
    return short.select(key, F.date_from_unix_date("day").alias("day"), "points", F.lit("DERIVATIVE_CUTOFF_INCOMPLETE").alias("code"))
