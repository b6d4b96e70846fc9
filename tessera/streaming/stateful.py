"""Streams that keep typed state for a key and let it expire: quotas, limiters, chat sessions, retention.

Each processor keeps list state in the state store; timers on event
time clear what is no longer needed, so a store holds the keys of the recent past
and not of all time.  Keys share a fixed number of buckets, each of which reads
and writes its state in a few calls a batch, however many keys it has: a call for
each key would cost more than all the rest.  Where the order of events matters,
they wait in state until the watermark has passed them and are then judged in
order, so results don't depend on the order in which files arrive, as long as no
event is later than the watermark's delay; events that are later are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
_PARTS = "spark.sql.shuffle.partitions"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Buckets of keys, and the rows that go into one entry of a bucket's state and into one file of a stream.
BUCKETS, _CHUNK, _FILE = 512, 10_000, 200_000


class _Due:
    """One timer of a bucket, moved as the earliest thing it waits for changes."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle

    def at(self, ms: int | None) -> None:
        due = list(self.handle.listTimers())
        if due == [ms]:
            return
        for t in due:
            self.handle.deleteTimer(t)
        if ms is not None:
            self.handle.registerTimer(ms)

    def soonest(self, ms: int) -> None:
        """Not later than this."""
        due = list(self.handle.listTimers())
        if not due or ms < min(due):
            self.at(ms)


class _Rows:
    """A bucket's rows in list state, packed by column: an entry holds many rows."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, columns: str, chunk: int | None = None):
        self.chunk = chunk or _CHUNK
        kinds = [c.split() for c in columns.split(", ")]
        self.names = [c for c, _ in kinds]
        self.state = handle.getListState(name, ", ".join(f"{c} array<{kind}>" for c, kind in kinds))

    def _packed(self, columns: Iterable) -> list[tuple]:
        lists = [list(c) for c in columns]
        return [tuple(c[i : i + self.chunk] for c in lists) for i in range(0, len(lists[0]), self.chunk)]

    def add(self, *columns) -> None:
        if chunks := self._packed(columns):
            self.state.appendList(chunks)

    def put(self, *columns) -> None:
        if chunks := self._packed(columns):
            self.state.put(chunks)
        else:
            self.state.clear()

    def get(self) -> list[list]:
        """The columns."""
        columns: list[list] = [[] for _ in self.names]
        for chunk in self.state.get():
            for column, more in zip(columns, chunk):
                column += more
        return columns


class _Bucketed(StatefulProcessor):
    """Takes the rows of a bucket of keys, of which it reads COLUMNS; rows without a key only move the watermark."""

    COLUMNS: tuple[str, ...] = ()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        keyed = (part[part["key"].notna()] for part in rows)
        yield from self.take((part for part in keyed if len(part)), timerValues)

    def spread(self) -> Column:
        """What decides a row's bucket: all rows that belong together must have it in common."""
        return F.xxhash64("key")

    def close(self) -> None: ...


class Quota(_Bucketed):
    """key, ask_count, allowed of each ask: the first ``most`` are allowed; with ``minutes`` a key that has not asked for so long (in event time) is forgotten."""

    SCHEMA = "key string, ask_count int, allowed boolean"

    def __init__(self, most: int = 5, minutes: int | None = None):
        self.most, self.idle = most, minutes and minutes * 60_000
        self.COLUMNS = ("us",) if self.idle else ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = _Rows(handle, "counts", "key string, n int, last long")
        self.due = _Due(handle)

    def _put(self, known: dict[str, tuple[int, int]], passed: int) -> None:
        self.counts.put(known, (n for n, _ in known.values()), (last for _, last in known.values()))
        if self.idle:
            self.due.at(max(min(last for _, last in known.values()) + self.idle, passed + 1) if known else None)

    def _known(self) -> dict[str, tuple[int, int]]:
        return {k: (n, last) for k, n, last in zip(*self.counts.get())}

    def take(self, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = None
        # A key's asks go by their time, so those of a batch are taken together; without time they come as they are.
        parts = [pd.concat(found).sort_values("us", kind="stable")] if self.idle and (found := list(rows)) else rows
        for part in parts:
            known = self._known() if known is None else known
            counts = []
            for key, ms in zip(part["key"], part["us"] // 1000 if self.idle else [0] * len(part)):
                n, last = known.get(key, (0, 0))
                # The timer may not have come yet when the key asks again.
                n = 1 if self.idle and ms - last >= self.idle else n + 1
                known[key] = n, max(last, int(ms))
                counts.append(n)
            yield pd.DataFrame({"key": part["key"].to_numpy(), "ask_count": counts, "allowed": [c <= self.most for c in counts]})
        if known is not None:
            self._put(known, timerValues.getCurrentWatermarkInMs() if self.idle else 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        self._put({k: (n, last) for k, (n, last) in self._known().items() if last + self.idle > passed}, passed)
        yield from ()


class Limiter(_Bucketed):
    """key, us, blocked of each attempt (us: its time in microseconds, ok): after ``most`` failures within ``minutes`` of the first, until they are over; a success starts anew.

    Attempts of one time are judged failures first.
    """

    SCHEMA = "key string, us long, blocked boolean"
    COLUMNS = ("us", "ok")

    def __init__(self, minutes: int = 15, most: int = 5):
        self.length, self.most = minutes * 60_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = _Rows(handle, "waiting", "key string, us long, ok boolean")
        self.windows = _Rows(handle, "windows", "key string, count int, start long")
        self.due = _Due(handle)

    def take(self, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs(), None
        for part in rows:
            part = part[part["us"] // 1000 >= passed]
            if len(part):
                us = part["us"].astype("int64")
                self.waiting.add(part["key"], us.tolist(), part["ok"].eq(True).tolist())
                first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is not None:
            self.due.soonest(max(first // 1000, passed) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(zip(*self.waiting.get()))
        ripe, left = sorted(x for x in held if x[1] // 1000 < passed), [x for x in held if x[1] // 1000 >= passed]
        windows = {k: (count, start) for k, count, start in zip(*self.windows.get())}
        blocks = []
        for k, us, ok in ripe:
            count, start = windows.get(k, (0, 0))
            if count == 0 or us - start >= self.length:
                count, start = 0, us
            blocked = count >= self.most
            if not blocked:
                count = 0 if ok else count + 1
            windows[k] = count, start
            blocks.append(blocked)
        if ripe:
            self.waiting.put(*(zip(*left) if left else [[]]))
        # A window that the watermark has passed says nothing about later attempts.
        windows = {k: (count, start) for k, (count, start) in windows.items() if count and (start + self.length) // 1000 >= passed}
        self.windows.put(windows, (count for count, _ in windows.values()), (start for _, start in windows.values()))
        # Wake up for the first attempt that waits, else when a window is over.
        if left:
            self.due.at(max(min(us for _, us, _ in left) // 1000, passed) + 1)
        else:
            self.due.at(min((start + self.length) // 1000 for _, start in windows.values()) + 1 if windows else None)
        if ripe:
            yield pd.DataFrame({"key": [k for k, _, _ in ripe], "us": [us for _, us, _ in ripe], "blocked": blocks})


class Sessions(_Bucketed):
    """key, message_count, messages of a chat session once no turn has come for ``minutes``; a turn that comes again replaces the earlier one."""

    SCHEMA = "key string, message_count int, messages array<struct<turn: bigint, role: string, content: string>>"
    COLUMNS = ("turn", "role", "content", "us")

    def __init__(self, minutes: int = 30):
        self.idle = minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = _Rows(handle, "turns", "key string, turn long, role string, content string", 500)
        self.open = _Rows(handle, "open", "key string, last long, due long")
        self.due = _Due(handle)

    def _known(self) -> dict[str, tuple[int, int]]:
        return {k: (last, due) for k, last, due in zip(*self.open.get())}

    def _put(self, known: dict[str, tuple[int, int]]) -> None:
        self.open.put(known, (last for last, _ in known.values()), (due for _, due in known.values()))
        self.due.at(min(due for _, due in known.values()) if known else None)

    def take(self, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, known = timerValues.getCurrentWatermarkInMs(), None
        for part in rows:
            known = self._known() if known is None else known
            self.turns.add(part["key"], part["turn"].astype("int64").tolist(), part["role"], part["content"])
            for key, ms in zip(part["key"], part["us"] // 1000):
                last = int(max(known.get(key, (0, 0))[0], ms))
                known[key] = last, max(last + self.idle, passed + 1)
        if known is not None:
            self._put(known)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, known = timerValues.getCurrentWatermarkInMs(), self._known()
        told: dict[str, dict[int, tuple]] = {k: {} for k, (_, due) in known.items() if due <= passed}
        left = []
        for k, turn, role, content in zip(*self.turns.get()):
            if k in told:
                told[k][turn] = role, content
            else:
                left.append((k, turn, role, content))
        self.turns.put(*(zip(*left) if left else [[]]))
        self._put({k: x for k, x in known.items() if k not in told})
        for i in range(0, len(told), 500):
            some = list(told.items())[i : i + 500]
            messages = [[{"turn": t, "role": role, "content": content} for t, (role, content) in sorted(turns.items())] for _, turns in some]
            yield pd.DataFrame({"key": [k for k, _ in some], "message_count": [len(turns) for _, turns in some], "messages": messages})


class Retention(_Bucketed):
    """key, day, removed: how many rows of a day (UTC) go when it is more than ``days`` before the watermark; state holds a count for each later day."""

    SCHEMA = "key string, day date, removed long"
    COLUMNS = ("us",)
    _DAY = 86_400_000

    def __init__(self, days: int):
        self.days = days

    def spread(self) -> Column:
        """The days of a key go to different buckets, so that a few large keys do not wait for each other."""
        return F.xxhash64("key", F.col("us") - F.pmod("us", F.lit(1000 * self._DAY)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = _Rows(handle, "counts", "key string, day long, n long")
        self.due = _Due(handle)

    def _known(self) -> dict[tuple[str, int], int]:
        return {(k, day): n for k, day, n in zip(*self.counts.get())}

    def _ends(self, day: int) -> int:
        return (day + 1 + self.days) * self._DAY

    def _put(self, known: dict[tuple[str, int], int], passed: int) -> None:
        self.counts.put((k for k, _ in known), (day for _, day in known), known.values())
        self.due.at(max(self._ends(min(day for _, day in known)), passed + 1) if known else None)

    def take(self, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = None
        for part in rows:
            known = self._known() if known is None else known
            for (key, day), n in part.groupby(["key", part["us"] // (1000 * self._DAY)]).size().items():
                known[key, int(day)] = known.get((key, int(day)), 0) + int(n)
        if known is not None:
            self._put(known, timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, known = timerValues.getCurrentWatermarkInMs(), self._known()
        gone = sorted((k, day, n) for (k, day), n in known.items() if self._ends(day) <= passed)
        self._put({(k, day): n for (k, day), n in known.items() if self._ends(day) > passed}, passed)
        if gone:
            yield pd.DataFrame({"key": [k for k, _, _ in gone], "day": [pd.Timestamp(day * self._DAY, unit="ms").date() for _, day, _ in gone], "removed": [n for _, _, n in gone]})


# Running ------------------------------------------------------------------------


def stateful(stream: DataFrame, key: str, processor: _Bucketed, late: str | None = None) -> DataFrame:
    """A processor's rows for each key; with ``late`` on event time (column at), else without time."""
    rows = stream.withColumn("key", F.col(key).cast("string"))
    if late is not None:
        # Python gets times as numbers, whatever the session's time zone.
        rows = rows.withWatermark("at", late).withColumn("us", F.unix_micros("at"))
    rows = rows.select(F.pmod(processor.spread(), F.lit(BUCKETS)).cast("int").alias("bucket"), "key", *processor.COLUMNS, *([] if late is None else ["at"]))
    return rows.groupBy("bucket").transformWithStateInPandas(processor, processor.SCHEMA, "append", "none" if late is None else "eventTime")


@contextmanager
def state_store(spark: SparkSession):
    """Queries started here keep their state in a store that holds it on disk, two partitions a core at most; the session's settings come back.

    Each partition opens and commits its store in every batch, whatever it holds.
    """
    before, parts = spark.conf.get(_STORE), spark.conf.get(_PARTS)
    spark.conf.set(_STORE, _ROCKS)
    spark.conf.set(_PARTS, str(min(int(parts), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)
        spark.conf.set(_PARTS, parts)


def written(stream: DataFrame, folder: str, progress: list | None = None) -> DataFrame:
    """All rows a stream gives until its input ends, written once each to ``folder``; goes on from there when called again.

    ``progress`` gets the state's number of rows after each batch.
    """
    spark = stream.sparkSession
    with state_store(spark):
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    try:
        query.awaitTermination()
        if progress is not None:
            progress += [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def filed(df: DataFrame, folder: str, number, end=None) -> DataFrame:
    """A stream of a table's rows, a batch for each value of ``number`` (a few, in order), rows shuffled inside.

    A batch has as many files as the largest needs, empty ones among them, so that each takes those of its number alone.
    ``end``: a last row without a key whose time moves the watermark past everything.
    """
    spark = df.sparkSession
    rows = df.withColumn("_file", number)
    sizes = sorted(((r[0], r[1]) for r in rows.groupBy("_file").count().collect()), key=lambda r: (r[0] is not None, r[0]))
    files = max([1, *(-(-n // _FILE) for _, n in sizes)])
    for i, (file, _) in enumerate(sizes, 1):
        rows.where(F.col("_file").eqNullSafe(F.lit(file))).drop("_file").repartition(files).sortWithinPartitions(F.rand(7)).write.mode("append").parquet(folder)
        for _ in range(i * files - len(spark.read.schema(df.schema).parquet(folder).inputFiles()) if files > 1 else 0):
            spark.range(0).select(*(F.lit(None).cast(t).alias(c) for c, t in df.dtypes)).coalesce(1).write.mode("append").parquet(folder)
    if end is not None:
        last = spark.range(1).select(*(F.lit(end).cast("timestamp").alias(c) if c == "at" else F.lit(None).cast(t).alias(c) for c, t in df.dtypes))
        last.write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)
