"""STR2, STR5: keyed state with timers. Events wait in the state until the watermark has passed them, are then applied in order, and go; so what arrives
in any order within the watermark gives what a batch gives, and the state holds open files and unsettled edits only.

- states(): the state of each file. A cancel only moves files that are pending; done, error and cancelled are final. Of a final file a mark stays for
  `keep`, so that events that come after it change nothing; then it goes. A file without events for `idle` is given up: its row says so.
- debounced(): edits of a field, of which a later one within `quiet` takes the place of the earlier.

Defined cases: events with a null key, time or number are left out (they have no place in the order); equal times are ordered by number; equal events
count once; events later than the watermark allows are dropped by Spark, and counted in the query's progress. Stateful operators of this kind need
the RocksDB state store: configured() sets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINAL = ("done", "error", "cancelled")
#: Fixed value: milliseconds without another edit after which one is saved.
QUIET = timedelta(milliseconds=700)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def _ms(ts: datetime) -> int:
    return round(ts.astimezone(timezone.utc).timestamp() * 1000)


def _later(d: timedelta) -> int:
    return round(d.total_seconds() * 1000)


def step(state: str, event: str) -> str:
    """As batches.latest_state()."""
    if state in FINAL or event == "cancelled" and state != "pending":
        return state
    return event


class FileStates(StatefulProcessor):
    def __init__(self, keep: timedelta, idle: timedelta):
        self.keep, self.idle = _later(keep), _later(idle)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, state string")
        self.now = handle.getValueState("now", "state string, seq long, ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(_ms(r.ts), r.seq, r.state) for r in rows]
        self.waiting.appendList(new)
        for ms in {ms for ms, *_ in new}:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted({(r[0], r[1], r[2]) for r in waiting if r[0] <= passed}, key=lambda e: (e[1], e[0], e[2]))
        old = tuple(self.now.get()) if self.now.exists() else None
        if not due:
            if old is None or expiredTimerInfo.getExpiryTimeInMs() < old[2] + (self.keep if old[0] in FINAL else self.idle):
                return
            self.now.clear()  # the mark of a final file, or a file that was given up
            if old[0] not in FINAL:
                yield Row(file_id=key[0], seq=old[1], state=old[0], given_up=True)
            return
        if left := [tuple(r) for r in waiting if r[0] > passed]:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        state, seq, ms = old or ("pending", None, 0)
        for at, number, event in due:
            state, seq, ms = step(state, event), number if state not in FINAL else seq, max(ms, at)
        self.now.update((state, seq, ms))
        self.handle.registerTimer(ms + (self.keep if state in FINAL else self.idle))
        if old is None or old[:2] != (state, seq):
            yield Row(file_id=key[0], seq=seq, state=state, given_up=False)

    def close(self) -> None:
        pass


def states(events: DataFrame, late: timedelta = timedelta(minutes=10), keep: timedelta = timedelta(hours=1), idle: timedelta = timedelta(days=1)) -> DataFrame:
    """STR2: (file_id, seq, state, given_up) of a stream of events (file_id, seq, state, ts), a row for each change; the last of a file is its state."""
    rows = events.where("file_id is not null and seq is not null and ts is not null and state is not null")
    rows = rows.select(F.col("file_id").cast("long").alias("file_id"), F.col("seq").cast("long").alias("seq"), "state", "ts").withWatermark("ts", f"{_later(late)} milliseconds")
    return rows.groupBy("file_id").transformWithState(FileStates(keep, idle), "file_id long, seq long, state string, given_up boolean", "Update", "EventTime")


class Edits(StatefulProcessor):
    def __init__(self, quiet: timedelta):
        self.quiet = _later(quiet)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, seq long, value string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(_ms(r.ts), r.seq, r.value) for r in rows]
        self.waiting.appendList(new)
        for ms in {ms for ms, *_ in new}:
            self.handle.registerTimer(ms + self.quiet)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        edits = sorted({(r[0], r[1], r[2]) for r in self.waiting.get()}) if self.waiting.exists() else []
        after = [e[0] for e in edits[1:]] + [None]
        left = []
        for e, then in zip(edits, after):
            if e[0] + self.quiet > passed:
                left.append(e)  # another may still come
            elif then is None or then > e[0] + self.quiet:
                yield Row(page_id=key[0], key=key[1], seq=e[1], value=e[2])
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def debounced(edits: DataFrame, late: timedelta = timedelta(minutes=10), quiet: timedelta = QUIET) -> DataFrame:
    """STR5: of a stream of edits (page_id, key, seq, value, ts), those that no other of the field follows within `quiet`."""
    rows = edits.where("page_id is not null and key is not null and seq is not null and ts is not null")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), "key", F.col("seq").cast("long").alias("seq"), "value", "ts").withWatermark("ts", f"{_later(late)} milliseconds")
    return rows.groupBy("page_id", "key").transformWithState(Edits(quiet), "page_id long, key string, seq long, value string", "Append", "EventTime")


def debounced_batch(edits: DataFrame, quiet: timedelta = QUIET) -> DataFrame:
    """As debounced(), of a table: one window over each field's edits."""
    rows = edits.where("page_id is not null and key is not null and seq is not null and ts is not null").select("page_id", "key", "seq", "value", F.floor(F.unix_micros("ts") / 1000).alias("ms")).distinct()
    then = F.lead("ms").over(Window.partitionBy("page_id", "key").orderBy("ms", "seq", "value"))
    return rows.withColumn("then", then).where(F.col("then").isNull() | (F.col("then") > F.col("ms") + _later(quiet))).select("page_id", "key", "seq", "value")
