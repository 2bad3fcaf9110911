"""Keyed state with timers and with a start from a stored snapshot.

``silences``: an alarm for each key that stays silent longer than a threshold, raised by an event-time timer and cancelled by a later event. Events may come
out of order within the watermark's delay: an event counts from the time the watermark has passed it, so the rows are those of the events in order, however they were
dealt to micro-batches. Before the shuffle a task hands on the first and last event of a key in each half threshold only, between which no silence can lie: a hot key
is a few rows a task. State of a key: its last counted event, whether its alarm is out, and the events that the watermark has not passed. A call to the state store takes
longer than the work on a key, so keys are held in ``KEY_GROUPS`` groups by hash: the calls of a trigger are a few a group, and a task holds one group's rows.

``states_from``: the state counters of ``alerts.state_counters``, from a stored snapshot on: the state is set from the snapshot once, when the stream begins.
Batch, then stream gives what the stream over all gives, if the stream's events follow the snapshot's.

State lies in RocksDB, on the executors' disks and in the checkpoint. Null keys and null times are left out by ``silences``; a null state is a state of its own in ``states_from``. An empty
stream gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.streaming.alerts import counted

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession):
    """The state store in which timers and several variables can be kept, for streams that start inside."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


# ---------------------------------------------------------------- silences

SILENCE = "key string, last_seen long, alarm_at long, cancelled_at long"
KEY_GROUPS = 4096  # keys share the calls to the state store; a stream that goes on from its checkpoint keeps the number it began with


def _packed(frame: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(frame, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Silence(StatefulProcessor):
    """Times are in microseconds; timers and watermark in milliseconds. State and timer are a key group's, as Arrow tables of its keys and of its events that wait."""

    def __init__(self, threshold: int):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "rows binary")
        self.pending = handle.getListState("pending", "rows binary")
        self.due = handle.getValueState("due", "us long")

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))
        self.due.update((us,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([pdf[["key", "us"]] for pdf in rows])
        self.pending.appendValue((_packed(new),))
        first, due = int(new["us"].min()), self.due.get()
        if due is None or first < due[0]:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [_unpacked(x[0]) for x in self.pending.get()] if self.pending.exists() else []
        waiting = pd.concat([pd.DataFrame({"key": pd.Series(dtype=str), "us": pd.Series(dtype="int64")}), *parts])
        held = self.last.get()
        known = _unpacked(held[0]) if held else pd.DataFrame({"key": pd.Series(dtype=str), "us": pd.Series(dtype="int64"), "alarmed": pd.Series(dtype=bool)})
        passed = waiting["us"] <= mark
        # a key's last counted event, then those that the watermark has passed since, in order
        seen = pd.concat([known, waiting[passed].drop_duplicates().assign(alarmed=False)], ignore_index=True)
        code, names = pd.factorize(seen["key"])
        us, alarmed, is_new = seen["us"].to_numpy("int64"), seen["alarmed"].to_numpy(bool), np.arange(len(seen)) >= len(known)
        floor = np.full(len(names), np.iinfo(np.int64).min)
        floor[code[~is_new]] = us[~is_new]
        keep = np.flatnonzero(~is_new | (us > floor[code]))
        keep = keep[np.lexsort((us[keep], code[keep]))]
        code, us, alarmed = code[keep], us[keep], alarmed[keep]
        follows = np.append(code[1:] == code[:-1], False) if len(code) else np.zeros(0, bool)
        after = np.append(us[1:], 0)[: len(us)]
        silent = follows & (after - us > self.threshold)
        ends = ~follows
        lapsed = ends & ~alarmed & (us + self.threshold <= mark)
        last = pd.DataFrame({"key": names[code[ends]], "us": us[ends], "alarmed": (alarmed | lapsed)[ends]})
        rest = waiting[~passed]
        if len(last):
            self.last.update((_packed(last),))
        if len(rest):
            self.pending.put([(_packed(rest),)])
        else:
            self.pending.clear()
        open_ = last["us"][~last["alarmed"]] + self.threshold
        due = [int(x.min()) for x in (rest["us"], open_) if len(x)]
        if due:
            self._wake(min(due))
        else:
            self.due.clear()
        out = silent | lapsed
        if out.any():
            cancelled = pd.Series(after[out], dtype="Int64").mask(lapsed[out])
            yield pd.DataFrame({"key": names[code[out]], "last_seen": us[out], "alarm_at": us[out] + self.threshold, "cancelled_at": cancelled})

    def close(self) -> None:
        pass


def _ends(threshold: int):
    """First and last event of a key in each half threshold."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            by = pdf.groupby(["key", pdf["us"] // max(threshold // 2, 1)])["us"]
            both = pd.concat([by.min(), by.max()]).reset_index(level=0).drop_duplicates()
            yield both[["key", "us"]]

    return run


def silences(events: DataFrame, key: str, at: str, threshold_seconds: int, late: str = "2 hours") -> DataFrame:
    """(key, last_seen, alarm_at, cancelled_at) of a stream, in update mode: a silence's row comes again when a later event cancels it; times in microseconds."""
    e = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("key is not null and us is not null")
    e = e.mapInPandas(_ends(threshold_seconds * 1_000_000), "key string, us long").withColumn("at", F.timestamp_micros("us")).withWatermark("at", late)
    e = e.withColumn("key_group", F.pmod(F.xxhash64("key"), F.lit(KEY_GROUPS)))
    return e.groupBy("key_group").transformWithStateInPandas(Silence(threshold_seconds * 1_000_000), SILENCE, "Update", "EventTime")


def silence_alarms(spark: SparkSession, events: DataFrame, key: str, at: str, threshold_seconds: int, late: str = "2 hours") -> DataFrame:
    """The last row of every silence after all that the stream holds now, with times as timestamps."""
    from riskloom.streaming.alerts import run_to_end

    with rocks(spark):
        out = run_to_end(silences(events, key, at, threshold_seconds, late), ["key", "last_seen"])
    return out.select("key", *[F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("last_seen", "alarm_at", "cancelled_at")])


# ---------------------------------------------------------------- from batch to stream

STATES = "user_id long, dominant_state string, updates_in_state long"


class Counter(StatefulProcessor):
    """The state that a key was last in, and the updates since it came there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "name string")
        self.updates = handle.getValueState("updates", "n long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.update((initialState["dominant_state"].iloc[0],))
        self.updates.update((int(initialState["updates_in_state"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.updates.exists()
        was, n = (self.state.get()[0], self.updates.get()[0]) if known else (None, 0)
        was, n = counted((pdf[["ts", "event_id", "event_type"]] for pdf in rows), was, n, known)
        self.state.update((was,))
        self.updates.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "dominant_state": [was], "updates_in_state": [n]})

    def close(self) -> None:
        pass


def snapshot_of(events: DataFrame) -> DataFrame:
    """The counters after a batch of events, in one window: a run of equal states begins where the state before differs."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events.withColumns({"_n": F.row_number().over(order), "_new": ~F.equal_null(F.lag("event_type").over(order), F.col("event_type")) | (F.row_number().over(order) == 1)})
    last = e.groupBy("user_id").agg(F.max_by("event_type", "_n").alias("dominant_state"), (F.max("_n") - F.max(F.when(F.col("_new"), F.col("_n")))).cast("long").alias("updates_in_state"))
    return last.select("user_id", "dominant_state", "updates_in_state")


def states_from(events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(user_id, dominant_state, updates_in_state) of a stream that goes on from a snapshot, in update mode: keys without an event keep their row of the snapshot."""
    return events.groupBy("user_id").transformWithStateInPandas(Counter(), STATES, "Update", "None", snapshot.select("user_id", "dominant_state", "updates_in_state").groupBy("user_id"))


def states_after(spark: SparkSession, events: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The snapshot after all that the stream holds now."""
    from riskloom.streaming.alerts import run_to_end

    with rocks(spark):
        new = run_to_end(states_from(events, snapshot), ["user_id"])
    return new.unionByName(snapshot.join(new, "user_id", "left_anti").select(*new.columns))
