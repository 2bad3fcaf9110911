"""Timers and initial state, dealt to micro-batches in several ways, against the events in order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.streaming import alerts, keyed

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def events(seed: int) -> list[tuple]:
    rng, out, at = random.Random(seed), [], [0.0, 0.0, 0.0]
    for i in range(150):
        u = rng.choice([0, 0, 1, 2])
        at[u] += rng.choice([0, 1, 5, 40, 200])
        out.append((i, START + timedelta(minutes=at[u]), u, rng.choice(["a", "b", None])))
    return out + [(900, None, 1, "a"), (901, START + timedelta(minutes=3), None, "b")]


def stream(spark, path, rows, files: int, slack: int = 0):
    """Files in order of time, but for up to ``slack`` minutes, read one a trigger."""
    rng = random.Random(files)
    rows = sorted(rows, key=lambda r: ((r[1] or START) + timedelta(minutes=rng.uniform(-slack, slack)), r[0]))
    size = -(-len(rows) // files)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


def expected(rows, threshold: timedelta, late: timedelta):
    mark = max(r[1] for r in rows if r[1] and r[2] is not None) - late
    for u in {r[2] for r in rows} - {None}:
        at = sorted({r[1] for r in rows if r[2] == u and r[1] and r[1] <= mark})
        for a, b in zip(at, [*at[1:], None]):
            if (b is None and a + threshold <= mark) or (b is not None and b - a > threshold):
                yield str(u), a, a + threshold, b


@pytest.mark.parametrize(("files", "slack"), [(1, 0), (5, 15)])
def test_silences_equal_the_events_in_order(spark, tmp_path, files, slack):
    rows = events(files)
    out = keyed.silence_alarms(spark, stream(spark, tmp_path, rows, files, slack), "user_id", "ts", 3600, "45 minutes")
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = sorted(expected(rows, timedelta(hours=1), timedelta(minutes=45)), key=str)
    assert got == want and any(r[3] is None for r in got) and any(r[3] is not None for r in got)


@pytest.mark.parametrize("share", [0.0, 0.4, 1.0])
def test_batch_then_stream_equals_the_stream_over_all(spark, tmp_path, share):
    rows = [r for r in events(7) if r[1] and r[2] is not None]
    cut = sorted(r[1] for r in rows)[int(share * (len(rows) - 1))] + timedelta(seconds=share)
    first, rest = [r for r in rows if r[1] < cut], [r for r in rows if r[1] >= cut]
    snapshot = keyed.snapshot_of(spark.createDataFrame(first, SCHEMA))
    frame = stream(spark, tmp_path / "rest", rest, 3) if rest else alerts.source(spark, str(tmp_path)).select("event_id", "ts", "user_id", "event_type")
    want = sorted(map(tuple, keyed.snapshot_of(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert sorted(map(tuple, keyed.states_after(spark, frame, snapshot).collect())) == want
    by_hand = {}
    for _, _, u, e in sorted(rows, key=lambda r: (r[1], r[0])):
        was, n = by_hand.get(u, (object(), 0))
        by_hand[u] = (e, n + 1 if e == was else 0)
    assert want == sorted((u, *x) for u, x in by_hand.items())


def test_state_counters_order_all_batches_of_a_key(spark, tmp_path):
    """A key's events come in several Arrow batches, none of them in order; a state may be null, the first one too."""
    rng = random.Random(5)
    rows = [(i, START + timedelta(seconds=i // 3), i % 2 if i < 300 else 0, rng.choice(["a", "b", None]) if i < 280 else "a") for i in range(320)] + [(400 + i, START, 7, None) for i in range(4)]
    by_hand = {}
    for _, _, u, e in sorted(rows, key=lambda r: (r[1], r[0])):
        was, n = by_hand.get(u, (object(), 0))
        by_hand[u] = (e, n + 1 if e == was else 0)
    rng.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "events"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "16")
    try:
        got = alerts.run_to_end(alerts.state_counters(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "events"))), ["user_id"]).collect()
    finally:
        spark.conf.set(size, before)
    assert sorted(map(tuple, got)) == sorted((u, *x) for u, x in by_hand.items())


def test_calls_to_the_state_store_do_not_grow_with_the_keys(spark, tmp_path, monkeypatch):
    """Keys of a group share state and timers: 400 keys in 8 groups, in triggers that bring late events, new keys and cancelled alarms."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Kept(StreamingQueryListener):
        timers: list[int] = []

        def onQueryStarted(self, event): ...
        def onQueryTerminated(self, event): ...
        def onQueryProgress(self, event):
            self.timers += [s.customMetrics.get("numRegisteredTimers", 0) for s in event.progress.stateOperators]

    monkeypatch.setattr(keyed, "KEY_GROUPS", 8, raising=False)
    rng = random.Random(3)
    rows = [(i, START + timedelta(minutes=rng.uniform(0, 600) * (1 if i % 3 else 0.2)), rng.randrange(400), "a") for i in range(2000)]
    kept = Kept()
    spark.streams.addListener(kept)
    try:
        out = keyed.silence_alarms(spark, stream(spark, tmp_path, rows, 4, 10), "user_id", "ts", 3600, "45 minutes").collect()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(kept)
    assert sorted(map(tuple, out), key=str) == sorted(expected(rows, timedelta(hours=1), timedelta(minutes=45)), key=str)
    assert 0 < sum(kept.timers) <= 8 * 2 * len(kept.timers)
