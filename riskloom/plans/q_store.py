"""Queries of the store: imports that add up, commits of a cycle, and streams that go on from a stored snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.lineage import new_folder
from riskloom.operators import commits, importing, store
from riskloom.plans import projection as P
from riskloom.plans.q_sources import _feed, _inventory
from riskloom.plans.registry import query
from riskloom.sources import json_ranges


@query(
    """SELECT (SELECT count(*) + 5 + 3 + count(DISTINCT s_suppkey % 25) FROM supplier) AS nodes, (SELECT count(*) * 5 FROM supplier) AS edges, 2 AS files, 2 AS versions,
 (SELECT count(*) + count(DISTINCT s_suppkey % 5) + count(DISTINCT s_suppkey % 3) + count(DISTINCT s_suppkey % 25) + count(*) * 5 FROM supplier WHERE s_suppkey % 10 < 5) AS records_first"""
)
def import_twice(spark, sf):
    """An inventory in two files, one after the other, then the first again."""
    folder, store_ = new_folder(spark, "feed"), new_folder(spark, "store")
    half = F.substring("asset_id", 2, 20).cast("long") % 10 < 5
    paths = [f"{folder}/a/cmdb.csv", f"{folder}/b/cmdb.csv"]
    for path, rows in zip(paths, (_inventory(spark, sf).where(half), _inventory(spark, sf).where(~half))):
        rows.write.csv(path, header=True)
    for path in (paths[0], paths[1], paths[0]):
        importing.import_new(spark, store_, [path], "2024-01-01 00:00:00")
    n, e, log = (importing.stored(spark, store_, t) for t in ("nodes", "edges", "import_log"))
    counts = n.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(e.agg(F.count(F.lit(1)).alias("edges")))
    files = log.agg(F.count(F.lit(1)).cast("int").alias("files"), F.max(F.when(F.col("file").endswith("/a/cmdb.csv"), F.col("records"))).alias("records_first"))
    return counts.crossJoin(files).withColumn("versions", F.lit(len(commits.versions(spark, store_))))


_CYCLE = "n{i} AS (SELECT user_id, arg_max(event_type, event_id) AS s FROM events WHERE event_id % 3 = {i} GROUP BY user_id)"
_NEXT = "c{i} AS (SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.s, o.s) AS s, CASE WHEN n.user_id IS NULL THEN o.u WHEN n.s = o.s THEN o.u + 1 ELSE 0 END AS u FROM c{o} o FULL JOIN n{i} n ON n.user_id = o.user_id)"


@query(
    f"""WITH {_CYCLE.format(i=0)}, {_CYCLE.format(i=1)}, {_CYCLE.format(i=2)}, c0 AS (SELECT user_id, s, 0 AS u FROM n0), {_NEXT.format(i=1, o=0)}, {_NEXT.format(i=2, o=1)}, a AS (SELECT 0 AS cycle, * FROM c0 UNION ALL SELECT 1, * FROM c1 UNION ALL SELECT 2, * FROM c2)
 SELECT cycle, user_id, s AS dominant_state, CAST(u AS INT) AS updates_in_state, (SELECT count(*) FROM n0) + CASE WHEN cycle > 0 THEN (SELECT count(*) FROM n1) ELSE 0 END + CASE WHEN cycle > 1 THEN (SELECT count(*) FROM n2) ELSE 0 END AS history_rows FROM a"""
)
def state_commit(spark, sf):
    """K4-K6: three cycles of states, each with its history in one commit; the snapshot and history as of every cycle."""
    folder, key = new_folder(spark, "states"), ["user_id"]
    events = P.table(spark, sf, "events").select("user_id", "event_id", F.col("event_type").alias("dominant_state"))
    out = None
    for i in range(3):
        new = store.latest(events.where(F.col("event_id") % 3 == i), key, ["event_id"]).drop("event_id")
        old = commits.read(spark, folder, "states")
        snapshot, added = store.update_states(old if old is not None else spark.createDataFrame([], "user_id long, dominant_state string, updates_in_state int"), new, key)
        commits.commit(spark, folder, f"cycle {i}", replace={"states": snapshot}, append={"history": added.withColumn("cycle", F.lit(i))})
    for i in range(3):
        history = commits.read(spark, folder, "history", cycle=f"cycle {i}").agg(F.count(F.lit(1)).alias("history_rows"))
        then = commits.read(spark, folder, "states", cycle=f"cycle {i}").select(F.lit(i).alias("cycle"), "user_id", "dominant_state", F.col("updates_in_state").cast("int").alias("updates_in_state")).crossJoin(F.broadcast(history))
        out = then if out is None else out.unionByName(then)
    return out


@query("SELECT o_orderkey, o_orderpriority || ' }{\"]' AS note, o_custkey, o_custkey + 1 AS next FROM orders")
def feed_in_ranges(spark, sf):
    """Documents cut into records by byte ranges, with braces and quotes in strings and lists in records."""
    rows = P.table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderpriority", F.lit(' }{"]')).alias("note"), F.array(F.col("o_custkey").cast("long"), F.col("o_custkey").cast("long") + 1).alias("numbers"))
    path = _feed(spark, rows, "orders", "orders.json")
    out = json_ranges.records(spark, path, "orders").select(F.from_json("value", "o_orderkey long, note string, numbers array<long>").alias("r"))
    return out.select("r.o_orderkey", "r.note", F.col("r.numbers")[0].alias("o_custkey"), F.col("r.numbers")[1].alias("next"))


@query(
    """WITH e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key, ts FROM events), m AS (SELECT CAST(floor(epoch_us(max(ts)) / 1000) AS BIGINT) * 1000 - 7200000000 AS mark FROM events),
 c AS (SELECT key, ts, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS after FROM e WHERE epoch_us(ts) <= (SELECT mark FROM m))
 SELECT key, ts AS last_seen, ts + INTERVAL 2 DAY AS alarm_at, after AS cancelled_at FROM c WHERE CASE WHEN after IS NULL THEN epoch_us(ts + INTERVAL 2 DAY) <= (SELECT mark FROM m) ELSE after > ts + INTERVAL 2 DAY END"""
)
def silence_alarms(spark, sf):
    """Users without an event for two days, by event-time timers."""
    from riskloom.streaming import alerts, keyed

    return keyed.silence_alarms(spark, alerts.source(spark, f"{sf}/events.parquet"), "user_id", "ts", 2 * 86400)


@query(
    """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events),
 b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM a),
 c AS (SELECT user_id, island, count(*) - 1 AS updates FROM b GROUP BY ALL) SELECT b.user_id, b.event_type AS dominant_state, updates AS updates_in_state FROM b JOIN c USING (user_id, island) WHERE back = 1"""
)
def batch_then_stream(spark, sf):
    """The snapshot of the first half of the month is stored and starts the state of a stream over the rest."""
    from riskloom.streaming import alerts, keyed

    folder, half = new_folder(spark, "states"), F.lit("2024-01-16").cast("timestamp_ntz")
    commits.commit(spark, folder, "half", replace={"states": keyed.snapshot_of(P.table(spark, sf, "events").where(F.col("ts") < half))})
    rest = alerts.source(spark, f"{sf}/events.parquet").where(F.col("ts") >= half)
    return keyed.states_after(spark, rest, commits.read(spark, folder, "states"))
