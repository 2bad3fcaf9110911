"""Structured Streaming forms: windowed alert counts with a watermark, and the keyed state of a pair's dominant risk state."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream; a single file is read through its folder, with its name let through."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(SCHEMA)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def windowed(events: DataFrame, late: str = "2 hours", length: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; events later than ``late`` behind the newest are left out once their window is closed."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return e.groupBy(F.window("at", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _base(spark: SparkSession) -> str:
    from riskloom.functions.lineage import cut

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        cut(spark.range(1).toDF("x"))
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Consume what there is in ``update`` mode and return the last row of each key: a trigger writes only what it changed, to the shared folder."""
    spark = stream.sparkSession
    base, triggers = _base(spark), []

    def keep(batch: DataFrame, n: int) -> None:
        triggers.append(n)
        batch.withColumn("_trigger", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/run={n}")

    q = stream.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(keep).start()
    q.awaitTermination()
    if not triggers:
        return spark.createDataFrame([], stream.schema)
    rest = [c for c in stream.columns if c not in keys]
    out = spark.read.schema(stream.withColumn("_trigger", F.lit(0)).schema).option("recursiveFileLookup", True).parquet(f"{base}/out")
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_trigger").alias("_x")).select(*keys, "_x.*")


def hourly_alerts(spark: SparkSession, path: str) -> DataFrame:
    out = run_to_end(windowed(source(spark, path)), ["window", "event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """Each key's dominant state and counter after all events."""
    return run_to_end(state_counters(source(spark, path)), ["user_id"])


def trailing(pdf: pd.DataFrame) -> pd.DataFrame:
    """A key's events in order of (ts, event_id), from the last one on that differs from the newest: what lies before cannot change the counter, whatever is still to come."""
    pdf = pdf.sort_values(["ts", "event_id"], kind="stable")
    kind = pdf["event_type"]
    same = kind.isna() if pd.isna(kind.iloc[-1]) else kind == kind.iloc[-1]
    differs = (~same).to_numpy().nonzero()[0]
    return pdf.iloc[differs[-1] :] if len(differs) else pdf


def counted(batches, was, n: int, known: bool):
    """(dominant state, updates in it) after a key's events, from the state before, if it is known. A key's rows come in several Arrow batches,
    each in an order of its own, so the order is that of all of them; of those seen only the run that is still open is held."""
    held = None
    for pdf in batches:
        held = trailing(pdf if held is None else pd.concat([held, pdf]))
    now = None if pd.isna(held["event_type"].iloc[-1]) else held["event_type"].iloc[-1]
    first = held["event_type"].iloc[0]
    if (None if pd.isna(first) else first) != now:
        return now, len(held) - 2
    return now, (n if known and was == now else -1) + len(held)


def state_counters(events: DataFrame) -> DataFrame:
    """A key's dominant state and the updates since it last changed, as custom keyed state; updates count in order of (ts, event_id) within a trigger."""

    def update(key, batches, state):
        was, n = state.get if state.exists else (None, 0)
        was, n = counted((pdf[["ts", "event_id", "event_type"]] for pdf in batches), was, n, state.exists)
        state.update((was, n))
        yield pd.DataFrame({"user_id": [key[0]], "dominant_state": [was], "updates_in_state": [n]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    needed = events.select("user_id", "ts", "event_id", "event_type")
    return needed.groupBy("user_id").applyInPandasWithState(update, "user_id long, dominant_state string, updates_in_state long", "was string, n long", "update", GroupStateTimeout.NoTimeout)
