"""Sharding by rendezvous hashing of stable record keys over weighted shards.

``assign``: for every shard a record draws a uniform number u from the MD5 of its key and the shard's name, and goes to the shard with the smallest
-ln(u) / weight, the first such in case of a tie. A shard's share of the keys is its share of the weights. A draw depends on key and shard only, so a further shard takes records into
itself and moves no other, and a shard that leaves or loses weight gives up records of its own only.

``numbered``: places in each shard, gapless from 0, in the order of the key. Rows are dealt to ranges of (shard, key) and sorted there; a range holds one or more
runs of shards, and each run's length goes into a sum over ranges. So a shard may be larger than any task, and what is summed is one row a range and
shard.

``write_shards``: the records themselves, a folder a shard, files of a bounded number of rows; a hot shard is written by many tasks.

Only DataFrame functions. The key is the record's id as text. Defined results: a row whose id is null is keyed by the MD5 of its text under a name that no id has, so rows without ids spread
over the shards and equal ones stay together; rows that repeat an id share a shard and have a place each, ordered by text checksum, then size; which of two rows that agree
in all of these comes first shows in no column. A null text has size 8 and checksum 0, as an empty one. A very long text is hashed whole. An empty table gives no rows. Extra columns
are not read (``write_shards`` keeps them, whatever their names). A weight of 0 or less is an error, as is an empty list of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import narrow, partitions_for, shared_dir, written

#: Bytes that a record takes beside its text.
ID_BYTES = 8


def key_of(ident: Column, content: Column) -> Column:
    return F.coalesce(F.concat(F.lit("#"), ident.cast("string")), F.concat(F.lit("?"), F.md5(F.coalesce(content.cast("string"), F.lit("")))))


def uniform(key: Column, shard: Column) -> Column:
    """Between 0 and 1, neither included: 52 bits of a digest."""
    digest = F.md5(F.concat(key, F.lit("/"), shard.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def draws(key: Column, weights: list[float]) -> Column:
    """What each shard, from 0, asks of a record with this key: an array of (cost, shard)."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.transform(shards, lambda s: F.struct((-F.ln(uniform(key, s["shard"])) / s["weight"]).alias("cost"), s["shard"].alias("shard")))


def assign(key: Column, weights: list[float]) -> Column:
    """The shard, from 0, of a record with this key."""
    return F.array_min(draws(key, weights))["shard"]


def sharded(docs: DataFrame, weights: list[float], more: list[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, grown_shard): each record's shard, and the one it has when shards of the weights ``more`` are added."""
    d = narrow(docs, "doc_id", "text").toDF("doc_id", "text")
    all_draws = draws(key_of(F.col("doc_id"), F.col("text")), [*weights, *(more or [])])
    d = d.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ID_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        all_draws.alias("_draws"),
    )
    grown = F.array_min("_draws")["shard"] if more else F.lit(None).cast("int")
    return d.select("doc_id", "size", "text_crc32", "law", F.array_min(F.slice("_draws", 1, len(weights)))["shard"].alias("shard"), grown.alias("grown_shard"))


#: Ranges and groups up to which their sums, one row each, are broadcast.
BROADCAST_ROWS = 1_000_000


def numbered(rows: DataFrame, group: str, groups: int, order: list[str], name: str) -> DataFrame:
    """``rows`` with a long column ``name``: places from 0 in each of so many ``groups``, in ``order``."""
    spark = rows.sparkSession
    folder = shared_dir(spark)
    # ranges are sampled, so the rows are written first; rows that agree in all else are told apart, so that a range can end between them
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), f"{folder}/rows")
    parts = partitions_for(rows, 32 << 20)
    by = [group, *order, "_row"]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_row")
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), f"{folder}/dealt").withColumn("_task", F.shiftright("_at", 33))
    # each range and group has one run of neighbouring numbers: at most parts + groups runs in all
    runs = dealt.groupBy(group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(group, "_task", (before - F.col("_first")).alias("_shift"))
    runs = F.broadcast(runs) if parts + groups <= BROADCAST_ROWS else runs
    return dealt.join(runs, [group, "_task"]).withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_task", "_shift")


def shard_table(docs: DataFrame, weights: list[float], more: list[float] | None = None) -> DataFrame:
    """``sharded`` with each record's place, ``slot``, in its shard."""
    out = numbered(sharded(docs, weights, more), "shard", len(weights), ["doc_id", "text_crc32", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: list[float], max_rows: int = 1_000_000) -> str:
    """The records with all their columns under ``path``, a folder a shard; the name of the column that says the shard: ``shard``, with underscores where that is taken."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    placed = docs.withColumn(name, assign(key_of(docs["doc_id"], docs["text"]), weights))
    size = partitions_for(docs, 128 << 20)
    # as many tasks a shard as its share of the bytes asks for
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(-(-size // len(weights))))
    placed.withColumn("_salt", salt).repartition(max(size, len(weights)), name, "_salt").drop("_salt").write.partitionBy(name).option("maxRecordsPerFile", max_rows).parquet(path)
    return name
