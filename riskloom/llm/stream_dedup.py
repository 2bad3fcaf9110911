"""Exact deduplication by a stateful stream.

``scan_state`` runs a Structured Streaming aggregation over the documents' digests
with the RocksDB state store and no watermark: state is on disk and never expires.
A key is a digest (SHA-256 of the text's UTF-8 bytes); its state is the group's
size, the stable identifier of the row that stays (the largest doc_id) and that
row's content locator (the file that holds it). Each trigger emits changed keys only;
they are appended to a log in the shared folder, of which the last entry of a
key counts. Kept with its checkpoint folder, the stream goes on with later files.

``verdicts`` joins the state to the documents and, on hits (groups of more than
one), compares the full bytes with those of the row that stays. A row whose
bytes differ in spite of an equal digest is no copy: it stays, as a group of one.

Only DataFrame and Structured Streaming operations run on the executors. The
stream's partial aggregation leaves one record for each key and task, so a hot group is
not a hot partition; the two joins are plain shuffled equi-joins of which AQE can split
the skewed side, as the state and the rows that stay have a key once.

Defined results: a null text counts as empty. Null doc_ids rank lowest; a group with
no other has keep_id null and its rows stay. Rows that repeat both doc_id and text
are one document: they get the same verdict. An empty table gives no rows. A very long text
is read whole, hashed and compared like others. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import is_file, release, remove, shared_dir, written

#: State on disk; each store's files grow with its state instead of being allocated ahead (4 MB for each partition), and a commit uploads changes only.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def digest(text: str = "text") -> Column:
    return digest_of(F.col(text))


def scan_state(stream: DataFrame, folder: str) -> DataFrame:
    """Consume all that the streaming ``stream`` (doc_id, text_sha256, locator) has and return the state: text_sha256, keep_id, locator, group_size."""
    spark = stream.sparkSession
    state = (
        stream.groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "locator")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        .select("text_sha256", F.col("top.doc_id").alias("keep_id"), F.col("top.locator").alias("locator"), "group_size")
    )
    log = f"{folder}/log"

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{log}/run={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        q = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(append).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "text_sha256 string, keep_id long, locator string, group_size long, batch int"
    if q.lastProgress is None or q.lastProgress["batchId"] < 0:
        return spark.createDataFrame([], schema).drop("batch")
    out = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(log)
    if q.lastProgress["batchId"] > 0:  # keys may have been emitted more than once
        out = out.groupBy("text_sha256").agg(F.max_by(F.struct("keep_id", "locator", "group_size"), "batch").alias("x")).select("text_sha256", "x.*")
    return out.select("text_sha256", "keep_id", "locator", "group_size")


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files at ``path``, a folder or one file, as a stream of doc_id, text_sha256 and locator."""
    reader = spark.readStream.schema("doc_id long, text string")
    if is_file(spark, path):  # the source takes folders: the file's folder, with only its name let through
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).select("doc_id", digest().alias("text_sha256"), F.col("_metadata.file_path").alias("locator"))


def stream_of(docs: DataFrame, folder: str) -> DataFrame:
    """Any DataFrame as such a stream: its ids and digests are written to the shared folder as a feed."""
    feed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest_of(docs["text"]).alias("text_sha256"), F.input_file_name().alias("locator"))
    feed = written(feed, f"{folder}/feed")
    return docs.sparkSession.readStream.schema(feed.schema).parquet(f"{folder}/feed")


def verdicts(docs: DataFrame, state: DataFrame, folder: str, carry: list[str] = ()) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, locator, and the carried columns as ``_in_`` and their name.

    One shuffle of the texts, by digest; after it only hits (groups of more than one) keep their bytes.
    """
    carried = [docs[c].alias(f"_in_{c}") for c in carry]
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("_text"), *carried).withColumn("text_sha256", digest("_text"))
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    d = d.join(state, "text_sha256").withColumn("_hit", (F.col("group_size") > 1) & F.col("keep_id").isNotNull())
    d = written(d.withColumn("_text", F.when(F.col("_hit"), F.col("_text"))), f"{folder}/joined")
    kept = written(d.where(F.col("_hit") & stays).groupBy("text_sha256").agg(F.first("_text").alias("_kept")), f"{folder}/kept")
    hits = d.where("_hit").join(kept, "text_sha256").withColumn("_same", F.coalesce("_text", F.lit("")) == F.coalesce("_kept", F.lit(""))).drop("_kept")
    out = d.where("not _hit").withColumn("_same", F.lit(True)).unionByName(hits)
    same = F.col("_same")
    return out.select(
        "doc_id",
        F.when(same, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.when(same, F.col("group_size")).otherwise(F.lit(1)).cast("long").alias("group_size"),
        F.when(same, stays).otherwise(F.lit(True)).alias("kept"),
        "text_sha256",
        "locator",
        *[f"_in_{c}" for c in carry],
    )


def deduplicate(docs: DataFrame, carry: list[str] = (), path: str | None = None) -> DataFrame:
    """State and verdicts of a batch DataFrame; ``path``: the folder or file of Parquet that it was read from, if any."""
    folder = shared_dir(docs.sparkSession)
    stream = stream_files(docs.sparkSession, path) if path else stream_of(docs, folder)
    return verdicts(docs, scan_state(stream, folder), folder, carry)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat doc_id and text, one.

    Verdicts are written without texts; what goes leaves the documents by an anti-join on doc_id and digest.
    """
    spark = docs.sparkSession
    work, folder = shared_dir(spark), shared_dir(spark)
    told = verdicts(docs, scan_state(stream_of(docs, work), work), work)
    told = written(told.select("doc_id", "text_sha256", "kept"), f"{folder}/verdicts")
    remove(spark, work)
    release(spark)
    gone = told.where("not kept").select(F.col("doc_id").alias("_gone"), "text_sha256").distinct()
    text_digest = digest_of(docs["text"])
    stays = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_gone"]) & (text_digest == gone["text_sha256"]), "left_anti")
    if told.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        rows = stays.select(F.struct(*[stays[c] for c in docs.columns]).alias("_row"), stays["doc_id"].alias("_id"), digest_of(stays["text"]).alias("_digest"))
        stays = rows.groupBy("_id", "_digest").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return stays
