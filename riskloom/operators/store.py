"""Feature, label, state, model and import stores: keyed tables as DataFrames, written as Parquet in partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import ab_bucket

MODEL_SCHEMA = "model string, version string, status string, trained_at timestamp, metrics map<string,double>"


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: one max_by, so partial aggregation runs before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def save_features(df: DataFrame, path: str, cycle: str) -> None:
    """K4: a cycle's features as one partition; saving a cycle again replaces it."""
    df.withColumn("cycle_id", F.lit(cycle)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cycle_id").parquet(path)


def training_dataset(features: DataFrame, labels: DataFrame, label: str, limit: int | None = None, per_pair: bool = True) -> DataFrame:
    """Features with a label, the newest first, all or with ``limit`` so many; each pair's latest features, or with ``per_pair=False`` every cycle's."""
    f = latest(features, ["vuln_id", "asset_id"], ["computed_at", "cycle_id"]) if per_pair else features
    lab = labels.where(F.col("label_name") == label).select("vuln_id", "asset_id", "label_value")
    out = f.join(lab, ["vuln_id", "asset_id"]).orderBy(F.desc("computed_at"), "vuln_id", "asset_id")
    return out if limit is None else out.limit(limit)


def kept_cycles(features: DataFrame, keep: int = 30, cycle: str = "cycle_id") -> DataFrame:
    """K7, U4: rows of the last ``keep`` cycles in lexicographic order; the cycles to keep are a distinct top-k, not a window over all rows."""
    last = features.select(cycle).distinct().orderBy(F.desc(cycle)).limit(keep)
    return features.join(F.broadcast(last), cycle, "left_semi")


def update_states(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(snapshot, history to append): the counter of updates in a state goes on while the dominant state stays, else starts at 0."""
    o = old.select(*key, F.col("dominant_state").alias("_was"), F.col("updates_in_state").alias("_n"))
    now = new.join(o, key, "left").withColumn("updates_in_state", F.when(F.col("dominant_state").eqNullSafe(F.col("_was")), F.coalesce("_n", F.lit(0)) + 1).otherwise(0)).drop("_was", "_n")
    rest = old.join(new, key, "left_anti")
    return rest.unionByName(now, allowMissingColumns=True), now


def promote(registry: DataFrame, model: str, version: str) -> DataFrame:
    """K9: the version becomes production, the one before is archived."""
    mine = F.col("model") == model
    return registry.withColumn("status", F.when(mine & (F.col("version") == version), "production").when(mine & (F.col("status") == "production"), "archived").otherwise(F.col("status")))


def production(registry: DataFrame) -> DataFrame:
    """The production version of each model."""
    return latest(registry.where("status = 'production'"), ["model"], ["trained_at", "version"])


def variants(keys: DataFrame, key: str, share_a: float, a: str = "A", b: str = "B") -> DataFrame:
    """F-hash2, L8: a fixed A/B variant for each key by its hash."""
    bucket = ab_bucket(F.col(key))
    return keys.withColumn("bucket", bucket).withColumn("variant", F.when(F.col("bucket") / 10000 < share_a, a).otherwise(b))


def upsert_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """K2: an import log with new batches; a batch_id that comes again replaces the old row."""
    both = log.withColumn("_n", F.lit(0)).unionByName(rows.withColumn("_n", F.lit(1)))
    return latest(both, ["batch_id"], ["_n"]).drop("_n")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def version_list(registry: DataFrame, model: str) -> DataFrame:
    """W10."""
    return registry.where(F.col("model") == model).orderBy(F.desc("trained_at"), F.desc("version"))


def register(registry: DataFrame, rows: DataFrame) -> DataFrame:
    """K9: a registry with new versions, which start as "staged"; a version that comes again replaces the old row."""
    both = registry.withColumn("_n", F.lit(0)).unionByName(rows.withColumn("status", F.lit("staged")).withColumn("_n", F.lit(1)), allowMissingColumns=True)
    return latest(both, ["model", "version"], ["_n"]).drop("_n")


def start_ab_test(tests: DataFrame, model: str, a: str, b: str, share_a: float, started_at) -> DataFrame:
    """Tests (model, version_a, version_b, share_a, started_at, ended_at) with one more; the model's running test ends as it starts."""
    if not 0 <= share_a <= 1:
        raise ValueError("share_a must be between 0 and 1")
    ended = end_ab_test(tests, model, started_at)
    new = tests.sparkSession.range(1).select(F.lit(model).alias("model"), F.lit(a).alias("version_a"), F.lit(b).alias("version_b"), F.lit(float(share_a)).alias("share_a"), F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(None).cast("timestamp").alias("ended_at"))
    return ended.unionByName(new)


def end_ab_test(tests: DataFrame, model: str, ended_at) -> DataFrame:
    """The model's running test, if any, has an end."""
    running = (F.col("model") == model) & F.col("ended_at").isNull()
    return tests.withColumn("ended_at", F.when(running, F.lit(ended_at).cast("timestamp")).otherwise(F.col("ended_at")))


def exposures(tests: DataFrame, uses: DataFrame, key: str, at: str) -> DataFrame:
    """Uses (model, ``key``, ``at``) that fell into a test of their model, with the version that the key's hash gives them and the test's times; an end is not part of its test."""
    # tests are few; joined by model, all uses of a model would be one task
    running = uses.join(F.broadcast(tests), "model").where((F.col(at) >= F.col("started_at")) & (F.col("ended_at").isNull() | (F.col(at) < F.col("ended_at"))))
    return running.withColumn("version", F.when(ab_bucket(F.col(key)) / 10000 < F.col("share_a"), F.col("version_a")).otherwise(F.col("version_b"))).select(*uses.columns, "version", "started_at", "ended_at")


def pruned(features: DataFrame, keep: int = 30, cycle: str = "cycle_id") -> tuple[DataFrame, DataFrame]:
    """K7: (rows of the cycles that stay, one row with the number of cycles removed)."""
    cycles = features.select(cycle).distinct()
    gone = cycles.agg(F.greatest(F.count(F.lit(1)) - keep, F.lit(0)).alias("removed_cycles"))
    return kept_cycles(features, keep, cycle), gone


def prune_files(spark: SparkSession, path: str, keep: int = 30, cycle: str = "cycle_id") -> int:
    """K7 on a table in partitions by cycle: folders of older cycles are deleted, no row is rewritten; the number of cycles removed."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted((x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().startswith(f"{cycle}=")), reverse=True)
    for name in names[keep:]:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return len(names[keep:])


def table(spark: SparkSession, path: str, where: str | None = None, order: list[Column] = (), limit: int | None = None) -> DataFrame:
    """A stored table, filtered, ordered and cut to a page; filter and columns reach the scan."""
    t = spark.read.parquet(path)
    t = t.where(where) if where else t
    t = t.orderBy(*order) if order else t
    return t.limit(limit) if limit is not None else t


def as_json(df: DataFrame, key: list[str], name: str = "payload") -> DataFrame:
    """F-json1: all other columns as one JSON column."""
    return df.select(*key, F.to_json(F.struct(*[c for c in df.columns if c not in key])).alias(name))


def of_json(df: DataFrame, key: list[str], schema: str, name: str = "payload") -> DataFrame:
    """F-json1: and back."""
    return df.select(*key, F.from_json(name, schema).alias("_x")).select(*key, "_x.*")


#: The stored tables' columns.
TABLES = {
    "import_log": "batch_id string, source string, file string, import_ts timestamp, records long, sha256 string",
    "node_versions": "node_id string, version int, changed_at timestamp, attrs map<string,string>",
    "features": "vuln_id string, asset_id string, cycle_id string, computed_at timestamp, features map<string,double>",
    "labels": "vuln_id string, asset_id string, label_name string, label_value double",
    "states": "vuln_id string, asset_id string, distribution array<double>, dominant_state int, entropy double, updates_in_state long, absorption_time double, cycle_id string",
    "models": MODEL_SCHEMA,
    "ab_tests": "model string, version_a string, version_b string, share_a double, started_at timestamp, ended_at timestamp",
}


def create_tables(spark: SparkSession, path: str) -> None:
    """Those tables that are not there yet, empty."""
    jvm = spark.sparkContext._jvm
    for name, schema in TABLES.items():
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
