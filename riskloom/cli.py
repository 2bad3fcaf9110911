"""Commands over a store folder: import, batch, assess, backtest, freshness. ``python -m riskloom.cli --store FOLDER COMMAND ..``

The store has commits (graph, import log, and each cycle's states, risks and roll-up; see ``operators/commits.py``) and features/; reports/ has predictions.json and ground_truth.json for the back-test.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import constants as C
from riskloom.functions.scalar import d
from riskloom.operators import backtest, freshness, importing, store
from riskloom.plans import batch
from riskloom.plans.from_graph import estate_of
from riskloom.sources import readers

PREDICTED = "vuln_id string, asset_id string, exploit_likelihood double, adjusted_impact double, composite_risk double, final_rank long, markov_distribution array<double>"
HAPPENED = "vuln_id string, asset_id string, was_exploited boolean, actual_impact double, actual_state int"


def show(df: DataFrame, out, rows: int = 100) -> None:
    for r in df.limit(rows).collect():
        print(json.dumps(r.asDict(recursive=True), default=str), file=out)


def freshness_of(spark: SparkSession, folder: str, ref) -> tuple[DataFrame, DataFrame]:
    log = importing.stored(spark, folder, "import_log")
    thresholds = spark.createDataFrame(list(C.FRESHNESS_DAYS.items()), "source string, threshold_days int")
    report = freshness.report(log.withColumn("import_ts", F.col("import_ts").cast("timestamp_ntz")), thresholds, ref)
    return report, freshness.overall(report, spark.createDataFrame(list(C.FRESHNESS_WEIGHT.items()), "source string, weight double"))


def run_import(spark: SparkSession, folder: str, path: str, now: str, out) -> None:
    """The files that are new add to the stored graph; graph and log change together."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    is_folder = fs.exists(p) and fs.getFileStatus(p).isDirectory()
    show(importing.import_new(spark, folder, readers.importable(spark, path) if is_folder and not readers.route(path) else [path], now), out)


def _estate(spark: SparkSession, folder: str, ref):
    return estate_of(importing.stored(spark, folder, "nodes"), importing.stored(spark, folder, "edges"), ref)


def run_batch(spark: SparkSession, folder: str, now: str, out) -> None:
    ref = F.lit(now).cast("timestamp_ntz")
    fresh = freshness_of(spark, folder, ref)[1].first()[0]
    pairs, units = batch.daily_batch(_estate(spark, folder, ref), d(fresh), d(0), folder=folder, cycle=now[:10])
    show(pairs.agg(F.count(F.lit(1)).alias("pairs"), F.lit(fresh).alias("freshness"), F.lit("complete").alias("status")), out)


def run_assess(spark: SparkSession, folder: str, vuln: str, asset: str, now: str, out) -> None:
    ref = F.lit(now).cast("timestamp_ntz")
    fresh = freshness_of(spark, folder, ref)[1].first()[0]
    show(batch.assess(_estate(spark, folder, ref), vuln, asset, d(fresh), d(0)), out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=sys.stdout) -> int:
    p = argparse.ArgumentParser(prog="riskloom", description="Continuous risk scoring over an entity graph")
    p.add_argument("--store", required=True, help="folder of the store, in any file system that Spark reaches")
    p.add_argument("--now", default=None, help="reference time, else the present")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("import", help="import a file or a folder").add_argument("path")
    sub.add_parser("batch", help="run the daily batch")
    one = sub.add_parser("assess", help="assess one pair")
    one.add_argument("vuln_id")
    one.add_argument("asset_id")
    sub.add_parser("backtest", help="compare predictions with what happened")
    sub.add_parser("freshness", help="show how fresh the sources are")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("riskloom").getOrCreate()
    now = a.now or str(spark.sql("select current_timestamp()").first()[0])
    store.create_tables(spark, a.store)
    if a.command == "import":
        run_import(spark, a.store, a.path, now, out)
    elif a.command == "batch":
        run_batch(spark, a.store, now, out)
    elif a.command == "assess":
        run_assess(spark, a.store, a.vuln_id, a.asset_id, now, out)
    elif a.command == "backtest":
        predicted, happened = (readers.backtest_file(spark, f"{a.store}/reports/{n}.json", f) for n, f in (("predictions", PREDICTED), ("ground_truth", HAPPENED)))
        show(backtest.report(predicted, happened), out)
    else:
        report, overall = freshness_of(spark, a.store, F.lit(now).cast("timestamp_ntz"))
        show(report, out)
        show(overall, out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
