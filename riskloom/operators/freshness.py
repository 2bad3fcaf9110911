"""Freshness of the data sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import d, days_between, freshness_score


def latest_imports(log: DataFrame, source: str = "source", ts: str = "import_ts") -> DataFrame:
    """The last import of each source."""
    return log.groupBy(F.col(source).alias("source")).agg(F.max(ts).alias("last_import"))


def report(log: DataFrame, thresholds: DataFrame, ref: Column) -> DataFrame:
    """A10: for each (source, threshold_days): age in days (null if never), stale?, score 0..1."""
    r = thresholds.join(latest_imports(log), "source", "left").withColumn("age_days", days_between(F.col("last_import"), ref))
    r = r.withColumn("stale", F.col("age_days").isNull() | (F.col("age_days") > F.col("threshold_days")))
    return r.withColumn("score", freshness_score(F.col("age_days"), F.col("threshold_days").cast("double")))


def overall(report_: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean score; an unknown source weighs 1."""
    r = report_.join(weights, "source", "left").withColumn("_w", F.coalesce(F.col("weight"), d(1)))
    return r.agg(F.coalesce(F.sum(F.col("_w") * F.col("score")) / F.nullif(F.sum("_w"), d(0)), d(0)).alias("overall_freshness"))
