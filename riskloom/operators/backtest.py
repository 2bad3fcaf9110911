"""Back-test metrics: predictions against what happened."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.scalar import d
from riskloom.operators.service import running_total


def matched(predictions: DataFrame, actual: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Predictions with what happened; of repeated actual rows the last by ``order`` counts, unmatched predictions drop out."""
    cols = [x for x in actual.columns if x not in keys]
    last = actual.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_x")).select(*keys, *[F.col(f"_x.{x}").alias(x) for x in cols])
    return predictions.join(last, keys)


def confusion(df: DataFrame, score: str, label: str, at: float = 0.5) -> DataFrame:
    """Precision, recall, f1 and the four counts."""
    p, y = F.col(score) >= at, F.col(label) == 1
    n = lambda x: F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")
    c = df.agg(n(p & y).alias("tp"), n(p & ~y).alias("fp"), n(~p & y).alias("fn"), n(~p & ~y).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(d(0))
    c = c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall")))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve, ties averaged; 0.5 with one class only.

    Rows are counted by distinct score first; the running sum over those goes in two steps, in range partitions.
    """
    g = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0.0).otherwise(1.0)).alias("n"))
    g = running_total(g, "s", "n").withColumn("_won", F.col("p") * (F.col("upto") - F.col("n") / 2))
    total = F.sum("p") * F.sum("n")
    return g.agg(F.when(total > 0, F.sum("_won") / total).otherwise(d(0.5)).alias("auc"))


def errors(df: DataFrame, predicted: str, actual: str, default: float = 5.0) -> DataFrame:
    """Mae and rmse."""
    e = F.coalesce(F.col(predicted), d(default)) - F.coalesce(F.col(actual), d(default))
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def state_accuracy(df: DataFrame, predicted: str, actual: str) -> DataFrame:
    """Share of rows, of those with both, whose predicted state is the actual one."""
    both = df.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    return both.agg(F.coalesce(F.avg(F.when(F.col(predicted) == F.col(actual), 1.0).otherwise(0.0)), d(0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, order: list[Column], label: str, k: int = 10) -> DataFrame:
    """Precision and recall of the first k; the first k come from a top-k, not a full sort."""
    first = df.orderBy(*order).limit(k).agg(F.coalesce(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.lit(0)).alias("_hits"), F.count(F.lit(1)).alias("_k"))
    total = df.agg(F.coalesce(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)), F.lit(0)).alias("_all"))
    return first.crossJoin(F.broadcast(total)).select(F.when(F.col("_k") > 0, F.col("_hits") / F.col("_k")).otherwise(d(0)).alias("precision_at_k"), F.when(F.col("_all") > 0, F.col("_hits") / F.col("_all")).otherwise(d(0)).alias("recall_at_k"))


def overall(auc_: Column, mae: Column, accuracy: Column, precision_at_k: Column) -> Column:
    """A16."""
    return (auc_ + (d(1) - F.least(d(1), mae / 10)) + accuracy + precision_at_k) / 4


def report(predictions: DataFrame, happened: DataFrame, k: int = 10) -> DataFrame:
    """J5, A11-A16 in one row: pairs matched, precision, recall, f1, auc, mae, rmse, state accuracy, precision and recall of the first k, overall score.

    predictions: vuln_id, asset_id, exploit_likelihood, adjusted_impact, final_rank, markov_distribution; happened: vuln_id, asset_id, was_exploited, actual_impact, actual_state.
    """
    from riskloom.functions.lineage import cut
    from riskloom.functions.scalar import argmax

    keys = ["vuln_id", "asset_id"]
    m = cut(matched(predictions, happened.withColumn("_n", F.monotonically_increasing_id()), keys, "_n"))
    m = m.withColumns({"_label": F.when(F.col("was_exploited"), 1).otherwise(0), "_score": F.coalesce("exploit_likelihood", d(0)), "_state": argmax(F.col("markov_distribution"))})
    parts = [
        m.agg(F.count(F.lit(1)).alias("pairs")),
        confusion(m, "_score", "_label").select("precision", "recall", "f1"),
        auc(m, "_score", "_label"),
        errors(m, "adjusted_impact", "actual_impact").select(F.coalesce("mae", d(5)).alias("mae"), "rmse"),
        state_accuracy(m, "_state", "actual_state").select("accuracy"),
        top_k(m, [F.col("final_rank"), *[F.col(x) for x in keys]], "_label", k),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.withColumn("overall_score", overall(F.col("auc"), F.col("mae"), F.col("accuracy"), F.col("precision_at_k")))
