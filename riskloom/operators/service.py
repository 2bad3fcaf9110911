"""Read side: lists, details, pages, filters and lookups over scored pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.scalar import d, risk_band, split_key


def check_page(limit: int, offset: int = 0, most: int = 10_000) -> None:
    """P3."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")


def listed(entities: DataFrame, risks: DataFrame, key: str, sort_by: str = "risk", limit: int = 100, offset: int = 0) -> DataFrame:
    """Entities with the largest risk of their pairs, a page in falling order (null counts as 0), ties by key."""
    check_page(limit, offset)
    top = risks.groupBy(key).agg(F.max("risk").alias("risk"))
    return entities.join(top, key, "left").orderBy(F.coalesce(F.col(sort_by).cast("double"), d(0)).desc(), F.col(key)).offset(offset).limit(limit)


def risk_pairs(risks: DataFrame, min_risk: float = 0.0, limit: int | None = None) -> DataFrame:
    """Pairs of at least ``min_risk``, riskiest first where a page is asked for."""
    if not 0 <= min_risk <= 1:
        raise ValueError("min_risk must be between 0 and 1")
    out = risks.where(F.col("risk") >= min_risk)
    if limit is None:
        return out
    check_page(limit)
    return out.orderBy(F.desc("risk"), "vuln_id", "asset_id").limit(limit)


def detail(entities: DataFrame, edges: DataFrame, key: str, other: str) -> DataFrame:
    """Each entity with the sorted distinct ids at the other end of its links."""
    near = edges.groupBy(key).agg(F.array_sort(F.collect_set(other)).alias("linked"))
    return entities.join(near, key, "left").withColumn("linked_count", F.coalesce(F.size("linked"), F.lit(0)))


def prioritised(ranked: DataFrame, limit: int = 100) -> DataFrame:
    """W11."""
    check_page(limit, most=1000)
    return ranked.where(F.col("final_rank") <= limit)


def banded(risks: DataFrame) -> DataFrame:
    """Number of pairs in each dashboard band."""
    return risks.groupBy(risk_band(F.col("risk")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def page(entities: DataFrame, risks: DataFrame, key: str, sort_by: str = "risk", limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one row with the list's total, a page of it)."""
    return entities.agg(F.count(F.lit(1)).alias("total")), listed(entities, risks, key, sort_by, limit, offset)


def split_pairs(rows: DataFrame, key: str = "pair_key") -> DataFrame:
    """vuln_id and asset_id in place of the key, cut at its first "::"; rows whose key has none are skipped."""
    vuln, asset = split_key(F.col(key))
    return rows.where(F.contains(F.col(key), F.lit("::"))).withColumns({"vuln_id": vuln, "asset_id": asset}).drop(key)


def percentiles(df: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles, linear between ranks, in one row: values are counted, numbered in range partitions, and only those at the asked ranks are read."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, "v", "n")
    n = ranked.agg(F.max("upto")).first()[0]
    if not n:
        return df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(k) for k in shares])
    at = {k: (n - 1) * p for k, p in shares.items()}
    pick = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    return ranked.agg(*[(pick(int(x)) + (pick(min(int(x) + 1, n - 1)) - pick(int(x))) * (x - int(x))).alias(k) for k, x in at.items()])


def running_total(counts: DataFrame, order: str, n: str) -> DataFrame:
    """``counts`` with upto, the sum of ``n`` up to and with each row: inside range partitions first, then with the partitions' totals, one number each."""
    from pyspark.sql import Window

    from riskloom.functions.lineage import cut

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(counts.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    before = dealt.groupBy("_part").agg(F.sum(n).alias("_t")).select("_part", F.coalesce(F.sum("_t").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum(n).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("upto", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def summary(risks: DataFrame, value: str, freshness: DataFrame) -> DataFrame:
    """Pairs, mean, largest, median and 95th percentile of the risks, and the data's overall freshness (one row)."""
    flat = risks.agg(F.count(F.lit(1)).alias("total_pairs"), F.coalesce(F.avg(value), d(0)).alias("mean_risk"), F.coalesce(F.max(value), d(0)).alias("max_risk"))
    return flat.crossJoin(percentiles(risks, value, {"median_risk": 0.5, "p95_risk": 0.95})).crossJoin(freshness)


def forecast_of(forecasts: DataFrame, key: str, horizons: tuple[int, ...]) -> DataFrame:
    """(horizon_days, risk_score) of one pair, by its key; no rows if it is unknown."""
    points = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon_days"), F.col(f"risk_{h}").alias("risk_score")) for h in horizons]))
    return forecasts.where(F.concat_ws("::", "vuln_id", "asset_id") == key).select(points.alias("x")).select("x.*")


def unit_of(units: DataFrame, bu: str | None = None) -> DataFrame:
    """The roll-up, of one unit or all."""
    return units if bu is None else units.where(F.col("bu") == bu)


def update_caches(views: dict[str, DataFrame]) -> None:
    """What a batch has made, in place of what the service showed before."""
    for name, df in views.items():
        df.createOrReplaceTempView(f"service_{name}")


def cached(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(f"service_{name}")


def select_fields(resolvers: dict[str, Callable[..., DataFrame]], name: str, fields: list[str], **arguments) -> DataFrame:
    """One field of the query surface with its arguments, and of its rows the chosen fields; unknown ones are an error."""
    if name not in resolvers:
        raise ValueError(f"unknown query {name!r}: {', '.join(resolvers)}")
    rows = resolvers[name](**arguments)
    if missing := [f for f in fields if f not in rows.columns]:
        raise ValueError(f"unknown fields of {name}: {', '.join(missing)}")
    return rows.select(*fields)
