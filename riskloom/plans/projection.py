"""The driver's tables seen as risk data: the same projections as DataFrames and, for the oracle, as SQL common table expressions.

part is the vulnerability, supplier the asset, a (part, supplier) of lineitem a pair, events the intelligence and
history, orders the registries, region and nation the organisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.lineage import spread_by
from riskloom.functions.scalar import d, q6

REF = "2024-02-10 00:00:00"
EVENT_SOURCES = ("nvd", "cisa_kev", "exploitdb", "otx", "siem_alerts")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ref() -> Column:
    return F.lit(REF).cast("timestamp_ntz")


def day(base: str, n: Column) -> Column:
    return F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(n.cast("int"))


def vulns(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    published = day("2023-06-01 00:00:00", k % 200)
    return table(spark, sf, "part").select(
        k.alias("vuln_id"),
        (size / d(5)).alias("cvss"),
        F.array(F.col("p_type"), F.concat(F.lit("S"), (size % 7).cast("string"))).alias("cwe_ids"),
        F.col("p_brand").alias("vendor"),
        F.col("p_name").alias("description"),
        (k % 17 == 0).alias("is_in_kev"),
        (k % 5 == 0).alias("has_public_exploit"),
        published.alias("published_ts"),
        F.when(k % 3 == 0, published + F.make_dt_interval(size)).alias("patch_ts"),
        F.when(k % 4 == 0, size.cast("double")).otherwise(d(-1)).alias("patch_lag_days"),
        F.element_at(F.array(*[F.lit(x) for x in ("poc", "Functional", "weaponized", "none", "HIGH", "unproven")]), (k % 6 + 1).cast("int")).alias("exploit_maturity"),
        (size / d(7)).alias("cvss_exploitability"),
        (size / d(9)).alias("cvss_impact"),
        F.when(k % 4 == 1, (k % 45).cast("int")).otherwise(F.lit(-1)).alias("exploit_velocity_days"),
    )


VULN = """vuln AS (SELECT p_partkey AS vuln_id, p_size / 5.0::DOUBLE AS cvss, [p_type, 'S' || (p_size % 7)] AS cwe_ids, p_brand AS vendor, p_name AS description,
 p_partkey % 17 = 0 AS is_in_kev, p_partkey % 5 = 0 AS has_public_exploit, TIMESTAMP '2023-06-01' + to_days(CAST(p_partkey % 200 AS INT)) AS published_ts,
 CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2023-06-01' + to_days(CAST(p_partkey % 200 AS INT) + p_size) END AS patch_ts,
 CASE WHEN p_partkey % 4 = 0 THEN p_size::DOUBLE ELSE -1.0::DOUBLE END AS patch_lag_days,
 ['poc', 'Functional', 'weaponized', 'none', 'HIGH', 'unproven'][p_partkey % 6 + 1] AS exploit_maturity,
 p_size / 7.0::DOUBLE AS cvss_exploitability, p_size / 9.0::DOUBLE AS cvss_impact,
 CASE WHEN p_partkey % 4 = 1 THEN CAST(p_partkey % 45 AS INT) ELSE -1 END AS exploit_velocity_days FROM part)"""


def assets(spark: SparkSession, sf: str) -> DataFrame:
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    nation = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return (
        table(spark, sf, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            k.alias("asset_id"),
            F.col("s_name").alias("hostname"),
            F.when(bal < 1500, "low").when(bal < 4500, "medium").when(bal < 8000, "high").otherwise("critical").alias("criticality"),
            F.element_at(F.array(*[F.lit(x) for x in ("dmz", "internal", "external", "restricted")]), (k % 4 + 1).cast("int")).alias("zone"),
            F.col("n_name").alias("bu"),
            F.col("r_name").alias("parent_bu"),
            day("2024-01-01 00:00:00", k % 30).alias("last_scan_ts"),
        )
    )


ASSET = """asset AS (SELECT s_suppkey AS asset_id, s_name AS hostname,
 CASE WHEN s_acctbal < 1500 THEN 'low' WHEN s_acctbal < 4500 THEN 'medium' WHEN s_acctbal < 8000 THEN 'high' ELSE 'critical' END AS criticality,
 ['dmz', 'internal', 'external', 'restricted'][s_suppkey % 4 + 1] AS zone, n_name AS bu, r_name AS parent_bu, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 30 AS INT)) AS last_scan_ts
 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

TIER_SQL = "CASE criticality WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.75::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END"


def q6_sql(x: str) -> str:
    return f"floor(({x} + 1e-9) * 1e6) / 1e6"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(vuln_id, asset_id, exploit, impact, cost): averaged signals, cut to six digits so later arithmetic does not depend on the order of sums.

    Pairs are nearly as many as lines, so lines are dealt once, by pair, to as many tasks as their size asks for: a task's groups do not grow with the table.
    """
    lines = spread_by(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_tax"), "l_partkey", "l_suppkey", bytes_each=1 << 20)
    g = lines.groupBy(F.col("l_partkey").alias("vuln_id"), F.col("l_suppkey").alias("asset_id"))
    return g.agg(q6(F.avg("l_discount") * 10).alias("exploit"), q6(F.avg("l_quantity") / 5).alias("impact"), q6(F.avg("l_tax") * 10 + 1).alias("cost"))


PAIR = f"""pair AS (SELECT l_partkey AS vuln_id, l_suppkey AS asset_id, {q6_sql("avg(l_discount) * 10")} AS exploit, {q6_sql("avg(l_quantity) / 5")} AS impact, {q6_sql("avg(l_tax) * 10 + 1")} AS cost
 FROM lineitem GROUP BY ALL)"""


def with_criticality(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    from riskloom.operators.risk import criticality_score

    # left to itself, Spark takes the pairs for the smaller side and sends them all through the driver
    a = assets(spark, sf).select("asset_id", "criticality", criticality_score(F.col("criticality")).alias("crit"))
    return df.join(F.broadcast(a), "asset_id")


SIGNAL = f"signal AS (SELECT p.*, a.criticality, {TIER_SQL} AS crit FROM pair p JOIN asset a USING (asset_id))"


def with_state(df: DataFrame) -> DataFrame:
    v, a = F.col("vuln_id"), F.col("asset_id")
    raw = [v % 3 + 1, a % 4 + 1, v % 5 + 1, a % 2 + 1, F.lit(1), F.lit(0.5)]
    total = sum((x.cast("double") for x in raw[1:]), raw[0].cast("double"))
    return df.withColumns({f"s{i}": x.cast("double") / total for i, x in enumerate(raw)})


_W = ["(1 + vuln_id % 3)", "(1 + asset_id % 4)", "(1 + vuln_id % 5)", "(1 + asset_id % 2)", "1", "0.5::DOUBLE"]
STATE = "state AS (SELECT *, " + ", ".join(f"CAST({w} AS DOUBLE) / ({' + '.join(_W)}) AS s{i}" for i, w in enumerate(_W)) + " FROM signal)"


def connects(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey")
    n = F.broadcast(s.agg(F.count(F.lit(1)).alias("n")))
    k = F.col("s_suppkey")
    return s.crossJoin(n).select(k.alias("src"), F.explode(F.array((k * 7 + 1) % F.col("n"), (k * 13 + 5) % F.col("n"))).alias("dst")).where("src <> dst").distinct()


CONNECT = """connect AS (SELECT DISTINCT src, dst FROM (SELECT s_suppkey AS src, unnest([(s_suppkey * 7 + 1) % n, (s_suppkey * 13 + 5) % n]) AS dst FROM supplier, (SELECT count(*) AS n FROM supplier)) WHERE src <> dst)"""


def risks(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with state, composite risk (six digits) and the mass on states 2 and 3."""
    from riskloom.operators.risk import composite

    df = with_state(with_criticality(pairs(spark, sf), spark, sf)).withColumn("active_mass", F.col("s2") + F.col("s3"))
    return df.withColumn("risk", q6(composite(F.col("exploit"), F.col("impact"), F.col("active_mass"), F.col("crit"))))


RISK = f"""risk AS (SELECT *, s2 + s3 AS active_mass, {q6_sql("greatest(0, least(1, 0.30::DOUBLE * exploit + 0.25::DOUBLE * (impact / 10) + 0.25::DOUBLE * (s2 + s3) + 0.20::DOUBLE * crit))")} AS risk FROM state)"""

WITH_PAIR = f"WITH {ASSET}, {PAIR}, {SIGNAL}, {STATE}, {RISK}"


def intel_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """events as intelligence nodes: type by event_id, time of the event."""
    kinds = F.array(*[F.lit(x) for x in ("Indicator", "ThreatActor", "Campaign", "TTP")])
    return table(spark, sf, "events").select(F.concat(F.lit("ev"), F.col("event_id")).alias("node_id"), F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("node_type"), F.col("ts").alias("modified_ts"), (F.col("event_id") * 7 % 500).alias("vuln_id"))


INTEL = "intel AS (SELECT 'ev' || event_id AS node_id, ['Indicator', 'ThreatActor', 'Campaign', 'TTP'][event_id % 4 + 1] AS node_type, ts AS modified_ts, event_id * 7 % 500 AS vuln_id FROM events)"


def history(spark: SparkSession, sf: str) -> DataFrame:
    """events as state history: key user_id, order (ts, event_id), mass value / 600, dominant state the event type."""
    return table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id", (F.col("value") / 600).alias("mass"), F.col("event_type").alias("state"))


HISTORY = "history AS (SELECT user_id AS key, ts, event_id, value / 600 AS mass, event_type AS state FROM events)"


def import_log(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in EVENT_SOURCES])
    return table(spark, sf, "events").select(F.element_at(names, (F.col("user_id") % 5 + 1).cast("int")).alias("source"), F.col("ts").alias("import_ts"), F.col("event_id").alias("batch_id"))


IMPORTS = f"imports AS (SELECT {list(EVENT_SOURCES)!r}[user_id % 5 + 1] AS source, ts AS import_ts, event_id AS batch_id FROM events)"
