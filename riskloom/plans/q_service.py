"""Queries of the read side and of the streaming forms run to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.scalar import q6
from riskloom.operators import service as S
from riskloom.plans import projection as P
from riskloom.plans.projection import q6_sql
from riskloom.plans.registry import query

_TOP = "top AS (SELECT vuln_id, max(risk) AS risk FROM risk GROUP BY vuln_id)"


@query(f"{P.WITH_PAIR}, {P.VULN}, {_TOP} SELECT v.vuln_id, v.cvss, t.risk FROM vuln v LEFT JOIN top t USING (vuln_id) ORDER BY coalesce(risk, 0) DESC, vuln_id LIMIT 50 OFFSET 10")
def list_vulns(spark, sf):
    """A page of a list: fifty vulnerabilities from the eleventh on."""
    return S.listed(P.vulns(spark, sf).select("vuln_id", "cvss"), P.risks(spark, sf), "vuln_id", limit=50, offset=10)


@query(f"{P.WITH_PAIR} SELECT a.asset_id, a.hostname, t.risk FROM asset a LEFT JOIN (SELECT asset_id, max(risk) AS risk FROM risk GROUP BY asset_id) t USING (asset_id) ORDER BY coalesce(t.risk, 0) DESC, a.asset_id LIMIT 100")
def list_assets(spark, sf):
    """A page of a list: the first hundred assets."""
    return S.listed(P.assets(spark, sf).select("asset_id", "hostname"), P.risks(spark, sf), "asset_id", limit=100)


@query(f"{P.WITH_PAIR} SELECT vuln_id, asset_id, risk FROM risk WHERE risk >= 0.6")
def risk_pairs_min(spark, sf):
    return S.risk_pairs(P.risks(spark, sf).select("vuln_id", "asset_id", "risk"), 0.6)


@query(f"WITH {P.VULN}, l AS (SELECT l_partkey AS vuln_id, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS assets, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_partkey) SELECT v.vuln_id, v.description, coalesce(assets, '') AS assets, coalesce(n, 0) AS linked_count FROM vuln v LEFT JOIN l USING (vuln_id)")
def vuln_detail(spark, sf):
    edges = P.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("vuln_id"), F.col("l_suppkey").alias("asset_id"))
    out = S.detail(P.vulns(spark, sf).select("vuln_id", "description"), edges, "vuln_id", "asset_id")
    return out.select("vuln_id", "description", F.coalesce(F.array_join(F.transform("linked", lambda x: x.cast("string")), ","), F.lit("")).alias("assets"), F.col("linked_count").cast("long").alias("linked_count"))


@query(f"{P.WITH_PAIR} SELECT CASE WHEN risk >= 0.8 THEN 'critical' WHEN risk >= 0.6 THEN 'high' WHEN risk >= 0.3 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM risk GROUP BY 1")
def risk_bands(spark, sf):
    return S.banded(P.risks(spark, sf))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, floor((sum(value) + 1e-9) * 1e4) / 1e4 AS total FROM events GROUP BY 1, 2")
def alerts_windowed(spark, sf):
    from riskloom.streaming.alerts import hourly_alerts

    out = hourly_alerts(spark, f"{sf}/events.parquet")
    return out.select("window_start", "event_type", "n", (F.floor((F.col("total") + 1e-9) * 1e4) / 1e4).alias("total"))




@query(
    f"""WITH {P.HISTORY}, a AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY key ORDER BY ts, event_id) IS NOT DISTINCT FROM state THEN 0 ELSE 1 END AS n FROM history),
 b AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY ts, event_id) AS island, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS back FROM a),
 c AS (SELECT key, island, count(*) - 1 AS updates FROM b GROUP BY ALL) SELECT b.key AS user_id, b.state AS dominant_state, updates AS updates_in_state FROM b JOIN c USING (key, island) WHERE back = 1"""
)
def stream_state_counters(spark, sf):
    from riskloom.streaming.alerts import latest_states

    return latest_states(spark, f"{sf}/events.parquet")


@query(
    f"""WITH p AS (SELECT c_custkey AS k, least(1, abs(c_acctbal) / 10000) AS score, c_custkey % 10 AS impact, c_custkey AS final_rank FROM customer), a AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS hit, max(o_orderkey % 9)::DOUBLE AS impact FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey),
 m AS (SELECT p.k, score, p.impact AS predicted, a.impact AS actual, CASE WHEN hit THEN 1 ELSE 0 END AS y FROM p JOIN a USING (k)), c AS (SELECT count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn FROM m)
 SELECT (SELECT count(*) FROM m) AS pairs, {q6_sql('tp / (tp + fp)::DOUBLE')} AS precision, {q6_sql('tp / (tp + fn)::DOUBLE')} AS recall, {q6_sql("(SELECT avg(abs(predicted - actual)) FROM m)")} AS mae FROM c"""
)
def backtest_report(spark, sf):
    """The back-test's report: predictions from customers, what happened from orders."""
    from riskloom.operators import backtest

    c, k = P.table(spark, sf, "customer"), F.col("c_custkey")
    predicted = c.select(k.alias("vuln_id"), F.lit("a").alias("asset_id"), F.least(F.lit(1.0), F.abs("c_acctbal") / 10000).alias("exploit_likelihood"), (k % 10).cast("double").alias("adjusted_impact"), k.alias("final_rank"), F.array(*[F.lit(0.0)] * 5, F.lit(1.0)).alias("markov_distribution"))
    o = P.table(spark, sf, "orders").where("o_custkey % 3 > 0").groupBy(F.col("o_custkey").alias("vuln_id"))
    happened = o.agg(F.bool_or(F.col("o_orderstatus") == "F").alias("was_exploited"), F.max(F.col("o_orderkey") % 9).cast("double").alias("actual_impact")).withColumns({"asset_id": F.lit("a"), "actual_state": F.lit(5)})
    r = backtest.report(predicted, happened)
    return r.select("pairs", *[q6(F.col(x)).alias(x) for x in ("precision", "recall", "mae")])
