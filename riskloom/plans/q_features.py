"""Queries of the feature families and their assembly (F-date3, A17, B*, J7, J8, W2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.scalar import q6
from riskloom.operators import features as E
from riskloom.operators import graph as G
from riskloom.operators import markov as M
from riskloom.plans import projection as P
from riskloom.plans.projection import q6_sql
from riskloom.plans.registry import query

_DAYS = lambda a, b: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN -1 ELSE greatest(0, date_diff('microsecond', {a}, {b}) / 86400e6) END"
_REF = f"TIMESTAMP '{P.REF}'"
TEMPORAL = f"""ex AS (SELECT vuln_id, min(modified_ts) AS first FROM intel WHERE node_type = 'Indicator' GROUP BY vuln_id),
 temporal AS (SELECT p.vuln_id, p.asset_id, {_DAYS("published_ts", _REF)} AS days_since_disclosure, {_DAYS("first", _REF)} AS days_since_exploit_published, {_DAYS("published_ts", "first")} AS exploit_velocity,
  {_DAYS("patch_ts", _REF)} AS days_since_patch_available, {_DAYS("published_ts", "patch_ts")} AS patch_lag, {_DAYS("last_scan_ts", _REF)} AS days_since_last_scan
  FROM pair p JOIN vuln v ON v.vuln_id = p.vuln_id LEFT JOIN ex ON ex.vuln_id = p.vuln_id LEFT JOIN asset a ON a.asset_id = p.asset_id)"""
TEMPORAL_COLS = ["days_since_disclosure", "days_since_exploit_published", "exploit_velocity", "days_since_patch_available", "patch_lag", "days_since_last_scan"]
BASE = f"WITH {P.VULN}, {P.ASSET}, {P.PAIR}, {P.INTEL}"


def _temporal(spark, sf):
    ex = P.intel_nodes(spark, sf).where("node_type = 'Indicator'").select("vuln_id", F.col("modified_ts").alias("published_ts"))
    return E.temporal(P.pairs(spark, sf), P.vulns(spark, sf), P.assets(spark, sf), ex, P.ref())


@query(f"{BASE}, {TEMPORAL} SELECT vuln_id, asset_id, {', '.join(f'{q6_sql(c)} AS {c}' for c in TEMPORAL_COLS)} FROM temporal")
def temporal_features(spark, sf):
    return _temporal(spark, sf).select("vuln_id", "asset_id", *[q6(F.col(c)).alias(c) for c in TEMPORAL_COLS])


INTEL_COLS = ["has_public_exploit", "exploit_maturity_score", "is_in_kev", "threat_actor_interest", "campaign_count", "ioc_count", "ttp_count", "intel_freshness_days"]
_N = lambda t: f"coalesce(count(DISTINCT i.node_id) FILTER (i.node_type = '{t}'), 0)::DOUBLE"
THREAT = f"""threat AS (SELECT v.vuln_id, CASE WHEN any_value(has_public_exploit) THEN 1.0::DOUBLE ELSE 0 END AS has_public_exploit,
 CASE lower(any_value(exploit_maturity)) WHEN 'unproven' THEN 0.1::DOUBLE WHEN 'poc' THEN 0.3::DOUBLE WHEN 'functional' THEN 0.6::DOUBLE WHEN 'weaponized' THEN 0.9::DOUBLE WHEN 'high' THEN 0.8::DOUBLE ELSE 0 END AS exploit_maturity_score,
 CASE WHEN any_value(is_in_kev) THEN 1.0::DOUBLE ELSE 0 END AS is_in_kev, {_N("ThreatActor")} AS threat_actor_interest, {_N("Campaign")} AS campaign_count, {_N("Indicator")} AS ioc_count, {_N("TTP")} AS ttp_count,
 {_DAYS("max(modified_ts)", _REF)} AS intel_freshness_days FROM vuln v LEFT JOIN intel i ON i.vuln_id = v.vuln_id GROUP BY v.vuln_id)"""


def _threat(spark, sf):
    nodes = P.intel_nodes(spark, sf)
    edges = nodes.select(F.col("vuln_id").cast("string").alias("src"), F.col("node_id").alias("dst"))
    edges = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))  # repeated the other way: neighbours are distinct
    v = P.vulns(spark, sf).withColumn("vuln_id", F.col("vuln_id").cast("string"))
    return E.threat_intel(v, edges, nodes, P.ref()).withColumn("vuln_id", F.col("vuln_id").cast("long"))


@query(f"{BASE}, {THREAT} SELECT vuln_id, {', '.join(f'{q6_sql(c)} AS {c}' for c in INTEL_COLS)} FROM threat")
def threat_intel_features(spark, sf):
    return _threat(spark, sf).select("vuln_id", *[q6(F.col(c)).alias(c) for c in INTEL_COLS])


SIBLINGS = """sib AS (SELECT v.vuln_id, count(*)::DOUBLE AS sibling_vuln_count, avg(CASE WHEN o.is_in_kev OR o.has_public_exploit THEN 1.0 ELSE 0 END) AS historical_exploit_rate FROM vuln v JOIN vuln o ON list_has_any(v.cwe_ids, o.cwe_ids) GROUP BY v.vuln_id)"""


@query(f"WITH {P.VULN}, {SIBLINGS} SELECT vuln_id, sibling_vuln_count, {q6_sql('historical_exploit_rate')} AS historical_exploit_rate FROM sib")
def cwe_siblings(spark, sf):
    v = P.vulns(spark, sf).withColumn("exploited", F.col("is_in_kev") | F.col("has_public_exploit"))
    return E.weakness_siblings(v).select("vuln_id", "sibling_vuln_count", q6(F.col("historical_exploit_rate")).alias("historical_exploit_rate"))


RATE = "rate AS (SELECT vuln_id, coalesce(avg(CASE WHEN patch_lag_days >= 0 THEN patch_lag_days END) OVER (PARTITION BY lower(vendor)), -1) AS vendor_patch_rate FROM vuln)"


@query(f"WITH {P.VULN}, {RATE} SELECT vuln_id, {q6_sql('vendor_patch_rate')} AS vendor_patch_rate FROM rate")
def vendor_patch_rate(spark, sf):
    return E.vendor_patch_rate(P.vulns(spark, sf)).select("vuln_id", q6(F.col("vendor_patch_rate")).alias("vendor_patch_rate"))


HIST_COLS = ["cvss_base_score", "cvss_exploitability", "cvss_impact", "epss_score_estimate", "sibling_vuln_count", "historical_exploit_rate", "vendor_patch_rate"]
HIST = f"""{SIBLINGS}, {RATE}, hist AS (SELECT v.vuln_id, cvss AS cvss_base_score, cvss_exploitability, cvss_impact, greatest(0, least(1, 0.5::DOUBLE * (cvss / 10) + CASE WHEN has_public_exploit THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN is_in_kev THEN 0.30::DOUBLE ELSE 0 END)) AS epss_score_estimate,
 sibling_vuln_count, historical_exploit_rate, vendor_patch_rate FROM vuln v JOIN sib USING (vuln_id) JOIN rate USING (vuln_id))"""


@query(f"WITH {P.VULN}, {HIST} SELECT vuln_id, {', '.join(f'{q6_sql(c)} AS {c}' for c in HIST_COLS)} FROM hist")
def historical_features(spark, sf):
    return E.historical(P.vulns(spark, sf)).select("vuln_id", *[q6(F.col(c)).alias(c) for c in HIST_COLS])


@query(
    f"""WITH {P.HISTORY}, h AS (SELECT key, mass, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS n FROM history QUALIFY n <= 3), p AS (SELECT key, -n::DOUBLE AS x, mass AS y, 0 AS cur FROM h UNION ALL SELECT c_custkey, 0, abs(c_acctbal) / 10000, 1 FROM customer)
 SELECT key, {q6_sql('CASE WHEN count(*) - sum(cur) >= 2 THEN coalesce(regr_slope(y, x), 0) ELSE 0 END')} AS risk_trajectory_slope FROM p GROUP BY key HAVING sum(cur) > 0"""
)
def trajectory_slope(spark, sf):
    cur = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.abs("c_acctbal") / 10000).alias("mass"))
    return E.trajectory_slope(P.history(spark, sf), cur, ["key"], ["ts", "event_id"], "mass").select("key", q6(F.col("risk_trajectory_slope")).alias("risk_trajectory_slope"))


FEEDBACK_COLS = [f"state_prob_{i}" for i in range(6)] + ["entropy", "time_in_current_state", "expected_absorption_time", "dominant_state", "risk_trajectory_slope"]
_HAS = "vuln_id % 10 < 7"


def _feedback(spark, sf):
    st = P.with_state(P.with_criticality(P.pairs(spark, sf), spark, sf))
    stored = st.where(_HAS).select("vuln_id", "asset_id", F.array(*M.PI).alias("distribution"), M.entropy_of().alias("entropy"), (F.col("asset_id") % 5).alias("updates_in_state"), (F.col("vuln_id") % 9).cast("double").alias("absorption_time"))
    return E.markov_feedback(st.select("vuln_id", "asset_id"), stored)


_S = ", ".join(f"{q6_sql(f'CASE WHEN {_HAS} THEN s{i} ELSE 0 END')} AS state_prob_{i}" for i in range(6))


@query(
    f"""WITH {P.ASSET}, {P.PAIR}, {P.SIGNAL}, {P.STATE} SELECT vuln_id, asset_id, {_S}, {q6_sql(f"CASE WHEN {_HAS} THEN -({' + '.join(f's{i} * ln(s{i})' for i in range(6))}) ELSE 0 END")} AS entropy,
 CASE WHEN {_HAS} THEN (asset_id % 5)::DOUBLE ELSE 0 END AS time_in_current_state, CASE WHEN {_HAS} THEN (vuln_id % 9)::DOUBLE ELSE -1 END AS expected_absorption_time,
 CASE WHEN {_HAS} THEN (list_position([s0, s1, s2, s3, s4, s5], list_max([s0, s1, s2, s3, s4, s5])) - 1)::DOUBLE ELSE 0 END AS dominant_state, 0.0::DOUBLE AS risk_trajectory_slope FROM state"""
)
def markov_feedback(spark, sf):
    f = _feedback(spark, sf)
    return f.select("vuln_id", "asset_id", *[q6(F.col(c)).alias(c) if c.startswith(("state_prob", "entropy")) else F.col(c) for c in FEEDBACK_COLS])


@query(
    f"""{BASE}, {TEMPORAL}, {THREAT}, {HIST}, {P.CONNECT}, deg AS (SELECT src AS asset_id, count(*)::DOUBLE AS asset_degree FROM connect GROUP BY src), reach AS (SELECT vuln_id, count(*)::DOUBLE AS vuln_reach FROM pair GROUP BY vuln_id)
 SELECT p.vuln_id, p.asset_id, {q6_sql('t.days_since_disclosure')} AS days_since_disclosure, {q6_sql('x.intel_freshness_days')} AS intel_freshness_days, {q6_sql('h.epss_score_estimate')} AS epss_score_estimate, h.sibling_vuln_count, coalesce(deg.asset_degree, 0) AS asset_degree, r.vuln_reach
 FROM pair p JOIN temporal t USING (vuln_id, asset_id) JOIN threat x USING (vuln_id) JOIN hist h USING (vuln_id) LEFT JOIN deg USING (asset_id) JOIN reach r USING (vuln_id)"""
)
def feature_assembly(spark, sf):
    pairs = P.pairs(spark, sf)
    degree = G.degrees(P.connects(spark, sf)).select(F.col("node").alias("asset_id"), F.col("degree").alias("asset_degree"))
    reach = pairs.groupBy("vuln_id").agg(F.count(F.lit(1)).cast("double").alias("vuln_reach"))
    out = E.assemble(pairs, by_pair=[_temporal(spark, sf)], by_vuln=[_threat(spark, sf), E.historical(P.vulns(spark, sf)), reach], by_asset=[degree])
    return out.select("vuln_id", "asset_id", *[q6(F.col(c)).alias(c) for c in ("days_since_disclosure", "intel_freshness_days", "epss_score_estimate")], "sibling_vuln_count", "asset_degree", "vuln_reach")


