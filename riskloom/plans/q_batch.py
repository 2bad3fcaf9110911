"""Queries of the batch: inference, Markov cycle, aggregation, ranks, roll-up, feedback, details and lookups (O*, M11, L5, R7, J14, J15, W11)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from riskloom.functions.lineage import new_folder
from riskloom.functions.scalar import d, q6
from riskloom.operators import freshness as Fr
from riskloom.operators import commits, ml, rank
from riskloom.operators import service as S
from riskloom.plans import batch as B
from riskloom.plans import projection as P
from riskloom.plans import q_markov as Q
from riskloom.plans.projection import q6_sql
from riskloom.plans.q_graph import WITH_TOPOLOGY
from riskloom.plans.registry import query

AGE = 30.0  # days since the models were trained
FRESH = 0.8


def estate(spark, sf) -> B.Estate:
    intel = P.intel_nodes(spark, sf)
    edges = intel.select(F.col("vuln_id").alias("src"), F.col("node_id").alias("dst"))
    exploits = intel.where("node_type = 'Indicator'").select("vuln_id", F.col("modified_ts").alias("published_ts"))
    return B.Estate(P.vulns(spark, sf), P.assets(spark, sf), P.pairs(spark, sf).select("vuln_id", "asset_id"), P.connects(spark, sf), exploits, edges, intel, P.ref())


# ---------------------------------------------------------------- SQL: the batch by the rules, its two passes unrolled

_DEGRADED = lambda raw: f"greatest(0.05::DOUBLE, least(1, {raw} * {FRESH}::DOUBLE * greatest(0.05::DOUBLE, exp(-ln(2::DOUBLE) / 90 * {AGE}))))"
PRED = f"""elp AS (SELECT vuln_id, cvss, greatest(0, least(1, 0.5::DOUBLE * (cvss / 10) + CASE WHEN has_public_exploit THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN is_in_kev THEN 0.30::DOUBLE ELSE 0 END)) AS elp FROM vuln),
 pred AS (SELECT p.vuln_id, p.asset_id, {_DEGRADED('elp')} AS exploit, cvss AS impact, CASE WHEN cvss >= 9 THEN 1.0::DOUBLE WHEN cvss >= 7 THEN 0.75::DOUBLE WHEN cvss >= 4 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS crit FROM pair p JOIN elp USING (vuln_id)),
 state AS (SELECT *, 1.0::DOUBLE AS s0, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0.0::DOUBLE AS s3, 0.0::DOUBLE AS s4, 0.0::DOUBLE AS s5 FROM pred)"""
_CELL = {(i, j): Q._NORM(i, j) if i in (1, 2) else f"p{i}{j}" for i in range(6) for j in Q._ROWS[i]}
_S = ", ".join(f"s{i}" for i in range(6))
_PS = ", ".join(f"p{i}{j}" for i in range(6) for j in Q._ROWS[i])
PASSES = f"""WITH RECURSIVE {P.VULN}, {P.ASSET}, {P.PAIR}, {P.CONNECT}, {PRED}, {Q.RAW}, {Q.TPM},
 st1 AS (SELECT vuln_id, asset_id, {Q._step_sql()} FROM tpm),
 pressure AS (SELECT a.vuln_id, a.asset_id, avg(o.s2 + o.s3) AS pressure FROM st1 a JOIN connect c ON c.src = a.asset_id JOIN st1 o ON o.vuln_id = a.vuln_id AND o.asset_id = c.dst GROUP BY ALL),
 tc AS (SELECT t.vuln_id, t.asset_id, exploit, impact, crit, {", ".join(f"{e} AS c{i}{j}" for (i, j), e in _CELL.items())}, {", ".join(f"st1.s{i}" for i in range(6))}
  FROM tpm t JOIN st1 USING (vuln_id, asset_id) LEFT JOIN pressure USING (vuln_id, asset_id)),
 st2 AS (SELECT vuln_id, asset_id, exploit, impact, crit, {", ".join(f"c{i}{j} AS p{i}{j}" for i, j in _CELL)}, {Q._step_sql(matrix="c")} FROM tc)"""
_ABSORB = Q.STEPS.split("solved AS", 1)[1].replace("FROM tpm)", "FROM st2)", 1)
CYCLE = f"{PASSES}, solved AS{_ABSORB}"
_DOMINANT = "list_position([s0, s1, s2, s3, s4, s5], list_max([s0, s1, s2, s3, s4, s5])) - 1"
_TIME = "(s0 * t0 + s1 * t1 + s2 * t2 + s3 * t3 + s4 * t4) / (s0 + s1 + s2 + s3 + s4)"


def _run(spark, sf):
    return B.daily_batch(estate(spark, sf), d(FRESH), d(AGE))


def _cycles(spark, sf):
    x = estate(spark, sf)
    return B.passes(lambda s: B.feature_rows(x, s), B.rule_inference(d(FRESH), d(AGE)), x.connects, x.vulns, None, 2, 0.0)


@query(
    f"""{CYCLE} SELECT vuln_id, asset_id, {", ".join(f"{q6_sql(f's{i}')} AS s{i}" for i in range(6))}, {_DOMINANT} AS dominant_state, {q6_sql(_TIME)} AS absorption_time,
 CASE {_DOMINANT} WHEN 4 THEN 14.0::DOUBLE WHEN 5 THEN 3.0::DOUBLE END AS half_life FROM s0_"""
)
def markov_cycle(spark, sf):
    """States after two cycles: start, matrix, coupling, one step, absorption time, half-life."""
    now = _cycles(spark, sf)[1]
    return now.select("vuln_id", "asset_id", *[q6(F.col(f"s{i}")).alias(f"s{i}") for i in range(6)], "dominant_state", q6(F.col("absorption_time")).alias("absorption_time"), "half_life")


@query(f"{PASSES}, m AS (SELECT max({' + '.join(f'abs(a.s{i} - b.s{i})' for i in range(6))}) AS delta FROM st1 a JOIN st2 b USING (vuln_id, asset_id)) SELECT 1 AS iteration, NULL::DOUBLE AS delta, false AS converged UNION ALL SELECT 2, {q6_sql('delta')}, delta < 0.01 FROM m")
def feedback_convergence(spark, sf):
    x = estate(spark, sf)
    _, _, log = B.feedback_loop(x, B.rule_inference(d(FRESH), d(AGE)))
    return spark.createDataFrame(log, "iteration int, delta double, converged boolean").withColumn("delta", q6(F.col("delta")))


_COMP = f"""comp AS (SELECT *, {q6_sql('greatest(0, least(1, 0.30::DOUBLE * exploit + 0.25::DOUBLE * (impact / 10) + 0.25::DOUBLE * (s2 + s3) + 0.20::DOUBLE * crit))')} AS composite_risk, {_TIME} AS absorption_time FROM s0_)"""
_URG = "composite_risk * CASE WHEN is_in_kev THEN 1.5::DOUBLE ELSE 1 END * CASE WHEN has_public_exploit THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN exploit_velocity_days >= 0 THEN greatest(1::DOUBLE, 2 - exploit_velocity_days / 30.0::DOUBLE) ELSE 1 END"
_T = {"composite_risk": 0.35, "exploit": 0.25, "impact": 0.25}
#: With one cost for all a Pareto layer is a distinct risk; every rank breaks the next one's ties.
RANKED = f"""{_COMP}, it AS (SELECT c.vuln_id, c.asset_id, c.vuln_id || '::' || c.asset_id AS k, composite_risk, exploit, impact, is_in_kev, has_public_exploit, exploit_velocity_days FROM comp c JOIN vuln USING (vuln_id)),
 nm AS (SELECT {", ".join(f"sqrt(sum({x} * {x})) AS n_{x}" for x in _T)} FROM it), sc AS (SELECT it.*, {", ".join(f"{x} / n_{x} * {w}::DOUBLE AS v_{x}" for x, w in _T.items())} FROM it, nm),
 ex AS (SELECT {", ".join(f"max(v_{x}) AS hi_{x}, min(v_{x}) AS lo_{x}" for x in _T)} FROM sc),
 ds AS (SELECT *, sqrt({" + ".join(f"pow(v_{x} - hi_{x}, 2)" for x in _T)}) AS far, sqrt({" + ".join(f"pow(v_{x} - lo_{x}, 2)" for x in _T)}) AS near FROM sc, ex),
 cr AS (SELECT *, floor(({_URG}) * 1e9 + 0.5) AS urgency, floor(near / (far + near + 1e-12) * 1e9 + 0.5) AS closeness FROM ds),
 r1 AS (SELECT *, row_number() OVER (ORDER BY composite_risk DESC, k) AS pareto_rank FROM cr),
 r2 AS (SELECT *, row_number() OVER (ORDER BY floor(composite_risk * 1e9 + 0.5) DESC, pareto_rank) AS cost_benefit_rank FROM r1),
 r3 AS (SELECT *, row_number() OVER (ORDER BY urgency DESC, cost_benefit_rank) AS time_rank FROM r2),
 r4 AS (SELECT *, row_number() OVER (ORDER BY closeness DESC, time_rank) AS topsis_rank FROM r3),
 ranked AS (SELECT *, row_number() OVER (ORDER BY (pareto_rank + cost_benefit_rank + time_rank + topsis_rank) / 4.0::DOUBLE, topsis_rank) AS final_rank FROM r4)"""
_RANK_COLS = ["pareto_rank", "cost_benefit_rank", "time_rank", "topsis_rank", "final_rank"]
HOPS = """reach AS (SELECT dst AS asset_id, src AS upstream, 1 AS hop FROM connect UNION ALL SELECT r.asset_id, c.src, hop + 1 FROM reach r JOIN connect c ON c.dst = r.upstream WHERE hop < 4),
 hops AS (SELECT asset_id, upstream, min(hop) AS hop FROM reach WHERE asset_id <> upstream GROUP BY ALL)"""
PROP = f"""{HOPS}, direct AS (SELECT asset_id, sum(composite_risk) AS direct_risk, sum(composite_risk * (s2 + s3)) AS weighted FROM comp GROUP BY asset_id),
 inflow AS (SELECT h.asset_id, sum(weighted * pow(0.7::DOUBLE, hop)) AS inflow FROM hops h JOIN direct d ON d.asset_id = h.upstream GROUP BY h.asset_id),
 prop AS (SELECT asset_id, coalesce(direct_risk, 0) + coalesce(inflow, 0) AS propagated_risk FROM direct FULL JOIN inflow USING (asset_id))"""
_RISK_SQL = Q._RISK_SQL
WALK = f"""walk AS (SELECT t.vuln_id, t.asset_id, {", ".join(f"t.p{i}{j}" for i in range(6) for j in Q._ROWS[i])}, {", ".join(f"b.s{i}" for i in range(6))}, 0 AS n FROM tpm t JOIN st2 b USING (vuln_id, asset_id)
 UNION ALL SELECT vuln_id, asset_id, {_PS}, {Q._step_sql()}, n + 1 FROM walk WHERE n < 90),
 fore AS (SELECT vuln_id, asset_id, {", ".join(f"max(CASE WHEN n = {h} THEN {_RISK_SQL} END) AS risk_{h}" for h in (1, 7, 14, 30, 90))} FROM walk GROUP BY ALL)"""


@query(
    f"""{CYCLE}, {RANKED}, {PROP}, {WALK} SELECT c.vuln_id, c.asset_id, c.composite_risk, {q6_sql('propagated_risk')} AS propagated_risk, {q6_sql('risk_7')} AS risk_7, {q6_sql('risk_30')} AS risk_30, {q6_sql('risk_90')} AS risk_90,
 {q6_sql('absorption_time')} AS absorption_time, {", ".join(_RANK_COLS)} FROM comp c JOIN ranked USING (vuln_id, asset_id) JOIN prop ON prop.asset_id = c.asset_id JOIN fore USING (vuln_id, asset_id)"""
)
def daily_batch(spark, sf):
    r, _ = _run(spark, sf)
    return r.select("vuln_id", "asset_id", "composite_risk", *[q6(F.col(c)).alias(c) for c in ("propagated_risk", "risk_7", "risk_30", "risk_90", "absorption_time")], *[F.col(c).cast("long").alias(c) for c in _RANK_COLS])


_WEIGHT = "CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query(f"{CYCLE}, {_COMP}, {PROP} SELECT a.bu, {q6_sql('sum(propagated_risk)')} AS total_risk, {q6_sql(f'sum({_WEIGHT} * propagated_risk)')} AS weighted_risk, count(*) AS asset_count, {q6_sql('max(propagated_risk)')} AS max_risk FROM prop JOIN asset a USING (asset_id) GROUP BY a.bu")
def batch_rollup(spark, sf):
    """The batch's roll-up, read back from where the batch saved it."""
    folder = new_folder(spark, "batch")
    B.daily_batch(estate(spark, sf), d(FRESH), d(AGE), folder=folder)
    u = commits.read(spark, folder, "rollup")
    return u.select("bu", q6(F.col("total_risk")).alias("total_risk"), q6(F.col("weighted_risk")).alias("weighted_risk"), "asset_count", q6(F.col("max_risk")).alias("max_risk"))


@query(f"{CYCLE}, {RANKED} SELECT vuln_id, asset_id, composite_risk, final_rank FROM ranked WHERE final_rank <= 100")
def prioritization_list(spark, sf):
    """A top-k report: the first hundred of the batch's final ranking."""
    r, _ = _run(spark, sf)
    return S.prioritised(r, 100).select("vuln_id", "asset_id", "composite_risk", F.col("final_rank").cast("long").alias("final_rank"))


@query(
    f"""{PASSES.replace('FROM pair p JOIN elp USING (vuln_id))', 'FROM pair p JOIN elp USING (vuln_id) WHERE p.vuln_id = (SELECT min(vuln_id) FROM pair) AND p.asset_id = (SELECT min(asset_id) FROM pair WHERE vuln_id = (SELECT min(vuln_id) FROM pair)))')}
 SELECT t.vuln_id, t.asset_id, {q6_sql('t.exploit')} AS exploit_likelihood, t.impact AS adjusted_impact, {q6_sql('greatest(0, least(1, 0.30::DOUBLE * t.exploit + 0.25::DOUBLE * (t.impact / 10) + 0.25::DOUBLE * (st1.s2 + st1.s3) + 0.20::DOUBLE * t.crit))')} AS composite_risk FROM tpm t JOIN st1 USING (vuln_id, asset_id)"""
)
def on_demand(spark, sf):
    """One pair, the first, in one pass without stored states."""
    x = estate(spark, sf)
    first = x.pairs.orderBy("vuln_id", "asset_id").first()
    r = B.assess(x, first.vuln_id, first.asset_id, d(FRESH), d(AGE))
    return r.select("vuln_id", "asset_id", q6(F.col("exploit")).alias("exploit_likelihood"), F.col("impact").alias("adjusted_impact"), q6(F.col("composite_risk")).alias("composite_risk"))


# ---------------------------------------------------------------- criticality by distribution, details, lookups


@query("SELECT p_partkey AS vuln_id, CASE WHEN p_partkey % 5 = 0 THEN 0.4::DOUBLE ELSE 0.7::DOUBLE * ['0.25', '0.5', '0.75', '1.0'][p_partkey % 4 + 1]::DOUBLE + 0.3::DOUBLE END AS crit FROM part")
def criticality_of_distribution(spark, sf):
    from riskloom.operators.risk import criticality_of_distribution as of

    k = F.col("p_partkey")
    tier = F.element_at(F.array(*[F.lit(x) for x in ml.TIERS]), (k % 4 + 1).cast("int"))
    dist = F.when(k % 5 > 0, F.when(tier == "critical", F.create_map(tier, d(1.0))).otherwise(F.create_map(tier, d(0.7), F.lit("critical"), d(0.3))))
    return P.table(spark, sf, "part").select(k.alias("vuln_id"), of(dist, d(0.4)).alias("crit"))


@query("WITH l AS (SELECT l_suppkey AS asset_id, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey AS asset_id, s_name AS hostname, coalesce(n, 0) AS linked_count FROM supplier LEFT JOIN l ON asset_id = s_suppkey")
def asset_detail(spark, sf):
    edges = P.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("asset_id"), F.col("l_partkey").alias("vuln_id"))
    return S.detail(P.assets(spark, sf).select("asset_id", "hostname"), edges, "asset_id", "vuln_id").select("asset_id", "hostname", F.col("linked_count").cast("long").alias("linked_count"))


@query(f"{Q.WITH_TPM.replace('WITH ', 'WITH RECURSIVE ', 1)}, {Q._walk(30)} SELECT k AS horizon_days, {q6_sql(_RISK_SQL)} AS risk_score FROM walk WHERE k IN (1, 7, 14, 30) AND vuln_id || '::' || asset_id = (SELECT min(vuln_id || '::' || asset_id) FROM pair)")
def forecast_lookup(spark, sf):
    """The points of one pair's forecast, by its key."""
    from riskloom.operators import markov as M

    df = M.modulated(P.with_state(P.with_criticality(P.pairs(spark, sf), spark, sf)), "exploit", "impact", "crit")
    key = df.agg(F.min(F.concat_ws("::", "vuln_id", "asset_id"))).first()[0]
    one = df.where(F.concat_ws("::", "vuln_id", "asset_id") == key)  # only this pair is forecast
    return S.forecast_of(M.forecast(one, (1, 7, 14, 30)), key, (1, 7, 14, 30)).select("horizon_days", q6(F.col("risk_score")).alias("risk_score"))


@query("SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS vuln_id, 'h' || o_orderkey % 9 AS asset_id FROM orders WHERE o_orderkey % 3 > 0")
def pair_keys_split(spark, sf):
    """Keys of risk pairs; those without the separator are skipped."""
    k = F.col("o_orderkey")
    keys = P.table(spark, sf, "orders").select(k.alias("id"), F.when(k % 3 > 0, F.concat("o_custkey", F.lit("::h"), k % 9)).otherwise(F.concat(F.lit("h"), k)).alias("pair_key"))
    return S.split_pairs(keys)


@query(f"{P.WITH_PAIR} SELECT count(*) AS total_pairs, {q6_sql('avg(risk)')} AS mean_risk, max(risk) AS max_risk, {q6_sql('quantile_cont(risk, 0.5)')} AS median_risk, {q6_sql('quantile_cont(risk, 0.95)')} AS p95_risk, 0.75::DOUBLE AS overall_freshness FROM risk")
def risk_overview(spark, sf):
    """The summary with exact percentiles by rank, and the data's freshness."""
    fresh = spark.range(1).select(d(0.75).alias("overall_freshness"))
    s = S.summary(P.risks(spark, sf), "risk", fresh)
    return s.select("total_pairs", q6(F.col("mean_risk")).alias("mean_risk"), "max_risk", q6(F.col("median_risk")).alias("median_risk"), q6(F.col("p95_risk")).alias("p95_risk"), "overall_freshness")


@query(f"{P.WITH_PAIR}, {P.VULN}, t AS (SELECT vuln_id, max(risk) AS risk FROM risk GROUP BY vuln_id) SELECT (SELECT count(*) FROM vuln) AS total, count(*) AS shown FROM (SELECT * FROM vuln LIMIT 50)")
def list_totals(spark, sf):
    """A page with the total of the list."""
    total, page = S.page(P.vulns(spark, sf).select("vuln_id", "cvss"), P.risks(spark, sf), "vuln_id", limit=50)
    return total.crossJoin(page.agg(F.count(F.lit(1)).alias("shown")))


@query("SELECT event_type, arg_max(user_id, event_id) AS user_id FROM events GROUP BY event_type")
def service_cache(spark, sf):
    """Views that a batch puts in place of the ones before: the second set is what is read."""
    e = P.table(spark, sf, "events")
    S.update_caches({"risks": e.where("false")})
    S.update_caches({"risks": e.groupBy("event_type").agg(F.max_by("user_id", "event_id").alias("user_id"))})
    return S.cached(spark, "risks")


# ---------------------------------------------------------------- graph selection by fields


@query(f"{P.WITH_PAIR} SELECT vuln_id, asset_id, risk AS composite_risk FROM risk WHERE risk >= 0.5 ORDER BY risk DESC, vuln_id, asset_id LIMIT 40")
def selected_fields(spark, sf):
    """A query of the graph-style surface: chosen fields of one entity, a page."""
    r = P.risks(spark, sf).withColumn("composite_risk", F.col("risk"))
    return S.select_fields({"risk_pairs": lambda limit, min_risk: S.risk_pairs(r, min_risk, limit)}, "risk_pairs", ["vuln_id", "asset_id", "composite_risk"], limit=40, min_risk=0.5)


# ---------------------------------------------------------------- registry


@query("SELECT 'm' || o_custkey % 5 AS model, CAST(o_orderkey AS VARCHAR) AS version, 'staged' AS status FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'm' || o_custkey % 5, CAST(o_orderkey AS VARCHAR), 'production' FROM orders WHERE o_orderkey % 2 = 1")
def register_models(spark, sf):
    from riskloom.operators import store

    r = P.table(spark, sf, "orders").select(F.concat(F.lit("m"), F.col("o_custkey") % 5).alias("model"), F.col("o_orderkey").cast("string").alias("version"), F.lit("production").alias("status"), "o_orderkey")
    old, new = r.where("o_orderkey % 2 = 1").drop("o_orderkey"), r.where("o_orderkey % 2 = 0").drop("o_orderkey", "status")
    return store.register(old, new)


@query("SELECT o_orderkey AS version FROM orders WHERE o_custkey % 5 = 1")
def list_versions(spark, sf):
    from riskloom.operators import store

    r = P.table(spark, sf, "orders").select((F.col("o_custkey") % 5).cast("string").alias("model"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("trained_at"))
    return store.version_list(r, "1").select("version")


_BUCKET = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256(CAST(k AS VARCHAR)), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT))), lambda a, x: (a * 16 + x) % 10000)"


@query(
    f"""WITH t(model, version_a, version_b, share_a, started_at, ended_at) AS (VALUES ('elp', '1', '2', 0.5, TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01'), ('elp', '2', '3', 0.1, TIMESTAMP '1998-01-01', TIMESTAMP '2000-01-01'), ('isa', '1', '4', 0.5, TIMESTAMP '1997-01-05', NULL)),
 b AS (SELECT k, {_BUCKET} AS bucket FROM (SELECT DISTINCT o_custkey AS k FROM orders)), u AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'elp' ELSE 'isa' END AS model, o_custkey AS k, CAST(o_orderdate AS TIMESTAMP) AS used FROM orders)
 SELECT model, CASE WHEN bucket / 10000.0 < share_a THEN version_a ELSE version_b END AS version, started_at, ended_at, count(*) AS uses, count(DISTINCT k) AS customers FROM u JOIN t USING (model) JOIN b USING (k) WHERE used >= started_at AND (ended_at IS NULL OR used < ended_at) GROUP BY ALL"""
)
def ab_tests(spark, sf):
    """Tests that follow each other, and the orders that fall into them as uses of a model's versions."""
    from riskloom.operators import store

    t = spark.createDataFrame([], store.TABLES["ab_tests"])
    t = store.start_ab_test(t, "elp", "1", "2", 0.5, "1996-01-01 00:00:00")
    t = store.start_ab_test(t, "isa", "1", "4", 0.5, "1997-01-05 00:00:00")
    t = store.start_ab_test(t, "elp", "2", "3", 0.1, "1998-01-01 00:00:00")
    t = store.end_ab_test(t, "elp", "2000-01-01 00:00:00").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")})
    uses = P.table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "elp").otherwise("isa").alias("model"), "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    seen = store.exposures(t, uses, "o_custkey", "at")
    return seen.groupBy("model", "version", "started_at", "ended_at").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS customer, o_orderstatus AS status FROM orders")
def json_payloads(spark, sf):
    """Columns to JSON and back."""
    from riskloom.operators import store

    o = P.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("customer"), F.col("o_orderstatus").alias("status"))
    return store.of_json(store.as_json(o, ["o_orderkey"]), ["o_orderkey"], "customer long, status string")


@query("WITH c AS (SELECT DISTINCT 'c' || strftime(o_orderdate, '%Y%m') AS cycle_id FROM orders) SELECT greatest(count(*) - 30, 0) AS removed_cycles, least(count(*), 30) AS kept_cycles FROM c")
def prune_stored_cycles(spark, sf):
    """Cycles written as partitions, older ones deleted as folders."""
    from riskloom.operators import store

    path = new_folder(spark, "features")
    f = P.table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("c"), F.date_format("o_orderdate", "yyyyMM")).alias("cycle_id"))
    f.repartition("cycle_id").write.partitionBy("cycle_id").parquet(path)
    removed = store.prune_files(spark, path, 30)
    kept = spark.read.parquet(path).agg(F.countDistinct("cycle_id").alias("kept_cycles"))
    return kept.select(F.lit(removed).cast("long").alias("removed_cycles"), "kept_cycles")


# ---------------------------------------------------------------- topology as a bundle


@query(f"{WITH_TOPOLOGY}")
def topological_features(spark, sf):
    from riskloom.operators import graph as G

    x = estate(spark, sf)
    starts = P.table(spark, sf, "part").select(F.col("p_partkey").alias("vuln_id"), (F.col("p_partkey") * 3 % 100).alias("node"))
    edges = x.pairs.select(F.concat(F.lit("v"), "vuln_id").alias("src"), F.concat(F.lit("a"), "asset_id").alias("dst")).unionAll(x.connects.select(F.concat(F.lit("a"), "src").alias("src"), F.concat(F.lit("a"), "dst").alias("dst")))
    t = G.topological(x.pairs, x.connects, x.assets, starts, edges, F.concat(F.lit("v"), "vuln_id"))
    return t.select("vuln_id", "asset_id", "asset_degree", "vuln_reach", "attack_path_depth", q6(F.col("network_exposure_score")).alias("network_exposure_score"), q6(F.col("vuln_clustering")).alias("vuln_clustering"), "connected_critical_assets")
